"""N-gram Jaccard join: size-banded tiles, hashed bitmaps as upper bounds of overlap, exact sorted-array intersection.

Sets of word shingles (64-bit hashes) link when den * |A and B| >= num * |A or B|. Every link is found:

* Documents of equal sets form a class, linked to its smallest id. Each task gives keys for one document of a class only.
* Tile t holds the sizes of band t (a factor BAND wide) and those just above that can still link into it. In a tile two
  linked sets differ in at most H elements, so of m = H + 1 + e parts of the hash range at least e + 1 hold the same
  elements. A node leaves out its e parts of fewest elements (the same order in both sets, so one equal part stays) and
  gives one key (tile, part, sum of the part's hashes) for each other one. Parts hold several shingles, so a passage or
  word that many documents share does not make keys equal.
* Nodes of equal key are candidates. A node's home is the smallest node of any of its keys (and that one's home, twice),
  so a family of near copies mostly has one home. Homes are cut into blocks bounded in nodes and bytes, and each node is
  sent to its block once, a home's own to each of its blocks. Within a block all pairs of fitting sizes and different
  components are compared, first by bitmaps, which bound their overlap from above; only nodes with a partner that passes
  send their elements, which are intersected exactly. A block gives one edge less than its nodes at most.
* What is left are keys whose nodes are in several blocks and, by now, several components. Each pair of blocks that such
  a key spans is a tile; it gets the nodes of these keys, once each, and is solved like a block. A pair within one
  component needs no test: it changes no component.
* Components come from alternating large-star and small-star steps on stored edge tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import BROADCAST_IDS, Scratch, WordHashes, chunks, mix, shingles, small_batches, tidy, without_ids

BAND = 1.5
#: Bits of a bitmap for each element, least and most (a power of two).
BITS_EACH, BITS = 4, (256, 1 << 16)
#: Nodes and bytes of elements that a block holds at most (on average where a home is cut into blocks by hash).
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Sets of a task that are remembered, so that copies give no keys again; a bound on memory only.
SEEN = 50_000
NONE = np.zeros(0, np.int64)


class Tiles:
    """Bands of set sizes and the parts of each tile, for a threshold of num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den or den / num > BAND:
            raise ValueError(f"the threshold must lie in {1 / BAND:.3f}..1")
        self.num, self.den = num, den
        self.low = [1]

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND)))

    def of(self, size: int) -> list[int]:
        """Tiles of a set of this size: its own band's, and the one below if a set of that band can link with it."""
        self._grow(size)
        t = int(np.searchsorted(self.low, size, side="right")) - 1
        return [t] + [t - 1] * (t > 0 and size * self.num <= (self.low[t] - 1) * self.den)

    def parts(self, tile: int) -> tuple[int, int]:
        """(parts, parts left out); no parts where only equal sets can link."""
        self._grow(self.low[-1] if tile + 1 >= len(self.low) else 1)
        x = self.low[tile + 1] - 1
        h = (x + x * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        return (h + 1 + (spare := h // 3 + 1), spare) if h else (0, 0)

    def keys(self, sets: np.ndarray) -> np.ndarray:
        """Candidate keys of a sorted set."""
        out = []
        mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets))])
        for tile in self.of(len(sets)):
            m, spare = self.parts(tile)
            if not m:
                continue
            edges = np.array([-(-(i << 32) // m) for i in range(m)] + [1 << 32], np.uint64)
            cut = np.searchsorted(sets >> np.uint64(32), edges)
            count = np.diff(cut)
            part = np.argsort(count, kind="stable")[spare:].astype(np.uint64)
            total = (mixed[cut[1:]] - mixed[cut[:-1]])[part.astype(np.int64)]
            out.append(mix(mix(total + np.uint64(tile + 1)) + part * np.uint64(0x9E3779B97F4A7C15) + count[part.astype(np.int64)].astype(np.uint64)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(sets: np.ndarray) -> np.ndarray:
    """A bitmap of the elements' hashes, BITS_EACH bits an element or more, as 64-bit words."""
    width = min(max(BITS[0], 1 << max(BITS_EACH * len(sets) - 1, 1).bit_length()), BITS[1])
    bits = np.zeros(width, np.uint8)
    bits[(mix(sets ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same elements have in fewer bits."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def text_sets(texts: list[bytes], k: int, hashes: WordHashes):
    """The sorted shingle set of each text; A-Z count as a-z."""
    split = [t.lower().split() for t in texts]
    flat = hashes.of([w for ws in split for w in ws])
    at = 0
    for ws in split:
        yield np.unique(shingles(flat[at : at + len(ws)], k))
        at += len(ws)


def _features(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    def run(batches):
        hashes, tiles = WordHashes(1), Tiles(num, den)
        seen: set[tuple[int, int, int]] = set()
        for (ids,), texts in chunks(batches, "text", ["doc_id"]):
            if len(seen) > SEEN:
                seen.clear()
            rows = []
            for d, s in zip(ids, text_sets(texts, k, hashes), strict=True):
                whole = (len(s), *(int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for c in (3, 5)))
                keys = NONE if d is None or whole in seen else tiles.keys(s).view(np.int64)
                if d is not None:
                    seen.add(whole)
                rows.append((*whole, keys))
            size = [len(r[3]) for r in rows]
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate([r[3] for r in rows])))
            cols = [pa.array(c, pa.int64()) for c in (ids, *list(zip(*rows, strict=True))[:3])]
            yield pa.RecordBatch.from_arrays([*cols, keys], names=["doc_id", "n_shingles", "s1", "s2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, node, center) of keys with two or more nodes; center is the smallest. Rows come sorted by key and node."""

    def run(batches):
        last_key = last_node = center = None
        opened = False  # whether the center of the last key has been given
        for b in batches:
            key, node = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            new = np.concatenate([[key[0] != last_key if last_key is not None else True], key[1:] != key[:-1]])
            same = np.concatenate([[not new[0] and node[0] == last_node], (key[1:] == key[:-1]) & (node[1:] == node[:-1])])
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            centers = np.where(start >= 0, node[start], center if center is not None else 0)
            member = ~new & ~same
            rows = [(key[member], node[member], centers[member])]
            first = np.unique(start[member])  # each key's center is a row too, once it has company
            if len(first) and first[0] == -1:
                if not opened:
                    rows.append((key[:1], np.array([center]), np.array([center])))
                opened, first = True, first[1:]
            rows.append((key[first], node[first], node[first]))
            if start[-1] >= 0:
                opened = bool(len(first) and first[-1] == start[-1])
            last_key, last_node, center = key[-1], node[-1], centers[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows, strict=True)], names=["key", "node", "center"])

    return keyed.mapInArrow(run, "key long, node long, center long")


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, size, bits, elements (sorted, packed) of the documents that are nodes."""
    want = nodes.select(F.col("node").alias("_node"))
    picked = docs.select("doc_id", "text").join(_small(want), F.col("doc_id") == F.col("_node"), "left_semi")

    def run(batches):
        hashes = WordHashes(1)
        for (ids,), texts in chunks(batches, "text", ["doc_id"]):
            sets = list(text_sets(texts, k, hashes))
            cols = [
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "size", "bits", "elements"])

    return picked.mapInArrow(tidy(run), "node long, size long, bits binary, elements binary")


def _small(df: DataFrame) -> DataFrame:
    """A stored table of narrow rows, broadcast if it has few of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _least(x, y, num: int, den: int):
    """The least intersection that links sets of sizes x and y."""
    return -(-num * (x + y) // (den + num))


def possible_in(comp: np.ndarray, side: np.ndarray, size: np.ndarray, bits: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets have a partner, on another side (or side is 0 for all) and in another component, that their bitmaps let link."""
    order = np.argsort(size, kind="stable")
    comp, side, size, bits = comp[order], side[order], size[order], [bits[i] for i in order]
    ends = np.searchsorted(size, size * den // num, side="right")
    words = np.array([len(b) for b in bits])
    twice, found = bool(side.any()), np.zeros(len(size), bool)
    for w in np.unique(words).tolist():  # sets that can link have as many bits or twice as many
        mine = np.flatnonzero((words == w) | (words == 2 * w))
        table = np.stack([fold(bits[i], w) for i in mine])
        count = np.bitwise_count(table).sum(1, dtype=np.int64)
        stop = np.searchsorted(mine, ends[mine])
        for k in range(int((words[mine] == w).sum())):
            r, c = mine[k], np.arange(k + 1, stop[k])
            other = mine[c]
            fits = comp[other] != comp[r]
            if twice:
                fits &= side[other] != side[r]
            if found[r]:
                fits &= ~found[other]
            c, other = c[fits], other[fits]
            if not len(c):
                continue
            both = np.bitwise_count(table[c] & table[k]).sum(1, dtype=np.int64)
            most = np.minimum(size[r] - count[k], size[other] - count[c]) + both
            if (hit := other[most >= _least(size[other], size[r], num, den)]).size:
                found[r] = found[hit] = True
    out = np.zeros(len(size), bool)
    out[order] = found
    return out


def links_in(comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of components that links between the sets join, at most one less than there are components.

    comp has the component of each set so far; sets are compared as in possible_in, and no more once they are in one
    component.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    comp, side = comp[order].copy(), side[order]
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.searchsorted(size, size * den // num, side="right")
    bits = [bitmap(s) for s in sets]
    words = np.array([len(b) for b in bits])
    twice, out = bool(side.any()), []
    for w in np.unique(words).tolist():
        mine = np.flatnonzero((words == w) | (words == 2 * w))
        table = np.stack([fold(bits[i], w) for i in mine])
        count = np.bitwise_count(table).sum(1, dtype=np.int64)
        stop = np.searchsorted(mine, ends[mine])
        for k in range(int((words[mine] == w).sum())):
            r, c = mine[k], np.arange(k + 1, stop[k])
            other = mine[c]
            fits = comp[other] != comp[r]
            if twice:
                fits &= side[other] != side[r]
            c, other = c[fits], other[fits]
            if not len(c):
                continue
            both = np.bitwise_count(table[c] & table[k]).sum(1, dtype=np.int64)
            need = _least(size[other], size[r], num, den)
            pick = np.minimum(size[r] - count[k], size[other] - count[c]) + both >= need
            for d, n in zip(other[pick].tolist(), need[pick].tolist(), strict=True):
                if comp[d] == comp[r]:
                    continue
                pair = np.concatenate([sets[r], sets[d]])
                pair.sort(kind="stable")
                if int(np.count_nonzero(pair[1:] == pair[:-1])) >= n:
                    lo, hi = sorted((int(comp[r]), int(comp[d])))
                    out.append((lo, hi))
                    comp[comp == hi] = lo
    return out


def _groups(batches, names: list[str]):
    """(group, columns) of rows that come sorted by group, one group at a time; binary columns stay Arrow scalars."""
    last, held = None, []
    for b in batches:
        cols = [b.column(c) if pa.types.is_binary(b.schema.field(c).type) else b.column(c).to_pylist() for c in names]
        for group, *row in zip(b.column("group").to_pylist(), *cols, strict=True):
            if group != last:
                if len(held) > 1:
                    yield last, list(zip(*held, strict=True))
                last, held = group, []
            held.append([x.as_py() if isinstance(x, pa.Scalar) else x for x in row])
    if len(held) > 1:
        yield last, list(zip(*held, strict=True))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group")


def _links(members: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b) of components that links within the groups join. members: group, side, node, comp; stored tables."""

    def near(batches):
        for group, (side, node, comp, size, bits) in _groups(batches, ["side", "node", "comp", "size", "bits"]):
            keep = possible_in(np.array(comp), np.array(side), np.array(size), [np.frombuffer(b, np.uint64) for b in bits], num, den)
            cols = [np.full(int(keep.sum()), group), np.array(side)[keep], np.array(node)[keep], np.array(comp)[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["group", "side", "node", "comp"])

    def link(batches):
        for _, (side, comp, elements) in _groups(batches, ["side", "comp", "elements"]):
            found = links_in(np.array(comp), np.array(side), [np.frombuffer(e, np.uint64) for e in elements], num, den)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ((), ()))], names=["a", "b"])

    with small_batches(sets.sparkSession):
        about = _small(members).join(sets.select("node", "size", "bits"), "node").select("group", "side", "node", "comp", "size", "bits")
        likely = scratch.keep(_dealt(about).mapInArrow(tidy(near), "group long, side int, node long, comp long"), f"{name}-likely")
        scratch.release()
        whole = _small(likely).join(sets.select("node", "elements"), "node").select("group", "side", "comp", "elements")
        out = scratch.keep(_dealt(whole).mapInArrow(tidy(link), "a long, b long"), name)
    scratch.drop(f"{name}-likely")
    scratch.release()
    return out


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node and comp (the smallest node reachable) of all nodes on an edge (a, b).

    Alternates large-star and small-star until nothing changes; the rounds grow with the logarithm of a component's size.
    Hubs are no hot group: minima are pre-aggregated and rows joined back by a join that adaptive execution may split.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0")
    sign = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    step, seen = 0, sign(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.keep(large, f"{label}-l{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        step += 1
        new = scratch.keep(small.distinct(), f"{label}-{step}")
        sig = sign(new)
        scratch.drop(f"{label}-l{step - 1}")
        scratch.drop(f"{label}-{step - 1}")
        scratch.release()
        now = new
        if sig == seen:
            break
        seen = sig
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links, itself included) of every row.

    A text of fewer than k words is one shingle, its whole sequence; null, empty or blank texts have no shingles and link
    with nothing. Rows with the same set link, repeated rows included. Rows of one doc_id and different texts are labelled
    each on its own and count as one node. Rows with a null doc_id keep a null component and link nothing. An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    feats = scratch.keep(_features(docs, k, num, den), "features")
    whole = ["n_shingles", "s1", "s2"]
    classes = feats.filter("n_shingles > 0 and doc_id is not null").groupBy(*whole).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.keep(classes.filter("copies > 1").drop("copies"), "classes")
    rows = scratch.keep(feats.select("doc_id", *whole).join(classes, whole, "left").withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))).select("doc_id", "n_shingles", "node"), "rows")

    scratch.drop("classes")
    keyed = feats.filter("size(keys) > 0").select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"))
    shared = scratch.keep(_shared(keyed.repartition("key").sortWithinPartitions("key", "node")), "shared")
    scratch.drop("features")
    scratch.release()

    homes = _homes(shared, scratch)
    sets = scratch.keep(_sets(docs, homes, k), "sets")
    blocks = scratch.keep(_blocks(homes, sets, scratch), "blocks")
    scratch.drop("cut")
    links = _links(scratch.keep(_in_blocks(blocks), "members"), sets, num, den, scratch, "links")
    scratch.drop("members")
    comps = scratch.keep(components(links.unionByName(_one_node(rows, homes)), scratch, "first"), "comps")
    scratch.drop("links")
    scratch.drop("homes")
    scratch.release()

    tiles = _tiles(shared, blocks, comps, scratch)
    for name in ("shared", "blocks", "about", "open", "open-rows", "lists", "rest", "pairs"):
        scratch.drop(name)
    scratch.release()
    if not tiles.isEmpty():
        across = _links(tiles, sets, num, den, scratch, "links-across")
        if not across.isEmpty():
            known = comps.filter("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))
            comps = scratch.keep(components(known.unionByName(across), scratch, "second"), "comps-across")
        for name in ("tiles", "links-across"):
            scratch.drop(name)
    scratch.drop("sets")
    scratch.release()
    return rows.join(comps, "node", "left").select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("component_id"))


def _one_node(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) from the first of a class to its members that gave keys, and among the nodes of one doc_id."""
    copies = rows.filter("node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    copies = copies.join(_small(nodes.select(F.col("node").alias("_node"))), F.col("b") == F.col("_node"), "left_semi")
    several = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_most")).filter("a < _most").drop("_most")
    return copies.unionByName(rows.join(several, "doc_id").select("a", F.col("node").alias("b")))


def _homes(shared: DataFrame, scratch: Scratch) -> DataFrame:
    """node and home: the smallest center of its keys, then that center's home, and that one's."""
    homes = scratch.keep(shared.groupBy("node").agg(F.min("center").alias("home")), "nearest")
    to = homes.select(F.col("node").alias("home"), F.col("home").alias("next"))
    for _ in range(2):
        homes = homes.join(to, "home").select("node", F.col("next").alias("home"))
    homes = scratch.keep(homes, "homes")
    scratch.drop("nearest")
    scratch.release()
    return homes


def _block(home: Column, part: Column) -> Column:
    """A block's number. Blocks that should share one would only be one larger block."""
    return F.xxhash64(home, part)


def _blocks(homes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """node, home, parts, block: homes of many nodes or bytes are cut into parts of about BLOCK nodes, BLOCK_BYTES at most.

    Only homes that are cut are joined back, so that no family's nodes meet in one task; they are few, each having many nodes
    or bytes, and broadcast where their number is small.
    """
    load = sets.select("node", "size").join(homes, "node").groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("elements") * 8 / BLOCK_BYTES)).cast("int")
    cut = scratch.keep(load.select("home", parts.alias("parts")).filter("parts > 1"), "cut")
    x = homes.join(_small(cut), "home", "left").select("node", "home", F.coalesce("parts", F.lit(1)).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return x.select("node", "home", "parts", _block(F.col("home"), part).alias("block"))


def _in_blocks(blocks: DataFrame) -> DataFrame:
    """group, side, node, comp: every node in its block, and of a home that is cut in each of its blocks."""
    cut = blocks.filter("parts > 1").select("home", "parts").distinct()
    cut = cut.select("home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(_block(F.col("home"), F.col("part")).alias("group"), F.col("home").alias("node"))
    every = blocks.select(F.col("block").alias("group"), "node").unionByName(cut)
    return every.select("group", F.lit(0).alias("side"), "node", F.col("node").alias("comp"))


def _tiles(shared: DataFrame, blocks: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """group, side, node, comp: nodes of two blocks that share a key there while the key's nodes are in several components."""
    about = scratch.keep(blocks.select("node", "block").join(comps, "node", "left").select("node", "block", F.coalesce("comp", "node").alias("comp")), "about")
    rest = shared.select("key", "node").join(_small(about), "node")
    edges = [f(c).alias(f"{n}_{c}") for c in ("comp", "block") for n, f in (("lo", F.min), ("hi", F.max))]
    keys = rest.groupBy("key").agg(*edges).filter("lo_comp < hi_comp and lo_block < hi_block").select("key")
    keys = scratch.keep(keys, "open")
    rest = scratch.keep(rest.join(_small(keys), "key"), "open-rows")
    scratch.release()
    # Of keys with equal lists of members one will do.
    lists = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("node").cast("long")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(17))).alias("h2"))
    keys = scratch.keep(lists.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key"), "lists")
    rest = scratch.keep(rest.join(_small(keys), "key"), "rest")
    side = lambda b, s: rest.groupBy("key", F.col("block").alias(b)).agg(F.min("comp").alias(f"lo_{s}"), F.max("comp").alias(f"hi_{s}"))
    pairs = side("x", 0).join(side("y", 1), "key").filter("x < y and least(lo_0, lo_1) < greatest(hi_0, hi_1)").select("key", "x", "y")
    pairs = scratch.keep(pairs, "pairs")
    ends = [
        rest.join(pairs.select("key", F.col(b).alias("block"), F.xxhash64("x", "y").alias("group")), ["key", "block"]).select("group", F.lit(s).alias("side"), "node", "comp")
        for s, b in enumerate("xy")
    ]
    return scratch.keep(ends[0].unionByName(ends[1]).distinct(), "tiles")


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each component; rows without doc_id stay.

    Repeated rows of one doc_id and text become one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    found = jaccard_components(docs, k, num, den, scratch)
    out = without_ids(docs, found.filter("doc_id <> component_id").select("doc_id"), scratch, "copies")
    unique = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty()
    return out if unique else out.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(out.filter("doc_id is null"))
