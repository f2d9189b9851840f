"""Prefix trie of conversations: mergeable partial tries, merged by hashed keys in a tree of rounds, then rolled up.

A rebuilt conversation is the first h turns of its base followed by its own turns after its first h. Turns are stored in
order of conversation and turn, in parts of about PART_ROWS narrow rows (no text after the first scan), so a conversation
of any length is spread over parts like any other rows. Turn sequences have polynomial prefix sums modulo four primes of
31 bits: sums of a piece need only a factor and an offset to be those of the whole conversation, or of the rebuilt one.
Depth and sums name a node.

1. Partial tries: each part combines the paths of its conversations to a table of nodes (members, smallest member, list of
   those that end there). A node that all conversations share is one row a part.
2. Tree of merges: the parts' tables are merged by hashed node keys, FAN parts at a time, until one is left. Lists of ends
   are ascending within a part and from part to part; they are merged by streaming them in that order through the digest,
   so no list is ever held.
3. Rollup: every node's own share (saved words; whether it is a leaf) goes to the one part that holds its smallest
   member, each part sums its trie from the bottom up, and the parts' sums are merged by the same rounds. What lies below a
   piece of a conversation cut by parts is added to the bottom of the piece.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import Scratch, tidy

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1500450271, 1326390143, 1847265091, 1203945677)
#: Rows of a part; parts merged at a time.
PART_ROWS, FAN = 200_000, 256
#: Conversations that share a base, and the turns taken from it at most.
FAMILY, HEADS = 20, 3
WORD = r"[^\x20\x09-\x0D]+"
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
KEY = ["depth", "hi", "lo"]
SUMS = [f"p{k}" for k in range(4)]


def narrow(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, key (128 bits of SHA-256 of role and text) and words of every turn of some conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.lit(":"), text), 256)), 1, 16)
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )


def powers(k: int, n: int) -> np.ndarray:
    """The first n powers of base k."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(BASES[k], done, PRIMES[k])) % np.uint64(PRIMES[k])
        done += more
    return out


def walk(batches):
    """Sorted turns in, one row each out: part number, conversation, place in its piece, prefix sums of the piece, words."""
    pid, conv, place, sums = TaskContext.get().partitionId(), None, 0, [0] * 4
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("conv_id").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        at = np.arange(len(ids)) - first[run]
        goes_on = conv is not None and ids[0] == conv
        if goes_on:
            at[run == 0] += place
        parts = np.frombuffer(b"".join(b.column("key").to_pylist()), ">u4").reshape(-1, 4).astype(np.uint64)
        cols = []
        for k, p in enumerate(map(np.uint64, PRIMES)):
            total = np.cumsum(parts[:, k] % p * powers(k, int(at.max()) + 1)[at] % p)
            before = np.append(np.uint64(0), total)[first][run]
            out = total - before
            if goes_on:
                out[run == 0] += np.uint64(sums[k])
            cols.append(out % p)
        conv, place, sums = ids[-1], int(at[-1]) + 1, [int(c[-1]) for c in cols]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), pid, np.int32)), b.column("conv_id"), pa.array(at), *(pa.array(c.astype(np.int32)) for c in cols), b.column("words")],
            names=["pid", "conv_id", "place", *SUMS, "words"],
        )


def cut_pieces(walked: DataFrame) -> list[tuple]:
    """Of conversations cut by parts, each piece: pid, conv_id, turns and factors and sums before it, turns in all, whether it
    is the last.

    Two conversations a part at most, and two ids a part, come to the driver; no turns."""
    ends = sorted((r.pid, r.a, r.b) for r in walked.groupBy("pid").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).collect())
    cut = {b for (_, _, b), (_, a, _) in zip(ends, ends[1:], strict=False) if a == b}
    if not cut:
        return []
    few = walked.sparkSession.createDataFrame([(int(c),) for c in cut], "conv_id long")
    last = F.max_by(F.struct(*SUMS), "place").alias("sums")
    found = walked.join(F.broadcast(few), "conv_id").groupBy("conv_id", "pid").agg((F.max("place") + 1).alias("n"), last).collect()
    by_conv = defaultdict(list)
    for r in found:
        by_conv[r.conv_id].append((r.pid, r.n, tuple(r.sums)))
    out = []
    for c, pieces in by_conv.items():
        n, sums, total = 0, [0] * 4, sum(x[1] for x in pieces)
        for j, (pid, size, own) in enumerate(sorted(pieces)):
            factors = [pow(BASES[k], n, PRIMES[k]) for k in range(4)]
            out.append((pid, c, n, *factors, *sums, total, j == len(pieces) - 1))
            sums = [(sums[k] + factors[k] * own[k]) % PRIMES[k] for k in range(4)]
            n += size
    return out


PIECE = "pid int, conv_id long, before long, f0 long, f1 long, f2 long, f3 long, s0 long, s1 long, s2 long, s3 long, total long, is_last boolean"


def whole_sums(rows: DataFrame) -> DataFrame:
    """Prefix sums of the conversation from those of the piece, and its turn number."""
    q = [((F.col(f"p{k}").cast("long") * F.coalesce(f"f{k}", F.lit(1)) + F.coalesce(f"s{k}", F.lit(0))) % PRIMES[k]).alias(f"p{k}") for k in range(4)]
    return rows.select("pid", "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), *q, "words", "before", *(f"s{k}" for k in range(4)), "total", "is_last")


def packed(q: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hi, lo = (q[i].astype(np.int64) << np.int64(31) | q[i + 1].astype(np.int64) for i in (0, 2))
    return hi, lo


TRIE = "part long, depth long, hi long, lo long, phi long, plo long, words long, n long, conv_id long, ends string"


def partial_trie(turns: pa.Table, convs: pa.Table) -> pa.Table:
    """The node table of one part, from its turns and what is known of its conversations (h, the base's first turns, the
    own prefix sums after h turns). Up to three tables in one: the last piece of a conversation begun before, whole
    conversations, the first piece of one that goes on after; a piece is a table of its own."""
    turns, convs = turns.sort_by([("conv_id", "ascending"), ("place", "ascending")]), convs.sort_by("conv_id")
    num = lambda t, c, fill=0: t.column(c).fill_null(fill).to_numpy() if t.column(c).null_count else t.column(c).to_numpy()
    ids, pid = num(convs, "conv_id"), int(convs.column("pid")[0].as_py())
    h, before = num(convs, "h"), num(convs, "before")
    is_cut = ~convs.column("before").is_null().to_numpy()
    last = np.array([x is not False for x in convs.column("is_last").to_pylist()])
    heads = convs.column("base").to_pylist()
    hb = np.minimum(h, [len(x or ()) for x in heads])
    own = [num(convs, f"o{k}") for k in range(4)]
    seg = np.where(is_cut, np.where(before == 0, 2, 0), 1)

    at = np.searchsorted(ids, num(turns, "conv_id"))
    place = num(turns, "place")
    size = np.bincount(at, minlength=len(ids))
    total = np.where(is_cut, num(convs, "total"), size)
    opens = np.append(True, at[1:] != at[:-1])
    keep = place >= h[at]
    at_, hb_, h_ = at[keep], hb[at[keep]], h[at[keep]]
    q, pq = [], []
    for k, p in enumerate(map(np.uint64, PRIMES)):
        mine = num(turns, f"p{k}").astype(np.uint64)
        prev = np.append(np.uint64(0), mine[:-1])
        prev[opens] = num(convs, f"s{k}").astype(np.uint64)[at[opens]]
        shift = np.array([pow(BASES[k], -d, PRIMES[k]) for d in range(HEADS + 1)], np.uint64)[h_ - hb_]
        root = np.array([x[n - 1][f"p{k}"] if n else 0 for x, n in zip(heads, hb, strict=True)], np.uint64)[at_]
        less = p - own[k].astype(np.uint64)[at_] % p
        q.append((root + (mine[keep] + less) % p * shift) % p)
        pq.append((root + (prev[keep] + less) % p * shift) % p)
    hi, lo = packed(q)
    phi, plo = packed(pq)
    depth, words = place[keep] - h_ + hb_ + 1, num(turns, "words")[keep]
    ending = np.zeros(len(at), bool)
    ending[np.flatnonzero(np.append(at[1:] != at[:-1], True))] = True  # of its piece
    ending = ending[keep] & last[at_] & (total[at_] > h_)
    # part, depth, hi, lo, phi, plo, words, members, conv, ends there
    rows = [np.stack([seg[at_], depth, hi, lo, phi, plo, words, np.ones(len(at_), np.int64), ids[at_], ending], 1)]
    more = []
    for c in np.flatnonzero(before == 0):  # the root and what comes from the base
        short = total[c] <= h[c]
        more.append((seg[c], 0, 0, 0, 0, 0, 0, 1, ids[c], short and not hb[c]))
        up = (0, 0)
        for d in range(int(hb[c])):
            x = heads[c][d]
            me = (x["p0"] << 31 | x["p1"], x["p2"] << 31 | x["p3"])
            more.append((seg[c], d + 1, *me, *up, x["words"], 1, ids[c], short and d + 1 == hb[c]))
            up = me
    tops = np.flatnonzero(np.append(True, at_[1:] != at_[:-1]) & (before[at_] > 0)) if len(at_) else []
    more += [(0, depth[i] - 1, phi[i], plo[i], 0, 0, 0, 0, ids[at_[i]], False) for i in tops]  # the node above a piece
    rows = np.concatenate([*rows, np.array(more, np.int64).reshape(-1, 10)])
    if not len(rows):  # a later piece within the turns that the base replaces
        names = [x.split() for x in TRIE.split(", ")]
        return pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in names]).empty_table()
    rows = rows[np.lexsort((rows[:, 8], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.append(True, (rows[1:, :4] != rows[:-1, :4]).any(1)))
    node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
    lists = defaultdict(list)
    for i in np.flatnonzero(rows[:, 9]):
        lists[node[i]].append(str(rows[i, 8]))
    top, n = rows[first], np.add.reduceat(rows[:, 7], first)
    return pa.table({
        "part": 3 * pid + top[:, 0], **{c: top[:, i + 1] for i, c in enumerate(("depth", "hi", "lo", "phi", "plo", "words"))}, "n": n,
        "conv_id": pa.array(top[:, 8], mask=n == 0), "ends": pa.array([",".join(lists[i]) if i in lists else None for i in range(len(first))], pa.string()),
    })


def merged(tries: DataFrame, parts: int, fan: int, **how) -> DataFrame:
    """One row a node from one a part and node: rounds of merges by hashed keys, each of `fan` neighbouring parts."""
    while parts > 1:
        parts = -(-parts // fan)
        tries = tries.withColumn("part", F.floor(F.col("part") / fan).cast("long")).groupBy(*KEY, "part").agg(*(f(c).alias(c) for c, f in how.items()))
    return tries.drop("part")


def digest_ends(batches):
    """SHA-256 of each node's list; rows come ordered by node and part, so lists go on in ascending order."""
    now, state, out = None, None, []
    for b in batches:
        for *key, text in zip(*(b.column(c).to_pylist() for c in (*KEY, "ends")), strict=True):
            if key != now:
                if state:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if len(out) > 10_000:
            yield _ends(out)
            out = []
    if state:
        out.append((*now, state.hexdigest()))
    if out:
        yield _ends(out)


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*KEY, "ends_sha256"])


def rollup(t: pa.Table) -> pa.Table:
    """One part's trie, summed from the bottom up: of each node the leaves and saved words below it that have their home
    here, and for nodes that have theirs, the parent's smallest member."""
    t = t.sort_by([("depth", "descending"), ("conv_id", "ascending")])
    part = t.column("part")[0].as_py()
    cols = {c: t.column(c).to_pylist() for c in (*KEY, "phi", "plo", "words", "local", "n", "conv_id", "home", "n_children")}
    depth, hi, lo = cols["depth"], cols["hi"], cols["lo"]
    home = [x == part for x in cols["home"]]
    leaves = [int(o and not k) for o, k in zip(home, cols["n_children"], strict=True)]
    saved = [(n - 1) * w if o else 0 for o, n, w in zip(home, cols["n"], cols["words"], strict=True)]
    at = {k: i for i, k in enumerate(zip(depth, hi, lo, strict=True))}
    leaves[0] += t.column("more_leaves")[0].as_py() or 0  # of a cut conversation, what lies in later parts
    saved[0] += t.column("more_saved")[0].as_py() or 0
    parent = [None] * len(depth)
    for i, up in enumerate(zip(depth, cols["phi"], cols["plo"], strict=True)):
        j = at.get((up[0] - 1, *up[1:])) if cols["local"][i] else None  # not above the node above a piece
        if j is not None:
            leaves[j] += leaves[i]
            saved[j] += saved[i]
            if home[i]:
                parent[i] = cols["conv_id"][j]
    use = [i for i, n in enumerate(cols["local"]) if n and (home[i] or leaves[i] or saved[i])]
    pick = lambda x, kind=pa.int64(): pa.array([x[i] for i in use], kind)
    return pa.table({"part": pa.array([part] * len(use), pa.int64()), **{c: pick(cols[c]) for c in KEY}, "n_leaves": pick(leaves), "saved_tokens": pick(saved), "parent_conv_id": pick(parent)})


def rebuilt_tries(turns: DataFrame, scratch: Scratch, part_rows: int) -> tuple[DataFrame, int, list[tuple]]:
    """The parts' node tables (stored), the number of parts, and the pieces of conversations that parts cut."""
    spark = turns.sparkSession
    n = turns.select("conv_id").where(F.col("conv_id").isNotNull()).count()
    parts = max(-(-n // part_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000)), 1)
    order = ["conv_id", "turn", "role", "key", "row"]
    walked = scratch.keep(
        narrow(turns).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "key", "words")
        .mapInArrow(tidy(walk), "pid int, conv_id long, place long, p0 int, p1 int, p2 int, p3 int, words long"), "walked",
    )
    cuts = cut_pieces(walked)
    pieces = lambda: F.broadcast(spark.createDataFrame(cuts, PIECE))  # noqa: E731  two rows a part at most
    again = lambda: spark.read.schema(walked.schema).parquet(scratch.path("walked"))
    turns_ = whole_sums(walked.join(pieces(), ["pid", "conv_id"], "left"))
    heads = turns_.where(F.col("place") < HEADS).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", *SUMS, "words"))).alias("heads"))
    heads = scratch.keep(heads, "heads")
    base = heads.where(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("base_id"), F.col("heads").alias("base"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEADS + 1)
    own = F.get("heads", F.col("h").cast("int") - 1)
    convs = (
        again().where("place = 0").select("pid", "conv_id").join(heads, "conv_id").withColumn("h", h)
        .withColumn("base_id", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).join(base, "base_id", "left")
        .join(pieces(), ["pid", "conv_id"], "left")
        .select("pid", "conv_id", "h", "base", "before", "total", "is_last", *(f"s{k}" for k in range(4)), *(F.coalesce(own[f"p{k}"], F.lit(0)).alias(f"o{k}") for k in range(4)))
    )
    tries = turns_.select("pid", "conv_id", "place", *SUMS, "words").groupBy("pid").cogroup(convs.groupBy("pid")).applyInArrow(partial_trie, TRIE)
    return scratch.keep(tries, "tries"), 3 * ((walked.agg(F.max("pid")).first()[0] or 0) + 1), cuts


def prefix_trie(turns: DataFrame, part_rows: int = PART_ROWS, fan: int = FAN, scratch: Scratch | None = None) -> DataFrame:
    """The trie of rebuilt conversations, a row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Null roles and texts are empty. Turns are ordered by turn (null first), those of equal turn by role, then by the SHA-256
    of role and text; repeated rows are turns of their own. Rows without conv_id belong to no conversation. A base is
    conv_id - mod(conv_id, 20), the remainder never negative. An empty table has no conversation, so no node, not even a
    root. Long texts are read once, to be hashed and counted; long conversations are cut like any rows. Other columns are
    not read.
    """
    spark = turns.sparkSession
    scratch = scratch or Scratch(spark, "trie")
    tries, parts, cuts = rebuilt_tries(turns, scratch, part_rows)
    first = F.when(F.col("n") > 0, F.struct("conv_id", "part")).alias("first")
    nodes = merged(
        tries.select("part", *KEY, "phi", "plo", "words", "n", first), parts, fan,
        phi=F.max, plo=F.max, words=F.max, n=F.sum, first=F.min,
    )
    nodes = scratch.keep(nodes.select(*KEY, "phi", "plo", "words", "n", F.col("first.conv_id").alias("conv_id"), F.col("first.part").alias("home")), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = scratch.keep(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")

    here = tries.select("part", *KEY, F.col("n").alias("local")).join(nodes, KEY)
    here = here.join(F.broadcast(below(spark, nodes, cuts)), "part", "left")
    sums = here.groupBy("part").applyInArrow(rollup, "part long, depth long, hi long, lo long, n_leaves long, saved_tokens long, parent_conv_id long")
    sums = merged(sums, parts, fan, n_leaves=F.sum, saved_tokens=F.sum, parent_conv_id=F.max)
    ends = (
        tries.where("ends IS NOT NULL").select(*KEY, "part", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "part")
        .mapInArrow(tidy(digest_ends), "depth long, hi long, lo long, ends_sha256 string")
    )
    none = hashlib.sha256().hexdigest()
    return nodes.join(sums, KEY).join(ends, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def below(spark: SparkSession, nodes: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Of each part that is a piece of a cut conversation, the leaves and saved words of the pieces after it (two rows a
    part at most)."""
    piece = lambda pid, before: 3 * pid + (0 if before else 2)
    rows = [(c, piece(pid, before)) for pid, c, before, *_ in cuts]
    own = {}
    if rows:
        some = spark.createDataFrame([(p,) for _, p in rows], "home long")
        saved = F.sum((F.col("n") - 1) * F.col("words"))
        found = nodes.join(F.broadcast(some), "home").groupBy("home").agg(F.sum((F.col("n_children") == 0).cast("long")), saved).collect()
        own = {r[0]: (r[1], r[2]) for r in found}
    out, sums = [], defaultdict(lambda: (0, 0))
    for c, p in sorted(rows, key=lambda x: -x[1]):
        out.append((p, *sums[c]))
        sums[c] = reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), [own.get(p, (0, 0))], sums[c])
    return spark.createDataFrame(out, "part long, more_leaves long, more_saved long")


SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, sha256(strlen(role) || ':' || role || ':' || text) AS code, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, code) - 1 AS i FROM o),
c AS (SELECT conv_id, n, conv_id - (conv_id % 20 + 20) % 20 AS base,
        (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: list_prepend(CAST(ascii(x) AS BIGINT), [0, 0, 0, 0, 0, 0, 0])))),
           lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)))) % 4 AS h
      FROM (SELECT conv_id, count(*) AS n FROM i GROUP BY conv_id)),
b AS (SELECT c.conv_id, c.h, c.base, least(c.h, coalesce(k.n, 0)) AS hb FROM c LEFT JOIN c k ON k.conv_id = c.base),
r AS (SELECT b.conv_id, i.i AS pos, i.code, i.words FROM b JOIN i ON i.conv_id = b.base WHERE i.i < b.hb
      UNION ALL SELECT b.conv_id, i.i - b.h + b.hb, i.code, i.words FROM b JOIN i ON i.conv_id = b.conv_id WHERE i.i >= b.h),
w AS (SELECT conv_id, pos + 1 AS d, words, sha256(string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM r),
p AS (SELECT conv_id, d, words, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY d), '') AS up FROM w
      UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
l AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS is_end FROM p),
n AS (SELECT node, any_value(d) AS d, any_value(words) AS words, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends FROM l GROUP BY node),
k AS (SELECT up, count(*) AS n_children FROM n GROUP BY up),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.node),
s AS (SELECT p.node, sum(CAST(m.n_children = 0 AS BIGINT)) AS n_leaves, sum((m.n - 1) * m.words) AS saved_tokens
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.node)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n AS n_convs, m.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN s ON s.node = m.node LEFT JOIN n q ON q.node = m.up
"""
