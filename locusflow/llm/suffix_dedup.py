"""Removal of repeated byte strings through enhanced suffix arrays over anchored contexts.

A byte goes when a string of LENGTH bytes over it also starts in a document with a smaller id. The suffix array is cut
into buckets without losing a repeat:

1. Every LENGTH-byte string has an anchor: among its K-byte grams the one of least hash, the leftmost of equal ones. So
   equal strings have equal anchors, and consecutive strings share one: a document has an anchor about every 16 bytes.
   The strings of one anchor lie in one context of LENGTH to 2 * LENGTH - K bytes. Contexts go to the bucket of their
   anchor's hash, as hashes only (about 17 bytes a context). A context that a smaller document of the same task has too
   is settled before the shuffle, and one that it meets in its bucket there.
2. Where an anchor has different contexts in different documents, one of each is fetched from its text. They are the
   suffix array's input: only there can part of a context repeat.
3. In each bucket all suffixes of at least LENGTH bytes are sorted, neighbours give the common-prefix lengths, and a scan
   with a stack builds the tree of common-prefix intervals. Intervals whose occurrences are preceded by different bytes
   (or by the context's edge) are the maximal repeats; each occurrence in a document beyond the group's smallest is a
   span to remove. Intervals with one left extension are part of the interval one byte before.
4. Spans meet the texts again, which are cut and hashed.

Rows between the steps are packed arrays, one a bucket and flush. There is a bucket for each BUCKET_BYTES of text, and as
many as shuffle partitions at least; a task holds one bucket's arrays, never its texts, and of an anchor with many
contexts it writes out and sorts only the suffixes that begin alike, a set at a time.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import Scratch, chunks, mix, tidy

LENGTH, K = 50, 20
STEP = 2 << 20
#: Contexts that a task gathers before it sends them on.
FLUSH = 1_000_000
#: Text bytes that a bucket is for; contexts hashed, and suffixes sorted, at a time.
BUCKET_BYTES, CONTEXTS_AT_ONCE, SUFFIXES = 64 << 20, 50_000, 200_000
ODD = np.uint64(0xD6E8FEB86659FD93)
RECORD = (("h", "<u4", 4), ("c", "<u8", 6), ("doc", "<i8", 8), ("tag", "<u4", 4), ("lo", "<u4", 4), ("off", "u1", 1), ("span", "u1", 1))
SPAN = (("doc", "<i8", 8), ("tag", "<u4", 4), ("lo", "<u4", 4), ("end", "<u4", 4))
WANT = (("bucket", "<u4", 4), ("doc", "<i8", 8), ("tag", "<u4", 4), ("lo", "<u4", 4), ("span", "u1", 1))
ROWS = "bucket int, kind int, data binary"
#: Kinds of rows: spans and wanted contexts by the bucket of their document, records and contexts by that of their anchor;
#: whole texts sort behind what belongs to them.
SPANS, RECORDS, WANTS, CONTEXTS, TEXTS = range(5)


FIELDS = {SPANS: SPAN, RECORDS: RECORD, WANTS: WANT, CONTEXTS: (*WANT, ("body", "u1", 0))}


def pack(fields, arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays of one length as planes of bytes, which compress well. A field of size 0 has rows of bytes, kept as they are."""
    n = len(arrays[fields[0][0]])
    planes = [np.ascontiguousarray(arrays[f].astype(t)).view(np.uint8).reshape(n, -1) for f, t, _ in fields]
    return n.to_bytes(8, "little") + b"".join((p[:, :size].T if size else p).tobytes() for p, (*_, size) in zip(planes, fields, strict=True))


def unpack(fields, blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {f: [] for f, *_ in fields}
    for blob in blobs:
        n, at = int.from_bytes(blob[:8], "little"), 8
        raw = np.frombuffer(blob, np.uint8)
        for f, t, size in fields:
            if not size:
                parts[f].append(raw[at:].reshape(n, -1))
                continue
            full = np.zeros((n, np.dtype(t).itemsize), np.uint8)
            full[:, :size] = raw[at : at + n * size].reshape(size, n).T
            parts[f].append(full.view(t)[:, 0])
            at += n * size
    return {f: np.concatenate(parts[f]) if parts[f] else np.zeros(0, t) for f, t, _ in fields}


class Anchors:
    """Contexts of concatenated pieces of text; see step 1."""

    def __init__(self, length: int, k: int):
        if not 17 <= k < length or length - k + 1 < 2 or 2 * length - k - length > 255:
            raise ValueError("k must be between 17 and the length, and their difference below 256")
        self.length, self.k, self.w = length, k, length - k + 1
        rng = np.random.default_rng(11)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.c = rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = np.ones(1, np.uint64)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """A hash of the k bytes from each place."""
        n = len(data) - self.k + 1
        at = lambda i, t: np.ndarray(n, t, data, i, (1,)).astype(np.uint64)
        t = at(0, "<u8") * self.c[0]
        i, c = 8, 1
        while i + 8 < self.k:
            t += at(i, "<u8") * self.c[c % 8]
            i, c = i + 8, c + 1
        t += at(self.k - 8, "<u8") * self.c[c % 8]
        t ^= t >> np.uint64(29)
        t *= self.c[7]
        t ^= t >> np.uint64(32)
        return t

    def of(self, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        """(piece, first start in it, last start, anchor's offset from the first, anchor hash, context hash) of each context."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        first = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, empty = len(data), (np.zeros(0, np.int64),) * 6
        if n < self.length:
            return empty
        edge = np.zeros(n + 1, np.int32)
        room = sizes >= self.length
        np.add.at(edge, first[room], 1)
        np.add.at(edge, (first + sizes - self.length + 1)[room], -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(starts):
            return empty
        gram = self.grams(data)
        v = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= self.w:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        if width < self.w:
            v = np.minimum(v[: len(v) - (self.w - width)], v[self.w - width :])
        anchor = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)[starts]
        piece = np.searchsorted(first, starts, side="right") - 1
        # Anchors of neighbouring pieces differ, so a change of anchor is all that ends a context.
        cut = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(starts)]])
        lo, hi, anchor, piece = starts[cut[:-1]], starts[cut[1:] - 1], anchor[cut[:-1]], piece[cut[:-1]]
        if len(self.power) <= n:
            self.power, self.inverse = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + STEP, x, np.uint64)])) for x in (ODD, np.uint64(pow(int(ODD), -1, 1 << 64)))
            )
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.power[:n])])
        off, span = anchor - lo, hi - lo
        c = (total[hi + self.length] - total[lo]) * self.inverse[lo]
        c = mix(c + off.astype(np.uint64) * self.c[5] + span.astype(np.uint64) * self.c[6]) & np.uint64(0xFFFFFFFFFFFF)
        return piece, lo - first[piece], hi - first[piece], off, mix(gram[anchor]), c


def _group(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys (the last first) and where each group of equal first-to-last keys starts in it."""
    order = np.lexsort(keys)
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(change)


def _dbucket(doc: np.ndarray, count: int) -> np.ndarray:
    x = doc ^ (doc >> np.int64(9)) ^ (doc >> np.int64(23))
    return np.mod(x, np.int64(count))


def _dbucket_column(doc: Column, count: int) -> Column:
    x = doc.bitwiseXOR(F.shiftright(doc, 9)).bitwiseXOR(F.shiftright(doc, 23))
    return F.coalesce(F.pmod(x, F.lit(count).cast("long")), F.lit(0)).cast("int")


class Rows:
    """Packed arrays that gather until they are sent on: one row for each kind and bucket."""

    def __init__(self):
        self.held: dict[int, list[tuple[np.ndarray, dict[str, np.ndarray]]]] = {}
        self.count = 0

    def add(self, kind: int, bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> None:
        if len(bucket):
            self.held.setdefault(kind, []).append((bucket, arrays))
            self.count += len(bucket)

    def batch(self) -> pa.RecordBatch:
        keys, kinds, blobs = [], [], []
        for kind, parts in sorted(self.held.items()):
            fields = FIELDS[kind]
            bucket = np.concatenate([b for b, _ in parts])
            order = np.argsort(bucket, kind="stable")
            arrays = {f: np.concatenate([x[f] for _, x in parts])[order] for f, *_ in fields}
            bucket = bucket[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                keys.append(int(bucket[a]))
                kinds.append(kind)
                blobs.append(pack(fields, {f: v[a:b] for f, v in arrays.items()}))
        self.held, self.count = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "data"])


def _deal(rows: DataFrame, buckets: int) -> DataFrame:
    """One bucket a partition, each bucket's rows by kind."""
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def _whole(batches):
    """(bucket, {kind: blobs}) of dealt rows, one bucket at a time."""
    key, held = None, {}
    for batch in batches:
        for b, k, d in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
            if b != key:
                if key is not None:
                    yield key, held
                key, held = b, {}
            held.setdefault(k, []).append(d)
    if key is not None:
        yield key, held


def _by_text(batches, fields):
    """(sorted arrays of a bucket, where each (doc, tag) lies in them, ids, texts) for each batch of a bucket's texts."""
    key, blobs, x, where = None, [], None, {}
    for batch in batches:
        bucket, kind = (batch.column(c).to_numpy() for c in ("bucket", "kind"))
        cut = np.concatenate([[0], np.flatnonzero((np.diff(bucket) != 0) | ((np.diff(kind) != 0) & (kind[1:] == TEXTS))) + 1, [len(bucket)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if a == b:
                continue
            if bucket[a] != key:
                key, blobs, x = int(bucket[a]), [], None
            part = batch.slice(a, b - a)
            if kind[a] != TEXTS:
                blobs += part.column("data").to_pylist()
                continue
            if x is None:
                x = unpack(fields, blobs)
                order, start = _group(x["tag"], x["doc"])
                x = {f: v[order] for f, v in x.items()}
                stop = np.append(start, len(order))[1:]
                where = {(int(x["doc"][i]), int(x["tag"][i])): (i, j) for i, j in zip(start.tolist(), stop.tolist(), strict=True)}
            yield x, where, part.column("doc_id").to_pylist(), part.column("data").to_pylist()


def _find(docs: DataFrame, length: int, k: int, buckets: int, tagged: bool) -> DataFrame:
    def run(batches):
        anchors, out = Anchors(length, k), Rows()
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush():
            nonlocal held, count
            doc, tag, lo, span, off, gram, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held, count = [], 0
            order = _group(lo, doc, c, gram)[0]
            group = np.zeros(len(order), bool)
            g, cc, d = gram[order], c[order], doc[order]
            group[:1] = True
            group[1:] = (g[1:] != g[:-1]) | (cc[1:] != cc[:-1])
            least = d[np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))]
            later = d > least  # a smaller document of this task has the whole context
            rest, later = order[~later], order[later]
            span_of = {"doc": doc[later], "tag": tag[later], "lo": lo[later], "end": lo[later] + span[later] + length}
            out.add(SPANS, _dbucket(doc[later], buckets), span_of)
            bucket = ((gram[rest] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            rec = {"h": gram[rest] & np.uint64(0xFFFFFFFF), "c": c[rest], "doc": doc[rest], "tag": tag[rest], "lo": lo[rest], "off": off[rest], "span": span[rest]}
            out.add(RECORDS, bucket, rec)
            return out.batch()

        for (ids,), texts in chunks(batches, "text", ["doc_id"], STEP):
            pieces = [
                (d, s, t, t[s : s + STEP + length - 1]) for d, t in zip(ids, texts, strict=True) if d is not None for s in range(0, max(1, len(t) - length + 1), STEP)
            ]
            for a in range(0, len(pieces), max(1, len(pieces) if sum(len(p[3]) for p in pieces) < 2 * STEP else 1)):
                some = pieces[a : a + (len(pieces) if sum(len(p[3]) for p in pieces) < 2 * STEP else 1)]
                piece, lo, hi, off, gram, c = anchors.of([p[3] for p in some])
                if not len(piece):
                    continue
                doc = np.array([p[0] for p in some], np.int64)[piece]
                tag = np.array([zlib.crc32(p[2]) if tagged else 0 for p in some], np.uint32)[piece]
                held.append((doc, tag, lo + np.array([p[1] for p in some], np.int64)[piece], hi - lo, off, gram, c))
                count += len(piece)
                if count >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), ROWS)


def _settle(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Per bucket: spans of whole contexts that a smaller document has, and the contexts that must be looked at."""

    def run(batches):
        out = Rows()
        for bucket, blobs in _whole(batches):
            passed = blobs.get(SPANS, [])  # dealt by document, and stay so
            if passed:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * len(passed), pa.int32()), pa.array([SPANS] * len(passed), pa.int32()), pa.array(passed, pa.binary())], names=["bucket", "kind", "data"]
                )
            x = unpack(RECORD, blobs.get(RECORDS, []))
            order, start = _group(x["c"], x["h"])
            if not len(order):
                continue
            x = {f: v[order] for f, v in x.items()}
            least = np.minimum.reduceat(x["doc"], start)  # of each class of equal contexts
            size = np.diff(np.concatenate([start, [len(order)]]))
            h = x["h"][start]
            gstart = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            several = np.minimum.reduceat(least, gstart) < np.maximum.reduceat(least, gstart)
            several = np.repeat(several, np.diff(np.concatenate([gstart, [len(h)]])))
            mine, several = np.repeat(least, size), np.repeat(several, size)
            later = x["doc"] > mine
            y = {f: v[later] for f, v in x.items()}
            out.add(SPANS, _dbucket(y["doc"], buckets), y | {"end": y["lo"].astype(np.int64) + y["span"] + length})
            want = ~later & several
            y = {f: v[want] for f, v in x.items()}
            out.add(WANTS, _dbucket(y["doc"], buckets), y | {"bucket": np.full(len(y["doc"]), bucket)})
            if out.count >= FLUSH:
                yield out.batch()
        yield out.batch()

    return _deal(rows, buckets).mapInArrow(tidy(run), ROWS)


def _with_texts(texts: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """Rows by document, dealt with the texts behind them."""
    both = rows.withColumn("doc_id", F.lit(None).cast("long")).unionByName(
        texts.select("bucket", F.lit(TEXTS).alias("kind"), F.coalesce("text", F.lit("")).cast("binary").alias("data"), "doc_id")
    )
    return _deal(both, buckets)


def _contexts(texts: DataFrame, wanted: DataFrame, length: int, width: int, buckets: int, tagged: bool) -> DataFrame:
    """The bytes of the wanted contexts, `width` for each, by the bucket of the anchor."""

    def run(batches):
        out = Rows()
        for x, where, ids, whole in _by_text(batches, WANT):
            for d, t in zip(ids, whole, strict=True):
                if (at := where.get((d, zlib.crc32(t) if tagged else 0))) is None:
                    continue
                y = {f: v[at[0] : at[1]] for f, v in x.items()}
                body = b"".join(t[lo : lo + length + s].ljust(width, b"\0") for lo, s in zip(y["lo"].tolist(), y["span"].tolist(), strict=True))
                out.add(CONTEXTS, y["bucket"].astype(np.int64), y | {"body": np.frombuffer(body, np.uint8).reshape(-1, width)})
            if out.count >= FLUSH // 4:
                yield out.batch()
        yield out.batch()

    return _with_texts(texts, wanted, buckets).mapInArrow(tidy(run), ROWS)


def interval_spans(suffix: np.ndarray, rest: np.ndarray, doc: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, the longest prefix (0 if under `length`) that a smaller document also has, by maximal repeats.

    suffix: a row of bytes each, padded; rest: how many of them count; left: the byte before, or -1 at an edge. This is the
    stack scan of the enhanced suffix array. A suffix whose repeats all have one left extension may get 0 or less than its
    own, as the suffix one byte before gets all of that.
    """
    n, width = suffix.shape
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    # Padding equals zero bytes of a text; of equal rows the shorter comes first, so it stands between no two longer ones.
    order = np.argsort(rest, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(suffix[order]).view(f"S{width}")[:, 0], kind="stable")]
    rows, rest, doc, left = suffix[order], rest[order], doc[order], left[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.minimum(lcp, np.minimum(rest[1:], rest[:-1]))
    joined = lcp >= length
    start = np.flatnonzero(np.concatenate([[True], ~joined]))
    size = np.diff(np.concatenate([start, [n]]))
    lo_doc, hi_doc = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
    big = (size > 1) & (lo_doc < hi_doc)
    if not big.any():
        return out
    deep = np.concatenate([lcp, [0]])
    low, high = np.full(len(start), 1 << 30), np.zeros(len(start), np.int64)
    inner = np.concatenate([joined, [False]])
    run = np.cumsum(np.concatenate([[True], ~joined])) - 1
    np.minimum.at(low, run[inner], deep[inner])
    np.maximum.at(high, run[inner], deep[inner])
    found = np.zeros(n, np.int64)
    # Runs that are one interval.
    one = big & (low == high)
    lo_left, hi_left = np.minimum.reduceat(left, start), np.maximum.reduceat(left, start)
    diverse = (lo_left < hi_left) | (lo_left < 0)
    flat = np.repeat(one & diverse, size) & (doc > np.repeat(lo_doc, size))
    found[flat] = np.repeat(low, size)[flat]
    # Runs with intervals inside: the stack holds (common prefix, first suffix, least document, least and largest left byte).
    for r in np.flatnonzero(big & (low < high)).tolist():
        a, b = int(start[r]), int(start[r] + size[r])
        depth, docs, lefts = lcp[a : b - 1].tolist(), doc[a:b].tolist(), left[a:b].tolist()
        stack: list[list[int]] = []

        def close(top: list[int], end: int, a=a) -> None:
            ell, first, least, small, large = top
            if small < large or small < 0:
                d, f = doc[a + first : a + end], found[a + first : a + end]
                f[(d > least) & (f == 0)] = ell

        for i in range(b - a):
            ell = depth[i] if i < b - a - 1 else 0
            before = depth[i - 1] if i else 0
            leaf = [docs[i], lefts[i], lefts[i]]
            carry = None  # an interval that has just ended joins the one around it
            if before > ell:
                while stack and stack[-1][0] > ell:
                    top = stack.pop()
                    if carry:
                        top[2:] = [min(top[2], carry[2]), min(top[3], carry[3]), max(top[4], carry[4])]
                    if leaf:
                        top[2:] = [min(top[2], leaf[0]), min(top[3], leaf[1]), max(top[4], leaf[2])]
                        leaf = None
                    close(top, i + 1)
                    carry = top
            if ell == 0:
                break
            if stack and stack[-1][0] == ell:
                for x in ([carry[2:]] if carry else []) + ([leaf] if leaf else []):
                    stack[-1][2:] = [min(stack[-1][2], x[0]), min(stack[-1][3], x[1]), max(stack[-1][4], x[2])]
            elif carry:
                stack.append([ell, *carry[1:]])
            else:
                stack.append([ell, i, *leaf])
    out[order] = found
    return out


def _shared(body: np.ndarray, span: np.ndarray, doc: np.ndarray, length: int):
    """(context, place) of the suffixes whose first `length` bytes several documents have, in sets of about SUFFIXES or of one
    such string: only suffixes that begin alike can have a repeat, and only these are written out.
    """
    rng = np.random.default_rng(13)
    table = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(body.shape[1], ODD)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(body.shape[1], np.uint64(pow(int(ODD), -1, 1 << 64)))]))
    rows, places, codes = [], [], []
    for a in range(0, len(body), CONTEXTS_AT_ONCE):
        part, most = body[a : a + CONTEXTS_AT_ONCE], span[a : a + CONTEXTS_AT_ONCE]
        total = np.zeros((len(part), body.shape[1] + 1), np.uint64)
        np.cumsum(table[part] * power[:-1], axis=1, out=total[:, 1:])
        for at in range(int(most.max()) + 1 if len(most) else 0):
            has = np.flatnonzero(most >= at)
            rows.append(has + a)
            places.append(np.full(len(has), at, np.int16))
            codes.append(mix((total[has, at + length] - total[has, at]) * inverse[at]))
    if not rows:
        return
    row, at, code = np.concatenate(rows), np.concatenate(places), np.concatenate(codes)
    del rows, places, codes
    order = np.argsort(code, kind="stable")
    row, at, code = row[order], at[order], code[order]
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    size = np.diff(np.concatenate([start, [len(code)]]))
    d = doc[row]
    keep = np.repeat(np.minimum.reduceat(d, start) < np.maximum.reduceat(d, start), size)
    row, at, code = row[keep], at[keep].astype(np.int64), code[keep]
    if not len(row):
        return
    bounds = np.append(np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])), len(code))
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SUFFIXES, side="right")) - 1)
        yield row[bounds[i] : bounds[j]], at[bounds[i] : bounds[j]]
        i = j


def _repeats(contexts: DataFrame, length: int, width: int, buckets: int) -> DataFrame:
    """Spans of repeats inside contexts; the interval tree of each bucket."""

    def run(batches):
        out = Rows()
        for _, blobs in _whole(batches):
            x = unpack(FIELDS[CONTEXTS], blobs[CONTEXTS])
            body, span = x["body"], x["span"].astype(np.int64)
            for row, at in _shared(body, span, x["doc"], length):
                padded = np.zeros((len(row), 2 * width), np.uint8)
                padded[:, :width] = body[row]
                suffix = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[np.arange(len(row)), at]
                left = body[row, np.maximum(at - 1, 0)].astype(np.int64)
                left[at == 0] = -1
                got = interval_spans(suffix, span[row] + length - at, x["doc"][row], left, length)
                hit = got > 0
                of, lo = row[hit], x["lo"][row[hit]].astype(np.int64) + at[hit]
                out.add(SPANS, _dbucket(x["doc"][of], buckets), {"doc": x["doc"][of], "tag": x["tag"][of], "lo": lo, "end": lo + got[hit]})
            if out.count >= FLUSH:
                yield out.batch()
        yield out.batch()

    return _deal(contexts, buckets).mapInArrow(tidy(run), ROWS)


def merged(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    return lo[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


def _cut(texts: DataFrame, spans: DataFrame, buckets: int, tagged: bool, with_text: bool) -> DataFrame:
    def run(batches):
        for x, where, ids, whole in _by_text(batches, SPAN):
            rows = []
            for d, t in zip(ids, whole, strict=True):
                kept, removed, runs = t, 0, 0
                if (at := where.get((d, zlib.crc32(t) if tagged else 0))) is not None:
                    s, e = merged(x["lo"][at[0] : at[1]].astype(np.int64), x["end"][at[0] : at[1]].astype(np.int64))
                    runs, removed = len(s), int((e - s).sum())
                    edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(t)]
                    kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((d, len(t), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            cols = list(zip(*rows, strict=True))
            types = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names[: len(cols)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return _with_texts(texts, spans, buckets).mapInArrow(tidy(run), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of every row.

    Null texts are empty; texts under `length` bytes keep all. Rows of one doc_id are one document's: none removes from
    another, and each is cut by its own text. Rows with a null doc_id keep all and remove nothing elsewhere. An empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffix")
    width = 2 * length - k
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    about = ids.agg(F.max(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("most"), F.sum("size").alias("size")).first()
    tagged = (about["most"] or 0) > 1
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(about["size"] or 0) // BUCKET_BYTES))
    # Kinds by document pass the deal of records untouched, so both come from one pass over the texts.
    first = _find(docs, length, k, buckets, tagged)
    found = scratch.keep(_settle(first, length, buckets), "found")
    scratch.release()
    texts = docs.select("doc_id", "text", _dbucket_column(F.col("doc_id"), buckets).alias("bucket"))
    contexts = _contexts(texts.filter("doc_id is not null"), found.filter(F.col("kind") == WANTS), length, width, buckets, tagged)
    parts = scratch.keep(_repeats(contexts, length, width, buckets), "repeats")
    scratch.release()
    return _cut(texts, found.filter(F.col("kind") == SPANS).unionByName(parts), buckets, tagged, with_text)
