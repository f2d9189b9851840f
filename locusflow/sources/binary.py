"""BAM and bigWig files, split by Spark.

Spark's own text reader cuts a file into splits at any separator, on every file system it can read. A BAM file is cut at
the fixed header of its BGZF blocks, so a row is one compressed block. Any other file is cut at two bytes that cannot
overlap with themselves, and the pieces with their exact places give back its bytes. What lies across two splits (a
record, a section) goes as a fragment of a few hundred bytes to a second, small step that joins it.

Only the heads of files (names of references; the index of a bigWig file) are read on the driver, as Spark does with the
footers of its own formats.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS = "path string, read_name string, flag int, chrom string, pos bigint, mapq int, cigar string, seq string, qual string"
RUNS = "path string, chrom string, start bigint, end bigint, value double"
#: Rows of a batch.
BATCH = 8192


class HadoopFile:
    """A file's bytes by place, on the driver; for heads and indexes only."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.size = self.fs.getFileStatus(self.path).getLen()

    def __call__(self, at: int, n: int) -> bytes:
        stream = self.fs.open(self.path)
        try:
            stream.seek(at)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, max(0, min(n, self.size - at))))
        finally:
            stream.close()


def file_paths(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files of a path, named as a scan names them; their content is not read."""
    found = spark.read.format("binaryFile").load(path).select(F.col("_metadata")["file_path"].alias("path")).distinct().collect()
    return sorted(r["path"] for r in found)


def _split_rows(spark: SparkSession, path: str | list[str], separator: bytes) -> DataFrame:
    """path, split (where it starts), size, piece: what lies between separators, in order within a split."""
    df = spark.read.format("text").option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).load(path)
    meta = F.col("_metadata")
    return df.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("split"), meta["file_block_length"].alias("size"), F.col("value").cast("binary").alias("piece"))


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Iterator[bytes]]]:
    """(path, split, size, pieces) of each split that a task reads; pieces must be used up before the next."""
    rows = ((*r,) for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("path", "split", "size", "piece")), strict=True))
    held = next(rows, None)

    def pieces(key):
        nonlocal held
        while held is not None and held[:2] == key:
            piece = held[3]
            held = next(rows, None)
            yield piece

    while held is not None:
        key = held[:2]
        yield *held[:3], pieces(key)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names, strict=True)], names=[n for n, _ in names])


def _batched(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= BATCH:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


# ---- BAM ------------------------------------------------------------------------------------------------------------

#: What every BGZF block begins with, as its writers give it: fixed values of the format.
BLOCK = bytes.fromhex("1f8b08040000000000ff060042430200")
SEQ, CIGAR = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_LETTERS = str.maketrans("0123456789abcdef", SEQ)
_SHIFT = bytes(min(i + 33, 126) for i in range(256))
FRAGMENTS = "path string, split bigint, size bigint, whole int, head binary, tail binary"
#: Records that must follow one another where reading begins within a file.
CHAIN = 12


def inflate(block: bytes) -> bytes:
    """The content of a block without its fixed header: two bytes of its size, deflated data, checksum and length."""
    return zlib.decompress(block[2:-8], -15)


def bgzf(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member; the size in its header, if it has one, tells where the next begins."""
    at, view = 0, memoryview(data)
    while at < len(data):
        d = zlib.decompressobj(31)
        if data[at + 12 : at + 16] == b"BC\x02\x00":
            size = struct.unpack_from("<H", data, at + 16)[0] + 1
            yield d.decompress(view[at : at + size]) + d.flush()
            at += size
            continue
        while not d.eof and at < len(data):
            part = view[at : at + (1 << 16)]
            yield d.decompress(part)
            at += len(part)
        at -= len(d.unused_data)


def bam_head(raw: bytes) -> tuple[list[str], int] | None:
    """Names of references and where records begin; None if raw is too short."""
    if raw[:4] != b"BAM\x01"[: len(raw)]:
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", raw, 4)[0]
        (n,) = struct.unpack_from("<i", raw, at)
        at, names = at + 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<i", raw, at)
            names.append(raw[at + 4 : at + 3 + size].decode())
            at += 8 + size
    except struct.error:
        return None
    return (names, at) if at <= len(raw) else None


def read_head(file: HadoopFile) -> tuple[list[str], int]:
    """Names of references, and where records begin in the inflated bytes."""
    n = 1 << 18
    while True:
        data, parts = file(0, n), []
        try:
            for part in bgzf(data):
                parts.append(part)
        except zlib.error:  # the last block is cut short
            pass
        if head := bam_head(b"".join(parts)):
            return head
        if n >= file.size:
            raise ValueError("the file's header does not end")
        n *= 4


def plausible(raw: bytes, at: int, refs: int) -> int:
    """Where the record that may begin at `at` would end, 0 if none can, -1 if the bytes end before that is known."""
    if at + 36 > len(raw):
        return -1
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", raw, at)
    if not (-1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and l_name >= 1 and l_seq >= 0):
        return 0
    if size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
        return 0
    name = raw[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] != 0 or any(c < 33 or c > 126 for c in name[:-1])):
        return 0
    ops = raw[at + 36 + l_name : at + 36 + l_name + 4 * n_cigar]
    return 0 if any(c & 15 > 8 for c in ops[::4]) else at + 4 + size


def first_record(raw: bytes, refs: int, complete: bool) -> int | None:
    """Where the first record begins: CHAIN records, or all up to the end, must follow from there. `complete` tells that
    raw reaches to the end of the split; without it a chain cut short is not enough. None if no place will do; a beginning
    whose fixed fields are cut by the end goes with what lies before, as both are joined to the next split."""
    for start in range(len(raw) - 35):
        at, n = start, 0
        while n < CHAIN and 0 <= at < len(raw):
            at, n = plausible(raw, at, refs), n + 1
            if at == 0:
                break
        if at and (n >= CHAIN or complete):
            return start
        if at:
            return None
    return None


def parse(raw: bytes, at: int, names: list[str]) -> tuple[list[tuple], int]:
    """The complete records from `at` on, as name, flag, chrom, pos, mapq, cigar, seq and qual, and where the rest begins.

    Unplaced reads have no chrom and position -1; qualities are characters (from 33), null where the file has none.
    """
    out, end = [], len(raw)
    while at + 4 <= end:
        (size,) = struct.unpack_from("<i", raw, at)
        if at + 4 + size > end:
            break
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", raw, at + 4)
        p = at + 36
        name = raw[p : p + l_name - 1].decode()
        p += l_name
        ops = struct.unpack_from(f"<{n_cigar}I", raw, p)
        p += 4 * n_cigar
        seq = raw[p : p + (l_seq + 1) // 2].hex().translate(_LETTERS)[:l_seq]
        p += (l_seq + 1) // 2
        qual = raw[p : p + l_seq]
        out.append((
            name, flag, names[ref] if ref >= 0 else None, pos, mapq, "".join([f"{o >> 4}{CIGAR[o & 15]}" for o in ops]), seq,
            None if not l_seq or qual[0] == 255 else qual.translate(_SHIFT).decode(),
        ))
        at += 4 + size
    return out, at


def bam_records(data: bytes) -> Iterator[tuple]:
    """All records of a whole file in memory, in order."""
    raw = b"".join(bgzf(data))
    names, at = bam_head(raw)
    yield from parse(raw, at, names)[0]


def _decoder(heads: dict[str, tuple]):
    """A task's splits to records; the bytes before a split's first record and after its last complete one are fragments,
    which are given as rows of null records when asked for."""

    def splits(batches, fragments: bool):
        for path, split, size, pieces in _by_split(batches):
            names, start, _ = heads[path]
            raw, at, head, begun = b"", 0, b"", False
            for piece in pieces:
                if not piece:
                    continue
                raw = raw[at:] + inflate(piece)
                at = 0
                if not begun:
                    if split == 0:
                        if len(raw) < start:
                            continue
                        at, begun = start, True
                    elif (found := first_record(raw, len(names), False)) is not None:
                        head, at, begun = raw[:found], found, True
                    else:
                        continue
                rows, at = parse(raw, at, names)
                if not fragments:
                    for r in rows:
                        yield (path, *r)
            raw = raw[at:]
            if not begun and split and (found := first_record(raw, len(names), True)) is not None:
                head, begun = raw[:found], True
                rows, at = parse(raw, found, names)
                raw = raw[at:]
                if not fragments:
                    for r in rows:
                        yield (path, *r)
            if fragments:
                yield (path, split, size, int(not begun), head if begun else raw, raw if begun else b"")

    return splits


def _joined(heads: dict[str, tuple]):
    """Records across splits: the end of one, all of splits without a record's beginning, the beginning of the next.

    A split in which no block begins has no row. Where an index was used, splits between may be left out, which is so
    unless one of its ranges spans them; the record that leads there is not wanted then.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("split")
        out, carry, end = [], None, None
        for path, split, size, whole, head, tail in zip(*(t.column(c.split()[0]).to_pylist() for c in FRAGMENTS.split(", ")), strict=True):
            ranges = heads[path][2]
            if end != split and ranges is not None and not any(a <= (end or 0) and b > split for a, b in ranges):
                carry = None
            if whole:
                carry = None if carry is None else carry + head
            else:
                if carry is not None:
                    out += [(path, *r) for r in parse(carry + head, 0, heads[path][0])[0]]
                carry = tail
            end = split + size
        return pa.Table.from_batches([_batch(out, READS)])

    return run


def bai_ranges(data: bytes, names: list[str], regions: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(first, last) places of blocks that may hold reads of the regions, by a file's binning index."""
    if data[:4] != b"BAI\x01":
        raise ValueError("not a BAM index")
    at, (n_ref,) = 8, struct.unpack_from("<i", data, 4)
    wanted = {}
    for chrom, start, end in regions:
        if chrom in names and end > start:
            wanted.setdefault(names.index(chrom), []).append((max(start, 0), end))
    out = []
    for ref in range(n_ref):
        (n_bin,) = struct.unpack_from("<i", data, at)
        at, chunks = at + 4, []
        for _ in range(n_bin):
            number, n = struct.unpack_from("<Ii", data, at)
            if ref in wanted and number < 37450:
                chunks.append((number, struct.unpack_from(f"<{2 * n}Q", data, at + 8)))
            at += 8 + 16 * n
        (n_intv,) = struct.unpack_from("<i", data, at)
        linear = struct.unpack_from(f"<{n_intv}Q", data, at + 4) if ref in wanted else ()
        at += 4 + 8 * n_intv
        for start, end in wanted.get(ref, []):
            least = linear[min(start >> 14, len(linear) - 1)] if linear else 0
            bins = {0} | {first + k for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)) for k in range(start >> shift, (end - 1 >> shift) + 1)}
            out += [(a >> 16, b >> 16) for number, x in chunks if number in bins for a, b in zip(x[::2], x[1::2], strict=True) if b > least]
    return out


def bam_splits(spark: SparkSession, path: str | list[str], regions: list[tuple[str, int, int]] | None = None) -> tuple[DataFrame, dict]:
    """The compressed blocks that a read of the regions inflates, and the files' heads.

    Where a file has an index beside it (its name and .bai), only splits that the index points to are kept.
    """
    blocks = _split_rows(spark, path, BLOCK)
    files = file_paths(spark, path)
    heads, kept = {}, []
    for f in files:
        heads[f] = (*read_head(HadoopFile(spark, f)), None)
        index = f + ".bai"
        p = spark._jvm.org.apache.hadoop.fs.Path(index)
        this = F.col("path") == f
        if regions is None or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            kept.append(this)
            continue
        file = HadoopFile(spark, index)
        heads[f] = (*heads[f][:2], bai_ranges(file(0, file.size), heads[f][0], regions))
        for a, b in heads[f][2]:
            # A split has the blocks that begin after its start and up to its end; the first one those from 0.
            kept.append(this & (F.col("split") + F.col("size") >= a) & ((F.col("split") < b) | (F.col("split") == 0) & F.lit(b == 0)))
    if regions is not None:
        condition = F.lit(False)
        for k in kept:
            condition |= k
        blocks = blocks.where(condition)
    return blocks, heads


def read_bam(spark: SparkSession, path: str | list[str], regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Alignments of BAM files; many tasks read one file. With regions (chrom, start, end), those that overlap any of them.

    A read overlaps a region if one of its aligned or skipped bases lies in it; one without a CIGAR counts as one base.
    """
    files = file_paths(spark, path)
    usual = [f for f in files if HadoopFile(spark, f)(0, len(BLOCK)) == BLOCK]
    out = spark.createDataFrame([], READS)
    if usual:
        blocks, heads = bam_splits(spark, usual, regions)
        decode = _decoder(heads)
        whole = blocks.mapInArrow(lambda batches: _batched(decode(batches, False), READS), READS)
        parts = blocks.mapInArrow(lambda batches: _batched(decode(batches, True), FRAGMENTS), FRAGMENTS)
        out = whole.unionByName(parts.groupBy("path").applyInArrow(_joined(heads), READS))
    if other := sorted(set(files) - set(usual)):  # gzip members of another form, as no usual writer makes them: a task a file
        each = lambda batches: _batched(((p, *r) for b in batches for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in bam_records(c)), READS)
        out = out.unionByName(spark.read.format("binaryFile").load(other).select("path", "content").mapInArrow(each, READS))
    if regions is None:
        return out
    spans = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), lambda x: x.cast("bigint"))
    end = F.col("pos") + F.greatest(F.coalesce(F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)), F.lit(1))
    hit = F.lit(False)
    for chrom, start, stop in regions:
        hit |= (F.col("chrom") == chrom) & (F.col("pos") < stop) & (end > start)
    return out.where(hit)


# ---- bigWig ---------------------------------------------------------------------------------------------------------

#: Two bytes that cannot overlap with themselves.
CUT = b"\x00\x01"
SECTIONS = "path string, section bigint, at bigint, part binary"


def bigwig_head(read) -> tuple[dict[int, str], int, bool]:
    """Names of chromosomes, the place of the index, and whether sections are compressed."""
    head = read(0, 64)
    if head[:4] != struct.pack("<I", 0x888FFC26):
        raise ValueError("not a little-endian bigWig file")
    chrom_at, _, index_at = struct.unpack_from("<QQQ", head, 8)
    (packed,) = struct.unpack_from("<I", head, 52)
    (_, _, key, _, _) = struct.unpack_from("<IIIIQ", tree := read(chrom_at, 32), 0)
    names, todo = {}, [chrom_at + 32]
    while todo:
        at = todo.pop()
        leaf, n = (top := read(at, 4))[0], struct.unpack_from("<H", top, 2)[0]
        items = read(at + 4, n * (key + 8))
        for i in range(0, len(items), key + 8):
            if leaf:
                names[struct.unpack_from("<I", items, i + key)[0]] = items[i : i + key].rstrip(b"\0").decode()
            else:
                todo.append(struct.unpack_from("<Q", items, i + key)[0])
    del tree
    return names, index_at, bool(packed)


def bigwig_sections(read, names: dict[int, str], index_at: int, regions: list[tuple[str, int, int]] | None) -> list[tuple[int, int]]:
    """(place, size) of the sections that may overlap the regions, by a walk of the index through their nodes only."""
    ids = {n: i for i, n in names.items()}
    want = None if regions is None else [(ids[c], s, e) for c, s, e in regions if c in ids and e > s]

    def meets(first: tuple[int, int], last: tuple[int, int]) -> bool:
        return want is None or any((c, s) < last and (c, e) > first for c, s, e in want)

    out, todo = [], [index_at + 48]
    while todo:
        at = todo.pop()
        leaf, n = (top := read(at, 4))[0], struct.unpack_from("<H", top, 2)[0]
        width = 32 if leaf else 24
        items = read(at + 4, n * width)
        for i in range(0, n * width, width):
            c1, s, c2, e, offset = struct.unpack_from("<IIIIQ", items, i)
            if meets((c1, s), (c2, e)):
                if leaf:
                    out.append((offset, struct.unpack_from("<Q", items, i + 24)[0]))
                else:
                    todo.append(offset)
    return sorted(out)


def section_runs(part: bytes, packed: bool, names: dict[int, str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """chrom, starts, ends and values of a section."""
    part = zlib.decompress(part) if packed else part
    chrom, start, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", part, 0)
    if kind == 1:
        x = np.frombuffer(part, [("s", "<u4"), ("e", "<u4"), ("v", "<f4")], n, 24)
        return names[chrom], x["s"].astype(np.int64), x["e"].astype(np.int64), x["v"].astype(float)
    if kind == 2:
        x = np.frombuffer(part, [("s", "<u4"), ("v", "<f4")], n, 24)
        s, v = x["s"].astype(np.int64), x["v"]
    else:
        s, v = start + step * np.arange(n, dtype=np.int64), np.frombuffer(part, "<f4", n, 24)
    return names[chrom], s, s + span, v.astype(float)


def _runs(path: str, part: bytes, packed: bool, names: dict[int, str]) -> pa.RecordBatch:
    chrom, s, e, v = section_runs(part, packed, names)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(s), pa.string()), pa.array([chrom] * len(s), pa.string()), pa.array(s), pa.array(e), pa.array(v)], names=["path", "chrom", "start", "end", "value"])


def split_places(rows: DataFrame, cut: bytes) -> dict[str, dict[int, int]]:
    """For each file, where the first piece of each split begins: sums of the lengths of all pieces before (one row a split)."""
    size = F.sum(F.octet_length("piece") + len(cut))
    found = rows.groupBy("path", "split").agg(size.alias("n")).collect()
    out: dict[str, dict[int, int]] = {}
    for r in sorted(found, key=lambda r: (r["path"], r["split"])):
        here = out.setdefault(r["path"], {"": 0})
        here[r["split"]] = here[""]
        here[""] += r["n"]
    return out


def read_bigwig(spark: SparkSession, path: str | list[str], strand: str | None = None, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Runs of bigWig files; many tasks read one file. With regions (chrom, start, end), those that overlap any of them.

    Sections that lie in one split are decoded there; parts of others are joined by section first.
    """
    rows = _split_rows(spark, path, CUT)
    files = {}
    for f in file_paths(spark, path):
        file = HadoopFile(spark, f)
        names, index_at, packed = bigwig_head(file)
        files[f] = (names, packed, np.array(bigwig_sections(file, names, index_at, regions), np.int64).reshape(-1, 2))
    places = split_places(rows, CUT)

    def parts(batches):
        """path, section, at, part: all of each wanted section, or what this split has of it."""
        for path_, split, _, pieces in _by_split(batches):
            sections = files[path_][2]
            at = places[path_][split]
            k, held = int(np.searchsorted(sections.sum(1), at, side="right")), b""  # held: bytes from `at` on
            for piece in pieces:
                held += piece + CUT
                while k < len(sections) and sections[k].sum() <= at + len(held):
                    a, b = int(sections[k, 0]), int(sections[k].sum())
                    yield path_, a, max(a, at), held[max(a - at, 0) : b - at]
                    k += 1
                drop = len(held) if k == len(sections) else min(len(held), max(0, int(sections[k, 0]) - at))
                held, at = held[drop:], at + drop
            if k < len(sections) and held and sections[k, 0] < at + len(held):
                yield path_, int(sections[k, 0]), at, held

    def complete(path_: str, section: int, part: bytes) -> bool:
        sections = files[path_][2]
        return len(part) == sections[np.searchsorted(sections[:, 0], section), 1]

    def whole(batches):
        for p, section, _, part in parts(batches):
            if complete(p, section, part):
                yield _runs(p, part, files[p][1], files[p][0])

    def rest(batches):
        return _batched((r for r in parts(batches) if not complete(r[0], r[1], r[3])), SECTIONS)

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        p, section = t.column("path")[0].as_py(), t.column("section")[0].as_py()
        sections = files[p][2]
        data = b"".join(t.column("part").to_pylist())[: int(sections[np.searchsorted(sections[:, 0], section), 1])]
        return pa.Table.from_batches([_runs(p, data, files[p][1], files[p][0])])

    if regions is not None:  # splits without a wanted section are not decoded
        keep = F.lit(False)
        for f, (_, _, sections) in files.items():
            spots = sorted(s for s in places.get(f, {}) if s != "")
            ends = [places[f][s] for s in spots[1:]] + [places[f][""]]
            hit = [s for s, e in zip(spots, ends, strict=True) if len(sections) and bool(((sections[:, 0] < e) & (sections.sum(1) > places[f][s])).any())]
            keep |= (F.col("path") == f) & F.col("split").isin(hit)
        rows = rows.where(keep)
    out = rows.mapInArrow(whole, RUNS).unionByName(rows.mapInArrow(rest, SECTIONS).groupBy("path", "section").applyInArrow(joined, RUNS))
    if regions is not None:
        hit = F.lit(False)
        for chrom, start, stop in regions:
            hit |= (F.col("chrom") == chrom) & (F.col("start") < stop) & (F.col("end") > start)
        out = out.where(hit)
    return out if strand is None else out.withColumn("strand", F.lit(strand))


def chromosomes(spark: SparkSession, path: str) -> list[str]:
    """Names of the chromosomes that a bigWig file has."""
    return sorted(bigwig_head(HadoopFile(spark, path))[0].values())
