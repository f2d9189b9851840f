"""BAM and bigWig files of our own making, read by many tasks, against reading them in one piece."""

import random
import struct
import zlib
from contextlib import contextmanager

import pytest

from locusflow.sources import binary as B

REFS = [("chr1", 400_000), ("chr2", 90_000)]


@contextmanager
def splits_of(spark, size: int):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return B.BLOCK + struct.pack("<H", len(B.BLOCK) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(start: int, end: int) -> int:
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end - 1 >> shift:
            return first + (start >> shift)
    return 0


def make_bam(path, seed: int, n: int, long_read: int = 0):
    """Records sorted by place, in blocks of odd sizes, with an index; gives rows of what was written."""
    rng = random.Random(seed)
    head = b"BAM\x01" + struct.pack("<i", 9) + b"@HD\tx\n\0\0\0" + struct.pack("<i", len(REFS))
    for name, size in REFS:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    places = sorted((rng.randrange(2), rng.randrange(80_000)) for _ in range(n))
    rows, raw, spans = [], head, []
    for i, (ref, pos) in enumerate(places):
        size = long_read if long_read and i == n // 2 else rng.randrange(1, 60)
        ops = [(size, "M")] if rng.random() < 0.5 or size < 6 else [(2, "S"), (size - 4, "M"), (rng.randrange(1, 3000), "N"), (2, "M")]
        seq, name = "".join(rng.choice("ACGTN") for _ in range(size)), f"r{rng.randrange(n)}"
        qual = None if rng.random() < 0.1 else [rng.randrange(0, 60) for _ in range(size)]
        codes = [B.SEQ.index(c) for c in seq] + [0] * (size % 2)
        end = pos + sum(k for k, o in ops if o in "MN")
        body = struct.pack("<iiBBHHHi", ref, pos, len(name) + 1, 30, bin_of(pos, end), len(ops), rng.choice((0, 16, 147)), size) + struct.pack("<iii", -1, -1, 0)
        body += name.encode() + b"\0" + b"".join(struct.pack("<I", k << 4 | B.CIGAR.index(o)) for k, o in ops)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + (b"\xff" * size if qual is None else bytes(qual))
        spans.append((len(raw), len(raw) + 4 + len(body), ref, pos, end))
        raw += struct.pack("<i", len(body)) + body
        flag = struct.unpack_from("<H", body, 14)[0]
        rows.append((name, flag, REFS[ref][0], pos, 30, "".join(f"{k}{o}" for k, o in ops), seq, None if qual is None else "".join(chr(q + 33) for q in qual)))
    out, starts, at = b"", [], 0
    while at < len(raw):
        size = rng.randrange(200, 900)
        starts.append((at, len(out)))
        out += block(raw[at : at + size])
        at += size
    path.write_bytes(out + block(b""))

    def virtual(x: int) -> int:
        a, o = max((s for s in starts if s[0] <= x), default=starts[-1]) if x < len(raw) else (len(raw), len(out))
        return o << 16 | x - a

    index = b"BAI\x01" + struct.pack("<i", len(REFS))
    for ref in range(len(REFS)):
        bins, linear = {}, {}
        for a, b, r, pos, end in spans:
            if r == ref:
                bins.setdefault(bin_of(pos, end), []).append((virtual(a), virtual(b)))
                for w in range(pos >> 14, (end - 1 >> 14) + 1):
                    linear.setdefault(w, virtual(a))
        index += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", k, len(v)) + b"".join(struct.pack("<QQ", *x) for x in v) for k, v in bins.items())
        top = max(linear, default=-1) + 1
        index += struct.pack("<i", top) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(top))
    path.with_name(path.name + ".bai").write_bytes(index)
    return rows, [(REFS[r][0], pos, end) for _, _, r, pos, end in spans]


COLS = ["read_name", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual"]


@pytest.mark.parametrize("size, long_read", [(1_000, 0), (2_500, 4_000), (1 << 20, 0)])
def test_bam_by_many_tasks(spark, tmp_path, size, long_read):
    """A record may cross splits, and one longer than several splits has none beginning in some of them."""
    rows, _ = make_bam(tmp_path / "a.bam", 1, 700, long_read)
    other, _ = make_bam(tmp_path / "b.bam", 2, 40)
    assert [r for r in B.bam_records((tmp_path / "a.bam").read_bytes())] == rows
    with splits_of(spark, size):
        df = B.read_bam(spark, [str(tmp_path / "a.bam"), str(tmp_path / "b.bam")])
        got = df.select(*COLS).collect()
        tasks = B.bam_splits(spark, str(tmp_path / "a.bam"))[0].select("split").distinct().count()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows + other))
    assert tasks > 5 if size < 10_000 else tasks == 1


def test_bam_regions(spark, tmp_path):
    rows, spans = make_bam(tmp_path / "a.bam", 3, 900)
    regions = [("chr1", 20_000, 21_000), ("chr2", 60_000, 60_050), ("chr9", 0, 10)]
    want = [r for r, (c, a, b) in zip(rows, spans, strict=True) if any(c == x and a < e and b > s for x, s, e in regions)]
    with splits_of(spark, 1_500):
        got = B.read_bam(spark, str(tmp_path / "a.bam"), regions).select(*COLS).collect()
        every, few = (B.bam_splits(spark, str(tmp_path / "a.bam"), r)[0].where("length(piece) > 0").count() for r in (None, regions))
        none = B.read_bam(spark, str(tmp_path / "a.bam"), [("chr9", 0, 10)]).count()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 5
    assert few < every / 2 and none == 0
    (tmp_path / "a.bam.bai").unlink()
    with splits_of(spark, 1_500):
        assert B.read_bam(spark, str(tmp_path / "a.bam"), regions).count() == len(want)


def make_bigwig(path, seed: int, packed: bool):
    """Sections of all three kinds under an index of two levels; gives rows of what was written."""
    rng = random.Random(seed)
    rows, sections, at = [], [], 64
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 2, 4, 8, 2, 0) + struct.pack("<BBH", 1, 0, 2) + b"".join(n.encode() + struct.pack("<II", i, s) for i, (n, s) in enumerate(REFS))
    body, at = b"", 64 + len(tree)
    for chrom in range(2):
        pos = 0
        for _ in range(60):
            kind, n, step = rng.choice((1, 2, 3)), rng.randrange(1, 40), rng.randrange(2, 9)
            items, first, span = b"", pos + rng.randrange(5), rng.randrange(1, step + 1)
            x = first
            for j in range(n):
                v = rng.choice((0.5, -1.25, 3.0, 256.0))
                s = first + step * j if kind == 3 else x
                e = s + (rng.randrange(1, 9) if kind == 1 else span)
                items += struct.pack("<IIf", s, e, v) if kind == 1 else struct.pack("<If", s, v) if kind == 2 else struct.pack("<f", v)
                rows.append((REFS[chrom][0], s, e, v))
                x = e + rng.randrange(3)
            pos = e
            data = struct.pack("<IIIIIBBH", chrom, first, pos, step, span, kind, 0, n) + items
            data = zlib.compress(data) if packed else data
            sections.append((chrom, first, pos, at, len(data)))
            body += data
            at += len(data)
    index_at, groups = at, [sections[i : i + 16] for i in range(0, len(sections), 16)]
    leaves_at = index_at + 48 + 4 + 24 * len(groups)
    top, leaves = struct.pack("<BBH", 0, 0, len(groups)), b""
    for g in groups:
        top += struct.pack("<IIIIQ", g[0][0], g[0][1], g[-1][0], g[-1][2], leaves_at + len(leaves))
        leaves += struct.pack("<BBH", 1, 0, len(g)) + b"".join(struct.pack("<IIIIQQ", c, s, c, e, a, n) for c, s, e, a, n in g)
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 16, len(sections), 0, 0, 1, pos, index_at, 1, 0) + top + leaves
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, 64 + len(tree), index_at, 0, 0, 0, 0, 9999 if packed else 0, 0)
    path.write_bytes(head + tree + body + index)
    return rows


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("size", [300, 4_000, 1 << 20])
def test_bigwig_by_many_tasks(spark, tmp_path, packed, size):
    rows = make_bigwig(tmp_path / "a.bw", 5, packed)
    regions = [("chr1", 500, 700), ("chr9", 0, 5)]
    with splits_of(spark, size):
        got = B.read_bigwig(spark, str(tmp_path / "a.bw"), "-").select("chrom", "start", "end", "value", "strand").collect()
        some = B.read_bigwig(spark, str(tmp_path / "a.bw"), regions=regions).select("chrom", "start", "end", "value").collect()
    assert sorted(map(tuple, got)) == sorted((*r, "-") for r in rows)
    assert sorted(map(tuple, some)) == sorted(r for r in rows if r[0] == "chr1" and r[1] < 700 and r[2] > 500)
    file = B.HadoopFile(spark, str(tmp_path / "a.bw"))
    names, index_at, _ = B.bigwig_head(file)
    assert 0 < len(B.bigwig_sections(file, names, index_at, regions)) < 20
    assert B.chromosomes(spark, str(tmp_path / "a.bw")) == ["chr1", "chr2"]
