"""Aligned reads against counts by hand; controls of clusters; windows of features against dense vectors."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusflow.functions import vectors as V
from locusflow.operators import background as BG
from locusflow.operators import clusters as C
from locusflow.operators import density as D
from locusflow.operators import reads as R

READS = "chrom string, pos long, lib string, flag int, cigar string, seq string"


def piles(spark, rows, **how):
    out = R.pileup(spark.createDataFrame(rows, READS), **how).collect()
    return {(r.pos, r.strand): (r.A, r["T"], r.C, r.G, r.deletion, r.insertion, r.trun, r.mismatch) for r in out}


def test_pileup_by_hand(spark):
    """+ counts a truncation at the first base, - at the last; skips count nowhere, deletions and insertions before them."""
    rows = [("c", 10, "x", 128, "2M3N2M", "ACGT"), ("c", 20, "x", 128 | 16, "1S2M1D2M", "TACGT"), ("c", 30, "x", 128, "2M2I1M", "AAGGC")]
    assert piles(spark, rows) == {
        (10, "+"): (1, 0, 0, 0, 0, 0, 1, 0), (11, "+"): (0, 0, 1, 0, 0, 0, 0, 0), (15, "+"): (0, 0, 0, 1, 0, 0, 0, 0), (16, "+"): (0, 1, 0, 0, 0, 0, 0, 0),
        (20, "-"): (1, 0, 0, 0, 0, 0, 0, 0), (21, "-"): (0, 0, 1, 0, 1, 0, 0, 0), (23, "-"): (0, 0, 0, 1, 0, 0, 0, 0), (24, "-"): (0, 1, 0, 0, 0, 0, 1, 0),
        (30, "+"): (1, 0, 0, 0, 0, 0, 1, 0), (31, "+"): (1, 0, 0, 0, 0, 1, 0, 0), (32, "+"): (0, 0, 1, 0, 0, 0, 0, 0),
    }


def test_mates_and_flags(spark):
    rows = [("c", 1, "x", f, "1M", "A") for f in (128, 64, 0, 128 | 4, 128 | 256, 128 | 1024, 128 | 1, 128 | 1 | 2)] + [("c", 1, "x", 128, "1M", "G"), ("c", 1, "x", 128, None, None)]
    assert piles(spark, rows) == {(1, "+"): (2, 0, 0, 1, 0, 0, 3, 1)}
    assert piles(spark, rows, read2=False) == {(1, "+"): (2, 0, 0, 0, 0, 0, 2, 0)} == piles(spark, rows, single_end=True)
    assert piles(spark, []) == {}


def test_blocks(spark):
    rows = [("c", 10, "x", 0, "2M3N2M1D1M4N1M", "A" * 6), ("c", 5, "x", 0, "3S2M", "A" * 5), ("c", 5, "x", 0, "*", "A")]
    assert sorted((r.start, r.end) for r in R.blocks(spark.createDataFrame(rows, READS)).collect()) == [(5, 7), (10, 12), (15, 19), (23, 24)]


def test_truncation_axis(spark):
    """Of start..end-1 on + and end..start+1 on -, 5' to 3'."""
    events = spark.createDataFrame([("c", p, s, "x", 1) for p in range(8, 16) for s in "+-"], "chrom string, pos long, strand string, lib string, n int")
    regions = spark.createDataFrame([(1, "c", 10, 13, "+"), (2, "c", 10, 13, "-")], "id long, chrom string, start long, end long, strand string")
    assert sorted((r.id, r.rp) for r in R.truncation_axis(events, regions).collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    one = R.truncation_axis(events.filter("pos = 13"), regions).collect()
    assert [(r.id, r.rp) for r in one] == [(2, 0)]


def test_matched_controls(spark):
    """Parts too small for the next cluster are passed over; windows have its width around the part's middle."""
    regions = spark.createDataFrame([(1, "c", "+", 0, 100), (2, "c", "+", 0, 20)], "id long, chrom string, strand string, start long, end long")
    clusters = spark.createDataFrame([(1, 5, 15), (1, 40, 51), (2, 5, 15)], "id long, start long, end long")
    got = sorted(tuple(r) for r in C.matched_controls(clusters, regions).collect())
    # Region 1 leaves 0-5 (too small for 10), 15-40 (22.5 to 32.5, rounded up) and 51-100 (70 to 81); region 2 leaves two of 5.
    assert got == [(1, 23, 33), (1, 70, 81)]


def test_region_clusters(spark):
    sites = [("c", "+", p, True) for p in (10, 10, 11, 12, 60)] + [("c", "+", 11, False), ("c", "-", 10, True)]
    regions = [(1, "c", "+", 0, 60), (2, "c", "+", 55, 70)]
    df = spark.createDataFrame(sites, "chrom string, strand string, pos long, is_ip boolean"), spark.createDataFrame(regions, "id long, chrom string, strand string, start long, end long")
    out = {r.id: r for r in C.region_clusters(*df, eps=2, cov_ratio=40, members=True).collect()}
    # Region 1 has 5 sites on 60 bases, so 3 within reach make a core; region 2 one on 15, so 2 would.
    assert set(out) == {1} and (out[1].no_ip, out[1].no_input, out[1].ip_members, out[1].input_members) == (4, 1, [10, 10, 11, 12], [11])
    assert out[1].end - out[1].start == 30


@pytest.mark.parametrize("piece", [7, 100, 1 << 16])
def test_dbscan_in_pieces(spark, piece):
    rng = random.Random(2)
    pos = [rng.randrange(400) for _ in range(120)]
    got = sorted((r.start, r.end, r.no_ip) for r in C.dbscan(spark.createDataFrame([("k", p, True) for p in pos], "g string, pos long, is_ip boolean"), ["g"], 5, 4, piece=piece).collect())
    core = sorted(p for p in pos if sum(abs(p - q) <= 5 for q in pos) >= 4)
    want, at = [], []
    for p in core:
        if at and p - at[-1] > 5:
            want.append((at[0], at[-1], len(at)))
            at = []
        at.append(p)
    assert got == want + ([(at[0], at[-1], len(at))] if at else [])


@pytest.mark.parametrize("method", ["relative information", "fold change", "subtract", "subtract normal", None])
@pytest.mark.parametrize("normal", [False, True])
def test_feature_windows(spark, method, normal):
    """Windows from sparse values against those cut from dense vectors."""
    rng = random.Random(4)
    n = {1: 60, 2: 45}
    ip, ctrl = ({i: [rng.choice((0, 0, 0, 1, 4)) for _ in range(k + 1)] for i, k in n.items()} for _ in range(2))
    pairs = [(i, p, float(ip[i][p]), float(ctrl[i][p])) for i in n for p in range(n[i] + 1) if ip[i][p] or ctrl[i][p]]
    feats = [(1, "exon", 5, 17, "+"), (1, "exon", 30, 34, "+"), (1, "intron", 17, 30, "+"), (2, "exon", 0, 45, "-"), (2, "exon", 3, 9, "-"), (3, "exon", 0, 9, "-"), (1, "CDS", 5, 5, "+")]
    f = spark.createDataFrame([(*x, 0, n.get(x[0], 9)) for x in feats], "id long, fname string, f_start long, f_end long, strand string, start long, end long")
    lengths = spark.createDataFrame([(i, k + 1) for i, k in n.items()], "id long, length long")
    values = BG.remove_background(spark.createDataFrame(pairs, "id long, rp long, ip double, ctrl double"), lengths, method)
    got = {(r.id, r.fname, r.side): r.v for r in D.feature_windows(BG.normalize(values) if normal else values, f, lambda _: 10).collect()}
    dense = {}
    for i in n:
        row = spark.range(1).select(V.remove_background(F.array(*map(F.lit, map(float, ip[i]))), F.array(*map(F.lit, map(float, ctrl[i]))), method, True).alias("v")).first()["v"]
        dense[i] = [x / sum(row) for x in row] if normal else row
    want = Counter((i, fn, s) for i, fn, a, b, _ in feats if b > a and i in n for s in ("left", "right"))
    assert set(got) == set(want)
    for (i, fn, s), v in got.items():
        slices = [dense[i][rs : rs + b - a] for j, g, a, b, st in feats if (j, g) == (i, fn) and b > a for rs in [n[i] - b if st == "-" else a]]
        for p in range(10):
            at = [x[p if s == "left" else len(x) - 10 + p] for x in slices if (p < len(x) if s == "left" else len(x) - 10 + p >= 0)]
            assert v[p] == pytest.approx(sum(at) / len(at), abs=1e-12) if at else v[p] is None


def test_control_of():
    assert BG.control_of("rep2", ["rep1", "rep2", "ctrl"]) == "ctrl" and BG.control_of("rep2", ["rep1", "ctrl1"]) == "ctrl2"
    with pytest.raises(ValueError):
        BG.paired(None, "rep1", ["ctrl1"], ["rep1"])


def test_quality_and_mates(spark):
    """By hand: low qualities hide all that stands at their place; mates at one place count once."""
    schema = "chrom string, pos long, lib string, flag int, cigar string, seq string, qual string, name string"
    q = lambda *xs: "".join(chr(33 + x) for x in xs)
    rows = [
        ("c", 10, "x", 128 | 3, "2M1D2M", "ACGT", q(12, 13, 40, 5), "a"),  # its head is of low quality, so no truncation
        ("c", 30, "x", 64 | 3 | 16, "3M", "AAA", q(10, 30, 30), "b"), ("c", 30, "x", 128 | 3, "3M", "ACA", q(10, 20, 40), "b"),
        ("c", 50, "x", 64 | 3 | 16, "2M", "GG", q(30, 5), "c"), ("c", 51, "x", 128 | 3, "2M", "TT", q(30, 12), "c"),
        ("c", 70, "x", 128 | 3, "1M", "A", None, None), ("c", 70, "x", 128 | 3, "1M", "A", None, None), ("c", 71, "x", 128 | 3, "1M", "A", "", "d"),
        ("c", 90, "x", 128 | 3 | 1024, "1M", "A", None, "e"), ("c", 90, "x", 128 | 1, "1M", "A", None, "f"), ("c", 90, "y", 64 | 3, "1M", "A", None, "d"),
    ]
    out = lambda **how: {(r.pos, r.strand): (r.A, r["T"], r.C, r.G, r.deletion, r.insertion, r.trun, r.mismatch) for r in R.quality_pileup(spark.createDataFrame(rows, schema), **how).collect()}
    alone = {(11, "+"): (0, 0, 1, 0, 1, 0, 0, 0), (13, "+"): (0, 0, 0, 1, 0, 0, 0, 0), (70, "+"): (2, 0, 0, 0, 0, 0, 2, 0), (71, "+"): (1, 0, 0, 0, 0, 0, 1, 0)}
    # b: the second mate comes first (flags 131 and 83 at one start: the first mate leads); at 31 the first mate's C loses to 30.
    assert out() == alone | {(51, "+"): (0, 1, 0, 0, 0, 0, 1, 0)}
    assert out(mates=False) == alone | {(31, "+"): (0, 0, 1, 0, 0, 0, 0, 0), (32, "+"): (1, 0, 0, 0, 0, 0, 0, 0), (51, "+"): (0, 1, 0, 0, 0, 0, 1, 0)}
    assert out(read2=False, mates=True) == {(30, "-"): (1, 0, 0, 0, 0, 0, 0, 0), (31, "-"): (1, 0, 0, 0, 0, 0, 0, 0), (32, "-"): (1, 0, 0, 0, 0, 0, 1, 0), (50, "-"): (0, 0, 0, 1, 0, 0, 0, 0), (90, "+"): (1, 0, 0, 0, 0, 0, 1, 0)}
    assert out(least=0, mates=False)[(10, "+")] == (1, 0, 0, 0, 0, 0, 1, 0)
