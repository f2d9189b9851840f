"""Golden values of vectors, annotation and statistics."""

import math

import pytest
from pyspark.sql import functions as F

from locusflow.config import Settings
from locusflow.functions import stats as S
from locusflow.functions import vectors as V
from locusflow.operators import annotation as A
from locusflow.operators import clusters as C
from locusflow.operators import enrich as E
from locusflow.operators import intervals as I  # noqa: E741
from locusflow.operators import kmers as K


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple([None if x is None else float(x) for x in v] for v in cols.values())], ", ".join(f"{k} array<double>" for k in cols))
    return df.select(expr.alias("x")).first()["x"]


IP, CTRL = [0.0, 1.0, 3.0], [1.0, 0.0, 1.0]


@pytest.mark.parametrize(
    "method,sites,want",
    [
        ("subtract normal", True, [0, 0.25, 0.25]), ("subtract", True, [0, 1, 2]), (None, True, IP),
        ("relative information", False, [-0.212204, 0.147021, 0.294042]), ("fold change", False, [-1.485427, 0.514573, 0.514573]),
        ("relative information", True, [-0.000357, 3.072068, 0.438713]), ("fold change", True, [-14.287748, 12.287965, 0.584975]),
    ],
)
def test_background(spark, method, sites, want):
    got = one(spark, V.remove_background(F.col("a"), F.col("b"), method, sites), a=IP, b=CTRL)
    assert got == pytest.approx(want, abs=1e-6)


def test_background_zero_sums(spark):
    z = [0.0, 0.0, 0.0]
    assert one(spark, V.remove_background(F.col("a"), F.col("b"), "subtract normal"), a=z, b=CTRL) == z
    assert one(spark, V.remove_background(F.col("a"), F.col("b"), "subtract normal"), a=IP, b=z) == [0, 0.25, 0.75]
    with pytest.raises(ValueError):
        V.remove_background(F.col("a"), F.col("b"), "substraction")


@pytest.mark.parametrize("length,side,want", [(2, "left", [1, 2]), (2, "right", [2, 3]), (5, "left", [1, 2, 3, None, None]), (5, "right", [None, None, 1, 2, 3])])
def test_trim_or_pad(spark, length, side, want):
    assert one(spark, V.trim_or_pad(F.col("a"), length, side), a=[1.0, 2.0, 3.0]) == want


def test_windows_and_smoothing(spark):
    assert one(spark, V.window(F.col("a"), -1, 4), a=[1.0, 2.0, 3.0]) == [None, 1, 2, 3, None]
    assert one(spark, V.window(F.col("a"), 2, 2), a=[1.0]) == []
    assert one(spark, V.gaussian(F.col("a"), 1.0), a=[0.0, 0, 1, 0, 0]) == pytest.approx([0.058423, 0.242105, 0.398943, 0.242105, 0.058423], abs=1e-6)
    assert one(spark, V.convolve_full(F.col("a"), [1, 1]), a=[1.0, 2.0]) == [1, 3, 2]
    assert one(spark, V.normalize(F.col("a")), a=[0.0, 0.0]) == [None, None]
    assert one(spark, V.orient(F.col("a"), F.lit("-")), a=[1.0, None, -2.0]) == [-1, 0, 2]


EXONS = [(100, 110), (160, 190), (130, 150)]


def exons(spark, strand):
    return spark.createDataFrame([("g", strand, "exon", *e) for e in EXONS], "id string, strand string, fname string, f_start bigint, f_end bigint")


@pytest.mark.parametrize("strand,want", [("+", sorted(EXONS)), ("-", sorted(EXONS, reverse=True))])
def test_order(spark, strand, want):
    assert [(r.f_start, r.f_end) for r in A.ordered(exons(spark, strand)).orderBy("ord").collect()] == want


@pytest.mark.parametrize(
    "strand,direction,q,want",
    [
        ("+", "upstream", (150, 155), (130, 150)), ("+", "upstream", (100, 105), None), ("-", "upstream", (150, 155), (160, 190)), ("-", "upstream", (190, 195), None),
        ("+", "downstream", (150, 155), (160, 190)), ("-", "downstream", (150, 155), (130, 150)), ("+", "downstream", (190, 200), None), ("-", "downstream", (100, 105), None),
    ],
)
def test_nearest(spark, strand, direction, q, want):
    query = spark.createDataFrame([("g", strand, *q)], "id string, strand string, q_start bigint, q_end bigint")
    r = I.nearest_feature(query, exons(spark, strand), direction).first()
    assert (None if r.f_start is None else (r.f_start, r.f_end)) == want


@pytest.mark.parametrize("strand,want", [("+", (0, 50)), ("-", (50, 100))])
def test_relative(spark, strand, want):
    r = spark.range(1).select(I.relative(F.lit(100), F.lit(150), F.lit(100), F.lit(200), F.lit(strand)).alias("r")).first()["r"]
    assert (r.start, r.end) == want


def test_added_feature(spark):
    f = exons(spark, "+")
    new = A.add_feature(f, spark.createDataFrame([("g", "+", 150, 155)] * 2, "id string, strand string, f_start bigint, f_end bigint"), "window")
    assert [(r.f_start, r.f_end) for r in new.filter("fname = 'window'").collect()] == [(150, 155)]
    assert Settings().with_length("window", 5).length("window") == 5 and Settings().length("window") == 50


def test_statistics(spark):
    assert S.poisson_upper(25, 10) == pytest.approx(1.768027e-05, rel=1e-5)
    assert S.ks_p(0.5, 4, 4) == pytest.approx(0.4)
    assert S.ks_p(0.5, 4, 5) == pytest.approx(0.2857142857)
    assert S.wilcoxon_greater([-1, 1.5, 3, 6, 10]) == (14.0, 0.0625)
    assert S.binomial_cdf(9, 12, 31 / 52) == pytest.approx(0.920572, abs=1e-6)
    assert S.t_upper(2.0, 10) == pytest.approx(0.0366940, abs=1e-6)
    assert S.find_peaks([0, 1, 0, 2, 2, 0, 3], 0.5) == [1, 3]
    assert S.find_peaks([0, 1, 0, 2, 0], 0.5, 3) == [3]
    ps = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "i int, pval double")
    assert [r.fdr for r in E.fdr(ps, []).orderBy("i").collect()] == pytest.approx([0.04, 0.053333, 0.053333, 0.5], abs=1e-6)


def test_ks_table(spark):
    rows = [(True, float(x)) for x in (5, 6, 7, 3)] + [(False, float(x)) for x in (1, 2, 4, 8)]
    r = E.ks_enrichment(spark.createDataFrame(rows, "ip boolean, x double").withColumn("k", F.lit(1)), ["k"], F.col("ip")).first()
    assert (r.stat, round(r.pval, 9)) == (0.5, 0.4)


def test_elbow(spark):
    z = spark.createDataFrame([(f"k{i}", float(v)) for i, v in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 12, 20])], "kmer string, z double")
    r = K.elbow(z).first()
    assert (round(r.slope, 9), round(r.intercept, 9), r.cutoff) == (1, 0, 12)


def test_clusters(spark):
    c = C.fixed_size(spark.createDataFrame([(100, 110)], "start bigint, end bigint")).first()
    assert (c.start, c.end) == (90, 120)
    sites = spark.createDataFrame([("a", p, True) for p in (1, 3, 5, 50, 52, 54, 200)], "g string, pos bigint, is_ip boolean")
    got = sorted((r.start, r.end, r.no_ip) for r in C.dbscan(sites, ["g"], 5, 3).collect())
    assert got == [(1, 5, 3), (50, 54, 3)]


def test_interval_properties(spark):
    import random

    random.seed(2)
    schema = "id bigint, chrom string, start bigint, end bigint, strand string"
    make = lambda n: [(i, random.choice("xy"), s := random.randrange(30_000), s + random.randrange(0, 9000), random.choice("+-")) for i in range(n)]
    a, b = make(80), make(60)
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[4] == q[4] and p[2] < q[3] and q[2] < p[3] and p[2] < p[3] and q[2] < q[3])
    for size in (64, 4096, 1 << 20):
        assert sorted((r.id, r.b_id) for r in I.overlap_pairs(da, db, True, size).select("id", "b_id").collect()) == want
    hit = {r.id for r in I.semi_overlap(da, db, ["id"]).collect()}
    miss = {r.id for r in I.anti_overlap(da, db, ["id"]).collect()}
    assert hit == {p for p, _ in want} and hit | miss == {p[0] for p in a} and not hit & miss
    covered = {(c, s, x) for _, c, lo, hi, s in b for x in range(lo, hi)}
    left = sorted((r.id, x) for r in I.subtract(da, db, ["id"]).collect() for x in range(r.start, r.end))
    assert left == sorted((i, x) for i, c, lo, hi, s in a for x in range(lo, hi) if (c, s, x) not in covered)
    for piece in (100, 1 << 16):
        got = {(r.chrom, r.strand, x) for r in I.merge(db, piece=piece).collect() for x in range(r.start, r.end)}
        assert got == covered
        runs = {(r.chrom, r.strand, x): r.depth for r in I.coverage_runs(db, piece=piece).collect() for x in range(r.start, r.end)}
        assert {k for k, d in runs.items() if d} == covered
    assert math.isclose(sum(runs.values()), sum(hi - lo for _, _, lo, hi, _ in b))
