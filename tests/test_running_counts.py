"""Overlap counts, clusters of regions and moments of runs without pairs, against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from locusflow.operators import clusters as C
from locusflow.operators import intervals as I  # noqa: E741
from locusflow.operators import signal as S
from locusflow.operators import values as RV


def spans(rng, n, most=300):
    return [(i, rng.choice("abc"), rng.choice("+-"), s := rng.randrange(most), s + rng.choice((-1, 0, 1, 5, 40, 200))) for i in range(n)]


KIND = "id long, chrom string, strand string, start long, end long"


@pytest.mark.parametrize("piece", [3, 4096])
def test_overlap_counts(spark, monkeypatch, piece):
    monkeypatch.setattr(S, "COUNT_PIECE", piece)
    rng = random.Random(piece)
    a, b = spans(rng, 60), spans(rng, 50)
    da, db = spark.createDataFrame(a + [(99, None, "+", 1, 5)], KIND), spark.createDataFrame(b, KIND)
    for stranded in (True, False):
        want = {x[0]: sum(x[1] == y[1] and (not stranded or x[2] == y[2]) and x[3] < x[4] and y[3] < y[4] and x[3] < y[4] and y[3] < x[4] for y in b) for x in a} | {99: 0}
        got = {r.id: r.n for r in I.overlap_counts(da, db, ["chrom", "strand"] if stranded else ["chrom"]).collect()}
        assert got == want
        assert {r.id for r in I.semi_overlap(da, db, ["id"], stranded).collect()} == {i for i, n in want.items() if n}
        assert {r.id for r in I.anti_overlap(da, db, ["id"], stranded).collect()} == {i for i, n in want.items() if not n}


def test_many_peaks_on_one_place(spark):
    """Ten thousand peaks on each of a thousand transcripts: ten million pairs as rows, were they formed."""
    tx = spark.range(1000).select("id", F.lit("a").alias("chrom"), F.lit("+").alias("strand"), F.lit(5).cast("long").alias("start"), F.lit(90).cast("long").alias("end"))
    peaks = spark.range(10_000).select("id", F.lit("a").alias("chrom"), F.lit("+").alias("strand"), F.lit(50).cast("long").alias("start"), F.lit(60).cast("long").alias("end"))
    assert I.overlap_counts(tx, peaks, ["chrom", "strand"]).filter("n = 10000").count() == 1000
    assert "b_start" not in I.semi_overlap(tx, peaks, ["id"])._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("combine", [True, False])
def test_cores_at_edges_of_regions(spark, combine):
    """Neighbours outside of a region do not count, so a place may be core on the strand and not in a region."""
    rng = random.Random(7)
    sites = [("a", rng.choice("+-"), p, rng.random() < 0.6) for c in range(12) for p in [rng.choice((c * 40, c * 40 + 3, c * 40 + 5, rng.randrange(500))) for _ in range(25)]]
    regions = [(i, "a", rng.choice("+-"), s := rng.choice((0, 38, 41, 80, 123, rng.randrange(400))), s + rng.choice((4, 30, 90, 300))) for i in range(60)]
    eps, ratio = 4, 6
    want = set()
    for i, _, st, lo, hi in regions:
        both = [(p, ip) for _, t, p, ip in sites if t == st and lo <= p < hi]
        use = [x for x in both if combine or x[1]]
        least = int(ratio * (len(both) / (hi - lo)))
        core = sorted(x for x in use if sum(abs(x[0] - y[0]) <= eps for y in use) >= least)
        groups = []
        for x in core:
            if groups and x[0] - groups[-1][-1][0] <= eps:
                groups[-1].append(x)
            else:
                groups.append([x])
        for g in groups:
            mid = -((g[0][0] + g[-1][0]) // -2)
            want.add((i, mid - 15, mid + 15, sum(ip for _, ip in g), sum(not ip for _, ip in g)))
    frame = spark.createDataFrame(sites, "chrom string, strand string, pos long, is_ip boolean")
    got = C.region_clusters(frame, spark.createDataFrame(regions, KIND), eps, ratio, combine)
    assert {(r.id, r.start, r.end, r.no_ip, r.no_input) for r in got.collect()} == want and len(want) > 20


def test_run_moments(spark):
    rng = random.Random(5)
    runs = [(c, st, s, e, round(rng.random() * 9, 2)) for _, c, st, s, e in spans(rng, 80)]
    r, tx = spark.createDataFrame(runs, "chrom string, strand string, start long, end long, value double"), spark.createDataFrame(spans(rng, 40), KIND)
    x = RV.runs_on_transcripts(r, tx).withColumn("c", F.round(F.col("value") * 100).cast("bigint"))
    want = x.groupBy("id").agg(F.count(F.lit(1)).alias("n_bases"), F.sum("c").alias("total"), F.sum(F.col("c") * F.col("rp")).alias("weighted"))
    assert sorted(map(tuple, RV.run_moments(r, tx).collect())) == sorted(map(tuple, want.collect()))


def test_site_moments(spark):
    rng = random.Random(6)
    sites = spark.createDataFrame([(rng.choice("abc"), rng.randrange(-20, 500), rng.choice("+-"), rng.choice(("x", "y"))) for _ in range(700)], "chrom string, pos long, strand string, lib string")
    tx = spark.createDataFrame([t for t in spans(rng, 60) if t[3] <= t[4]], KIND)
    v = S.dense(S.profile(sites, tx), tx).collect()
    want = sorted((r.id, r.lib, len(r.v), int(sum(r.v)), int(sum(i * x for i, x in enumerate(r.v)))) for r in v)
    assert sorted(map(tuple, S.site_moments(sites, tx).collect())) == want and len(want) > 40


@pytest.mark.parametrize("name", ["site_vector", "stored_base_values"])
def test_no_place_meets_a_transcript(spark, name):
    """Sums are looked up at the ends of transcripts: no vector is collected, and no join is by bins."""
    from locusflow.plans.catalog import QUERIES
    from tests.conftest import SMALL

    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "_bin" not in plan
