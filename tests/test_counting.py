"""Sums in intervals by running counts, and tails by incomplete functions, against plain counting."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.functions import stats as S
from locusflow.operators import signal as G


@pytest.mark.parametrize("piece", [3, 64, 4096])
def test_interval_sums(spark, monkeypatch, piece):
    monkeypatch.setattr(G, "COUNT_PIECE", piece)
    rng = random.Random(piece)
    points = [(rng.choice("ab"), rng.choice("+-"), rng.randrange(60), rng.choice(("x", "y", None)), rng.randrange(3)) for _ in range(300)]
    spans = [(i, rng.choice("abc"), rng.choice("+-"), s := rng.randrange(60), s + rng.choice((-1, 0, 1, 5, 40))) for i in range(80)]
    p = spark.createDataFrame(points, "chrom string, strand string, pos long, lib string, w int").withColumn("n", F.lit(1))
    r = spark.createDataFrame(spans, "id long, chrom string, strand string, start long, end long")
    want = {}
    for i, c, st, a, b in spans:
        for c2, st2, pos, lib, w in points:
            if (c, st) == (c2, st2) and a <= pos < b and lib is not None:
                n, t = want.get((i, lib), (0, 0))
                want[i, lib] = n + 1, t + w
    known = p.filter("lib is not null")
    got = {(x.id, x.lib): (x.n, x.w) for x in G.interval_sums(known, r, ["n", "w"], ["chrom", "strand"], ["lib"]).collect()}
    assert got == want
    whole = {x.id: x.n for x in G.interval_sums(p, r, ["n"], ["chrom"], []).collect()}
    assert whole == {i: n for i, c, _, a, b in spans if (n := sum(c == c2 and a <= pos < b for c2, _, pos, _, _ in points))}
    none = p.filter("pos < 0")
    assert G.interval_sums(none, r, ["n"], ["chrom"], ["lib"]).isEmpty() and G.interval_sums(none, r, ["n"], ["chrom"], []).isEmpty()
    assert G.interval_sums(p, r.filter("id < 0"), ["n"], ["chrom"], ["lib"]).isEmpty()


def test_tails():
    rng = random.Random(1)
    for _ in range(300):
        mu, k = rng.choice((0.01, 0.5, 3.0, 40.0, 600.0)) * rng.uniform(0.5, 2), rng.choice((0, 1, 5, 50, 700))
        want = 1 - math.fsum(math.exp(i * math.log(mu) - mu - math.lgamma(i + 1)) for i in range(k + 1))
        assert S.poisson_upper(k, mu) == pytest.approx(max(want, 0), rel=1e-9, abs=2e-13)
        n = rng.choice((1, 2, 10, 90, 900))
        k, p = rng.randrange(-1, n + 2), rng.choice((0.0, 1e-6, 0.2, 0.5, 0.97, 1.0))
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(0, min(k, n) + 1)) if k >= 0 else 0.0
        assert S.binomial_cdf(k, n, p) == pytest.approx(min(want, 1), rel=1e-9, abs=1e-13)
    x = np.array([0.3, 1.0, 2.5, 9.7, 150.0, 9_999.5, 2e6])
    assert S.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-13)
    assert S.poisson_upper(5, 0.0) == 0 and S.poisson_upper(-1, 3.0) == 1


def test_large_counts_are_fast():
    """A hundred thousand regions of a million reads: a loop over counts would take hours."""
    rng = np.random.default_rng(2)
    mu = rng.uniform(9e5, 1.1e6, 100_000)
    k = np.floor(mu + rng.normal(0, 3, len(mu)) * np.sqrt(mu))
    began = time.process_time()
    tail = S.poisson_tails(k, mu)
    cdf = S.binomial_cdfs(k, 2 * np.floor(mu), np.full(len(mu), 0.5))
    assert time.process_time() - began < 150
    z = (k + 0.5 - mu) / np.sqrt(mu)
    normal = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
    assert np.abs(tail - normal).max() < 1e-3 and ((0 <= cdf) & (cdf <= 1)).all()


def test_udfs(spark):
    rows = spark.createDataFrame([(25.0, 10.0), (None, 1.0), (0.0, 2.0)], "k double, mu double")
    got = [r.p for r in rows.select(S.poisson_upper_udf("k", "mu").alias("p")).collect()]
    assert got[0] == pytest.approx(1.768027e-05, rel=1e-5) and got[1] is None and got[2] == pytest.approx(1 - math.exp(-2))
