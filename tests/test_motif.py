"""Motif refinement finds a planted motif and leaves sequences without it out."""

import random

from locusflow.operators import kmers as K
from locusflow.operators import motif as M


def test_refinement(spark):
    random.seed(1)
    seqs, sites = [], []
    for i in range(120):
        s = "".join(random.choice("ACGU") for _ in range(40))
        if i < 80:
            s = s[:15] + "GCAUGC" + s[21:]
            sites += [(i, 17 + random.choice((0, 0, 1)), 3)]
        else:
            sites += [(i, random.choice((1, 38)), 1)]
        seqs.append((i, s))
    background = ["".join(random.choice("ACGU") for _ in range(40)) for _ in range(200)]
    ds = spark.createDataFrame(seqs, "id bigint, seq string")
    bg = K.background(spark.createDataFrame(list(enumerate(background)), "id bigint, seq string"), 6, 60, 10)
    bg = bg.withColumn("std", M.F.when(M.F.col("std") > 0, M.F.col("std")).otherwise(0.01))
    # A k-mer that the background lacks has no score, so the planted one is made known to it.
    bg = bg.unionByName(spark.createDataFrame([("GCAUGC", 0.001, 0.01)], "kmer string, mean double, std double")).dropDuplicates(["kmer"])
    out, log = M.refine(ds, spark.createDataFrame(sites, "id bigint, pos int, n bigint"), 6, bg, iterations=2, top=1)
    inc = {r.id for r in out.filter("include").collect()}
    assert log[0]["top"] == "GCAUGC"
    assert len(inc & set(range(80))) > 70 and len(inc & set(range(80, 120))) < 15


def test_best_window():
    m = M.matrix([("ACGU", 1.0)])
    assert M.best_window("GGACGUGG", m)[1] == 2
    assert M.best_window("AC", m) == (0.0, -1)
