"""The k-mer background at the reference's size."""

import pytest

from locusflow.operators import kmers as K
from locusflow.plans import bindings, catalog


def test_a_third_of_few_sequences(spark):
    """Of ten sequences four are drawn, so one that all contain has frequency 1."""
    seqs = spark.createDataFrame([(i, "ACGTA" + "CGT"[i % 3] * 3) for i in range(10)], "id bigint, seq string")
    bg = {r.kmer: (r.mean, r.std) for r in K.background(seqs, 5, 30, 20).collect()}
    assert bg["ACGTA"] == pytest.approx((1.0, 0.0))
    drawn = K.sample(seqs, "id", 4, 20).filter("id % 3 = 1").groupBy("iteration").count().collect()
    assert bg["TAGGG"][0] == pytest.approx(sum(r["count"] for r in drawn) / 4 / 20)


def test_rare_kmers_have_scores(spark, monkeypatch):
    """1,600 inputs, most with a k-mer of their own: 100 draws of 1,000 meet all of them."""
    word = lambda i: "".join("ACGT"[i >> s & 3] for s in (10, 8, 6, 4, 2, 0))
    rows = [(i, word(i)[1:], "input") for i in range(900)] + [(1024 + i, word(i)[1:], "input") for i in range(100, 800)] + [(5000 + i, word(i)[1:], "ip") for i in range(900)]
    monkeypatch.setattr(bindings, "sequences", lambda *_: spark.createDataFrame(rows, "id bigint, seq string, role string"))
    got = {r.kmer: r.z for r in catalog.kmer_zscore(spark, "").collect()}
    assert set(got) == {word(i)[1:] for i in range(900)}
