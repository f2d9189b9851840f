"""Secrets and spelt addresses of any length, whole."""

from pyspark.sql import functions as F

from locusflow.llm import pii


def test_long_ones_are_proposed(spark):
    found = ["0123456789abcdef" * 20, "ghp_" + "aB3" * 40, "sk_live_abcdef0123456789", "sk-proj-Ab1_cd-Ef2gh3Ij4kl", "xoxb-12345-67890-abcdefghij", "j" * 80 + " [at] " + "h" * 70 + " [dot] com", "a [at] b" + ".c" * 300]
    rows = spark.createDataFrame([(i, f"so {x} ends") for i, x in enumerate(found)], "doc_id long, text string")
    out = {r.doc_id: r.s for r in rows.select("doc_id", pii.settled(pii.proposals(F.col("text"))).alias("s")).collect()}
    assert all((pii.KINDS[s.kind], s.start, s.end) in {("secret", 3, 3 + len(x)), ("email", 3, 3 + len(x))} for i, x in enumerate(found) for s in out[i][-1:])
    assert all(out[i] for i in range(len(found)))


def test_long_texts_take_linear_time(spark):
    texts = ["z" * 300_000, "0" * 31 + "f" * 300_000 + "g", "sk-" + "x-" * 150_000 + "+", "a [at] b" + ".c" * 20_000 + "1"]
    rows = spark.createDataFrame([(i, t + " 1") for i, t in enumerate(texts)], "doc_id long, text string")
    n = rows.select(*(F.size(pii.matches(F.col("text"), p)).alias(k) for k, p in (("s", pii.SECRET), ("e", pii.SPELT_EMAIL)))).collect()
    assert [r.s or 0 for r in n] == [0, 0, 0, 0] and [r.e or 0 for r in n] == [0, 0, 0, 1]
