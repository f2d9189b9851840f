"""Filter stages drop rows by their own text, whatever their ids."""

import random

from locusflow.llm import common, decontam, quality

SCHEMA = "doc_id long, text string"


def clean(rng):
    return " ".join(rng.choice(["the", "of", "and", "to", "rivers", "stoned", "marketing", "garden", "gardens", "stones"]) + str(rng.randrange(9)) * (rng.random() < 0.6) for _ in range(120))


def test_quality(spark):
    rng = random.Random(4)
    good = [clean(rng) for _ in range(40)]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(good)] + [(None, ""), (None, None), (7, "too short"), (8, good[0])]
    left = quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = {r.text for r in quality.score_documents(spark.createDataFrame(list(enumerate(good)), SCHEMA)).filter("kept").join(spark.createDataFrame(list(enumerate(good)), SCHEMA), "doc_id").collect()}
    assert len(kept) > 30
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted((d or 0, t) for d, t in rows if t in kept)


def test_decontamination(spark, monkeypatch):
    item = "a train travels from here to there and back again while all of them wait at home"
    rows = [(None, "so " + item), (None, "clean text"), (None, None), (5, item), (5, "clean as well"), (5, "")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for limit in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        left = decontam.drop_contaminated(spark.createDataFrame(rows, SCHEMA), bench)
        assert sorted((r.doc_id or 0, r.text or "-") for r in left.collect()) == [(0, "-"), (0, "clean text"), (5, "-"), (5, "clean as well")]
        assert left.columns == ["doc_id", "text"]
