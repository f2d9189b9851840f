"""The density store's round trip and pruning, and the order in which inputs count."""

import pytest
from pyspark.sql import functions as F

from locusflow.sources.density_store import DensityStore, Inputs, reproducible, resolve

ROWS = "uid string, fname string, side string, rep string, id long, v array<double>"


def test_round_trip(spark, tmp_path):
    store = DensityStore(spark, str(tmp_path / "s"))
    rows = [(u, f, s, "rep1", i, [float(i), None, 0.5]) for u in ("a", "b") for f in ("exon", "intron") for s in ("left", "right") for i in range(4)]
    store.write(spark.createDataFrame(rows, ROWS).withColumn("more", F.lit(1)))
    names = [c.split()[0] for c in ROWS.split(", ")]
    plain = lambda df: sorted(map(repr, map(tuple, df.select(*names).collect())))
    assert plain(store.read()) == sorted(map(repr, rows))
    new = [("a", "exon", "left", "rep1", 9, [1.0]), ("c", "exon", "left", "rep1", 9, [2.0])]
    store.write(spark.createDataFrame(new, ROWS))
    want = [r for r in rows if r[:2] != ("a", "exon")] + new
    assert plain(store.read()) == sorted(map(repr, want))
    one = store.read("a", ["exon"])
    assert plain(one) == [repr(new[0])] and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert "uid" in filters and "fname" in filters
    assert store.features("a") == ["exon", "intron"] and store.features("c") == ["exon"] and store.features("z") == []


def test_precedence(spark):
    genome = spark.createDataFrame([(i, "c", i * 100, i * 100 + 50, "+-"[i % 2], "protein_coding" if i < 8 else "other") for i in range(10)], "id long, chrom string, start long, end long, strand string, type string")
    feats = spark.createDataFrame([(i, "exon") for i in range(10)], "id long, fname string")
    peak = lambda *ids: spark.createDataFrame([("c", i * 100 + 10, i * 100 + 12, "+-"[i % 2]) for i in ids], "chrom string, start long, end long, strand string")
    all_of = {
        "stored": spark.createDataFrame([(100,)], "id long"), "metagenes": feats.filter("id = 1"), "transcript_ids": spark.createDataFrame([(5, 0), (9, 1), (3, 2), (5, 3)], "id long, ord int"),
        "transcripts": genome.filter("id in (2, 4, 8)"), "peaks": {"rep1": peak(6, 7), "rep2": peak(0)}, "idr": peak(7, 9),
    }
    order = [("stored", [100]), ("metagenes", [1]), ("transcript_ids", [3, 5]), ("transcripts", [2, 4]), ("reproducible", [7])]
    for k, (name, ids) in enumerate(order):
        given = {n: v for n, v in all_of.items() if n not in [x for x, _ in order[:k]]}
        used, df = resolve(Inputs(**given), genome, feats, lambda x: x)
        assert used == name and sorted(r.id for r in df.collect()) == ids
    # The cut to n comes before the kind; without reproducible peaks the first replicate's count.
    assert sorted(r.id for r in resolve(Inputs(transcript_ids=all_of["transcript_ids"]), genome, feats, lambda x: x, n=2)[1].collect()) == [5]
    assert sorted(r.id for r in reproducible(genome, None, all_of["peaks"]).collect()) == [6, 7]
    assert sorted(r.id for r in resolve(Inputs(peaks=all_of["peaks"]), genome, feats, lambda x: x, kind=None)[1].collect()) == [6, 7]
    with pytest.raises(ValueError):
        resolve(Inputs(), genome, feats, lambda x: x)
