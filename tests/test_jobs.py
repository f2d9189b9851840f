"""The command line over small tables, and counts over a stream."""

import pytest
from pyspark.sql import functions as F

from locusflow import cli
from locusflow.plans import bindings as B
from locusflow.streaming.incremental import site_counts
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    for name in ("sites", "transcripts", "sequences"):
        getattr(B, name)(spark, SMALL).write.parquet(str(at / name))
    B.features(spark, SMALL).filter("fname = 'exon'").write.parquet(str(at / "features"))
    return at


@pytest.mark.parametrize("job", ["density", "enrich", "regions", "clusters", "kmers"])
def test_job(job, tables, spark, tmp_path):
    args = [x for n in ("sites", "transcripts", "features", "sequences") for x in (f"--{n}", str(tables / n))]
    cli.main([job, *args, "--out", str(tmp_path / "o"), "--background", "subtract", "--eps", "400", "-k", "3", "--fold", "1", "--pval", "0.9"])
    out = spark.read.parquet(str(tmp_path / "o"))
    if job == "density":
        assert out.select(F.max(F.size("v")).alias("m"), F.min(F.size("v")).alias("n")).first() == (100, 100)
    assert job == "regions" or out.count() > 0


def test_stream(spark, tmp_path):
    src = B.table(spark, SMALL, "events").withColumns({"chrom": F.col("user_id") % 5, "strand": F.lit("+"), "lib": F.col("event_type")}).select("ts", "chrom", "strand", "lib")
    src.write.parquet(str(tmp_path / "in"))
    q = site_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == src.count()
