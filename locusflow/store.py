"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task gets where a table is dealt by a key: sorts and hash tables of what follows stay at a few pages each.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None, per: int | None = None) -> DataFrame:
    """df dealt by keys to as many tasks as keep each at about `per` rows (TASK_ROWS if not given), whatever the settings say;
    what follows by these keys needs no further shuffle. `rows` is the number of rows, counted if it is not given."""
    n = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // (per or TASK_ROWS))), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, but only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.locusflow.store", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="locusflow-")
        spark.conf.set("spark.locusflow.store", at)
    return at.rstrip("/")


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """df written once and read again, so that no later step runs it anew; gone when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/locusflow-store/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "_r") -> DataFrame:
    """df with numbers from 0 in an order, without all rows in one task: ranges are stored, counted (a row each) and numbered
    by themselves."""
    ranged = settle(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranges")
    at, starts = 0, []
    for p, n in sorted((r["_pid"], r["n"]) for r in ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((p, at))
        at += n
    first = df.sparkSession.createDataFrame(starts, "_pid int, _first long")
    own = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return ranged.join(F.broadcast(first), "_pid").withColumn(name, F.col("_first") + own).drop("_pid", "_first")
