"""Site counts over a stream of events: the counting operators with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def site_counts(stream: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Events by (chrom, strand, lib) and time window. State is dropped once the watermark passes a window."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), "chrom", "strand", "lib").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "chrom", "strand", "lib", "n")
