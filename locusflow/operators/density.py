"""Density matrices: rows of vectors (id, rep, v), summaries by position, merging, scaling, convolution, sorting."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions import vectors as V
from locusflow.operators.background import Track
from locusflow.operators.signal import met
from locusflow.store import TASK_ROWS, dealt

REDUCERS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "std": F.stddev_pop, "sum": F.sum, "min": F.min, "max": F.max,
}


def long(matrix: DataFrame, value: str = "v") -> DataFrame:
    """One row for each value: the other columns, pos, x."""
    keep = [c for c in matrix.columns if c != value]
    return matrix.select(*keep, F.posexplode(value).alias("pos", "x"))


def summary(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """mean, median, std (population), sem (over all rows, missing ones included) and n by keys and position."""
    x = long(matrix).groupBy(*keys, "pos").agg(
        F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.stddev_pop("x").alias("std"), F.count(F.lit(1)).alias("n")
    )
    return x.withColumn("sem", F.col("std") / F.sqrt("n"))


def apply(matrix: DataFrame, reducer: str | Callable[[pd.Series], float], keys: list[str], axis: int = 0) -> DataFrame:
    """A reducer across rows at each position (axis 0), or within each row (axis 1); named ones stay in the JVM."""
    x = long(matrix)
    by = [*keys, "pos"] if axis == 0 else [c for c in matrix.columns if c != "v"]
    if isinstance(reducer, str):
        return x.groupBy(*by).agg(REDUCERS[reducer]("x").alias("value"))
    f = reducer

    def own(s: pd.Series) -> float:
        return float(f(s))

    return x.groupBy(*by).agg(F.pandas_udf(own, "double")("x").alias("value"))


def merge_replicates(matrix: DataFrame, how: str = "mean") -> DataFrame:
    """id, v: the mean over replicates at each position (missing ones left out), all rows, or those of one replicate."""
    if how == "concat":
        return matrix.select("id", "v")
    if how != "mean":
        return matrix.filter(F.col("rep").cast("string") == how).select("id", "v")
    means = long(matrix.select("id", "v")).groupBy("id", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def align(matrix: DataFrame, length: int, side: str) -> DataFrame:
    return matrix.withColumn("v", V.trim_or_pad(F.col("v"), length, side))


def concat_features(slices: DataFrame, order: list[str]) -> DataFrame:
    """id, v: the vectors of the named features of each id one after the other; absent ones are skipped."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("fname"))
    rows = slices.filter(F.col("fname").isin(order)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "v"))).alias("s"))
    return rows.select("id", F.flatten(F.transform("s", lambda x: x["v"])).alias("v"))


def scale(matrix: DataFrame, how: str) -> DataFrame:
    """Rows over their sum (`norm_by_sum`) or their maximum (`max_scalar`); null where that is 0."""
    d = V.total(F.col("v")) if how == "norm_by_sum" else F.array_max("v")
    return matrix.withColumn("v", V.let(d, lambda s: F.transform("v", lambda x: F.when(s != 0, x / s))))


def convolve_rows(matrix: DataFrame, kernel: list[float]) -> DataFrame:
    """Convolution within each row (axis 1)."""
    return matrix.withColumn("v", V.convolve_full(F.col("v"), kernel))


def convolve_across(matrix: DataFrame, kernel: list[float], keys: list[str], order: str = "row_no") -> DataFrame:
    """Convolution across the rows of a matrix (axis 0): keys, row, pos, x; `order` numbers the rows from 0 without gaps."""
    taps = F.explode(F.array(*(F.struct(F.lit(i).alias("d"), F.lit(float(w)).alias("w")) for i, w in enumerate(kernel))))
    x = long(matrix.select(*keys, F.col(order).alias("row"), "v")).select(*keys, "row", "pos", "x", taps.alias("t"))
    return x.groupBy(*keys, (F.col("row") + F.col("t.d")).alias("row"), "pos").agg(F.sum(F.col("x") * F.col("t.w")).alias("x"))


def smooth(matrix: DataFrame, sigma: float) -> DataFrame:
    return matrix.withColumn("v", V.gaussian(F.col("v"), sigma))


def row_ranks(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """rank: the place of each row in the order of its values, the first position first; missing values come last."""
    last = F.transform("v", lambda x: F.struct(x.isNull().alias("m"), x.alias("x")))
    return matrix.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(last, "id")))


def multi_feature_average(slices: DataFrame, length: int, side: str) -> DataFrame:
    """id, fname, v: the mean over the slices of a feature of one id, each first brought to `length`."""
    aligned = slices.select("id", "fname", V.trim_or_pad(F.col("v"), length, side).alias("v"))
    means = long(aligned).groupBy("id", "fname", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("id", "fname").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


#: Bins of positions that slices and values are joined by: about a slice's length, so that few candidates miss.
SLICE_BIN = 64


def feature_windows(values: DataFrame | Track, features: DataFrame, length: Callable[[str], int], sides: tuple[str, ...] = (V.LEFT, V.RIGHT)) -> DataFrame:
    """id, fname, side, v: for each feature of a transcript the mean of its slices, each brought to the feature's length.

    values: id, rp, value and zero, the value at positions without a row; or a `Track`, whose places meet the slices on the
    genome, so that no transcript's values are shuffled (features then have its chrom too). Features without any length give nothing, nor do
    transcripts without values. One join by bins serves all features and sides, and a transcript's values are never one
    row; null where no slice reaches.
    """
    minus = F.col("strand") == "-"
    of_track = isinstance(values, Track)
    keep = [F.col("chrom"), F.col("strand"), F.when(minus, F.col("f_start") + 1).otherwise(F.col("f_start")).alias("_a"), F.when(minus, F.col("f_end")).otherwise(F.col("f_end") - 1).alias("_z"), (F.col("end") - F.col("start")).alias("_last")] if of_track else []
    slices = features.select("id", "fname", *keep, F.when(minus, F.col("end") - F.col("f_end")).otherwise(F.col("f_start") - F.col("start")).alias("rs"), (F.col("f_end") - F.col("f_start")).alias("len")).filter("len > 0")
    names = sorted((r["fname"], r["count"]) for r in features.filter("fname is not null").groupBy("fname").count().collect())  # a few dozen names
    widths = features.sparkSession.createDataFrame([(n, length(n)) for n, _ in names], "fname string, width int")
    slices = slices.join(F.broadcast(widths), "fname")
    if of_track:
        reach = slices.withColumnsRenamed({"_a": "start", "_z": "end"}).join(values.known.drop("chrom", "strand", "start", "end"), "id")
        hits = met(reach, values.places, size=SLICE_BIN).withColumn("value", values.value).withColumnRenamed("rp", "_at").filter("rs + _at between 0 and _last")
        hits = hits.select("id", "fname", "width", "len", "_at", "value")
    else:
        bins = F.sequence(F.floor(F.col("rs") / SLICE_BIN), F.floor((F.col("rs") + F.col("len") - 1) / SLICE_BIN))
        hits = slices.withColumn("_bin", F.explode(bins)).join(values.select("id", "rp", "value", F.floor(F.col("rp") / SLICE_BIN).alias("_bin")), ["id", "_bin"])
        hits = hits.filter("rp >= rs and rp < rs + len").withColumn("_at", F.col("rp") - F.col("rs"))
    # Hits are dealt by transcript as they are; sides, sums and vectors follow where they lie.
    hits = dealt(hits.select("id", "fname", "width", "len", F.col("_at").cast("int").alias("_at"), "value"), "id", rows=sum(n for _, n in names), per=TASK_ROWS // 8)
    hits = hits.withColumn("side", F.explode(F.array(*map(F.lit, sides))))
    at = F.col("_at")
    hits = hits.withColumn("pos", F.when(F.col("side") == V.LEFT, at).otherwise(F.col("width") - F.col("len") + at).cast("int")).filter("pos >= 0 and pos < width")
    sums = hits.groupBy("id", "fname", "side", "pos").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    known = sums.groupBy("id", "fname", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "n"))).alias("_h"))
    zeros = values.zeros() if of_track else values.groupBy("id").agg(F.first("zero").alias("zero"))
    lens = slices.groupBy("id", "fname", "width").agg(F.array_sort(F.collect_list(F.least("len", F.col("width").cast("bigint")).cast("int"))).alias("_lens")).join(zeros, "id")
    # One row a transcript, so that this join is by transcript too and vectors are not shuffled again.
    name = F.concat_ws("\t", "side", "fname")
    known = known.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(name, "_h"))).alias("_of"))
    x = lens.join(known, "id", "left").withColumn("side", F.explode(F.array(*map(F.lit, sides)))).withColumn("_h", F.try_element_at("_of", name)).drop("_of")
    # Slices that reach each place are a step function of the sorted lengths, hits a sorted list: both become arrays by runs,
    # so a place costs one step, however many slices or hits there are.
    many = F.size("_lens")
    until = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_lens", i - 1))
    steps = F.concat(F.flatten(F.transform("_lens", lambda n, i: F.array_repeat(many - i, n - until(i)))), F.array_repeat(F.lit(0), F.col("width") - until(many)))
    own = F.coalesce("_h", F.array().cast("array<struct<pos:int,s:double,n:bigint>>"))
    x = x.withColumns({"_h": own, "_c": F.when(F.col("side") == V.LEFT, steps).otherwise(F.reverse(steps))})
    gap = lambda n: F.array_repeat(F.lit(None).cast("struct<pos:int,s:double,n:bigint>"), n)
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_h", i - 1)["pos"] + 1)
    placed = F.concat(F.flatten(F.transform("_h", lambda h, i: F.concat(gap(h["pos"] - after(i)), F.array(h)))), gap(F.col("width") - after(F.size("_h"))))
    mean = F.zip_with("_c", placed, lambda c, h: F.when(c > 0, (F.coalesce(h["s"], F.lit(0.0)) + F.col("zero") * (c - F.coalesce(h["n"], F.lit(0)))) / c))
    return x.select("id", "fname", "side", mean.alias("v"))


def wide_matrix(matrix: DataFrame, key: str, length: int, how: str = "mean") -> DataFrame:
    """key, v: one row of summaries for each key, missing as 0."""
    x = long(matrix).groupBy(key, "pos").agg(REDUCERS[how]("x").alias("x"))
    m = F.map_from_entries(F.collect_list(F.struct("pos", "x")))
    return x.groupBy(key).agg(m.alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: F.coalesce(F.col("m")[p], F.lit(0.0))).alias("v"))


def relative_entropy(matrix: DataFrame, ip: Column, null: Column) -> DataFrame:
    """By position: sum over rows of p ln(p/q), each column of either side over its sum; rows are paired by id."""
    x = long(matrix.select("id", F.when(ip, "ip").when(null, "null").alias("side"), "v").filter("side is not null"))
    both = x.groupBy("id", "pos").agg(F.sum(F.when(F.col("side") == "ip", F.col("x"))).alias("p"), F.sum(F.when(F.col("side") == "null", F.col("x"))).alias("q"))
    sums = both.groupBy("pos").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    y = both.join(sums, "pos").select("pos", (F.col("p") / F.col("sp")).alias("p"), (F.col("q") / F.col("sq")).alias("q"))
    return y.groupBy("pos").agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln(F.col("p") / F.col("q"))).otherwise(0.0)).alias("kl"))
