"""The numbers behind the figures: axis labels, heat maps, mean curves, enrichment curves, k-mer scatter, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions import vectors as V
from locusflow.operators import density as D

POINTS = ("branchpoint", "branchpoint_pred", "polyAsite", "polyAsignal")


def axis_label(fname: Column, side: Column, pos: Column, length: Column) -> Column:
    """Labels of positions: 0..L from the left, -L..0 to the right; the other way round for point features."""
    point = fname.isin(*POINTS)
    left = side == "left"
    return F.when(left == point, pos - length).otherwise(pos)


def heat_map(matrix: DataFrame, how: str = "mean") -> DataFrame:
    """Rows in sorted order: rank, id, v."""
    merged = D.merge_replicates(matrix, how).withColumn("_all", F.lit(1))
    return D.row_ranks(merged, ["_all"]).select("rank", "id", "v")


def mean_curve(matrix: DataFrame, keys: list[str], sigma: float | None = None, statistic: str = "mean") -> DataFrame:
    """keys, pos, center, low, high: mean or median with one standard error, smoothed along the positions if asked."""
    s = D.summary(matrix, keys).select(*keys, "pos", F.col(statistic).alias("center"), "sem")
    if sigma:
        rows = s.groupBy(*keys).agg(*(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(c, F.lit(0.0)).alias("x")))), lambda t: t["x"]).alias(c) for c in ("center", "sem")))
        rows = rows.select(*keys, V.gaussian(F.col("center"), sigma).alias("c"), V.gaussian(F.col("sem"), sigma).alias("s"))
        s = rows.select(*keys, F.posexplode(F.arrays_zip("c", "s")).alias("pos", "z")).select(*keys, "pos", F.col("z.c").alias("center"), F.col("z.s").alias("sem"))
    return s.select(*keys, "pos", "center", (F.col("center") - F.col("sem")).alias("low"), (F.col("center") + F.col("sem")).alias("high"))


def enrichment_curve(stats: DataFrame, threshold: float | None = None) -> DataFrame:
    return stats if threshold is None else stats.withColumn("stat", F.when(F.col("pval") <= threshold, F.col("stat")))


def labelled_kmers(r: DataFrame, ratio: float = 2.0, frequency: float = 0.125) -> DataFrame:
    """k-mers worth a label in a scatter plot."""
    return r.withColumn("labelled", (F.col("r_value") > ratio) | (F.col("ip_frequency") > frequency))
