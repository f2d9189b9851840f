"""Tests by position and by region: Kolmogorov-Smirnov, signed ranks, thresholds, Poisson calls, false discovery rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions import stats as S


def trimmed(x: DataFrame, keys: list[str], drop: int) -> DataFrame:
    """Values (column x) without the `drop` largest of each group; missing ones count as 0."""
    x = x.withColumn("x", F.coalesce("x", F.lit(0.0)))
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy("x", *[c for c in ("id",) if c in x.columns]))
    return x.withColumns({"_r": rank, "_n": F.count(F.lit(1)).over(w)}).filter(F.col("_r") <= F.col("_n") - drop).drop("_r", "_n")


def ks_statistic(x: DataFrame, keys: list[str], sample: Column) -> DataFrame:
    """n_ip, n_null, d_less (null above ip) and d_greater by keys. sample: true for ip, false for null.

    Values are counted first; cumulated counts step once at ties.
    """
    points = x.groupBy(*keys, "x").agg(F.count_if(sample).alias("a"), F.count_if(~sample).alias("b"))
    over = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    c = points.withColumns({"ca": F.sum("a").over(over), "cb": F.sum("b").over(over), "na": F.sum("a").over(whole), "nb": F.sum("b").over(whole)}).filter("na > 0 and nb > 0")
    gap = F.col("cb") / F.col("nb") - F.col("ca") / F.col("na")
    return c.groupBy(*keys).agg(
        F.max("na").alias("n_ip"), F.max("nb").alias("n_null"), F.greatest(F.max(gap), F.lit(0.0)).alias("d_less"), F.greatest(F.max(-gap), F.lit(0.0)).alias("d_greater")
    )


def ks_enrichment(x: DataFrame, keys: list[str], sample: Column, both_sides: bool = False) -> DataFrame:
    """stat and pval by keys: ip larger than null; with both_sides the likelier side, negative where ip is smaller."""
    d = ks_statistic(x, keys, sample)
    less = S.ks_p_udf(F.col("d_less"), F.col("n_ip"), F.col("n_null"))
    if not both_sides:
        return d.select(*keys, F.col("d_less").alias("stat"), less.alias("pval"))
    d = d.withColumns({"p_less": less, "p_greater": S.ks_p_udf(F.col("d_greater"), F.col("n_ip"), F.col("n_null"))})
    up = F.col("p_less") < F.col("p_greater")
    return d.select(*keys, F.when(up, F.col("d_less")).otherwise(-F.col("d_greater")).alias("stat"), F.least("p_less", "p_greater").alias("pval"))


def fdr(df: DataFrame, keys: list[str], p: str = "pval", ties: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: the least p * n / rank among this and the larger p-values of its group, at most 1."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(p, *(ties or [])))
    q = F.col(p) * F.col("_n") / F.col("_rank")
    ranked = df.withColumns({"_rank": rank, "_n": F.count(F.lit(1)).over(w)})
    return ranked.withColumn("fdr", F.least(F.min(q).over(w.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_rank", "_n")


def wilcoxon_enrichment(x: DataFrame, keys: list[str], sample: Column, drop: int = 0) -> DataFrame:
    """Signed ranks of sorted ip against sorted null values, after the largest are dropped: r_plus and pval ('greater').

    Where the differences sum to 0 the result is (0, 1). Ranks are windows; only one row a group reaches the tail's UDF.
    """
    sides = trimmed(x.withColumn("_ip", sample), [*keys, "_ip"], drop)
    place = F.row_number().over(Window.partitionBy(*keys, "_ip").orderBy("x"))
    pairs = sides.withColumn("_k", place).groupBy(*keys, "_k").agg(F.max(F.when(F.col("_ip"), F.col("x"))).alias("a"), F.max(F.when(~F.col("_ip"), F.col("x"))).alias("b"))
    diffs = pairs.filter("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    whole = diffs.groupBy(*keys).agg(F.sum("d").alias("_sum"), F.count_if(F.col("d") == 0).alias("_zeros"))
    out = whole.join(signed_rank_statistic(diffs, keys), keys, "left").na.fill(0, ["r_plus", "n", "ties"])
    ties = F.when((F.col("_zeros") > 0) & (F.col("ties") == 0), -1.0).otherwise(F.col("ties"))
    flat = F.abs("_sum") < 1e-12
    p = F.when(flat, 1.0).otherwise(S.wilcoxon_p_udf(F.col("r_plus"), F.col("n").cast("double"), ties))
    return out.select(*keys, F.when(flat, 0.0).otherwise(F.col("r_plus")).alias("r_plus"), p.alias("pval"))


def signed_rank_statistic(diffs: DataFrame, keys: list[str], d: str = "d") -> DataFrame:
    """r_plus and n of nonzero differences, ties at average ranks, and ties, the sum of t^3 - t over groups of t equal ones."""
    nz = diffs.filter(F.col(d) != 0).withColumn("_a", F.abs(d))
    w = Window.partitionBy(*keys)
    nz = nz.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_a")))
    nz = nz.withColumn("_r", F.rank().over(w.orderBy("_a")) + (F.col("_t") - 1) / 2)
    up = F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0))
    return nz.groupBy(*keys).agg(up.alias("r_plus"), F.count(F.lit(1)).alias("n"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("ties"))


def null_threshold(x: DataFrame, keys: list[str], pos: str = "pos", percentile: float = 0.99) -> DataFrame:
    """The percentile of x by keys and position; zeros take the nearest position's value that is not 0, of two the lower one's."""
    t = x.groupBy(*keys, pos).agg(F.percentile("x", F.lit(percentile)).alias("thr"))
    t = t.withColumn("_v", F.when(F.col("thr") != 0, F.struct(F.col(pos).alias("p"), F.col("thr").alias("t"))))
    w = Window.partitionBy(*keys).orderBy(pos)
    t = t.withColumns({"_b": F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.first("_v", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    nearer = F.when(F.col("_b").isNull() | (F.col("_a")["p"] - F.col(pos) < F.col(pos) - F.col("_b")["p"]), F.col("_a")).otherwise(F.col("_b"))
    return t.select(*keys, pos, F.coalesce(nearer, "_b")["t"].alias("thr"))


def mask_by_null(real: DataFrame, thresholds: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Values under the threshold of their position hidden (null), missing ones taken as 0."""
    x = real.join(thresholds, [*keys, pos]).withColumn("x", F.coalesce("x", F.lit(0.0)))
    return x.withColumn("masked", F.when(F.col("x") >= F.col("thr"), F.col("x")))


def mask_by_pvalue(stats: DataFrame, threshold: float) -> DataFrame:
    return stats.withColumn("masked", F.when(F.col("pval") <= threshold, F.col("stat")))


def region_tests(counts: DataFrame, ip_total: float, ctrl_total: float) -> DataFrame:
    """pval of ip reads against a Poisson rate from the control, and log2 fold; regions with both counts only, p below 0.05."""
    x = counts.filter("ip > 0 and ctrl > 0")
    mu = F.col("ctrl") / F.lit(float(ctrl_total)) * F.lit(float(ip_total))
    x = x.withColumns({
        "pval": S.poisson_upper_udf(F.col("ip").cast("double"), mu),
        "log2_fold": F.log2((F.col("ip") / F.lit(float(ip_total))) / (F.col("ctrl") / F.lit(float(ctrl_total)))),
    })
    return x.filter("pval < 0.05")


def call_regions(tests: DataFrame, regions: int, pval: float = 1e-3, fold: float = 3.0) -> DataFrame:
    """Regions that pass after Bonferroni; p-values of 0 take the second least value in use.

    The least values are two aggregates, not a sort.
    """
    least = tests.agg(F.min("pval").alias("p1"))
    second = tests.join(F.broadcast(least), F.col("pval") > F.col("p1")).agg(F.min("pval").alias("p2"))
    x = tests.crossJoin(F.broadcast(least)).crossJoin(F.broadcast(second))
    p = F.when(F.col("pval") == 0, F.coalesce("p2", "p1")).otherwise(F.col("pval"))
    x = x.withColumn("log10_padj", F.when(p > 0, F.log10(p * F.lit(float(regions))))).drop("p1", "p2")
    return x.filter((F.col("log10_padj") < F.log10(F.lit(float(pval)))) & (F.col("log2_fold") > F.log2(F.lit(float(fold)))))
