"""Reactivity windows around event sites, junction reads, paired tests, group comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions import stats as S
from locusflow.functions import vectors as V
from locusflow.operators.enrich import ks_statistic
from locusflow.operators.signal import interval_sums, junction


def windows_around(sites: DataFrame, shape: DataFrame, width: int) -> DataFrame:
    """id, rp, n (how often the site counts), v: shape values rp-width..rp+width-1; windows without any value are dropped."""
    x = sites.join(shape.select("id", F.col("v").alias("_s")), "id").withColumn("v", V.window(F.col("_s"), F.col("rp") - width, F.col("rp") + width))
    return x.filter(F.exists("v", lambda y: y.isNotNull())).drop("_s")


def signed_ks(d: DataFrame) -> DataFrame:
    """stat and pval from d_less, d_greater, n_ip, n_null: +D where the 'less' side is likelier, else -D."""
    d = d.withColumns({"p_less": S.ks_p_udf(F.col("d_less"), F.col("n_ip"), F.col("n_null")), "p_greater": S.ks_p_udf(F.col("d_greater"), F.col("n_ip"), F.col("n_null"))})
    less = F.col("p_less") < F.col("p_greater")
    return d.withColumns({"stat": F.when(less, F.col("d_less")).otherwise(-F.col("d_greater")), "pval": F.least("p_less", "p_greater")})


def junction_fractions(hits: DataFrame, keys: list[str], is_junction: Column, over: int) -> DataFrame:
    """Share of junction reads by keys, null where there are not more than `over` reads."""
    x = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(is_junction.cast("int")).alias("share"))
    return x.withColumn("share", F.when(F.col("n") > over, F.col("share")))


def junction_shares(reads: DataFrame, transcripts: DataFrame, over: int, intron: int = 500) -> DataFrame:
    """id, lib, n, share: junction reads among the reads that begin in each transcript, by library; counted by place."""
    points = reads.select("chrom", "strand", "pos", "lib", F.lit(1).alias("n"), junction(F.col("cigar"), intron).cast("int").alias("j"))
    x = interval_sums(points, transcripts, ["n", "j"], ["chrom", "strand"], ["lib"])
    return x.select("id", "lib", "n", F.when(F.col("n") > over, F.col("j") / F.col("n")).alias("share"))


def paired_t(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """n, t, p_greater and p_less of the paired t-test of a over b; pairs with a null are left out."""
    d = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    x = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_s"))
    x = x.withColumn("t", F.when(F.col("_s") > 0, F.col("_m") / (F.col("_s") / F.sqrt("n")))).drop("_m", "_s")
    return x.withColumn("p_greater", S.t_upper_udf(F.col("t"), (F.col("n") - 1).cast("double"))).withColumn("p_less", 1 - F.col("p_greater"))


def expression_groups(results: DataFrame, padj: float = 0.05, fold: float = 1.0) -> DataFrame:
    """id (version stripped) and direction (up, down) of significant rows of a differential-expression table."""
    way = F.when(F.col("log2FoldChange") > fold, "up").when(F.col("log2FoldChange") < -fold, "down")
    return results.filter(F.col("padj") < padj).select(F.substring_index("id", ".", 1).alias("id"), way.alias("direction")).filter("direction is not null")


def group_ks(density: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """direction, keys, n_ip, n_null, d_less, d_greater: rows (id, keys, x) of each group's ids against those of no group's."""
    names = groups.select("direction").distinct()  # two
    mine = density.join(groups.select("id", "direction"), "id", "left")
    rest = mine.filter("direction is null").drop("direction").crossJoin(F.broadcast(names)).withColumn("ip", F.lit(False))
    x = mine.filter("direction is not null").withColumn("ip", F.lit(True)).unionByName(rest)
    return ks_statistic(x.select("direction", *keys, "ip", "x"), ["direction", *keys], F.col("ip"))


def missing_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    return wanted.join(known.select("id"), "id", "left_anti")
