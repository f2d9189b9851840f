"""Jobs over stored tables: `python -m locusflow.cli JOB --sites DIR --transcripts DIR --out DIR ...`.

Tables are Parquet with the columns of the operators: sites (chrom, pos, strand, lib), transcripts (id, chrom, start, end,
strand, type), features (id, fname, f_start, f_end, strand, start, end), sequences (id, seq, role).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.config import Settings
from locusflow.functions import vectors as V
from locusflow.operators import background as BG
from locusflow.operators import clusters as C
from locusflow.operators import density as D
from locusflow.operators import enrich as E
from locusflow.operators import kmers as K
from locusflow.operators import signal as S


def density_rows(sites: DataFrame, transcripts: DataFrame, features: DataFrame, ip: str, ctrl: str, method: str | None, settings: Settings, normalized: bool = True) -> DataFrame:
    """id, fname, side, v: windows of every feature aligned left and right, of background-removed and normalised signal.

    Values are cut from the sparse profile, so a vector has the window's length and never the transcript's; places without
    counts have the value that the method gives them.
    """
    pairs = BG.paired(S.profile(sites, transcripts), ip, [ctrl])
    lengths = transcripts.select("id", (F.col("end") - F.col("start") + 1).alias("length"))
    values = BG.remove_background(pairs, lengths, method)
    return D.feature_windows(BG.normalize(values) if normalized else values, features, settings.length)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="locusflow")
    p.add_argument("job", choices=["density", "enrich", "regions", "clusters", "kmers"])
    for name in ("sites", "transcripts", "features", "sequences"):
        p.add_argument(f"--{name}")
    p.add_argument("--out", required=True)
    p.add_argument("--ip", default="rep1")
    p.add_argument("--ctrl", default="ctrl1")
    p.add_argument("--background", default="relative information", choices=[str(m) for m in V.METHODS])
    p.add_argument("--raw", action="store_true", help="no normalisation")
    p.add_argument("--drop", type=int, default=5, help="largest values left out of tests")
    p.add_argument("--pval", type=float, default=1e-3)
    p.add_argument("--fold", type=float, default=8.0)
    p.add_argument("--eps", type=int, default=50)
    p.add_argument("--min-samples", type=int, default=4)
    p.add_argument("--size", type=int, default=30)
    p.add_argument("-k", type=int, default=7)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"locusflow-{a.job}").getOrCreate()
    read = lambda name: spark.read.parquet(getattr(a, name))
    method = None if a.background == "None" else a.background
    if a.job in ("density", "enrich"):
        side = lambda ip, m: density_rows(read("sites"), read("transcripts"), read("features"), ip, a.ctrl, m, Settings(), not a.raw)
        out = side(a.ip, method)
        if a.job == "enrich":
            both = side(a.ip, None).withColumn("is_ip", F.lit(True)).unionByName(side(a.ctrl, None).withColumn("is_ip", F.lit(False)))
            x = E.trimmed(D.long(both), ["fname", "side", "pos", "is_ip"], a.drop)
            out = E.fdr(E.ks_enrichment(x, ["fname", "side", "pos"], F.col("is_ip")), ["fname", "side"], ties=["pos"])
    elif a.job == "regions":
        n = S.site_counts(read("sites").filter(F.col("lib").isin(a.ip, a.ctrl)), read("transcripts"))
        counts = n.groupBy("id").agg(*(F.sum(F.when(F.col("lib") == x, F.col("n")).otherwise(0)).alias(c) for x, c in ((a.ip, "ip"), (a.ctrl, "ctrl"))))
        t = read("sites").agg(F.count_if(F.col("lib") == a.ip).alias("i"), F.count_if(F.col("lib") == a.ctrl).alias("c")).first()
        out = E.call_regions(E.region_tests(counts, t["i"], t["c"]), read("transcripts").count(), a.pval, a.fold)
    elif a.job == "clusters":
        s = read("sites").filter(F.col("lib").isin(a.ip, a.ctrl)).withColumn("is_ip", F.col("lib") == a.ip)
        keys = ["chrom", "strand"]
        totals = s.groupBy(*keys).agg(F.count_if("is_ip").alias("ip"), F.count_if(~F.col("is_ip")).alias("input"))
        out = C.split(C.score(C.fixed_size(C.dbscan(s, keys, a.eps, a.min_samples), a.size), totals, keys))
    else:
        out = K.r_values(read("sequences"), a.k)
    out.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
