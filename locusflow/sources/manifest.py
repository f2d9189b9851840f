"""Experiment manifests: one wide row an experiment, columns named kind[_control][_replicate]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"^(bam|plus|minus|bed|idr)(?:_(control))?(?:_(\d+))?$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with a header; an unnamed first column is its index and dropped."""
    df = spark.read.csv(path, header=True)
    return df.drop("_c0") if "_c0" in df.columns else df


def unpivot(manifest: DataFrame) -> DataFrame:
    """uid, rbp, lib, role (ip, ctrl), pair, kind, path. Replicates count from 0; libraries are rep1.. and ctrl or ctrl1.. ."""
    import re

    names = [c for c in manifest.columns if re.match(NAME, c)]
    rbp = next((c for c in manifest.columns if c.lower() == "rbp"), None)
    wide = manifest.select("uid", (F.col(rbp) if rbp else F.lit(None).cast("string")).alias("rbp"), *names)
    x = wide.unpivot(["uid", "rbp"], names, "_c", "path").filter("path is not null")
    pair = F.nullif(F.regexp_extract("_c", NAME, 3), F.lit("")).cast("bigint")
    role = F.when(F.col("_c").contains("control"), "ctrl").otherwise("ip")
    lib = F.when(role == "ip", F.concat(F.lit("rep"), (F.coalesce(pair, F.lit(0)) + 1).cast("string"))).when(pair.isNull(), "ctrl").otherwise(F.concat(F.lit("ctrl"), (pair + 1).cast("string")))
    return x.select("uid", "rbp", lib.alias("lib"), role.alias("role"), pair.alias("pair"), F.regexp_extract("_c", NAME, 1).alias("kind"), "path")


def one_experiment(manifest: DataFrame, uid: str) -> DataFrame:
    """The row of a uid; an error if there is none or more than one."""
    rows = manifest.filter(F.col("uid") == uid)
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError(f"{n} rows for uid {uid!r}, one expected" if n == 0 else f"several rows for uid {uid!r}")
    return rows


def catalog(parts: list[DataFrame]) -> DataFrame:
    """Manifests of different columns as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def missing_files(spark: SparkSession, unpivoted: DataFrame) -> list[str]:
    """Paths that do not exist, asked of their file systems on the driver (a manifest has few)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = sorted({r["path"] for r in unpivoted.select("path").distinct().collect()})
    return [p for p in paths if not (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
