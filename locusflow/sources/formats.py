"""Text formats around the engine, as DataFrames, through Spark's own readers; binary ones are in `binary`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators.annotation import parse_attributes, strip_version
from locusflow.sources.binary import READS, RUNS, read_bam, read_bigwig  # noqa: F401  (readers of one place)

BED = ("chrom", "start", "end", "name", "score", "strand")


def _tsv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, comment="#", **options)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chrom string, start bigint, end bigint, name string, score string, strand string")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Half-open, 0-based intervals with their attributes as a map."""
    df = _tsv(spark, path, "chrom string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attrs string")
    return df.withColumns({"start": F.col("start") - 1, "attrs": parse_attributes(F.col("attrs"))})


def bed_from_string(spark: SparkSession, text: str) -> DataFrame:
    rows = [(p + [None] * 6)[:6] for p in (line.split() for line in text.splitlines()) if p]
    return spark.createDataFrame([(p[0], int(p[1]), int(p[2]), *p[3:]) for p in rows], "chrom string, start bigint, end bigint, name string, score string, strand string")


def write_bed(df: DataFrame, path: str) -> None:
    """The six columns of a BED file; absent ones are dots. Every row is written, repeated ones too."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) if c in df.columns else F.lit(".").alias(c) for c in BED]
    df.select(*cols).write.mode("overwrite").csv(path, sep="\t")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id and ord (place in the file; one file) of a list with an id a line."""
    return spark.read.text(path).select(F.rtrim("value").alias("id"), F.monotonically_increasing_id().alias("ord")).filter("id <> ''")


def write_ids(df: DataFrame, path: str) -> None:
    df.select(F.col("id").cast("string")).write.mode("overwrite").text(path)


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """chrom, chunk, seq: records cut into chunks of fixed size.

    A file is split at its record marks; each record is one row on the way.
    """
    records = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    name = F.split(F.split("value", "\n")[0], r"\s+")[0]
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    r = records.select(name.alias("chrom"), seq.alias("seq")).filter(F.length("seq") > 0)
    return r.select("chrom", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("chunk", "seq")).withColumn("chunk", F.col("chunk").cast("bigint"))


def read_polya_atlas(spark: SparkSession, path: str, kinds: list[str] | None = None, least: float = 0.2) -> DataFrame:
    """Poly-A sites of the given kinds and an expression over `least`; chromosomes get the prefix chr."""
    df = _tsv(spark, path, "chrom string, start bigint, end bigint, name string, average_expression double, strand string, perc_sample double, n_sample double, avg_tpm double, polyatype string, polyasignal string")
    df = df.withColumn("chrom", F.concat(F.lit("chr"), "chrom")).filter(F.col("average_expression") > least)
    return df.filter(F.col("polyatype").isin(kinds)) if kinds else df


def read_branchpoints(spark: SparkSession, path: str) -> DataFrame:
    """Predicted branch points: CSV with a header and 1-based starts."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.select(F.col("chromosome").alias("chrom"), (F.col("start").cast("bigint") - 1).alias("start"), F.col("end").cast("bigint").alias("end"), "strand")


def read_reactivity(spark: SparkSession, path: str) -> DataFrame:
    """id, length, coverage, v: tab-separated values, NULL as missing."""
    p = F.split("value", "\t")
    return spark.read.text(path).select(
        p[0].alias("id"), p[1].try_cast("int").alias("length"), p[2].try_cast("double").alias("coverage"),
        F.transform(F.slice(p, F.lit(4), F.greatest(F.size(p) - 3, F.lit(0))), lambda x: x.try_cast("double")).alias("v"),
    )


def write_reactivity(df: DataFrame, path: str) -> None:
    """id, 1-based place and value, tab-separated; missing values as -999."""
    x = df.select("id", F.posexplode("v").alias("p", "x")).select("id", (F.col("p") + 1).alias("p"), F.coalesce("x", F.lit(-999.0)).alias("x"))
    x.write.mode("overwrite").csv(path, sep="\t")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region tables of other callers: chrom, start, end, gc, strand, two q-values, and a key from the place."""
    df = spark.read.csv(path, sep="\t", header=True)
    cast = {c: F.col(c).cast("bigint") for c in ("start", "end")} | {c: F.col(c).cast("double") for c in df.columns if c == "gc" or c.startswith("q_")}
    df = df.withColumnRenamed("chr", "chrom").withColumns(cast)
    return df.withColumn("region", F.concat_ws(":", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "strand"))


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """id, log2FoldChange, padj and the file's name parts (before the extension, split at _)."""
    df = spark.read.csv(path, sep="\t", header=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return df.select(F.col(df.columns[0]).alias("id"), F.col("log2FoldChange").cast("double").alias("log2FoldChange"), F.col("padj").cast("double").alias("padj"), F.split(stem, "_").alias("name_parts"))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Reproducible windows: one row for each of the colon-joined genes, versions stripped."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.withColumn("gene_id", F.explode(F.split("gene_id", ":"))).withColumn("gene_id", strip_version(F.col("gene_id")))


def read_fold(spark: SparkSession, path: str) -> DataFrame:
    """seq, structure and energy from fold output: the second and third line of each file."""
    p = F.split("value", "\n")
    return spark.read.text(path, wholetext=True).select(p[1].alias("seq"), F.split(p[2], " ")[0].alias("structure"), F.regexp_extract(p[2], r"\(\s*(-?[0-9.]+)\)\s*$", 1).try_cast("double").alias("energy"))


def write_density(df: DataFrame, path: str) -> None:
    """Density rows by experiment and feature, to be read with partition pruning."""
    df.write.mode("overwrite").partitionBy("uid", "fname").parquet(path)


def read_density(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_line(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path)


def path_template(template: str, **parts: str) -> str:
    return template.format(**parts)
