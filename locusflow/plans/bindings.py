"""Logical tables over the driver's tables, in Spark and, for the oracles, as common table expressions in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.store import dealt

EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, chrom, pos (minute), strand, lib, value, k of each event."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    lib = F.when(F.col("event_type") == "click", "rep1").when(F.col("event_type") == "purchase", "rep2").when(F.col("event_type") == "view", "ctrl1")
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 5).alias("chrom"), F.floor((F.floor(micros / 1_000_000) - EPOCH) / 60).cast("bigint").alias("pos"),
        F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"),
        lib.when(F.col("event_type") == "signup", "ctrl2").otherwise("other").alias("lib"), "value",
        F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("k"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "chrom", "pos", "strand", "lib")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("event_id", "chrom", "strand", F.col("pos").alias("start"), (F.col("pos") + 1 + F.floor("value").cast("bigint")).alias("end"), "value", "lib")


def _reads(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    flag = F.when(F.col("strand") == "-", 16).otherwise(0) + F.when(F.floor(i / 2) % 2 == 0, 128).otherwise(64) + F.when(i % 17 == 0, 4).otherwise(0) + F.when(i % 23 == 0, 256).otherwise(0)
    return e.withColumn("flag", flag.cast("int"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flag, cigar, base and indel of one read an event."""
    i = F.col("event_id")
    cigar = F.when(F.col("k") % 3 == 0, F.concat(F.lit("30M"), (F.col("k") * 90).cast("string"), F.lit("N20M"))).otherwise("50M")
    return _reads(events(spark, sf_dir)).select(
        "event_id", "chrom", "pos", "strand", "lib", "flag", cigar.alias("cigar"),
        F.element_at(F.array(*map(F.lit, "ACGT")), (i * 7 % 4 + 1).cast("int")).alias("base"),
        F.when(i % 11 == 0, -1).when(i % 13 == 0, 2).otherwise(0).alias("indel"),
    )


def _cigar(i: Column) -> Column:
    return (
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("30M"), ((F.col("k") + 1) * 90).cast("string"), F.lit("N20M"))).when(i % 11 == 0, "20M3D30M")
        .when(i % 13 == 0, "25M2I23M").when(i % 7 == 0, "5S45M").otherwise("50M")
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read an event, with a CIGAR of matches, skips, deletions, insertions or clips and its 50 bases."""
    i = F.col("event_id")
    seq = F.substring(F.lit("ACGTTGCAGT" * 6), (i % 10 + 1).cast("int"), F.lit(50))
    return _reads(events(spark, sf_dir)).select("event_id", "chrom", "pos", "strand", "lib", "flag", _cigar(i).alias("cigar"), seq.alias("seq"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mates an event on opposite strands, most of which overlap; bases mostly agree, a third of qualities is low."""
    i = F.col("event_id")
    e = events(spark, sf_dir).withColumn("mate", F.explode(F.array(F.lit(1), F.lit(2))))
    second, minus = F.col("mate") == 2, F.col("strand") == "-"
    pos = F.col("pos") + F.when(second, i * 7 % 60).otherwise(0)
    flag = 3 + F.when(second, 128).otherwise(64) + F.when(minus != second, 16).otherwise(0) + F.when(i % 19 == 0, 1024).otherwise(0) - F.when(i % 29 == 0, 2).otherwise(0)
    e = e.select("event_id", "chrom", pos.alias("pos"), "lib", flag.cast("int").alias("flag"), "mate", "k")
    seq = F.substring(F.lit("ACGTTGCAGT" * 7), (F.pmod("pos", F.lit(10)) + F.when((i % 5 == 0) & (F.col("mate") == 2), 1).otherwise(0) + 1).cast("int"), F.lit(50))
    qual = F.substring(F.lit("+5I.?#A9-E" * 7), (i % 7 + F.col("mate") * 2 + 1).cast("int"), F.lit(50))
    return e.select(F.concat(F.lit("f"), i.cast("string")).alias("name"), "chrom", "pos", "lib", "flag", _cigar(i + F.col("mate")).alias("cigar"), seq.alias("seq"), F.when(i % 31 != 0, qual).alias("qual"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    start = k * 7919 % 40000
    return o.select(
        k.alias("id"), (F.col("o_custkey") % 5).alias("chrom"), start.alias("start"), (start + 100 + k * 31 % 2000).alias("end"),
        F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.col("o_orderpriority").alias("type"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, fname, f_start, f_end (sets) with the transcript's chrom, start, end, strand; dealt by id, to tasks of bounded size."""
    li, tx = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag"), transcripts(spark, sf_dir).drop("type")
    n = max(li.count(), tx.count())
    joined = dealt(li, "l_orderkey", rows=n).join(dealt(tx, "id", rows=n), F.col("l_orderkey") == F.col("id"))
    f_start = F.col("start") + F.col("l_partkey") * 13 % (F.col("end") - F.col("start"))
    fname = F.when(F.col("l_returnflag") == "N", "exon").when(F.col("l_returnflag") == "R", "intron").otherwise("CDS")
    return joined.select(
        "id", fname.alias("fname"), f_start.alias("f_start"), F.least("end", f_start + F.floor("l_quantity").cast("bigint")).alias("f_end"), "chrom", "start", "end", "strand"
    ).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, rep (10 labels), v: 64 doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("rep"), F.col("embedding").cast("array<double>").alias("v"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, role: documents with quality 1 as IP and 0 as Input; letters only, lower case."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"), F.when(F.col("quality") == 1, "ip").otherwise("input").alias("role"))


CTE = {
    "ev": f"""ev AS (SELECT event_id, user_id % 5 AS chrom, CAST(floor((epoch_us(ts) // 1000000 - {EPOCH}) / 60) AS BIGINT) AS pos,
  CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CASE event_type WHEN 'click' THEN 'rep1' WHEN 'purchase' THEN 'rep2' WHEN 'view' THEN 'ctrl1' WHEN 'signup' THEN 'ctrl2' ELSE 'other' END AS lib,
  value, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)""",
    "cov": """cov AS (SELECT event_id, chrom, strand, pos AS s, pos + 1 + CAST(floor(value) AS BIGINT) AS e, value, lib FROM ev)""",
    "rd": """rd AS (SELECT event_id, chrom, pos, strand, lib,
  CAST((CASE WHEN strand = '-' THEN 16 ELSE 0 END) + (CASE WHEN (event_id // 2) % 2 = 0 THEN 128 ELSE 64 END) + (CASE WHEN event_id % 17 = 0 THEN 4 ELSE 0 END)
    + (CASE WHEN event_id % 23 = 0 THEN 256 ELSE 0 END) AS INTEGER) AS flag,
  CASE WHEN k % 3 = 0 THEN '30M' || (k * 90) || 'N20M' ELSE '50M' END AS cigar, substr('ACGT', CAST(event_id * 7 % 4 + 1 AS INTEGER), 1) AS base,
  CASE WHEN event_id % 11 = 0 THEN -1 WHEN event_id % 13 = 0 THEN 2 ELSE 0 END AS indel FROM ev)""",
    "al": """al AS (SELECT event_id, rd.chrom, rd.pos, rd.strand, rd.lib, rd.flag, CASE WHEN k % 3 = 0 THEN '30M' || ((k + 1) * 90) || 'N20M' WHEN event_id % 11 = 0 THEN '20M3D30M'
  WHEN event_id % 13 = 0 THEN '25M2I23M' WHEN event_id % 7 = 0 THEN '5S45M' ELSE '50M' END AS cigar, substr(repeat('ACGTTGCAGT', 6), CAST(event_id % 10 + 1 AS BIGINT), 50) AS seq FROM rd JOIN ev USING (event_id)),
co AS (SELECT * EXCLUDE (ns, os), CAST(ns[i] AS BIGINT) AS n, os[i] AS op FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM (SELECT *, regexp_extract_all(cigar, '(\\d+)([MIDNS])', 1) AS ns, regexp_extract_all(cigar, '(\\d+)([MIDNS])', 2) AS os FROM al))),
pl AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END) OVER b, 0)::BIGINT AS ref, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN n ELSE 0 END) OVER b, 0)::BIGINT AS query,
  lead(op) OVER (PARTITION BY event_id ORDER BY i) AS nxt FROM co WINDOW b AS (PARTITION BY event_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "fr": """fm AS (SELECT ev.*, unnest([1, 2]) AS mate FROM ev),
fq AS (SELECT 'f' || event_id AS name, chrom, lib, event_id, mate, k, pos + CASE mate WHEN 2 THEN event_id * 7 % 60 ELSE 0 END AS pos,
  3 + CASE mate WHEN 2 THEN 128 ELSE 64 END + CASE WHEN (strand = '-') <> (mate = 2) THEN 16 ELSE 0 END + CASE WHEN event_id % 19 = 0 THEN 1024 ELSE 0 END - CASE WHEN event_id % 29 = 0 THEN 2 ELSE 0 END AS flag FROM fm),
fr AS (SELECT name, mate, chrom, lib, pos, CAST(flag AS INTEGER) AS flag, CASE WHEN k % 3 = 0 THEN '30M' || ((k + 1) * 90) || 'N20M' WHEN (event_id + mate) % 11 = 0 THEN '20M3D30M'
  WHEN (event_id + mate) % 13 = 0 THEN '25M2I23M' WHEN (event_id + mate) % 7 = 0 THEN '5S45M' ELSE '50M' END AS cigar,
  substr(repeat('ACGTTGCAGT', 7), CAST((pos % 10 + 10) % 10 + CASE WHEN event_id % 5 = 0 AND mate = 2 THEN 1 ELSE 0 END + 1 AS BIGINT), 50) AS seq,
  CASE WHEN event_id % 31 <> 0 THEN substr(repeat('+5I.?#A9-E', 7), CAST(event_id % 7 + mate * 2 + 1 AS BIGINT), 50) END AS qual FROM fq),
fo AS (SELECT * EXCLUDE (ns, os), CAST(ns[i] AS BIGINT) AS n, os[i] AS op FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM (SELECT *, regexp_extract_all(cigar, '(\\d+)([MIDNS])', 1) AS ns, regexp_extract_all(cigar, '(\\d+)([MIDNS])', 2) AS os FROM fr))),
fp AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END) OVER b, 0)::BIGINT AS ref, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN n ELSE 0 END) OVER b, 0)::BIGINT AS query,
  lead(op) OVER (PARTITION BY name, mate ORDER BY i) AS nxt FROM fo WINDOW b AS (PARTITION BY name, mate ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "tx": """tx AS (SELECT o_orderkey AS id, o_custkey % 5 AS chrom, o_orderkey * 7919 % 40000 AS s, o_orderkey * 7919 % 40000 + 100 + o_orderkey * 31 % 2000 AS e,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderpriority AS type FROM orders)""",
    "ft": """ft AS (SELECT DISTINCT id, CASE l_returnflag WHEN 'N' THEN 'exon' WHEN 'R' THEN 'intron' ELSE 'CDS' END AS fname, s + l_partkey * 13 % (e - s) AS fs,
  least(e, s + l_partkey * 13 % (e - s) + CAST(floor(l_quantity) AS BIGINT)) AS fe, chrom, s, e, strand FROM lineitem JOIN tx ON l_orderkey = id)""",
    "vec": """vec AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS rep, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)""",
    "vl": """vl AS (SELECT id, rep, p - 1 AS pos, v[p] AS x FROM vec, (SELECT unnest(range(1, 65)) AS p))""",
    "sq": """sq AS (SELECT doc_id AS id, text AS seq, CASE WHEN quality = 1 THEN 'ip' ELSE 'input' END AS role FROM documents JOIN labels USING (doc_id))""",
    "raw": """raw AS (SELECT id, lib, CASE tx.strand WHEN '-' THEN e - pos ELSE pos - s END AS rp, count(*) AS n FROM tx JOIN ev ON ev.chrom = tx.chrom AND ev.strand = tx.strand
  AND pos BETWEEN s AND e GROUP BY ALL)""",
}
NEEDS = {"cov": ["ev"], "rd": ["ev"], "al": ["rd"], "fr": ["ev"], "ft": ["tx"], "vl": ["vec"], "raw": ["ev", "tx"]}


def sql(names: str, body: str) -> str:
    """body (further `name AS (...)` or a SELECT) after the named common table expressions and those they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    body = body.strip()
    return "WITH " + ",\n".join(CTE[n] for n in order) + ("\n" if body.upper().startswith("SELECT") else ",\n") + body
