"""Transcripts and their features: order, first and last, untranslated regions, introns, selections, file parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.intervals import merge, subtract

#: features: id, fname, f_start, f_end and the transcript's strand.


def ordered(features: DataFrame) -> DataFrame:
    """features with rank `ord` from 5' to 3': first_*, then the middle ones, then last_*; by start, or by end downwards on -."""
    tier = F.when(F.col("fname").startswith("first_"), 0).when(F.col("fname").startswith("last_"), 2).otherwise(1)
    place = F.when(F.col("strand") == "-", -F.col("f_end")).otherwise(F.col("f_start"))
    other = F.when(F.col("strand") == "-", -F.col("f_start")).otherwise(F.col("f_end"))
    base = F.regexp_replace("fname", "^(first_|last_)", "")
    return features.withColumn("ord", F.row_number().over(Window.partitionBy("id", base).orderBy(tier, place, other)))


def first_last(features: DataFrame, kinds: list[str]) -> DataFrame:
    """Renames the first and last (5' to 3') features of the given kinds to first_* and last_*; ties all count.

    A sole feature counts as both and appears twice.
    """
    w = Window.partitionBy("id", "fname")
    low, high = F.col("f_start") == F.min("f_start").over(w), F.col("f_end") == F.max("f_end").over(w)
    minus = F.col("strand") == "-"
    first, last = F.when(minus, high).otherwise(low), F.when(minus, low).otherwise(high)
    names = F.filter(F.array(F.when(first, F.concat(F.lit("first_"), "fname")), F.when(last, F.concat(F.lit("last_"), "fname"))), lambda x: x.isNotNull())
    named = F.when(F.col("fname").isin(kinds), F.when(F.size(names) > 0, names).otherwise(F.array("fname"))).otherwise(F.array("fname"))
    return features.withColumn("_names", named).withColumn("fname", F.explode("_names")).drop("_names")


def split_utr(features: DataFrame, utr: str = "UTR", cds: str = "CDS") -> DataFrame:
    """utr features named five_prime_UTR or three_prime_UTR by their side of the coding region; those inside it are dropped."""
    bounds = features.filter(F.col("fname") == cds).groupBy("id").agg(F.min("f_start").alias("lo"), F.max("f_end").alias("hi"))
    plus = F.col("strand") == "+"
    side = F.when(F.col("f_end") <= F.col("lo"), F.when(plus, "five_prime_UTR").otherwise("three_prime_UTR")).when(
        F.col("f_start") >= F.col("hi"), F.when(plus, "three_prime_UTR").otherwise("five_prime_UTR")
    )
    return features.filter(F.col("fname") == utr).join(bounds, "id").withColumn("fname", side).filter("fname is not null").drop("lo", "hi")


def introns(transcripts: DataFrame, exons: DataFrame) -> DataFrame:
    """Transcripts minus all exons of their strand, of any transcript."""
    return subtract(transcripts, exons, ["id"], stranded=True)


def exon_union(exons: DataFrame) -> DataFrame:
    return merge(exons, stranded=True)


def select_transcripts(transcripts: DataFrame, ids: DataFrame, n: int | None = 200, kind: str | None = "protein_coding") -> DataFrame:
    """The first n listed ids (id, ord), and of them those of the kind: the cut comes before the filter, repeats count.

    With fewer than n ids all are taken.
    """
    listed = ids if n is None else ids.orderBy("ord").limit(n)
    out = listed.join(transcripts, "id")
    return out if kind is None else out.filter(F.col("type") == kind)


def add_feature(features: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """features with the rows (id, strand, f_start, f_end) under a new name; sets, so repeats vanish."""
    return features.unionByName(rows.withColumn("fname", F.lit(name)).select(*features.columns)).dropDuplicates(["id", "fname", "f_start", "f_end"])


def parse_attributes(column) -> Column:
    """`k=v;k=v` as a map."""
    return F.str_to_map(F.regexp_replace(column, r"[;\s]+$", ""), F.lit(";"), F.lit("="))


def parse_polya_signals(df: DataFrame, column: str = "signals") -> DataFrame:
    """Rows of `motif@relative@observed;...` as motif, rel, pos (bigint); empty parts are skipped."""
    part = F.explode(F.filter(F.split(column, ";"), lambda s: F.length(F.trim(s)) > 0))
    at = lambda i: F.element_at(F.split(F.trim("_p"), "@"), i)
    return df.withColumn("_p", part).withColumns({"motif": at(1), "rel": at(2).cast("bigint"), "pos": at(3).cast("bigint")}).drop("_p")


def strip_version(column) -> Column:
    return F.substring_index(column, ".", 1)


def host_sides(nested: DataFrame) -> DataFrame:
    """up_start..up_end and down_start..down_end of hosts (strand, start, end) around features fs..fe, 5' to 3'."""
    plus = F.col("strand") == "+"
    low, high = ("start", "fs"), ("fe", "end")
    return nested.withColumns({
        "up_start": F.when(plus, F.col(low[0])).otherwise(F.col(high[0])), "up_end": F.when(plus, F.col(low[1])).otherwise(F.col(high[1])),
        "down_start": F.when(plus, F.col(high[0])).otherwise(F.col(low[0])), "down_end": F.when(plus, F.col(high[1])).otherwise(F.col(low[1])),
    })
