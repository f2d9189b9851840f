"""A store of density rows by experiment and feature, and which input of an analysis counts where several are given."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators.annotation import select_transcripts
from locusflow.operators.intervals import semi_overlap


class DensityStore:
    """Rows uid, fname, side, rep, id, v under one path, partitioned by uid and fname."""

    COLUMNS = ("side", "rep", "id", "v", "uid", "fname")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame) -> None:
        """Adds rows; those of an experiment and feature that the store already has are replaced, others stay."""
        out = rows.select(*self.COLUMNS).repartition("uid", "fname", F.pmod(F.xxhash64("id"), F.lit(8)))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("uid", "fname").parquet(self.path)

    def read(self, uid: str | None = None, features: list[str] | None = None) -> DataFrame:
        """Rows of an experiment and features; only their folders are read."""
        df = self.spark.read.schema("side string, rep string, id long, v array<double>, uid string, fname string").parquet(self.path)
        if uid is not None:
            df = df.where(F.col("uid") == uid)
        return df if features is None else df.where(F.col("fname").isin(features))

    def features(self, uid: str) -> list[str]:
        """Names of the features that the store has of an experiment."""
        return sorted(r["fname"] for r in self.read(uid).select("fname").distinct().collect())


@dataclass(frozen=True)
class Inputs:
    """What an analysis of one experiment may be given. `stored` are density rows; `metagenes` are features with all that a
    density needs (id, fname, f_start, f_end, strand, start, end); ids have id and ord; transcripts and the replicates'
    peaks (by name, in order) and reproducible peaks (`idr`) are intervals."""

    stored: DataFrame | None = None
    metagenes: DataFrame | None = None
    transcript_ids: DataFrame | None = None
    transcripts: DataFrame | None = None
    peaks: dict[str, DataFrame] | None = None
    idr: DataFrame | None = None


def reproducible(transcripts: DataFrame, idr: DataFrame | None, peaks: dict[str, DataFrame] | None) -> DataFrame:
    """Transcripts with a reproducible peak on their strand; without such peaks, with a peak of the first replicate."""
    use = idr if idr is not None else next((p for p in (peaks or {}).values() if p is not None), None)
    if use is None:
        raise ValueError("neither reproducible peaks nor those of a replicate")
    return semi_overlap(transcripts, use, ["id"])


def resolve(
    inputs: Inputs, genome: DataFrame, features: DataFrame, density: Callable[[DataFrame], DataFrame], n: int | None = 200, kind: str | None = "protein_coding"
) -> tuple[str, DataFrame]:
    """(what was used, density rows) of the first input there is: stored rows, metagenes, transcript ids, transcripts, and else
    the transcripts of reproducible peaks.

    genome: all transcripts (id, chrom, start, end, strand, type); features: theirs. `density` makes rows of features. Ids
    and transcripts are cut to the first n (by ord; by place) before those of the kind are taken.
    """
    if inputs.stored is not None:
        return "stored", inputs.stored
    if inputs.metagenes is not None:
        return "metagenes", density(inputs.metagenes)
    if inputs.transcript_ids is not None:
        used, ids = "transcript_ids", inputs.transcript_ids.select("id", "ord")
    else:
        used = "transcripts" if inputs.transcripts is not None else "reproducible"
        rows = inputs.transcripts if inputs.transcripts is not None else reproducible(genome, inputs.idr, inputs.peaks)
        ids = rows.select("id", F.struct("chrom", "start", "id").alias("ord"))
    chosen = select_transcripts(genome, ids, n, kind)
    return used, density(features.join(chosen.select("id").distinct(), "id", "left_semi"))
