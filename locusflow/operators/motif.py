"""Motifs: position weight matrices, best windows, crosslink preference, and their refinement by iteration."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHABET = "ACGU"
NO_MOTIF = -100.0


def matrix(kmers: Iterable[tuple[str, float]], pseudocount: float = 0.1) -> np.ndarray:
    """A weight matrix from k-mers of one length and their weights, each column over its largest entry."""
    rows = [(k.upper().replace("T", "U"), w) for k, w in kmers if set(k.upper().replace("T", "U")) <= set(ALPHABET)]
    if not rows:
        raise ValueError("no k-mers over the alphabet")
    m = np.full((len(rows[0][0]), len(ALPHABET)), pseudocount)
    for k, w in rows:
        for i, c in enumerate(k):
            m[i, ALPHABET.index(c)] += max(w, 0.0)
    return m / m.max(1, keepdims=True)


def best_window(seq: str, m: np.ndarray) -> tuple[float, int]:
    """(largest product of weights, its first place); (0, -1) for sequences shorter than the matrix."""
    code = np.array([ALPHABET.find(c) for c in seq.upper().replace("T", "U")])
    if len(code) < len(m):
        return 0.0, -1
    win = np.lib.stride_tricks.sliding_window_view(code, len(m))
    w = np.where(win >= 0, m[np.arange(len(m)), np.maximum(win, 0)], 0.0).prod(1)
    at = int(w.argmax())
    return float(w[at]), at


def score_windows(seqs: DataFrame, matrices: dict[str, np.ndarray]) -> DataFrame:
    """id, motif, score, place: the best window of each sequence under each matrix."""

    def run(frames):
        for f in frames:
            rows = [(i, name, *best_window(s or "", m)) for i, s in zip(f["id"], f["seq"], strict=True) for name, m in matrices.items()]
            yield pd.DataFrame(rows, columns=["id", "motif", "score", "place"])

    return seqs.select("id", "seq").mapInPandas(run, "id long, motif string, score double, place int")


def best_explained(scores: DataFrame) -> DataFrame:
    """The motif of largest score of each sequence (score, then name)."""
    return scores.groupBy("id").agg(F.max_by(F.struct("motif", "score", "place"), F.struct("score", "motif")).alias("b")).select("id", "b.*")


def preference(sites: DataFrame, windows: DataFrame, reach: int = 15, pseudocount: float = 1.0) -> DataFrame:
    """motif, offset, p: where events lie around a motif's window, -reach..reach; each sequence has the same weight.

    sites: id, pos, n (events on the sequence); windows: id, motif, place.
    """
    x = windows.join(sites, "id").withColumn("offset", F.col("pos") - F.col("place")).filter(F.abs("offset") <= reach)
    grid = windows.select("id", "motif", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset"))
    counted = x.groupBy("id", "motif", F.col("offset").cast("int").alias("offset")).agg(F.sum("n").alias("n"))
    y = grid.join(counted, ["id", "motif", "offset"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + pseudocount)
    sums = y.groupBy("id", "motif").agg(F.sum("n").alias("s"))
    return y.join(sums, ["id", "motif"]).groupBy("motif", "offset").agg(F.avg(F.col("n") / F.col("s")).alias("p"))


def likelihood(sites: DataFrame, windows: DataFrame, pref: DataFrame, reach: int = 15) -> DataFrame:
    """id, motif, loglik: mean log preference of a sequence's events; NO_MOTIF where none lies within reach."""
    x = windows.join(sites, "id", "left").withColumn("offset", (F.col("pos") - F.col("place")).cast("int"))
    y = x.join(F.broadcast(pref), ["motif", "offset"], "left")
    return y.groupBy("id", "motif").agg((F.sum(F.ln("p") * F.when(F.col("p").isNotNull(), F.col("n"))) / F.sum(F.when(F.col("p").isNotNull(), F.col("n")))).alias("l")).select("id", "motif", F.coalesce("l", F.lit(NO_MOTIF)).alias("loglik"))


def refine(seqs: DataFrame, sites: DataFrame, k: int, background: DataFrame, iterations: int = 5, top: int = 10, reach: int = 15) -> tuple[DataFrame, list[dict]]:
    """Iterates: enriched k-mers of the included sequences, their matrix, best windows, preference, likelihood, inclusion.

    Returns the last windows with `include` and a log of each round. A sequence is included when its likelihood exceeds
    that of a flat preference. Only the `top` k-mers and the preference, of 2 * reach + 1 rows, reach the driver.
    """
    from locusflow.operators.kmers import document_frequency, rna, z_scores

    seqs = seqs.withColumn("seq", rna(F.upper("seq"), F.lit("+")))
    included, log, out = seqs.select("id"), [], None
    flat = -math.log(2 * reach + 1)
    for step in range(iterations):
        part = seqs.join(included, "id", "left_semi")
        n = part.count()
        if not n:
            break
        observed = document_frequency(part, k).select("kmer", (F.col("n") / F.lit(n)).alias("f"))
        best = z_scores(observed, background).filter("z is not null and not contains(kmer, 'N')").orderBy(F.desc("z"), "kmer").limit(top).collect()
        if not best:
            break
        windows = best_explained(score_windows(seqs, {"motif": matrix([(r["kmer"], r["z"]) for r in best])}))
        pref = preference(sites, windows.join(included, "id", "left_semi"), reach)
        table = seqs.sparkSession.createDataFrame([tuple(r) for r in pref.select("motif", "offset", "p").collect()], "motif string, offset int, p double")
        out = likelihood(sites, windows, table, reach).join(windows, ["id", "motif"]).withColumn("include", F.col("loglik") > flat)
        kept = seqs.sparkSession.createDataFrame([], "id long") if out is None else out.filter("include").select("id")
        log.append({"iteration": step, "sequences": n, "top": best[0]["kmer"]})
        included = kept.checkpoint() if seqs.sparkSession.sparkContext.getCheckpointDir() else kept
    return out, log
