"""Motif refinement with a set of matrices: k-mers to families, matrices, best windows, event preference, likelihood.

Clusters are rows (id, strand, start, end, seq, pseudoscore) whose seq runs 5' to 3' from the cluster's 5' end; events are
(id, pos) in genome places, one row each. Each round takes the k-mers over the elbow of their z-scores among included
clusters, groups and aligns them into matrices, finds every cluster's best window of each (one numpy pass over an Arrow
batch), learns where events lie around the windows of the included clusters that each matrix explains best, scores all
clusters by that, and includes those over the elbow of the likelihoods. Tables between rounds are stored; the driver sees
only k-mers of the set, matrices and preferences.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators import kmers as K
from locusflow.operators.motif import ALPHABET
from locusflow.store import numbered, settle

#: Likelihood of a cluster whose best matrix explains no included one.
UNSEEN = -100.0
REACH = 15


def align(kmer: str, to: str, most_shift: int) -> tuple[int, int]:
    """(mismatches, shift) of the best placement of a k-mer along another: fewest mismatches, then the least shift."""
    best = (len(kmer) + 1, 0)
    for shift in sorted(range(-most_shift, most_shift + 1), key=lambda s: (abs(s), s)):
        wrong = sum(a != b for a, b in zip(kmer[max(0, -shift) :], to[max(0, shift) :], strict=False))
        if wrong < best[0]:
            best = (wrong, shift)
    return best


def matrix_set(kmers: list[tuple[str, float]], most: int = 8, shift: int = 2, mismatches: int = 1, pseudocount: float = 0.05, least: float = 0.2) -> list[np.ndarray]:
    """Weight matrices of k-mers and weights, best first: each k-mer joins the first family whose seed it fits (shifted by
    `shift` at most, with so many mismatches over what they share), or else starts one. Columns are over their largest entry; those
    that less than `least` of the most reached column's weight reaches are left out. At most `most` families are kept, by weight."""
    families: list[tuple[str, list[tuple[str, float, int]]]] = []
    for kmer, w in sorted(kmers, key=lambda x: (-x[1], x[0])):
        kmer = kmer.upper().replace("T", "U")
        if set(kmer) - set(ALPHABET):
            continue
        for seed, members in families:
            wrong, by = align(kmer, seed, shift)
            if wrong <= mismatches:
                members.append((kmer, w, by))
                break
        else:
            families.append((kmer, [(kmer, w, 0)]))
    families.sort(key=lambda f: (-sum(m[1] for m in f[1]), f[0]))
    out = []
    for seed, members in families[:most]:
        m = np.zeros((len(seed) + 2 * shift, len(ALPHABET)))
        for kmer, w, by in members:
            for i, c in enumerate(kmer):
                m[shift + by + i, ALPHABET.index(c)] += w
        reached = m.sum(1)
        m = m[reached >= reached.max() * least]
        m += pseudocount * m.sum(1, keepdims=True)
        out.append(m / m.max(1, keepdims=True))
    return out


def consensus(m: np.ndarray) -> str:
    return "".join(ALPHABET[i] for i in m.argmax(1))


def shrink(m: np.ndarray, most: float = 0.7) -> np.ndarray:
    """The matrix without outer columns that hardly tell letters apart: those whose least weight is over `most`."""
    keep = np.flatnonzero(m.min(1) <= most)
    return m[keep[0] : keep[-1] + 1] if len(keep) else m[:1]


_CODES = np.full(256, -1, np.int8)
for _i, _c in enumerate(ALPHABET):
    _CODES[[ord(_c), ord(_c.lower())]] = _i
_CODES[[ord("T"), ord("t")]] = ALPHABET.index("U")


#: Starts of windows that one numpy pass takes.
PASS = 1 << 18


def best_windows(data: np.ndarray, ends: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences that lie one after the other in data (letters as bytes) and end at `ends`: the best score of a window and
    its first place. Scores are over the consensus'. Sequences shorter than the matrix score 0 at 0. Windows are taken PASS at a
    time, wherever sequences end, so memory depends on neither the batch nor the length of a sequence."""
    width, most = len(m), m.max(1).prod()
    starts = np.append(0, ends[:-1]).astype(np.int64)
    score, place = np.zeros(len(ends)), np.zeros(len(ends), np.int64)
    score[ends - starts >= width] = -1.0
    padded = np.hstack([m, np.zeros((width, 1))])  # other letters, at -1, weigh nothing
    for begin in range(0, len(data) - width + 1, PASS):
        code = _CODES[data[begin : begin + PASS + width - 1]]
        total = np.ones(len(code) - width + 1)
        for j in range(width):
            total *= padded[j][code[j : len(total) + j]]
        at = np.arange(begin, begin + len(total))
        seq = np.searchsorted(ends, at, "right")
        fit = at + width <= ends[seq]
        at, seq, total = at[fit], seq[fit], total[fit]
        if not len(at):
            continue
        first = np.flatnonzero(np.diff(seq, prepend=-1))
        best, own = np.maximum.reduceat(total, first), seq[first]
        hit = np.flatnonzero(total == np.repeat(best, np.diff(np.append(first, len(seq)))))
        hit = hit[np.unique(seq[hit], return_index=True)[1]]
        better = best > score[own]  # of equal ones the first stays
        score[own[better]], place[own[better]] = best[better], (at[hit] - starts[own])[better]
    return np.where(ends - starts >= width, score / most, 0.0), place


def explain(clusters: DataFrame, matrices: list[np.ndarray]) -> DataFrame:
    """clusters with motif (index of the matrix of largest score, the first of equal ones), score and place."""

    def run(batches):
        for b in batches:
            seqs = [(s or "").encode("ascii", "replace") for s in b.column("seq").to_pylist()]
            data, ends = np.frombuffer(b"".join(seqs), np.uint8), np.cumsum([len(s) for s in seqs])
            score, place, motif = np.full(len(seqs), -1.0), np.zeros(len(seqs), np.int64), np.zeros(len(seqs), np.int32)
            for i, m in enumerate(matrices):
                s, p = best_windows(data, ends, m)
                better = s > score
                score, place, motif = np.where(better, s, score), np.where(better, p, place), np.where(better, np.int32(i), motif)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(motif, pa.int32()), pa.array(score), pa.array(place)], names=[*b.schema.names, "motif", "score", "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clusters.schema) + ", motif int, score double, place long"
    return clusters.mapInArrow(run, schema)


def offsets(explained: DataFrame, events: DataFrame) -> DataFrame:
    """id, motif, offset of every event from its cluster's window, along the transcript; clusters without events have none."""
    x = explained.select("id", "motif", "strand", "start", "end", "place").join(events.select("id", "pos"), "id")
    along = F.when(F.col("strand") == "-", F.col("end") - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    return x.select("id", "motif", (along - F.col("place")).alias("offset"))


def counted(explained: DataFrame, events: DataFrame) -> DataFrame:
    """id, motif, events, hist (number of events at each offset within reach): narrow rows, one a cluster with events."""
    x = offsets(explained, events).groupBy("id", "motif", "offset").agg(F.count(F.lit(1)).alias("n"))
    near = F.when(F.abs("offset") <= REACH, F.struct(F.col("offset").cast("int").alias("offset"), "n"))
    return x.groupBy("id", "motif").agg(F.sum("n").alias("events"), F.collect_list(near).alias("hist"))


def preference(histograms: DataFrame) -> DataFrame:
    """motif, offset, p: the mean over clusters of their events' shares by offset, one added to each; a cluster counts once."""
    width = 2 * REACH + 1
    inside = F.aggregate("hist", F.lit(0).cast("bigint"), lambda a, h: a + h["n"])
    x = histograms.withColumn("_s", inside + width)
    base = x.groupBy("motif").agg(F.sum(1 / F.col("_s")).alias("base"), F.count(F.lit(1)).alias("m"))
    own = x.select("motif", "_s", F.explode("hist").alias("h")).groupBy("motif", F.col("h.offset").alias("offset")).agg(F.sum(F.col("h.n") / F.col("_s")).alias("own"))
    grid = base.withColumn("offset", F.explode(F.sequence(F.lit(-REACH), F.lit(REACH))))
    return grid.join(own, ["motif", "offset"], "left").select("motif", "offset", ((F.col("base") + F.coalesce("own", F.lit(0.0))) / F.col("m")).alias("p"))


def log_likelihood(histograms: DataFrame, table: dict[tuple[int, int], float]) -> DataFrame:
    """id, motif, log_l: the sum of log p over a cluster's events within reach, over all its events; UNSEEN for a matrix
    without preference. table: p by (motif, offset), of 2 * REACH + 1 offsets a matrix."""
    known = sorted({m for m, _ in table})
    if not known:
        return histograms.select("id", "motif", F.lit(UNSEEN).alias("log_l"))
    logs = F.create_map(*(x for (m, o), p in sorted(table.items()) for x in (F.lit(m * 100 + o), F.lit(float(np.log(p))))))
    inside = F.aggregate("hist", F.lit(0.0), lambda a, h: a + h["n"] * logs[F.col("motif") * 100 + h["offset"]])
    return histograms.select("id", "motif", F.when(F.col("motif").isin(known), inside / F.col("events")).otherwise(UNSEEN).alias("log_l"))


def elbow_of(values: DataFrame, name: str, cutoff: float) -> float | None:
    """The first value, in order, over the median that lies `cutoff` above the line of the lower half; None without one.

    Ranks are given by ranges, so no task sees all rows.
    """
    ranked = settle(numbered(values.select("id", F.col(name).alias("z")).filter("z is not null"), ["z", "id"]), "ranked")
    n = ranked.count()
    half = -(-n // 2)
    line = ranked.filter(F.col("_r") < half).agg(F.regr_slope("z", F.col("_r").cast("double")), F.regr_intercept("z", F.col("_r").cast("double"))).first()
    if line is None or line[0] is None:
        return None
    over = ranked.filter((F.col("_r") > half) & (F.col("z") - (F.lit(line[0]) * F.col("_r") + F.lit(line[1])) > cutoff))
    return over.agg(F.min_by("z", "_r")).first()[0]


def narrowed(cluster: DataFrame, lengths: list[int], margin: int = 3, moved_twice: bool = False) -> DataFrame:
    """Clusters with seq, start and end cut to the window of their matrix and `margin` on either side, within the cluster.

    `moved_twice` counts the far end from the already moved near end.
    """
    size = F.element_at(F.array(*map(F.lit, lengths)), F.col("motif") + 1)
    lo = F.greatest(F.col("place") - margin, F.lit(0))
    hi = F.least(F.col("place") + size + margin, F.length("seq"))
    x = cluster.withColumns({"_lo": lo.cast("bigint"), "_hi": hi.cast("bigint")})
    minus = F.col("strand") == "-"
    extra: Column = F.col("_lo") if moved_twice else F.lit(0)
    start = F.when(minus, F.col("end") - F.col("_hi") - extra).otherwise(F.col("start") + F.col("_lo"))
    end = F.when(minus, F.col("end") - F.col("_lo")).otherwise(F.col("start") + F.col("_hi") + extra)
    seq = F.substring(F.col("seq"), (F.col("_lo") + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int"))
    return x.withColumns({"start": start, "end": end, "seq": seq}).drop("_lo", "_hi")


@dataclass
class Round:
    """What a round saw: included clusters before it, its matrices, preferences by (motif, offset), and the cut-offs."""

    included: int
    z_cutoff: float
    kmers: int
    matrices: list[np.ndarray]
    preference: dict[tuple[int, int], float] = field(default_factory=dict)
    log_l_cutoff: float | None = None

    @property
    def consensus(self) -> list[str]:
        return [consensus(m) for m in self.matrices]


def refine_set(
    clusters: DataFrame, events: DataFrame, controls: DataFrame, k: int = 7, rounds: int = 10, pseudoscore: float = 0.95, most_kmers: int = 200,
    z_step: float = 1.0, log_l_step: float = 0.5, thin: float = 0.7, draws: int = 100, margin: int = 3,
) -> tuple[DataFrame, list[Round]]:
    """The clusters with include, stamp (the round that included them; null for the first ones), motif, score, place and
    log_l of the last round, and start, end and seq of stamped ones narrowed to their window; and what each round saw.

    clusters: id (unique), strand, start, end, seq, pseudoscore; events: id, pos; controls: id, seq. Clusters without events
    and rows alike in all six columns are left out first. Ends early where no k-mer lies over the elbow. Without any round
    motif, score, place and log_l are null. Once included, a cluster stays.
    """
    spark: SparkSession = clusters.sparkSession
    cols = ["id", "strand", "start", "end", "seq", "pseudoscore"]
    use = clusters.select(*cols).dropDuplicates().join(events.select("id").distinct(), "id", "left_semi")
    now = settle(use.withColumns({"seq": K.rna(F.upper("seq"), F.lit("+")), "include": F.coalesce(F.col("pseudoscore") > pseudoscore, F.lit(False)), "stamp": F.lit(None).cast("int")}), "clusters")
    last = now.withColumns({"motif": F.lit(None).cast("int"), "score": F.lit(None).cast("double"), "place": F.lit(None).cast("long"), "log_l": F.lit(None).cast("double")})
    controls = controls.select("id", K.rna(F.upper("seq"), F.lit("+")).alias("seq"))
    log: list[Round] = []
    for step in range(rounds):
        chosen = now.filter("include")
        n = chosen.count()
        if not n:
            break
        found = K.document_frequency(chosen, k).select("kmer", (F.col("n") / F.lit(n)).alias("f"))
        z = settle(K.z_scores(found, K.background(controls, k, n, draws)).filter("z is not null"), "z")
        cut = K.elbow(z, z_step).first()["cutoff"]
        if cut is None:
            break
        best = z.filter((F.col("z") > cut) & ~F.col("kmer").contains("N")).orderBy(F.desc("z"), "kmer").limit(most_kmers).collect()
        matrices = [shrink(m, thin) for m in matrix_set([(r["kmer"], r["z"]) for r in best])]
        if not matrices:
            break
        seen = Round(n, cut, len(best), matrices)
        whole = settle(explain(now, matrices), "explained")
        hist = settle(counted(whole, events), "histograms")
        pref = preference(hist.join(chosen.select("id"), "id", "left_semi")).collect()
        seen.preference = {(r["motif"], r["offset"]): r["p"] for r in pref}
        likely = settle(whole.join(log_likelihood(hist, seen.preference).drop("motif"), "id"), "likely")
        seen.log_l_cutoff = elbow_of(likely, "log_l", log_l_step)
        log.append(seen)
        if seen.log_l_cutoff is None:
            last = likely
            break
        new = (F.col("log_l") > F.lit(seen.log_l_cutoff)) & ~F.col("include")
        marked = likely.withColumn("_new", new)
        old, fresh = marked.filter("not _new").drop("_new"), marked.filter("_new").drop("_new")
        fresh = narrowed(fresh.withColumns({"include": F.lit(True), "stamp": F.lit(step)}), [len(m) for m in matrices], margin)
        last = settle(old.unionByName(fresh), "updated")
        now = last.select(*cols, "include", "stamp")
    return last, log


def write_matrices(spark: SparkSession, log: list[Round], path: str) -> None:
    """round, motif, consensus, place, letter, weight of every matrix."""
    rows = [(r, i, consensus(m), p, ALPHABET[c], float(m[p, c])) for r, seen in enumerate(log) for i, m in enumerate(seen.matrices) for p in range(len(m)) for c in range(len(ALPHABET))]
    spark.createDataFrame(rows, "round int, motif int, consensus string, place int, letter string, weight double").write.mode("overwrite").parquet(path)


def read_matrices(spark: SparkSession, path: str, round_: int) -> list[np.ndarray]:
    """The matrices of one round, in order."""
    out: dict[int, dict[tuple[int, str], float]] = {}
    for r in spark.read.parquet(path).filter(F.col("round") == round_).collect():
        out.setdefault(r["motif"], {})[r["place"], r["letter"]] = r["weight"]
    return [np.array([[m[p, c] for c in ALPHABET] for p in range(1 + max(p for p, _ in m))]) for _, m in sorted(out.items())]
