"""One-dimensional density clustering of sites, cluster scores, peaks of the relative-information track."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions import stats as S
from locusflow.functions.vectors import gaussian_kernel
from locusflow.operators.intervals import PIECE, anti_overlap, merge_by, overlap_counts, semi_overlap, subtract_within
from locusflow.operators.signal import POINT_BIN, interval_sums
from locusflow.store import settle


def dbscan(sites: DataFrame, keys: list[str], eps: int, min_samples: int | str, members: bool = False, piece: int = PIECE) -> DataFrame:
    """Clusters of core sites: keys, start (least position), end (greatest), no_ip, no_input (and ip_members, input_members:
    the sorted positions of the cores, each as often as it occurs).

    A site is core with min_samples sites (itself included; an int or a column of each group) within eps; cores no more
    than eps apart chain. Sites have pos and is_ip, or ip and n where they are counted by position already. Equal positions are counted once, with weights; neighbours are counted
    and chains formed in pieces of positions, so a chromosome is never one task's work.
    """
    extra = [min_samples] if isinstance(min_samples, str) else []
    counted = {"ip", "n"} <= set(sites.columns)
    w = sites.select(*keys, "pos", *extra, "ip", "n") if counted else sites.groupBy(*keys, "pos", *extra).agg(F.count_if("is_ip").alias("ip"), F.count(F.lit(1)).alias("n"))
    home = F.floor(F.col("pos") / piece)
    # A position is listed in each piece that one of its neighbours may lie in, and judged in its own.
    listed = w.withColumn("_piece", F.explode(F.sequence(F.floor((F.col("pos") - eps) / piece), F.floor((F.col("pos") + eps) / piece))))
    near = F.sum("n").over(Window.partitionBy(*keys, "_piece").orderBy("pos").rangeBetween(-eps, eps))
    core = listed.withColumn("near", near).filter((F.col("_piece") == home) & (F.col("near") >= (F.col(min_samples) if extra else F.lit(min_samples))))
    return _chains(core, keys, eps, members, piece)


def _chains(core: DataFrame, keys: list[str], eps: int, members: bool, piece: int = PIECE) -> DataFrame:
    """Clusters of core places (keys, pos, ip, n): those no more than eps apart chain."""
    reach = core.withColumns({"start": F.col("pos"), "end": F.col("pos") + eps, "_in": F.col("n") - F.col("ip")})
    sums = {"no_ip": (F.sum("ip"), F.sum("no_ip")), "no_input": (F.sum("_in"), F.sum("no_input"))}
    if members:
        for name, n in (("ip_members", "ip"), ("input_members", "_in")):
            sums[name] = (F.flatten(F.collect_list(F.array_repeat("pos", F.col(n).cast("int")))), F.array_sort(F.flatten(F.collect_list(name))))
    return merge_by(reach, keys, sums, piece).withColumn("end", F.col("end") - eps)


def region_clusters(sites: DataFrame, regions: DataFrame, eps: int = 2, cov_ratio: float = 10, combine: bool = True, size: int = 30, members: bool = False) -> DataFrame:
    """Scored clusters of `size` of each region (id, chrom, start, end, strand): id, chrom, strand, start, end, no_ip, no_input, pseudoscore.

    Sites (chrom, pos, strand, is_ip) count in the regions they lie in. min_samples of a region is cov_ratio times its
    sites per base, rounded down; without `combine` clusters are of ip sites only, against the totals of both.
    """
    r = regions.select("id", "chrom", "strand", "start", "end").filter("start < end")
    places = sites.groupBy("chrom", "strand", "pos").agg(F.count_if("is_ip").alias("ip"), F.count(F.lit(1)).alias("n"))
    counts = places.select("chrom", "strand", "pos", "ip", (F.col("n") - F.col("ip")).alias("input"))
    totals = interval_sums(counts, r, ["ip", "input"], ["chrom", "strand"], [])
    size_of = F.col("end") - F.col("start")
    least = F.floor(F.lit(float(cov_ratio)) * ((F.col("ip") + F.col("input")) / size_of)).cast("int")
    known = r.join(totals, "id").select("id", "chrom", "strand", "start", "end", least.alias("least"))
    used = places if combine else places.filter("ip > 0").withColumn("n", F.col("ip"))
    # Neighbours of a place are listed once, before regions multiply it. A place that has too few on the whole strand is core in
    # no region, and one at a region's edge has the listed ones inside, so whether a place on a region is core is known where
    # they meet. Only cores are shuffled: with a threshold of cov_ratio times the mean, few of a region's places.
    home = F.floor(F.col("pos") / PIECE)
    listed = used.withColumn("_piece", F.explode(F.sequence(F.floor((F.col("pos") - eps) / PIECE), F.floor((F.col("pos") + eps) / PIECE))))
    w = Window.partitionBy("chrom", "strand", "_piece").orderBy("pos").rangeBetween(-eps, eps)
    listed = listed.withColumns({"_near": F.sum("n").over(w), "_nb": F.collect_list(F.struct("pos", "n")).over(w)}).filter(F.col("_piece") == home).drop("_piece")
    binned = known.withColumn("_bin", F.explode(F.sequence(F.expr(f"start div {POINT_BIN}"), F.expr(f"(end - 1) div {POINT_BIN}"))))
    hits = binned.join(listed.withColumn("_bin", F.expr(f"pos div {POINT_BIN}")), ["chrom", "strand", "_bin"]).filter("pos >= start and pos < end and _near >= least")
    inside = F.aggregate("_nb", F.lit(0).cast("bigint"), lambda s, x: s + F.when((x["pos"] >= F.col("start")) & (x["pos"] < F.col("end")), x["n"]).otherwise(0))
    near = F.when((F.col("pos") - eps >= F.col("start")) & (F.col("pos") + eps < F.col("end")), F.col("_near")).otherwise(inside)
    found = _chains(hits.filter(near >= F.col("least")).select("id", "pos", "ip", "n"), ["id"], eps, members)
    scored = score(fixed_size(found, size), totals.select("id", "ip", "input"), ["id"])
    return scored.join(r.select("id", "chrom", "strand"), "id")


def fixed_size(clusters: DataFrame, size: int = 30) -> DataFrame:
    """Clusters of one size around ceil of their middle."""
    center = F.ceil((F.col("start") + F.col("end")) / 2)
    start = (center - math.ceil(size / 2)).cast("bigint")
    return clusters.withColumns({"start": start, "end": start + size})


def score(clusters: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """pseudoscore: the binomial cdf of the cluster's counts at its region's share of ip (totals: ip, input); 0 without ip."""
    x = clusters.join(totals, keys)
    p = (F.col("ip") + 1) / (F.col("ip") + F.col("input") + 2)
    cdf = S.binomial_cdf_udf((F.col("no_ip") + 1).cast("double"), (F.col("no_ip") + F.col("no_input") + 2).cast("double"), p)
    return x.withColumn("pseudoscore", F.when(F.col("ip") == 0, 0.0).otherwise(cdf)).drop("ip", "input")


def split(clusters: DataFrame) -> DataFrame:
    """kind: `control` below 0.2 or without ip, `real` above 0.2 with ip; exactly 0.2 is neither and dropped."""
    kind = F.when((F.col("pseudoscore") < 0.2) | (F.col("no_ip") == 0), "control").when(F.col("pseudoscore") > 0.2, "real")
    return clusters.withColumn("kind", kind).filter("kind is not null")


def gaps(clusters: DataFrame, keys: list[str], size: int = 30) -> DataFrame:
    """Windows of one size around the middle of the gap to the next cluster."""
    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    x = clusters.withColumn("_n", after).filter("_n is not null").withColumn("start", (F.floor((F.col("end") + F.col("_n")) / 2) - size // 2).cast("bigint"))
    return x.withColumn("end", F.col("start") + size).drop("_n")


def matched_controls(clusters: DataFrame, regions: DataFrame) -> DataFrame:
    """id, start, end of control windows: what clusters leave of their region is gone through in order, and each part that
    the next cluster fits into gives a window of its width around the part's middle. Parts and clusters without a partner
    give none. Clusters have id (of their region), start and end; their order is by start.
    """
    r = regions.select("id", "chrom", "strand", "start", "end")
    mine = clusters.select("id", "start", "end")
    left = subtract_within(r, mine)
    parts = left.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("parts"))
    found = mine.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))

    def step(state, part):
        c = F.get("found", state["at"])
        width = c["end"] - c["start"]
        fits = c.isNotNull() & (part["end"] - part["start"] >= width)
        middle = (part["start"] + part["end"]) / 2
        window = F.struct(F.ceil(middle - width / 2).cast("bigint").alias("start"), F.greatest(F.ceil(middle + width / 2), F.lit(0)).cast("bigint").alias("end"))
        return F.when(fits, F.struct((state["at"] + 1).alias("at"), F.concat(state["out"], F.array(window)).alias("out"))).otherwise(state)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    windows = F.aggregate("parts", zero, step, lambda s: s["out"])
    return parts.join(found, "id").select("id", F.explode(windows).alias("w")).select("id", "w.start", "w.end")


def with_region(clusters: DataFrame, regions: DataFrame, columns: list[str]) -> DataFrame:
    """Clusters with the named attributes of their region (null where it has none)."""
    return clusters.join(regions.select("id", *columns), "id", "left")


def top_clusters(clusters: DataFrame, n: int, least: float = 0.0, column: str = "pseudoscore") -> DataFrame:
    """The n clusters of highest score above `least`; ties by place."""
    order = [F.desc(column), *(c for c in ("chrom", "id", "start", "end") if c in clusters.columns)]
    return clusters.filter(F.col(column) > least).orderBy(*order).limit(n)


def free_controls(control: DataFrame, real: DataFrame, key: list[str]) -> DataFrame:
    """Control clusters that overlap no real one of their strand."""
    return anti_overlap(control, real, key)


def purity_sensitivity(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """One row: the share of new that overlaps old, and of old that overlaps new."""
    share = lambda a, b, name: semi_overlap(a, b, key).agg(F.count(F.lit(1)).alias("h")).crossJoin(a.agg(F.count(F.lit(1)).alias("n"))).select(F.try_divide("h", "n").alias(name))
    return share(new, old, "purity").crossJoin(share(old, new, "sensitivity"))


def score_bins(df: DataFrame, column: str = "pseudoscore", width: float = 0.2) -> DataFrame:
    """bin: the number of the right-closed interval of the score; 0 and less are in none."""
    return df.withColumn("bin", F.when(F.col(column) > 0, F.ceil(F.round(F.col(column) / width, 9)).cast("int"))).filter("bin is not null")


def purity_by_bin(new: DataFrame, old: DataFrame, key: list[str], by: str = "bin") -> DataFrame:
    """by, n, purity, sensitivity: for each group of new, its share that overlaps old, and the share of old that overlaps it."""
    # Looked at four times; clusters are far fewer than what they come from.
    new, old = settle(new.select(*key, by, "chrom", "strand", "start", "end"), "purity"), old.select(*key, "chrom", "strand", "start", "end")
    sizes = new.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    mine = overlap_counts(new, old, ["chrom", "strand"], "_n").filter("_n > 0").groupBy(by).agg(F.count_distinct(F.struct(*key)).alias("h"))
    # A row of old for each of the few groups: pairs are never formed.
    theirs = overlap_counts(old.crossJoin(F.broadcast(sizes.select(by))), new, ["chrom", "strand", by], "_n").filter("_n > 0").groupBy(by).agg(F.count_distinct(F.struct(*key)).alias("o"))
    hits = mine.join(theirs, by, "full")
    total = old.agg(F.count(F.lit(1)).alias("m"))
    x = sizes.join(hits, by, "left").na.fill(0).crossJoin(F.broadcast(total))
    return x.select(by, "n", F.try_divide("h", "n").alias("purity"), F.try_divide("o", "m").alias("sensitivity"))


def relative_information_track(ip: np.ndarray, ctrl: np.ndarray, pseudocount: float = 0.1, sigma: float = 2.0) -> np.ndarray:
    """p ln(p/q) of two smoothed vectors after a pseudocount."""
    k = np.array(gaussian_kernel(sigma))
    r = len(k) // 2

    def smooth(v: np.ndarray) -> np.ndarray:
        n = len(v)
        at = np.mod(np.arange(-r, n + r), 2 * n)
        return np.convolve(v[np.where(at < n, at, 2 * n - 1 - at)], k, "valid")

    p, q = (smooth(np.asarray(v, float) + pseudocount) for v in (ip, ctrl))
    p, q = p / p.sum(), q / q.sum()
    return p * np.log(p / q)


PEAKS = "region long, start long, end long, no_ip long, no_input long, pseudoscore double, kind string"


def information_peaks(vectors: DataFrame, height: float = 0.02, size: int = 30, pseudocount: float = 0.1, sigma: float = 2.0) -> DataFrame:
    """Windows of `size` around the peaks of each region's track, scored like clusters; peaks of the negated track are controls.

    vectors: region, ip and ctrl (arrays of counts). Regions are independent rows, mapped in Arrow batches; windows are
    clamped to their region.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for region, ip, ctrl in zip(frame["region"], frame["ip"], frame["ctrl"], strict=True):
                a, b = np.asarray(ip, float), np.asarray(ctrl, float)
                if not a.sum() or len(a) < 3:
                    continue
                track = relative_information_track(a, b, pseudocount, sigma)
                share = (a.sum() + 1) / (a.sum() + b.sum() + 2)
                for kind, v, h in (("real", track, height), ("control", -track, 0.0)):
                    for p in S.find_peaks(v, h, size):
                        lo, hi = max(0, p - size // 2), min(len(a), p + size // 2)
                        x, y = int(a[lo:hi].sum()), int(b[lo:hi].sum())
                        rows.append((region, lo, hi, x, y, S.binomial_cdf(x + 1, x + y + 2, share), kind))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PEAKS.split(", ")])

    return vectors.select("region", "ip", "ctrl").mapInPandas(run, PEAKS)
