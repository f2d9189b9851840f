"""k-mers: document frequencies, enrichment over a control, z-scores over sampled backgrounds, motif places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.enrich import ks_statistic

COMPLEMENT = ("ACGTacgt", "UGCAugca")


def rna(seq: Column, strand: Column) -> Column:
    """The transcribed strand: reverse complement on -, T as U."""
    return F.when(strand == "-", F.translate(F.reverse(seq), *COMPLEMENT)).otherwise(F.translate(seq, "Tt", "Uu"))


def kmers(seq: Column, k: int) -> Column:
    """The different k-mers of a sequence; none if it is shorter. One pass over the text: a lookahead matches at each place."""
    return F.array_distinct(F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def document_frequency(seqs: DataFrame, k: int, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """kmer, n: sequences that contain it, each as often as its weight says."""
    w = F.col(weight) if weight else F.lit(1)
    x = seqs.select(*(keys or []), w.cast("bigint").alias("_w"), F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    return x.groupBy(*(keys or []), "kmer").agg(F.sum("_w").alias("n"))


def site_sequences(sites: DataFrame, genome: DataFrame, chunk: int, window: int) -> DataFrame:
    """sites (chrom, pos, strand, ...) with seq, the transcribed bases from pos - window to pos + window, cut at the chromosome's start."""
    r = sites.withColumns({"start": F.greatest(F.col("pos") - window, F.lit(0)), "end": F.col("pos") + window}).filter("start < end")
    return region_sequences(r, genome, chunk).drop("start", "end")


def motif_ks(scored: DataFrame, motifs: list[str]) -> DataFrame:
    """motif, n_ip, n_null, d_less, d_greater: scores of sequences with the motif (ip) against those without. scored: seq, score."""
    names = F.explode(F.array(*map(F.lit, motifs)))
    x = scored.select("seq", "score", names.alias("motif")).select("motif", F.col("seq").contains(F.col("motif")).alias("ip"), F.col("score").alias("x"))
    return ks_statistic(x, ["motif"], F.col("ip"))


def r_values(seqs: DataFrame, k: int) -> DataFrame:
    """ip and input counts and frequencies of every k-mer of either role, and their ratio (infinite over 0). One pass over both roles."""
    x = seqs.select("role", F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    counts = x.groupBy("kmer").agg(F.count_if(F.col("role") == "ip").alias("ip_count"), F.count_if(F.col("role") == "input").alias("input_count"))
    totals = seqs.agg(F.count_if(F.col("role") == "ip").alias("_ip"), F.count_if(F.col("role") == "input").alias("_input"))
    c = counts.crossJoin(F.broadcast(totals)).withColumns({"ip_frequency": F.try_divide("ip_count", "_ip"), "input_frequency": F.try_divide("input_count", "_input")})
    return c.withColumn("r_value", F.when(F.col("input_frequency") == 0, F.lit(float("inf"))).otherwise(F.col("ip_frequency") / F.col("input_frequency"))).drop("_ip", "_input")


def sample(rows: DataFrame, key: str, n: int, iterations: int, seed: int = 1) -> DataFrame:
    """n rows without replacement in each of some iterations: those of least hash of key, iteration and seed. Reproducible."""
    its = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))
    h = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("iteration").cast("string"), F.lit(str(seed))))
    x = rows.withColumn("iteration", its).withColumn("_h", h)
    return x.withColumn("_r", F.row_number().over(Window.partitionBy("iteration").orderBy("_h"))).filter(F.col("_r") <= n).drop("_h", "_r")


def downsample(rows: DataFrame, key: str, fraction: float, seed: int = 5) -> DataFrame:
    """About a fraction of the keys, all rows of a key together."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    return rows.filter(h < int(fraction * 2**32))


def background(seqs: DataFrame, k: int, n: int = 1000, iterations: int = 100, seed: int = 1) -> DataFrame:
    """kmer, mean and std (sample) of its document frequency over n sampled sequences; iterations without it count as 0.

    Of fewer than n sequences a third is drawn (rounded up). Ids are unique; a sequence is cut into k-mers once, however
    often it is drawn.
    """
    size = seqs.count()
    n = n if size >= n else -(-size // 3)
    drawn = sample(seqs.select("id"), "id", n, iterations, seed).groupBy("id").agg(F.collect_list("iteration").alias("_its"))
    x = seqs.join(drawn, "id").select("_its", F.explode(kmers(F.col("seq"), k)).alias("kmer")).select("kmer", F.explode("_its").alias("iteration"))
    x = x.groupBy("iteration", "kmer").agg((F.count(F.lit(1)) / F.lit(n)).alias("f"))
    s = x.groupBy("kmer").agg(F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("ss"))
    mean = F.col("s") / iterations
    var = (F.col("ss") - iterations * mean * mean) / (iterations - 1)
    return s.select("kmer", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def z_scores(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """kmer, z for k-mers of both; null where the background does not vary. observed: kmer, f."""
    return observed.join(expected, "kmer").select("kmer", F.when(F.col("std") > 0, (F.col("f") - F.col("mean")) / F.col("std")).alias("z"))


def elbow(z: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """One row: slope and intercept of the lower half of sorted z, and the first later z above that line by the cutoff."""
    ranked = z.filter("z is not null").withColumn("_r", F.row_number().over(Window.orderBy("z", "kmer")) - 1)
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    x = ranked.crossJoin(F.broadcast(n)).withColumn("_low", F.col("_r") < F.ceil(F.col("_n") / 2))
    line = x.filter("_low").agg(F.regr_slope("z", F.col("_r").cast("double")).alias("slope"), F.regr_intercept("z", F.col("_r").cast("double")).alias("intercept"))
    y = x.crossJoin(F.broadcast(line))
    over = (F.col("_r") > F.ceil(F.col("_n") / 2)) & (F.col("z") - (F.col("slope") * F.col("_r") + F.col("intercept")) > cutoff)
    return y.agg(F.max("slope").alias("slope"), F.max("intercept").alias("intercept"), F.min_by(F.when(over, F.col("z")), F.when(over, F.col("_r"))).alias("cutoff"))


def filtered_correlation(a: DataFrame, b: DataFrame, cut_a: float, cut_b: float) -> DataFrame:
    """Pearson's r of two z tables, values under their cutoff as 0."""
    x = a.select("kmer", F.col("z").alias("_a")).join(b.select("kmer", F.col("z").alias("_b")), "kmer")
    cut = lambda c, t: F.when(F.col(c) < t, 0.0).otherwise(F.col(c))
    return x.agg(F.corr(cut("_a", cut_a), cut("_b", cut_b)).alias("r"))


def motif_places(seqs: DataFrame, motif: str) -> DataFrame:
    """m_start, m_end of the first occurrence in each sequence in genome coordinates, null without one. seqs: start, end, strand, seq."""
    at, k = F.instr("seq", motif), len(motif)
    plus = F.col("strand") == "+"
    start = F.when(at > 0, F.when(plus, F.col("start") + at - 1).otherwise(F.col("end") - (at - 1) - k))
    return seqs.withColumn("m_start", start.cast("bigint")).withColumn("m_end", F.col("m_start") + k)


def region_sequences(regions: DataFrame, genome: DataFrame, chunk: int, whole: bool = False) -> DataFrame:
    """regions with seq, cut from a genome stored in chunks (chrom, chunk, seq) of fixed size; transcribed by strand.

    A region in one chunk or two neighbours is cut where it meets them, so no sequence is shuffled; only longer ones are joined
    with each chunk that they touch and put together again. Regions that touch no chunk are left out, or, with `whole`, have
    an empty seq.
    """
    first, last = F.expr(f"start div {chunk}"), F.expr(f"(end - 1) div {chunk}")

    def part(seq: str, at: Column) -> Column:
        lo, hi = F.greatest(F.col("start") - at * chunk, F.lit(0)), F.least(F.col("end") - at * chunk, F.lit(chunk))
        return F.coalesce(F.substring(seq, (lo + 1).cast("int"), (hi - lo).cast("int")), F.lit(""))

    span = F.abs(last - first)
    near = regions.filter(F.coalesce(span <= 1, F.lit(whole))).withColumns({"chunk": F.least(first, last), "_two": span == 1})
    own = genome.select("chrom", "chunk", F.coalesce("seq", F.lit("")).alias("_g"))
    pairs = own.join(own.select("chrom", (F.col("chunk") - 1).alias("chunk"), F.col("_g").alias("_h")), ["chrom", "chunk"], "full")
    near = near.join(pairs, ["chrom", "chunk"], "left" if whole else "inner")
    if not whole:
        near = near.filter(F.col("_g").isNotNull() | (F.col("_two") & F.col("_h").isNotNull()))
    near = near.select(*regions.columns, F.concat(part("_g", F.col("chunk")), F.when(F.col("_two"), part("_h", F.col("chunk") + 1)).otherwise("")).alias("seq"))
    r = regions.filter(span > 1).withColumn("chunk", F.explode(F.sequence(first, last)))
    parts = r.join(own, ["chrom", "chunk"], "left" if whole else "inner").select(*regions.columns, "chunk", part("_g", F.col("chunk")).alias("_p"))
    far = parts.groupBy(*regions.columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "_p"))), lambda s: s["_p"]), "").alias("seq"))
    return near.unionByName(far).withColumn("seq", rna(F.col("seq"), F.col("strand")))
