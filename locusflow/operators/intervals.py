"""Interval operators: overlap joins, difference, union, coverage, nearest neighbours.

Intervals are half-open with columns chrom, start, end and, where stranded, strand. Overlap joins are equi-joins on bins
of BIN bases: both sides are listed in each bin they touch, and a pair counts only in the bin where the later start lies,
so no distinct is needed. Union and coverage run per bin first, so that a chromosome is never one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow import store
from locusflow.store import dealt

BIN = 4096
#: Width of the pieces in which unions and coverage are formed before pieces meet.
PIECE = 1 << 16


def _keys(stranded: bool) -> list[str]:
    return ["chrom", "strand"] if stranded else ["chrom"]


def overlap_pairs(a: DataFrame, b: DataFrame, stranded: bool = True, size: int = BIN) -> DataFrame:
    """Every overlapping pair: the columns of a, and those of b with the prefix b_. Empty intervals overlap nothing."""
    keys = _keys(stranded)
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    left = a.filter("start < end").withColumn("_bin", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(end - 1) div {size}"))))
    right = b.filter("b_start < b_end").withColumn("_b_bin", F.explode(F.sequence(F.expr(f"b_start div {size}"), F.expr(f"(b_end - 1) div {size}"))))
    on = [F.col(k) == F.col(f"b_{k}") for k in keys] + [F.col("_bin") == F.col("_b_bin")]
    meets = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    once = F.expr(f"greatest(start, b_start) div {size}") == F.col("_bin")
    return left.join(right, [*on, meets, once]).drop("_bin", "_b_bin")


#: Pieces of a chromosome that both sides are dealt by where their pairs are returned, and parts of a piece.
PAIR_PIECE, PAIR_PART = 128, 64


def together(spans: DataFrame, key: str = "id") -> DataFrame:
    """Spans that are alike in all but their key as one row, with their keys in `_keys`: what they meet is worked out once for all."""
    return spans.groupBy(*(c for c in spans.columns if c != key)).agg(F.sort_array(F.collect_list(F.struct(key))).alias("_keys"))


#: Fewer keys than this are told apart before pairs are formed, so that each has its rows in a run; more keys give runs of their own.
#: A row has at most so many.
LEAST_KEYS, MOST_KEYS = 16, 1024


def _by_run(keys: Column) -> Column:
    """Keys of a span in arrays that stay together where pairs are returned."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(keys) - 1) / MOST_KEYS).cast("int")), lambda i: F.slice(keys, i * MOST_KEYS + 1, MOST_KEYS))
    return F.when(F.size(keys) < LEAST_KEYS, F.transform(keys, lambda k: F.array(k))).otherwise(chunks)


def apart(df: DataFrame) -> DataFrame:
    """df of spans brought `together`, a row for each key again."""
    return df.select(*(c for c in df.columns if c != "_keys"), F.inline("_keys"))


def _piece_of(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("bigint")


def pieces_of(spans: DataFrame, first: Column, last: Column, piece: int = PAIR_PIECE) -> int:
    """How many rows spans become where each is listed in every piece it touches, those brought `together` counted one by one."""
    each = F.size("_keys") if "_keys" in spans.columns else F.lit(1)
    return spans.filter(first <= last).agg(F.sum((_piece_of(last, piece) - _piece_of(first, piece) + 1) * each)).first()[0] or 0


def pairs_in_order(
    spans: DataFrame, items: DataFrame, first: Column, last: Column, lo: str = "pos", hi: str = "pos", by: list[str] | None = None, anchor: Column | None = None, piece: int = PAIR_PIECE, rows: int | None = None,
) -> DataFrame:
    """The columns of spans, and those of items without chrom and strand, of pairs that share a place: first..last and lo..hi.

    For pairs that are returned: they outnumber both sides, so what they take on disk depends on their order. Spans of a piece are
    put in order by `anchor` (first, if not given; the place that distances are counted from), and the items of a part are one sorted
    array (by the columns `by`, then lo and hi), so neighbouring spans give the same runs of rows and columns compress well. Both
    sides are shuffled and sorted, pairs never are. Items of a piece are one row: points (unique, lo = hi) are as many as its places
    and values of `by`. Where places have few points, wide pieces give longer runs. A task gets a quarter of as many spans of pieces
    as `dealt` says, as it returns many rows for each; `rows` is their number, counted by `pieces_of` if it is not given.
    """
    part, keys = PAIR_PART, ["chrom", "strand"]
    at, per = _piece_of, max(1, store.TASK_ROWS // 4)
    x = spans.withColumn("_keys", F.explode(_by_run(F.col("_keys")))) if "_keys" in spans.columns else spans
    x = x.filter(first <= last).withColumn("_piece", F.explode(F.sequence(at(first, piece), at(last, piece))))
    n = pieces_of(spans, first, last, piece) if rows is None else rows
    # The explode after it keeps the sort: the optimizer drops one right below a join.
    x = dealt(x, *keys, "_piece", rows=n, per=per).withColumns({"_first": first, "_last": last, "_anchor": first if anchor is None else anchor})
    x = x.sortWithinPartitions(*keys, "_piece", "_anchor", "_first", "_last")
    low, high = F.greatest("_first", F.col("_piece") * piece), F.least("_last", F.col("_piece") * piece + piece - 1)
    x = x.withColumn("_part", F.explode(F.sequence(at(low, part), at(high, part))))
    points, ends = lo == hi, [lo] if lo == hi else [lo, hi]
    order = [*(by or []), *ends]
    order += [c for c in items.columns if c not in (*keys, *order)]
    # Dealt as the spans are: both groupings and the join need no further shuffle.
    parts = items.filter(F.col(lo) <= F.col(hi)).withColumn("_part", at(F.col(lo), part) if points else F.explode(F.sequence(at(F.col(lo), part), at(F.col(hi), part))))
    parts = dealt(parts.withColumn("_piece", at(F.col("_part"), piece // part)), *keys, "_piece", rows=n, per=per)
    parts = parts.groupBy(*keys, "_piece", "_part").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_x"))
    parts = parts.groupBy(*keys, "_piece").agg(F.map_from_entries(F.collect_list(F.struct("_part", "_x"))).alias("_items"))
    hits = x.join(parts.hint("merge"), [*keys, "_piece"])
    hits = hits.select(*spans.columns, "_first", "_last", "_part", F.inline(F.try_element_at("_items", F.col("_part"))))
    hits = hits.filter((F.col(lo) <= F.col("_last")) & (F.col(hi) >= F.col("_first")))
    if not points:  # in the part of the later start only
        hits = hits.filter(at(F.greatest(lo, "_first"), part) == F.col("_part"))
    return hits.drop("_first", "_last", "_part")


def overlap_counts(a: DataFrame, b: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows of a with the number of rows of b (of the same keys) that overlap them; empty intervals overlap nothing.

    Those that start before its end, less those that end up to its start: two running counts, so pairs are never formed and
    it does not matter how many rows overlap.
    """
    from locusflow.operators.signal import counts_before

    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("_s"), F.lit(0).alias("_e")), F.struct(F.col("end").alias("pos"), F.lit(0).alias("_s"), F.lit(1).alias("_e"))))
    points = b.filter("start < end").select(*keys, ends.alias("_x")).select(*keys, "_x.*")
    marks = a.filter("start < end").select(*keys, F.explode(F.array(F.col("end"), F.col("start") + 1)).alias("pos"))
    cum = counts_before(points, marks, ["_s", "_e"], keys)
    x = a.withColumn("_lo", F.col("start") + 1)
    x = x.join(cum.select(*keys, F.col("pos").alias("end"), "_s"), [*keys, "end"], "left").join(cum.select(*keys, F.col("pos").alias("_lo"), "_e"), [*keys, "_lo"], "left")
    n = F.when(F.col("start") < F.col("end"), F.coalesce(F.col("_s") - F.col("_e"), F.lit(0))).otherwise(0)
    return x.select(*a.columns, n.cast("bigint").alias(name))


def semi_overlap(a: DataFrame, b: DataFrame, key: list[str], stranded: bool = True) -> DataFrame:
    """Rows of a that overlap any of b; key names a row of a."""
    return overlap_counts(a, b, _keys(stranded), "_n").filter("_n > 0").drop("_n")


def anti_overlap(a: DataFrame, b: DataFrame, key: list[str], stranded: bool = True) -> DataFrame:
    """Rows of a that overlap none of b; key names a row of a."""
    return overlap_counts(a, b, _keys(stranded), "_n").filter("_n = 0").drop("_n")


def clip_overlap(a: DataFrame, b: DataFrame, stranded: bool = True) -> DataFrame:
    """Pairs with a's interval cut to the overlap."""
    pairs = overlap_pairs(a, b, stranded)
    return pairs.withColumns({"start": F.greatest("start", "b_start"), "end": F.least("end", "b_end")})


def clip_in_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """As `clip_overlap`, stranded, for pairs that are returned: in an order that takes little room."""
    items = a.withColumn("_to", F.col("end") - 1).drop("end")
    spans = together(b.select("chrom", "strand", *(F.col(c).alias(f"b_{c}") for c in b.columns)), "b_id")
    pairs = pairs_in_order(spans, items, F.col("b_start"), F.col("b_end") - 1, "start", "_to")
    pairs = pairs.withColumns({"start": F.greatest("start", "b_start"), "end": F.least(F.col("_to") + 1, "b_end")})
    return apart(pairs).select(*a.columns, *(f"b_{c}" for c in b.columns))


def _islands(df: DataFrame, parts: list[str], aggregates: dict[str, Column]) -> DataFrame:
    order = Window.partitionBy(*parts).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = df.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    numbered = numbered.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*parts, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *(c.alias(n) for n, c in aggregates.items())).drop("_island")


def merge(a: DataFrame, stranded: bool = True, extra: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """Unions of overlapping or touching intervals, with the number of members.

    `extra` are further key columns. Islands are formed among the intervals that start in one piece, and then among those
    islands, of which there are far fewer.
    """
    return merge_by(a, _keys(stranded) + (extra or []), {"n": (F.count(F.lit(1)), F.sum("n"))}, piece)


def merge_by(a: DataFrame, keys: list[str], aggregates: dict[str, tuple[Column, Column]], piece: int = PIECE) -> DataFrame:
    """Unions by keys: keys, start, end and aggregates, given as name: (over intervals, over the pieces' results)."""
    first = _islands(a.withColumn("_piece", F.expr(f"start div {piece}")), [*keys, "_piece"], {n: x for n, (x, _) in aggregates.items()})
    return _islands(first.drop("_piece"), keys, {n: y for n, (_, y) in aggregates.items()}).select(*keys, "start", "end", *aggregates)


def subtract(a: DataFrame, b: DataFrame, key: list[str], stranded: bool = True) -> DataFrame:
    """What is left of each interval of a outside all of b: key, chrom, (strand,) start, end."""
    keys = list(dict.fromkeys([*key, *_keys(stranded)]))
    cut = clip_overlap(a.select(*keys, "start", "end"), b.select(*_keys(stranded), "start", "end"), stranded).select(*keys, "start", "end")
    holes = _islands(cut, keys, {})
    inner = Window.partitionBy(*keys).orderBy("start")
    whole = a.select(*keys, F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    gaps = holes.withColumn("_next", F.lead("start").over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    pairs = whole.join(gaps, keys, "left")
    pieces = F.when(F.col("start").isNull(), F.array(F.struct(F.col("_lo").alias("s"), F.col("_hi").alias("e")))).otherwise(
        F.concat(
            F.when(F.col("_first"), F.array(F.struct(F.col("_lo").alias("s"), F.col("start").alias("e")))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>")),
            F.array(F.struct(F.col("end").alias("s"), F.coalesce("_next", "_hi").alias("e"))),
        )
    )
    return pairs.select(*keys, F.explode(pieces).alias("p")).select(*keys, F.col("p.s").alias("start"), F.col("p.e").alias("end")).filter("start < end")


def subtract_within(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, start, end of what the intervals of b with an id leave of the interval of a with that id."""
    whole = a.select("id", "start", "end").filter("start < end")
    cut = whole.join(b.select("id", F.col("start").alias("_s"), F.col("end").alias("_e")), "id")
    cut = cut.select("id", F.greatest("start", "_s").alias("start"), F.least("end", "_e").alias("end")).filter("start < end")
    holes = merge_by(cut, ["id"], {})
    inner = Window.partitionBy("id").orderBy("start")
    after = holes.select("id", F.col("end").alias("start"), F.lead("start").over(inner).alias("end"))
    after = after.join(whole.select("id", F.col("end").alias("_end")), "id").select("id", "start", F.coalesce("end", "_end").alias("end"))
    first = whole.join(holes.groupBy("id").agg(F.min("start").alias("_s")), "id", "left").select("id", "start", F.coalesce("_s", "end").alias("end"))
    return first.unionByName(after).filter("start < end")


def coverage_runs(a: DataFrame, stranded: bool = True, piece: int = PIECE) -> DataFrame:
    """Run-length depth between the first start and the last end of each chromosome, runs of zero depth included.

    Changes of depth are summed by position; running sums go within pieces, after the sum of the pieces before, which is
    a window over one row a piece.
    """
    keys = _keys(stranded)
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    steps = a.select(*keys, ends.alias("x")).groupBy(*keys, F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d"))
    steps = steps.withColumn("_piece", F.expr(f"pos div {piece}"))
    totals = steps.groupBy(*keys, "_piece").agg(F.sum("d").alias("t"), F.min("pos").alias("first"))
    over = Window.partitionBy(*keys).orderBy("_piece")
    offsets = totals.select(
        *keys, "_piece", F.coalesce(F.sum("t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(over).alias("after")
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy("pos")
    run = steps.join(offsets, [*keys, "_piece"]).select(
        *keys, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(inside), "after").alias("end"),
        (F.col("before") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("depth"),
    )
    return run.filter("end is not null")


def nearest_feature(query: DataFrame, features: DataFrame, direction: str) -> DataFrame:
    """For each query interval (id, strand, q_start, q_end) the nearest feature of its id downstream or upstream, 5' to 3'.

    Features have id, f_start, f_end. Queries without one keep nulls; ties go to the longer feature.
    """
    down = direction == "downstream"
    plus = F.col("strand") == "+"
    after = F.col("f_start") >= F.col("q_end")
    before = F.col("f_end") <= F.col("q_start")
    right = (plus & after) | (~plus & before) if down else (plus & before) | (~plus & after)
    hit = F.when(right, F.struct("f_start", "f_end"))
    # Places in the order of search: ascending on the side after the query, descending before it.
    rank = F.when(F.col("f_start") >= F.col("q_end"), F.struct(F.col("f_start").alias("x"), (-F.col("f_end")).alias("y"))).otherwise(
        F.struct((-F.col("f_end")).alias("x"), F.col("f_start").alias("y"))
    )
    joined = query.join(features.select("id", "f_start", "f_end"), "id", "left")
    best = joined.groupBy(*query.columns).agg(F.min_by(hit, F.when(right, rank)).alias("hit"))
    return best.select(*query.columns, F.col("hit.f_start").alias("f_start"), F.col("hit.f_end").alias("f_end"))


def relative(start: Column, end: Column, tx_start: Column, tx_end: Column, strand: Column) -> Column:
    """An interval on its transcript's 5' to 3' axis, as struct<start, end>."""
    minus = strand == "-"
    return F.struct(
        F.when(minus, tx_end - end).otherwise(start - tx_start).alias("start"), F.when(minus, tx_end - start).otherwise(end - tx_start).alias("end")
    )
