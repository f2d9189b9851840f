"""Column functions on array<double> vectors; a missing value is null, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEFT, RIGHT = "left", "right"
SITE_PSEUDOCOUNT = 1e-4
METHODS = ("subtract", "subtract normal", "relative information", "fold change", None)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def nulls(n: Column) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), n.cast("int"))


def trim_or_pad(v: Column, length: int, align: str = LEFT) -> Column:
    """The first (left) or last (right) `length` values, with nulls on the other side where there are fewer."""
    missing = F.greatest(F.lit(length) - F.size(v), F.lit(0))
    if align == LEFT:
        return F.concat(F.slice(v, 1, length), nulls(missing))
    start = F.greatest(F.size(v) - length + 1, F.lit(1))
    return F.concat(nulls(missing), F.slice(v, start, F.lit(length)))


def window(v: Column, start: Column | int, end: Column | int) -> Column:
    """Values start..end-1, null outside of the vector; empty if end <= start."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.when(end > start, F.transform(F.sequence(start.cast("int"), end.cast("int") - 1), lambda i: F.get(v, i))).otherwise(F.array().cast("array<double>"))


def normalize(v: Column) -> Column:
    """Values over their sum; all null where the sum is 0."""
    return let(total(v), lambda s: F.transform(v, lambda x: F.when(s != 0, x / s)))


def orient(v: Column, strand: Column) -> Column:
    """Nulls as 0; on -, the whole vector is negated if any value is negative."""
    filled = F.transform(v, lambda x: F.coalesce(x, F.lit(0.0)))
    return F.when((strand == "-") & (F.array_min(filled) < 0), F.transform(filled, lambda x: -x)).otherwise(filled)


def _pseudo(v: Column, sites: bool) -> Column:
    return F.lit(SITE_PSEUDOCOUNT) if sites else F.coalesce(F.array_min(F.filter(v, lambda x: x > 0)), F.lit(1.0))


def _shares(v: Column, sites: bool) -> Column:
    return let(_pseudo(v, sites), lambda c: let(F.transform(v, lambda x: x + c), lambda w: let(total(w), lambda s: F.transform(w, lambda x: x / s))))


def remove_background(ip: Column, ctrl: Column, method: str | None, sites: bool = True) -> Column:
    """ip cleaned of ctrl; both of one length and without nulls.

    `relative information` is p log2(p/q) and `fold change` log2(p/q), of shares after a pseudocount: 1e-4 for sites, the
    least positive value of the vector itself (1 if none) for coverage.
    """
    if method not in METHODS:
        raise ValueError(f"unknown background method {method!r}")
    zero = F.lit(0.0)
    if not method:
        return ip
    if method == "subtract":
        return F.zip_with(ip, ctrl, lambda x, y: F.greatest(x - y, zero))
    if method == "subtract normal":
        def normal(s: Column) -> Column:
            return F.when(s["ip"] == 0, F.transform(ip, lambda x: x * 0)).when(s["ctrl"] == 0, F.transform(ip, lambda x: x / s["ip"])).otherwise(
                F.zip_with(ip, ctrl, lambda x, y: F.greatest(x / s["ip"] - y / s["ctrl"], zero))
            )
        return let(F.struct(total(ip).alias("ip"), total(ctrl).alias("ctrl")), normal)
    ratio = lambda p, q: F.log2(p / q)
    if method == "fold change":
        return F.zip_with(_shares(ip, sites), _shares(ctrl, sites), ratio)
    return F.zip_with(_shares(ip, sites), _shares(ctrl, sites), lambda p, q: p * ratio(p, q))


def gaussian_kernel(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-x * x / (2 * sigma * sigma)) for x in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gaussian(v: Column, sigma: float) -> Column:
    """Smoothing with a normalised kernel of radius int(4 sigma + 0.5) and symmetric edges (d c b a | a b c d | d c b a)."""
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    n = F.size(v)

    def folded(j: Column) -> Column:
        m = F.pmod(j, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    taps = F.array(*(F.struct(F.lit(d - r).alias("d"), F.lit(w).alias("w")) for d, w in enumerate(k)))
    at = lambda i: F.aggregate(taps, F.lit(0.0), lambda s, t: s + t["w"] * F.get(v, folded(i + t["d"])))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(v)


def convolve_full(v: Column, kernel: list[float]) -> Column:
    """Full discrete convolution of each row: size(v) + len(kernel) - 1 values."""
    taps = F.array(*(F.struct(F.lit(i).alias("d"), F.lit(float(w)).alias("w")) for i, w in enumerate(kernel)))
    at = lambda i: F.aggregate(taps, F.lit(0.0), lambda s, t: s + t["w"] * F.coalesce(F.get(v, i - t["d"]), F.lit(0.0)))
    return F.transform(F.sequence(F.lit(0), F.size(v) + len(kernel) - 2), at)
