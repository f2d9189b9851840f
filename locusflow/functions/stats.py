"""Tail probabilities in numpy and plain Python, and pandas UDFs over them.

scipy is not needed. Tails of Poisson and binomial counts are incomplete gamma and beta functions over whole arrays; the
other functions take scalars, and their UDFs call them once for each different argument tuple of a batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Largest samples whose p-values are exact; beyond, asymptotic ones are taken. These are the usual automatic choice of
#: statistics libraries, and parameters of the functions.
EXACT_KS = 10_000
EXACT_WILCOXON = 25


#: Coefficients of the usual approximation of log gamma (g = 7, nine terms): fixed values.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers; from 1e4 on by Stirling's series, which loses no digits there."""
    x = np.asarray(x, float)
    y = np.minimum(x, 1e4) - 1
    series = np.full(y.shape, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + c / (y + i)
    t = y + 7.5
    small = 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(t) - t + np.log(series)
    big = np.maximum(x, 1.0)
    return np.where(x < 1e4, small, (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big))


def gamma_lower(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function P(a, x) of arrays, a > 0 and x >= 0: its series below a + 1, else one
    minus the continued fraction. Terms needed grow with the square root of a, not with a."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        front = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - log_gamma(a))
    low = (x > 0) & (x < a + 1)
    i = np.flatnonzero(low.ravel())
    aa, xx = a.ravel()[i], x.ravel()[i]
    term = total = 1 / aa
    n, live = 0, np.arange(len(i))
    term, total = term.copy(), total.copy()
    while len(live):
        n += 1
        term[live] *= xx[live] / (aa[live] + n)
        total[live] += term[live]
        live = live[term[live] > total[live] * 1e-17]
    out.ravel()[i] = total * front.ravel()[i]
    i = np.flatnonzero((~low & (x > 0)).ravel())
    aa, xx = a.ravel()[i], x.ravel()[i]
    b = xx + 1 - aa
    c, d = np.full(len(i), 1e300), 1 / np.where(b == 0, 1e-300, b)
    h, live, n = d.copy(), np.arange(len(i)), 0
    while len(live):
        n += 1
        num = -n * (n - aa[live])
        b[live] += 2
        d[live] = 1 / _off_zero(num * d[live] + b[live])
        c[live] = _off_zero(b[live] + num / c[live])
        step = c[live] * d[live]
        h[live] *= step
        live = live[np.abs(step - 1) > 1e-15]
        if n > 200_000:
            break
    out.ravel()[i] = 1 - h * front.ravel()[i]
    return np.clip(out, 0.0, 1.0)


def _off_zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


def beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b) of arrays, a and b > 0, by its continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    with np.errstate(under="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(y) + b * np.log1p(-y)) / a
    c, d = np.ones(a.shape), 1 / _off_zero(1 - (a + b) * y / (a + 1))
    h, live, n = d.copy(), np.ones(a.shape, bool), 0
    while live.any() and n < 200_000:
        n += 1
        for num in (n * (b - n) * y / ((a + 2 * n - 1) * (a + 2 * n)), -(a + n) * (a + b + n) * y / ((a + 2 * n) * (a + 2 * n + 1))):
            d = 1 / _off_zero(1 + num * d)
            c = _off_zero(1 + num / c)
            h = np.where(live, h * c * d, h)
        live &= np.abs(c * d - 1) > 1e-15
    out = np.where(inside, front * h, np.where(x >= 1, 1.0, 0.0))
    return np.clip(np.where(turn, 1 - out, out), 0.0, 1.0)


def poisson_tails(k: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """P(X > k) of arrays, rounded as one minus the cumulated probability is (0 below about 1e-16)."""
    k, mu = np.floor(np.asarray(k, float)), np.asarray(mu, float)
    tail = gamma_lower(np.maximum(k, 0) + 1, np.maximum(mu, 0))
    return np.where(mu <= 0, 0.0, np.where(k < 0, 1.0, np.where(tail < 1e-16, 0.0, tail)))


def binomial_cdfs(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= k) of arrays."""
    k, n, p = (np.asarray(v, float) for v in (k, n, p))
    inner = (k >= 0) & (k < n) & (p > 0) & (p < 1)
    out = beta_lower(np.where(inner, n - k, 1.0), np.where(inner, k + 1, 1.0), np.where(inner, 1 - p, 0.5))
    return np.where(inner, out, np.where(k >= n, 1.0, np.where(k < 0, 0.0, (p <= 0).astype(float))))


def poisson_upper(k: float, mu: float) -> float:
    return float(poisson_tails(k, mu))


def binomial_cdf(k: int, n: int, p: float) -> float:
    return float(binomial_cdfs(k, n, p))


def ks_p(d: float, m: int, n: int, exact: int = EXACT_KS) -> float:
    """One-sided two-sample Kolmogorov-Smirnov: P(D >= d) without ties. Exact up to `exact` values a sample (equal sizes: always)."""
    if m <= 0 or n <= 0:
        return float("nan")
    if d <= 0:
        return 1.0
    if m == n:
        h = round(d * n)
        return float(np.prod([(n - j) / (n + j + 1) for j in range(h)]))
    if max(m, n) > exact:
        big, small = max(m, n), min(m, n)
        z = math.sqrt(m * n / (m + n)) * d
        return min(1.0, math.exp(-2 * z * z - 2 * z * (big + 2 * small) / math.sqrt(m * n * (m + n)) / 3))
    # The share of lattice paths from (0, 0) to (m, n) that reach i/m - j/n >= d, diagonal by diagonal as probabilities.
    g = math.gcd(m, n)
    bound = round(d * (m // g) * n)
    i = np.arange(m + 1)
    safe = np.zeros(m + 1)  # probability to be at (i, s - i) and never to have crossed
    safe[0] = 1.0
    for s in range(m + n):
        new = safe * np.clip(n - s + i, 0, n) / (m + n - s)
        new[1:] += safe[:-1] * (m - i[:-1]) / (m + n - s)
        new[(i * (n // g) - (s + 1 - i) * (m // g) >= bound) | (i > s + 1) | (s + 1 - i > n)] = 0.0
        safe = new
    return float(min(1.0, max(0.0, 1.0 - safe[m])))


def wilcoxon_p(r: float, n: int, ties: float, zeros: int = 0, exact: int = EXACT_WILCOXON) -> float:
    """P(R+ >= r) of n signed ranks; ties is the sum of t^3 - t over groups of t equal ranks.

    Exact for up to `exact` ranks without ties and zeros, else by the normal approximation.
    """
    if not n:
        return 1.0
    if n <= exact and not zeros and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return float(ways[math.ceil(r) :].sum() / 2**n)
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return 0.5 * math.erfc((r - n * (n + 1) / 4) / sd / math.sqrt(2))


def wilcoxon_greater(diffs: list[float], exact: int = EXACT_WILCOXON) -> tuple[float, float]:
    """(R+, p) of the signed-rank test that differences exceed 0; zeros are dropped, ties get average ranks."""
    d = np.array([x for x in diffs if x != 0], float)
    size = np.sort(np.abs(d))
    lo, hi = np.searchsorted(size, np.abs(d), "left"), np.searchsorted(size, np.abs(d), "right")
    r = float(((lo + hi + 1) / 2)[d > 0].sum())
    return r, wilcoxon_p(r, len(d), float(((hi - lo) ** 2 - 1).sum()), len(diffs) - len(d), exact)


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # The fraction 1 / (1 + c1 / (1 + c2 / ...)), by the modified Lentz method.
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        k = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            num = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def t_upper(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def find_peaks(v: np.ndarray, height: float, distance: int = 1) -> list[int]:
    """Strict local maxima (of a plateau its middle, rounded down) of at least `height`, the highest first keeping `distance`."""
    v = np.asarray(v, float)
    peaks, i = [], 1
    while i < len(v) - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < len(v) - 1 and v[j + 1] == v[i]:
                j += 1
            if j < len(v) - 1 and v[j + 1] < v[i]:
                if v[i] >= height:
                    peaks.append((i + j) // 2)
                i = j
        i += 1
    keep = [True] * len(peaks)
    for k in sorted(range(len(peaks)), key=lambda k: (-v[peaks[k]], -peaks[k])):
        if keep[k]:
            for step in (-1, 1):
                q = k + step
                while 0 <= q < len(peaks) and abs(peaks[q] - peaks[k]) < distance:
                    keep[q] = False
                    q += step
    return [p for p, k in zip(peaks, keep, strict=True) if k]


def _udf(f, arity: int):
    def on(*cols: pd.Series) -> pd.Series:
        frame = pd.DataFrame(dict(enumerate(cols)))
        known = {}
        out = []
        for row in frame.itertuples(index=False, name=None):
            if any(pd.isna(x) for x in row):
                out.append(None)
                continue
            if row not in known:
                known[row] = f(*row)
            out.append(known[row])
        return pd.Series(out, dtype="float64")

    if arity == 2:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return on(a, b)
        return F.pandas_udf(two, "double")

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return on(a, b, c)
    return F.pandas_udf(three, "double")


def _arrays(f, *cols: pd.Series) -> pd.Series:
    """f over whole columns, null where any argument is."""
    frame = pd.DataFrame(dict(enumerate(cols)))
    known = frame.notna().all(axis=1).to_numpy()
    out = np.full(len(frame), np.nan)
    if known.any():
        out[known] = f(*(frame[c].to_numpy(float)[known] for c in frame))
    return pd.Series(out).where(known, None).astype("float64")


def poisson_upper_udf(k, mu):
    def tail(k: pd.Series, mu: pd.Series) -> pd.Series:
        return _arrays(poisson_tails, k, mu)

    return F.pandas_udf(tail, "double")(k, mu)


def binomial_cdf_udf(k, n, p):
    def cdf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return _arrays(binomial_cdfs, k, n, p)

    return F.pandas_udf(cdf, "double")(k, n, p)


def ks_p_udf(d, m, n):
    return _udf(lambda d, m, n: ks_p(d, int(m), int(n)), 3)(d, m, n)


def t_upper_udf(t, df):
    return _udf(t_upper, 2)(t, df)


def wilcoxon_p_udf(r, n, ties):
    """ties below 0 stands for none, but zeros among the differences."""
    return _udf(lambda r, n, t: wilcoxon_p(r, int(n), max(t, 0.0), int(t < 0)), 3)(r, n, ties)
