"""Exact p-values against all arrangements, asymptotic ones beyond the limit, peaks against all pairs."""

import itertools
import math
import random

import pytest

from locusflow.functions import stats as S


def paths(d, m, n):
    """The share of orders of m and n values whose one-sided statistic reaches d."""
    hit = total = 0
    for places in itertools.combinations(range(m + n), m):
        i = j = 0
        reached = False
        for k in range(m + n):
            i, j = (i + 1, j) if k in places else (i, j + 1)
            reached = reached or i * n - j * m >= round(d * m * n)
        hit += reached
        total += 1
    return hit / total


@pytest.mark.parametrize("m,n", [(3, 5), (6, 4), (5, 7), (1, 4), (4, 1), (4, 4)])
def test_ks_exact(m, n):
    whole = math.lcm(m, n)  # the statistic is a multiple of its inverse
    for k in range(1, whole + 1):
        assert S.ks_p(k / whole, m, n) == pytest.approx(paths(k / whole, m, n), abs=1e-12)


def test_ks_beyond_the_limit():
    exact, rough = (S.ks_p(0.12, 150, 220, limit) for limit in (10_000, 100))
    assert exact != rough and rough == pytest.approx(exact, rel=0.1)


def test_wilcoxon_on_both_sides():
    rng = random.Random(1)
    d = [rng.gauss(0.4, 1) for _ in range(18)]
    r, p = S.wilcoxon_greater(d)
    signs = list(itertools.product((0, 1), repeat=10))
    few = d[:10]
    rank = {x: i + 1 for i, x in enumerate(sorted(map(abs, few)))}
    mine = sum(rank[abs(x)] for x in few if x > 0)
    assert S.wilcoxon_greater(few) == (mine, pytest.approx(sum(sum(i + 1 for i, s in enumerate(c) if s) >= mine for c in signs) / len(signs)))
    assert S.wilcoxon_greater(d, exact=10)[0] == r and S.wilcoxon_greater(d, exact=10)[1] == pytest.approx(p, abs=0.02) and S.wilcoxon_greater(d, exact=10)[1] != p


def test_peaks_keep_their_distance():
    rng = random.Random(2)
    for distance in (1, 3, 8):
        v = [rng.random() for _ in range(120)]
        got = S.find_peaks(v, 0.2, distance)
        tops = [i for i in range(1, 119) if v[i - 1] < v[i] > v[i + 1] and v[i] >= 0.2]
        want = []
        for p in sorted(tops, key=lambda p: -v[p]):
            if all(abs(p - q) >= distance for q in want):
                want.append(p)
        assert got == sorted(want) and not math.isnan(v[0])
