"""Brackets are matched within their row, in passes."""

import random

import pytest

from locusflow.operators import structure as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_brackets_by_passes(spark, monkeypatch, size):
    rng = random.Random(size)
    monkeypatch.setattr(T, "PASS", size)
    rows = [(i, "".join(rng.choices("([{<)]}>.é😀", k=rng.choice((0, 1, 9, 60))))) for i in range(40)] + [(40, None)]
    want = {}
    for i, s in rows:
        for o, c in zip(T.OPEN, T.CLOSE, strict=True):
            last = {}
            level = 0
            for p, x in enumerate(s or ""):
                if x == o:
                    level += 1
                    last[level] = p
                    want[i, p] = (o, None)
                elif x == c:
                    want[i, p] = (o, last.pop(level, None))
                    if want[i, p][1] is not None:
                        want[i, want[i, p][1]] = (o, p)
                    level -= 1
    x = T.partners(spark.createDataFrame(rows, "id long, structure string"))
    assert "Exchange" not in plan(x) and "Window" not in plan(x)
    assert {(r.id, r.place): (r.kind, r.partner) for r in x.collect()} == want
