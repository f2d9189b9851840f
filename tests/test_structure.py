"""Partners against a stack; smoothed sparse tracks against dense vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from locusflow.functions.vectors import gaussian_kernel
from locusflow.operators import background as BG
from locusflow.operators import structure as T


def stack(s):
    held, out = {c: [] for c in T.OPEN}, {}
    for i, c in enumerate(s):
        if c in T.OPEN:
            held[c].append(i)
            out[i] = None
        elif c in T.CLOSE:
            k = T.OPEN[T.CLOSE.index(c)]
            out[i] = held[k].pop() if held[k] else None
            if out[i] is not None:
                out[out[i]] = i
    return out


def test_partners(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("((.)).[]{}<>") for _ in range(rng.randrange(60)))) for i in range(80)] + [(900, None), (901, ""), (902, ")(("), (903, "([)]")]
    got = {(r.id, r.place): r.partner for r in T.partners(spark.createDataFrame(rows, "id long, structure string")).collect()}
    assert got == {(i, p): q for i, s in rows for p, q in stack(s or "").items()}


def test_annotated(spark):
    s = spark.createDataFrame([(1, "GCAU", "(..)"), (2, "A", "..")], "id long, seq string, structure string")
    t = spark.createDataFrame([(1, 3, 0.5), (2, 0, 1.0), (2, 9, 9.0)], "id long, rp long, value double")
    got = sorted(map(tuple, T.annotated(s, t).select("id", "place", "base", "symbol", "partner", "value").collect()))
    assert got == [(1, 0, "G", "(", 3, None), (1, 1, "C", ".", None, None), (1, 2, "A", ".", None, None), (1, 3, "U", ")", 0, 0.5), (2, 0, "A", ".", None, 1.0), (2, 1, None, ".", None, None)]


@pytest.mark.parametrize("sigma", [0.4, 1.0, 5.0])
def test_smoothed_information(spark, sigma):
    """Vectors shorter than the kernel's reach are mirrored several times."""
    rng = random.Random(3)
    lengths = {1: 40, 2: 3, 3: 1, 4: 25, 5: 7}
    pairs = [(u, i, p, float(rng.randrange(1, 5)), float(rng.randrange(3))) for u in "xy" for i, n in lengths.items() for p in range(n) if rng.random() < 0.3]
    df = spark.createDataFrame(pairs, "uid string, id long, rp long, ip double, ctrl double")
    ln = spark.createDataFrame([(u, i, n) for u in "xy" for i, n in lengths.items()], "uid string, id long, length int")
    values = BG.smoothed_information(df, ln, sigma, keys=["uid", "id"])
    got = {}
    for r in values.collect():
        got.setdefault((r.uid, r.id), [r.zero] * lengths[r.id])[r.rp] = r.value
    kernel, want = gaussian_kernel(sigma), {}
    for u, i in {(x[0], x[1]) for x in pairs}:
        n, sides = lengths[i], []
        for side in (3, 4):
            v = [0.001] * n
            for x in pairs:
                if x[:2] == (u, i):
                    v[x[2]] += x[side]
            v = [x / sum(v) for x in v]
            fold = lambda j, n=n: (j % (2 * n)) if j % (2 * n) < n else 2 * n - 1 - j % (2 * n)
            sides.append([sum(w * v[fold(a + d - len(kernel) // 2)] for d, w in enumerate(kernel)) for a in range(n)])
        want[u, i] = [p * math.log(p / q) for p, q in zip(*sides, strict=True)]
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12)
    m = BG.information_matrix(values, ["uid", "id"], "uid")
    assert set(m.columns) == {"id", "rp", "x", "y"} and m.filter("x < 0 or y < 0 or x is null").isEmpty()
    assert m.agg(F.sum("x")).first()[0] == pytest.approx(values.filter("uid = 'x' and value > 0").agg(F.sum("value")).first()[0])
