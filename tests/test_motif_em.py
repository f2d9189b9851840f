"""Motif refinement with several matrices: two planted motifs, windows against a plain search, preferences and likelihoods by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.operators import motif as M
from locusflow.operators import motif_em as E
from locusflow.store import numbered


def test_best_windows_against_plain_search():
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGUTNacgu") for _ in range(rng.choice((0, 1, 3, 4, 9, 30)))) for _ in range(200)]
    data, ends = np.frombuffer("".join(seqs).encode(), np.uint8), np.cumsum([len(s) for s in seqs])
    for width in (1, 4, 7):
        m = np.array([[rng.choice((0.1, 0.5, 1.0)) for _ in range(4)] for _ in range(width)])
        m /= m.max(1, keepdims=True)
        score, place = E.best_windows(data, ends, m)
        for s, a, p in zip(seqs, score, place, strict=True):
            want = M.best_window(s, m) if len(s) >= width else (0.0, 0)
            assert a == pytest.approx(want[0]) and p == want[1]
    assert E.best_windows(data[:0], np.zeros(2, int), m)[1].tolist() == [0, 0]


def test_matrix_sets():
    kmers = [("UGCAUGC", 20.0), ("GCAUGCA", 18.0), ("UGCAUGA", 9.0), ("CCCUCCC", 15.0), ("CCUCCCG", 12.0), ("GANUCCC", 50.0)]
    a, b = E.matrix_set(kmers)
    assert E.consensus(a) == "UGCAUGCA" and E.consensus(b) == "CCCUCCCG"
    assert a.max(1).tolist() == [1.0] * len(a) and len(E.matrix_set(kmers, most=1)) == 1
    flat = np.vstack([[1, 0.9, 0.8, 0.9], a, [1, 1, 1, 1]])
    assert E.shrink(flat, 0.7).tolist() == a.tolist() and len(E.shrink(np.ones((3, 4)))) == 1


def test_preference_and_likelihood(spark):
    rows = [(1, "+", 100, 140, 5, 0), (2, "-", 200, 240, 10, 0), (3, "+", 0, 40, 0, 1), (4, "+", 0, 40, 1, 0)]
    x = spark.createDataFrame(rows, "id long, strand string, start long, end long, place long, motif int")
    events = spark.createDataFrame([(1, 105), (1, 105), (1, 139), (2, 231), (3, 2), (9, 1)], "id long, pos long")
    got = {(r.id, r.motif): sorted([r.offset]) for r in E.offsets(x, events).filter("id <> 1").collect()}
    assert got == {(2, 0): [-1], (3, 1): [2]}
    h = E.counted(x, events)
    p = {(r.motif, r.offset): r.p for r in E.preference(h.filter("id < 3")).collect()}
    assert p[0, 0] == pytest.approx((3 / 33 + 1 / 32) / 2) and p[0, -1] == pytest.approx((1 / 33 + 2 / 32) / 2) and len(p) == 31
    assert sum(p.values()) == pytest.approx(1)
    logs = {r.id: r.log_l for r in E.log_likelihood(h, p).collect()}
    assert logs[1] == pytest.approx(2 * math.log(p[0, 0]) / 3) and logs[2] == pytest.approx(math.log(p[0, -1])) and logs[3] == E.UNSEEN and 4 not in logs
    assert {r.log_l for r in E.log_likelihood(h, {}).collect()} == {E.UNSEEN}


def test_boundaries(spark):
    rows = [(1, "+", 100, 120, "A" * 20, 8, 0), (2, "-", 100, 120, "ACGU" * 5, 8, 0), (3, "+", 100, 120, "A" * 20, 1, 1), (4, "+", 100, 120, "A" * 20, 16, 0)]
    x = spark.createDataFrame(rows, "id long, strand string, start long, end long, seq string, place long, motif int")
    got = {r.id: (r.start, r.end, r.seq) for r in E.narrowed(x, [4, 6]).collect()}
    assert got == {1: (105, 115, "A" * 10), 2: (105, 115, ("ACGU" * 5)[5:15]), 3: (100, 110, "A" * 10), 4: (113, 120, "A" * 7)}
    twice = {r.id: (r.start, r.end) for r in E.narrowed(x, [4, 6], moved_twice=True).collect()}
    assert twice[1] == (105, 120) and twice[2] == (100, 115)


def test_elbow_by_ranges(spark):
    z = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 0, 2, 20, 5, 4, 7, 6, 12])], "id long, z double").repartition(3)
    assert E.elbow_of(z, "z", 1.0) == 12 and E.elbow_of(z, "z", 50.0) is None and E.elbow_of(z.filter("id < 0"), "z", 1.0) is None
    assert sorted((r.z, r.n) for r in numbered(z, ["z"], "n").collect()) == [(v, i) for i, v in enumerate(sorted([3, 1, 0, 2, 20, 5, 4, 7, 6, 12]))]


def test_two_planted_motifs(spark, tmp_path):
    """Clusters on both strands with one of two motifs at any place and events beside it; others have neither."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ACGU") for _ in range(n))
    motifs, clusters, events, truth = ("GCAUGCA", "CUCCUCC"), [], [], {}
    for i in range(700):
        start, strand, s = i * 1000, rng.choice("+-"), word(30)
        if i < 240:
            m, at = i % 2, rng.randrange(5, 19)
            s = s[:at] + motifs[m] + s[at + 7 :]
            truth[i] = (m, at)
            along = [at + 2] * 6 + [at + 3]
        else:
            along = [rng.randrange(8, 22) for _ in range(7)]
        clusters.append((i, strand, start, start + 30, s, rng.choice((0.99, 0.5)) if i < 240 else 0.4))
        events += [(i, start + 30 - a if strand == "-" else start + a) for a in along]
    clusters.append((900, "+", 0, 30, word(30), 0.99))  # without events
    c = spark.createDataFrame([*clusters, clusters[0]], "id long, strand string, start long, end long, seq string, pseudoscore double")
    controls = spark.createDataFrame([(i, word(30)) for i in range(600)] + [(600 + i, word(12) + m + word(12)) for i, m in enumerate(motifs * 6)], "id long, seq string")
    out, log = E.refine_set(c, spark.createDataFrame(events, "id long, pos long"), controls, k=5, rounds=2, draws=20, log_l_step=1.2)
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 700 and log and log[0].included == sum(x[5] > 0.95 for x in clusters[:-1])
    found = {j for c_ in log[0].consensus for j, m in enumerate(motifs) if any(m[a : a + 5] in c_ for a in range(3))}
    assert {0, 1} <= found
    stamped = [r for r in rows.values() if r.stamp is not None]
    right = [r for r in stamped if r.id in truth]
    assert len(right) > 90 and len(right) > 0.7 * len(stamped)  # of about 120 planted among about 580 open ones
    near = 0
    for r in right:
        m, at = truth[r.id]
        base = r.id * 1000
        lo, hi = (base + at, base + at + 7) if r.strand == "+" else (base + 30 - at - 7, base + 30 - at)
        assert r.end - r.start == len(r.seq)
        near += r.start <= lo + 2 and r.end >= hi - 2 and r.end - r.start < 22
    assert near > 0.85 * len(right)
    E.write_matrices(spark, log, str(tmp_path / "m"))
    again = E.read_matrices(spark, str(tmp_path / "m"), 0)
    assert all(np.allclose(a, b) for a, b in zip(again, log[0].matrices, strict=True)) and len(again) == len(log[0].matrices)


def test_nothing_to_refine(spark):
    schema = "id long, strand string, start long, end long, seq string, pseudoscore double"
    events, controls = spark.createDataFrame([(1, 5)], "id long, pos long"), spark.createDataFrame([(1, "ACGU")], "id long, seq string")
    for rows in ([], [(1, "+", 0, 9, None, None)], [(1, "+", 0, 9, "ACGUACGUA", 0.1)]):
        out, log = E.refine_set(spark.createDataFrame(rows, schema), events, controls, k=3, rounds=2, draws=2)
        assert out.count() == len(rows) and not log and out.filter("include").isEmpty()


def test_query_leaves_out_no_work(spark, monkeypatch):
    """The query refines with the operator's own rounds, draws and length of k-mers, on all clusters, events and controls."""
    import inspect

    from locusflow.plans import bindings, catalog

    seen = {}
    own = inspect.signature(E.refine_set)

    def refine(*args, **given):
        seen.update(own.bind(*args, **given).arguments)
        return args[0].selectExpr("*", "true AS include", "0 AS stamp", "0 AS motif", "0L AS place", "1D AS score", "0D AS log_l"), []

    rows = [(i, "ACGU" * 20, "ip" if i % 2 else "input") for i in range(40)]
    monkeypatch.setattr(E, "refine_set", refine)
    monkeypatch.setattr(bindings, "sequences", lambda *_: spark.createDataFrame(rows, "id long, seq string, role string"))
    catalog.motif_set_refinement(spark, "")
    assert seen["clusters"].count() == 20 and seen["controls"].count() == 20 and seen["events"].count() == 200
    assert all(seen.get(n, own.parameters[n].default) == own.parameters[n].default for n in ("k", "rounds", "draws", "most_kmers"))
