"""Windows of matrices are scored in passes, whatever the size of a batch."""

import random

import numpy as np

from locusflow.operators import motif_em as E


def test_windows_by_passes(monkeypatch):
    """Passes that end within sequences and matrices change nothing, and no array is as long as the batch."""
    rng = random.Random(3)
    seqs = ["".join(rng.choices("ACGUN", k=rng.choice((0, 2, 5, 40, 300)))).encode() for _ in range(60)]
    data, ends = np.frombuffer(b"".join(seqs), np.uint8), np.cumsum([len(s) for s in seqs])
    m = np.array([[rng.choice((0.2, 0.5, 1.0)) for _ in "ACGU"] for _ in range(5)])
    m /= m.max(1, keepdims=True)
    want = [E.best_windows(np.frombuffer(s, np.uint8), np.array([len(s)]), m) for s in seqs]
    for step in (1, 7, 64):
        monkeypatch.setattr(E, "PASS", step)
        score, place = E.best_windows(data, ends, m)
        assert score.tolist() == [w[0][0] for w in want] and place.tolist() == [w[1][0] for w in want]


def test_windows_of_a_large_batch_take_little_memory():
    import tracemalloc

    data = np.frombuffer(b"ACGU" * 2_000_000, np.uint8)
    tracemalloc.start()
    E.best_windows(data, np.arange(800, len(data) + 1, 800), np.eye(4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
