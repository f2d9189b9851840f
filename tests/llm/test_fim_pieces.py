"""Fill-in-middle and SentencePiece operators against plain Python, with nulls, long texts, repeats and odd columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from locusflow.llm import fim, pieces
from locusflow.llm.queries import PIECES, tokenizer_path

ODD = ["", None, " ", "  ", "a", "▁", "▁▁ ▁x", " a  b ", "a\n\nb", "<P>", "x<S", "y<M>z", "</s><s><unk><0x41>", "日本語 テキスト", "é é ﬁ  　​", "\x00\x01", "😀👩‍👩‍👧 x", "12 345\t6", "a" * 5000, "a " * 5000, " " * 3000]
CLASH = ("n", "form", "ids", "decoded", "output", "h1", "n_tokens")


def rows(seed: int, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    letters = "abcdefghij  \n<PSM>▁é日😀.,0123"
    out = [(i, "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 2, 5, 40, 300))))) for i in range(n)]
    out += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "of nobody"), (None, None), (3, "again"), (3, "again")]
    rng.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumns({c: F.lit("z") for c in CLASH})


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def plain_fim(d, t):
    t, n = t or "", len(t or "")
    h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (d, n, "plain", None, None, sha(t), sha(t))
    spm = h4 % 100 < 20
    out = "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b] if spm else "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]
    return (d, n, "spm" if spm else "psm", a, b - a, sha(out), sha(t))


def test_fill_in_middle(spark):
    data = rows(1)
    got = fim.digests(frame(spark, data))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain_fim(*r)) for r in data)
    assert {r[2] for r in map(lambda r: plain_fim(*r), data)} == {"plain", "psm", "spm"}
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_fill_in_middle_by_class(spark):
    data = [(i, t) for i, t in enumerate(["ab 12, cd", "日本 x", "", None, "  ..", "a1b2 " * 50])]
    out = fim.fill_in_middle(frame(spark, data), unit="class", plain=100)
    back = {r.doc_id: (r.n, r.text) for r in out.select("doc_id", "n", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()}
    assert back == {i: (n, t or "") for (i, t), n in zip(data, [6, 3, 0, 0, 2, 250], strict=True)}
    cuts = {r.doc_id: (r.prefix_chars, r.prefix_chars + r.middle_chars) for r in out.collect() if r.form != "plain"}
    edges = {0, 2, 3, 5, 6, 7, 9}
    assert set(cuts[0]) <= edges
    with pytest.raises(ValueError):
        fim.bounds(__import__("numpy").zeros(3, "u4"), "word")


def test_sql(spark, duck, compare):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(fim.digests(docs), duck.sql(fim.SQL))


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_path(PIECES))


def test_pieces(spark, library, monkeypatch):
    data = rows(2)
    want = []
    for d, t in data:
        ids = [*library.encode(t or ""), library.eos_id()]
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = pieces.digests(frame(spark, data), tokenizer_path(PIECES))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_pieces_of_one_process(library):
    """Tiny memories and whole-text mode give the same ids; decoding follows the library for any ids."""
    texts = [(t or "").encode() for _, t in rows(3)]
    want = [[*library.encode(t.decode()), library.eos_id()] for t in texts]
    for memory, chunked in ((400_000, True), (3, True), (10, False)):
        m = pieces.Pieces(tokenizer_path(PIECES), memory)
        assert m.chunked
        m.chunked = chunked
        for part in (texts, texts[:7], [b""], [b"", b""]):
            offsets, ids = m.encode(part)
            assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want[: len(part)] if part in (texts, texts[:7]) else set(ids) == {2}
    import numpy as np

    rng = random.Random(5)
    lists = [[rng.choice((0, 1, 2, 3, 28705, 259, 264, rng.randrange(3, 259), rng.randrange(32000))) for _ in range(rng.randrange(9))] for _ in range(3000)]
    for chunked in (True, False):
        m.chunked = chunked
        got = m.decode(np.cumsum([0, *map(len, lists)]), np.array([i for x in lists for i in x], np.int32))
        assert got == [library.decode(x) for x in lists]


def test_empty_and_nulls(spark):
    none = frame(spark, [])
    assert fim.digests(none).isEmpty() and pieces.digests(none, tokenizer_path(PIECES)).isEmpty()
    odd = spark.createDataFrame([(1, None), (2, []), (3, [264, 2])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in pieces.decode(odd, tokenizer_path(PIECES)).collect()} == {1: "", 2: "", 3: "a"}
    with pytest.raises(ValueError):
        pieces.decode(odd.withColumn("decoded", F.lit(1)), tokenizer_path(PIECES))
