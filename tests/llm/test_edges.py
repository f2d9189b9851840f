"""Cases at the edges: exact assignment, families without a center, repeated and null ids, very long texts, big archives."""

import gzip
import hashlib
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from locusflow.llm import common, decontam, jaccard_join, packing, pii, quality, sharding, warc
from tests.llm.test_text_operators import base_spans, links, plain_counts

DOCS = "doc_id long, text string"


def test_each_piece_goes_to_the_cheapest_with_room():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.choice((1, 3, 17, 60, 64, 65, 200)) + rng.randrange(5) for _ in range(rng.randrange(1, 60))]
        room = packing.capacities(sum(sizes), 64)
        spent, filled = [0.0] * len(room), [0] * len(room)
        todo = [(d, s, min(64, n - s)) for d, n in enumerate(sizes) for s in range(0, n, 64)]
        for d, s, n, q, o in packing.pack(sizes, 64):
            todo.sort(key=lambda p: (-packing.cost(p[2]), p[0], p[1]))
            piece = todo.pop(0)
            fits = [i for i in range(len(room)) if room[i] - filled[i] >= piece[2]] or [i for i in range(len(room)) if filled[i] < room[i]]
            best = min(fits, key=lambda i: (spent[i], i))
            take = min(piece[2], room[best] - filled[best])
            assert (d, s, n, q, o) == (piece[0], piece[1], take, best, filled[best])
            filled[best] += take
            spent[best] += packing.cost(take)
            if take < piece[2]:
                todo.append((piece[0], piece[1] + take, piece[2] - take))
        assert not todo and filled == room


def test_other_vocabularies_are_taken_as_they_are(spark, tmp_path):
    """A vocabulary that keeps case and white space gives the ids of its tokenizer."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = {c: i + 2 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,!?\n")}
    tok = Tokenizer(models.BPE(vocab=letters | {"<unk>": 0}, merges=[], unk_token="<unk>"))
    tok.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
    tok.save(str(tmp_path / "t.json"))
    text = "Aa b  C!"
    out = packing.pack_documents(spark.createDataFrame([(1, text)], DOCS), str(tmp_path / "t.json"), 64).collect()
    assert out[0].doc_tokens == len(text) + 1


def chain(rng, n, size=200, step=18):
    """Texts of which each links with the next ones only, so that a family has no center."""
    words = [f"v{rng.randrange(10**6)}" for _ in range(size + n * step)]
    return [" ".join(words[i * step : i * step + size]) for i in range(n)]


def test_family_without_a_center(spark, monkeypatch):
    rng = random.Random(8)
    rows = list(enumerate(chain(rng, 40)))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(100 + i, t) for i, t in enumerate(chain(rng, 12, 60, 40))]  # too far apart to link
    want = links(rows, 3, 80, 100)
    assert len({c for _, c in want.values()}) == 13
    for block, size in ((1024, 4 << 20), (3, 4 << 20), (1024, 4000)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", size)
        got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), 3, 80, 100).collect()}
        assert got == want


def test_jaccard_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(chain(rng, 15) + chain(rng, 15))]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS), 3, 80, 100).collect()}
    assert got == links(rows, 3, 80, 100)


def test_rows_of_one_id_and_several_texts(spark):
    """They count as one node: what links with either is in one component."""
    rng = random.Random(2)
    a, b = (" ".join(f"{p}{rng.randrange(999)}" for _ in range(80)) for p in "ab")
    rows = [(1, a), (5, a), (5, b), (3, b), (9, b + " end"), (7, None), (None, a)]
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS), 3, 90, 100).collect())
    assert got == Counter({(1, 1): 1, (5, 1): 2, (3, 1): 1, (9, 1): 1, (7, 7): 1, (None, None): 1})
    assert jaccard_join.keep_first(spark.createDataFrame(rows, DOCS)).count() == 3


def test_warc_ids(spark):
    """Rows of one page_id and different html keep each its payload; rows without an id revisit what has one."""
    rows = [(1, "u", "same"), (1, "u", "only here"), (2, "u", "same"), (None, "u", "same"), (None, "u", "none has an id"), (None, "u", "none has an id"), (2, "u", "same")]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_digest) for r in out)
    same, other, third = (warc.digest(x) for x in (b"same", b"only here", b"none has an id"))
    assert got == Counter({(1, "revisit", 2, same): 1, (1, "response", None, other): 1, (2, "response", None, same): 2, (None, "revisit", 2, same): 1, (None, "response", None, third): 2})


def test_warc_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, "u", f"body {i % 3}") for i in range(30)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter(r.record_type for r in out) == {"response": 3, "revisit": 27}
    assert all(r.refers_to == max(i for i in range(30) if i % 3 == r.page_id % 3) for r in out if r.record_type == "revisit")


def test_long_records(spark):
    """A record whose length has a highest byte other than 0 is followed by an empty member."""
    long = "x" * ((1 << 24) + 5)
    out = warc.round_trip(spark.createDataFrame([(1, "u", long), (2, "u", "y")], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in out) == [(1, len(long)), (2, 1)]


def test_salvage_is_linear():
    """100 MB of gzip members, and of members that are cut off, in far less than quadratic time."""
    rng = random.Random(1)
    body = rng.randbytes(25_000)
    one = gzip.compress(warc.record(1, "u", body, None) + b"\r\n", 1)
    took = []
    for n in (1000, 4000):
        data = one * n
        began = time.perf_counter()
        assert sum(1 for f in warc.salvage(data) if f[0] == "record") == n
        took.append(time.perf_counter() - began)
    assert len(data) >= 100_000_000 and took[1] < 8 * took[0] + 1
    broken = (one[:-9] + one) * 500
    began = time.perf_counter()
    assert sum(1 for f in warc.salvage(broken) if f[0] == "record") >= 500
    assert time.perf_counter() - began < 4 * took[1] + 5


def test_templates_match(spark):
    item = "If Tom has 9 apples and Anna has 4 apples then how many apples do the two children have in all at home"
    rows = [
        (1, item.replace("9", "9").replace("4", "9")),  # two values that become one
        (2, item.replace("Anna", "Mary Ann")),  # a name of two words
        (3, item.replace("If Tom", "If Carol").replace("9", "12")), (4, "Say: " + item.replace("children", "young children")),
        (5, item.replace("Tom", "Bob").replace("apples and", "pears and")), (6, "Tom has apples and Anna has pears at home"), (7, None),
    ]
    bench = [(1, item), (2, "Maria buys 3 pens at 2 dollars each and pays with 10 dollars so what does the shop give back")]
    rows += [(8, "Text. " + bench[1][1].replace("Maria", "Carlos").replace("3", "5"))]  # a name that begins the item
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 2)}


def test_decontamination_against_brute_force(spark):
    """Copies of 13 words or more, found by trying every place, are all reported; texts without a common window are not."""
    rng = random.Random(6)
    words = [f"{c}{d}w" for c in "abcdefghij" for d in "klmnopqrst"]
    bench = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(14, 40)))) for i in range(12)]
    rows = []
    for d in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if d % 2:
            i = rng.choice(bench)[1].split()
            a = rng.randrange(len(i) - 5)
            t[3:3] = i[a : a + rng.randrange(3, 30)]
        rows.append((d, " ".join(t)))
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    grams = lambda t, k: {tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)}
    runs = {(d, i) for d, t in rows for i, x in bench if grams(t, decontam.RUN) & grams(x, decontam.RUN)}
    near = {(d, i) for d, t in rows for i, x in bench if len(grams(t, decontam.WINDOW) & grams(x, decontam.WINDOW)) >= decontam.COVERAGE * len(grams(x, decontam.WINDOW))}
    assert len(runs) > 10 and got == runs | near


def test_verdicts_by_plain_counting(spark):
    """The verdicts equal those of a model fitted document by document in plain Python."""
    import math

    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "and", "river", "stones", "market", "gardens", "walked"])
    rows = []
    for i in range(160):
        w = [word() + str(rng.randrange(99)) * (rng.random() < 0.3) for _ in range(rng.randrange(55, 120))]
        k = i % 8
        w = [x.upper() for x in w] if k == 1 else [x + "##" for x in w] if k == 2 else [x + "!" for x in w] if k == 3 else w
        rows.append((i, " ".join(w)))
    out = {r.doc_id: r for r in quality.score_documents(spark.createDataFrame(rows, DOCS)).collect()}
    names = [f"vote_{k}" for k in quality.rules()]
    votes = {d: [r[n] for n in names] for d, r in out.items() if not r.base_failed}
    good = {d: 0.1 if -1 in v else 0.9 for d, v in votes.items()}
    for _ in range(100):
        share = min(0.95, max(0.05, sum(good.values()) / len(good)))
        odds = []
        for j in range(len(names)):
            one = {}
            for v in (-1, 1):
                a = (sum(p for d, p in good.items() if votes[d][j] == v) + 1) / (sum(good.values()) + 3)
                b = (sum(1 - p for d, p in good.items() if votes[d][j] == v) + 1) / (sum(1 - p for p in good.values()) + 3)
                one[v] = max(0.0, math.log(a / b)) if v > 0 else min(0.0, math.log(a / b))
            odds.append(one)
        good = {d: 1 / (1 + math.exp(-(math.log(share / (1 - share)) + sum(o.get(v, 0.0) for o, v in zip(odds, votes[d]))))) for d in votes}
    for d, r in out.items():
        assert r.kept == (d in good and good[d] >= 0.5)
        if d in good:
            assert abs(r.p_good - good[d]) < 1e-6


def test_sharding_by_plain_integers(spark):
    """Places recomputed without numpy, one row at a time; names of helper columns in the input survive."""
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & m
        x ^= x >> 29
        x = x * 0xC4CEB9FE1A85EC53 & m
        return x ^ x >> 32

    def place(i, n, seed):
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        while True:
            left, right = i >> half, i & (1 << half) - 1
            for k in range(1, sharding.ROUNDS + 1):
                left, right = right, left ^ mix((right + mix((k * 0x9E3779B97F4A7C15 + seed) & m)) & m) & (1 << half) - 1
            i = left << half | right
            if i < n:
                return i

    rows = [(i * 7 % 100, f"t{i}") for i in range(100)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"pid": F.lit("p"), "first": F.lit("f"), "_pid": F.lit(1)})
    out = sharding.shard_rows(df, ["doc_id"], 7, 20).collect()
    assert {(r.pid, r["first"], r._pid) for r in out} == {("p", "f", 1)}
    for r in out:
        p = place(r.doc_id, 100, 20)
        assert (r.row_number, r.shard, r.slot) == (r.doc_id, p % 7, p // 7)


def test_very_long_texts(spark):
    """One text of several chunks among short ones."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(500_000)) + " mail a.b@c.de now"
    assert len(long) > common.CHUNK_BYTES
    rows = [(1, long), (2, "short text"), (3, long), (4, None)]
    df = spark.createDataFrame(rows, DOCS)
    sizes = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 3, 90, 100).collect()}
    words = long.split()
    assert sizes[1] == sizes[3] == (len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}), 1) and sizes[4] == (0, 4)
    q = {r.doc_id: r for r in quality.score_documents(df).collect()}
    assert (q[1].n_words, q[1].word_chars, q[1].n_symbols, q[1].n_dup_lines, q[1].n_repeat_words) == plain_counts(long)
    import public_tokenizers

    pieces = packing.pack_documents(df, str(public_tokenizers.path("word_bpe_49k.json"))).filter("doc_id = 1").collect()
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens > 500_000
    bench = spark.createDataFrame([(1, " ".join(words[499_000:499_030]))], "item_id long, text string")
    assert {r.doc_id for r in decontam.contamination(df, bench).collect()} == {1, 3}
    found = {r.doc_id: r for r in pii.report(df).collect()}
    want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(long))
    assert found[1].n_email == 1 and found[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long)], "page_id long, url string, html string")
    assert {r.payload_bytes for r in warc.round_trip(pages).collect()} == {len(long)}


def test_stages_with_odd_rows(spark):
    """Nulls, repeats, ties, clashing columns and empty tables pass through every stage of the pipeline."""
    import corpus_pipeline as p

    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["the", "of", "and", "to", "rivers", "stoned", "marketing", "garden", "gardens", "stones"]) + str(rng.randrange(99)) * (rng.random() < 0.6) for _ in range(120))
    item = "a train travels from here to there and back again while all of them wait at home"
    t = [text() for _ in range(30)]
    rows = [(i, x, "en", "web", len(x)) for i, x in enumerate(t)] + [(None, t[0] + " new", None, None, None), (None, None, "en", "web", 0), (3, t[3], "en", "web", 1), (3, text(), "en", "web", 1)]
    rows += [(50, t[5] + " x", "en", "web", 2), (60, t[6] + " " + item, "en", "web", 2), (None, text() + " " + item, "en", "web", 2), (70, "", "en", "web", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = {c: F.lit(c) for c in ("node", "key", "kind", "spans", "_drop", "_key", "text_key", "item_id", "home", "block", "value", "url")}
    import tempfile

    sf = tempfile.mkdtemp()
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for docs in (spark.createDataFrame(rows, schema).withColumns(extra), spark.createDataFrame([], schema).withColumns(extra)):
        empty = docs.isEmpty()
        scratch = common.Scratch(spark, "odd")
        kept = []
        for i, (_, stage) in enumerate(p.STAGES[:-1]):
            new = scratch.keep(stage(spark, docs, sf), f"s{i}")
            assert new.columns == docs.columns
            docs = new
            kept.append(Counter((r.doc_id, r.text) for r in new.collect()))
        pieces = p.STAGES[-1][1](spark, docs, sf)
        assert empty == pieces.isEmpty()
        if not empty:
            quality_, near, clean, _ = kept
            assert quality_[(3, t[3])] == 2 and (70, "") not in quality_ and (None, None) not in quality_
            assert near[(3, t[3])] == 1 and (50, t[5] + " x") not in near and (None, t[0] + " new") in near
            assert not [x for _, x in clean if item in x] and len(clean) >= 29
