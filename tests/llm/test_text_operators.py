"""Operators over documents against brute force, with nulls, empty and long texts, repeats, empty tables, odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import decontam, jaccard_join, packing, pii, quality, sharding, suffix_dedup

WORDS = [f"w{i}" for i in range(60)]


def corpus(seed: int, n: int = 90) -> list[tuple]:
    """Rows of ids and texts: random ones, near and exact copies, shared passages, empty and null texts, a long one."""
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice((12, 40, 120)))) for _ in range(6)]
    passage = " ".join(rng.choice(WORDS) for _ in range(25))
    rows = []
    for i in range(n):
        k = rng.random()
        if k < 0.45:
            w = rng.choice(base).split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            text = " ".join(w)
        elif k < 0.6:
            text = rng.choice(base).upper()
        elif k < 0.8:
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(40))) + "\n" + passage
        else:
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "é " * 3000), (n + 6, "x" * 5000)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, extra: bool = True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("z") for c in ("node", "key", "kind", "bucket", "spans", "_drop", "n_words", "row_number", "shard")}) if extra else df


def links(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("seed,k,num", [(1, 3, 90), (2, 5, 80), (3, 3, 70)])
def test_jaccard(spark, seed, k, num):
    rows = corpus(seed)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(frame(spark, rows), k, num, 100).collect()}
    assert got == links(rows, k, num, 100)


def test_jaccard_keys_meet():
    """Linked sets of any sizes share a key: the bound on parts holds."""
    rng = np.random.default_rng(3)
    for num in (70, 80, 90, 95):
        tiles = jaccard_join.Tiles(num, 100)
        for _ in range(150):
            n = int(rng.integers(2, 400))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            keep = a[rng.random(len(a)) > rng.random() * (1 - num / 100)]
            b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 9)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert np.intersect1d(tiles.keys(a), tiles.keys(b)).size


def test_jaccard_blocks(spark, monkeypatch):
    """Pairs of different components in large keys are found block by block."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = corpus(7, 160)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(frame(spark, rows), 3, 70, 100).collect()}
    assert got == links(rows, 3, 70, 100)


def test_jaccard_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (None, None)]
    got = Counter(map(tuple, jaccard_join.jaccard_components(frame(spark, rows), 3, 90, 100).collect()))
    assert got == Counter({(1, 2, 1): 2, (2, 2, 1): 1, (None, 2, None): 1, (None, 0, None): 1})
    kept = jaccard_join.keep_first(frame(spark, rows))
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, None: 2})


def test_empty_tables(spark):
    e = frame(spark, [])
    b = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.jaccard_components(e).count() == 0 and suffix_dedup.remove_repeats(e).count() == 0
    assert quality.score_documents(e).count() == 0 and pii.report(e).count() == 0 and sharding.shard_documents(e.select("doc_id", "text")).count() == 0
    assert decontam.contamination(e, b).count() == 0 and decontam.contamination(frame(spark, [(1, "a b")]), b).count() == 0
    assert jaccard_join.keep_first(e).count() == 0 and quality.keep_good(e).count() == 0 and pii.redact(e).count() == 0


def removed(rows, length):
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], d)
    out = {}
    for d, t in rows:
        m = np.zeros(len(t) + 2, int)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                m[i + 1 : i + 1 + length] = 1
        kept = bytes(np.frombuffer(t, np.uint8)[m[1:-1] == 0])
        out[d] = (len(t), int(m.sum()), int((np.diff(m) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed) + [(1000 + i, ("ab\0" * 60)[: rng.randrange(180)] + "\0" * rng.randrange(80)) for i in range(12)]
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == removed([(d, (t or "").encode()) for d, t in rows], 50)


def test_suffix_dedup_pieces_and_ids(spark, monkeypatch):
    """Texts cut into small pieces, flushes of few contexts, repeated and null ids."""
    monkeypatch.setattr(suffix_dedup, "STEP", 300)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 200)
    rows = corpus(5)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == removed([(d, (t or "").encode()) for d, t in rows], 50)
    t = "".join(random.Random(1).choice("abcdef") for _ in range(120))
    rows = [(3, t), (3, "q" + t), (None, t), (5, "z" + t[:60])]
    out = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    assert out == [("3", 120, 0), ("3", 121, 0), ("5", 61, 60), ("None", 120, 0)]
    kept = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(frame(spark, rows), with_text=True).filter("doc_id = 5").collect()}
    assert bytes(kept[5]) == b"z"


def test_interval_scan():
    """The stack scan against all pairs: the longest prefix with a smaller document, where a left extension differs."""
    rng = random.Random(4)
    for _ in range(60):
        n, width = rng.randrange(2, 25), 12
        rows = ["".join(rng.choice("ab") for _ in range(width)).encode() for _ in range(n)]
        doc = np.array([rng.randrange(5) for _ in range(n)])
        rest, left = np.array([rng.randrange(6, width + 1) for _ in range(n)]), np.full(n, -1)
        got = suffix_dedup.interval_spans(np.frombuffer(b"".join(r[:k].ljust(width, b"\0") for r, k in zip(rows, rest)), np.uint8).reshape(n, width), rest, doc, left, 5)
        for i in range(n):
            best = 0
            for j in range(n):
                if doc[j] < doc[i]:
                    k = next((x for x in range(min(rest[i], rest[j])) if rows[i][x] != rows[j][x]), min(rest[i], rest[j]))
                    best = max(best, k)
            assert got[i] == (best if best >= 5 else 0)


def plain_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = Counter(zip(w, w[1:], w[2:]))
    cover = {i + j for i in range(len(w) - 2) if win[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dups, len(cover)


def test_quality_counts(spark):
    rows = corpus(3) + [(500, "a b c a b c a"), (501, "a\nb\na\n\na "), (502, "# ** $x <y> | é日本")]
    got = {r.doc_id: r for r in quality.score_documents(frame(spark, rows)).collect()}
    for d, t in rows:
        r, want = got[d], plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_verdicts(spark):
    """Held-out junk of three kinds goes, clean documents stay, and the fitted model equals one fitted by plain counting."""
    rng = random.Random(9)
    clean = lambda: " ".join(rng.choice(["the", "of", "and", "to", *[rng.choice(["river", "stone", "market", "garden"]) + rng.choice(["s", "ed", "ing", ""]) for _ in range(6)]]) + str("." * (rng.random() < 0.1)) for _ in range(rng.randrange(60, 200)))
    rows = [(i, clean()) for i in range(150)]
    rows += [(1000 + i, " ".join(w + "###" for w in clean().split())) for i in range(12)] + [(1100 + i, " | ".join(clean().split())) for i in range(8)]
    rows += [(1200 + i, " ".join(w.upper() + "!!" for w in clean().split())) for i in range(8)]
    kept = {r.doc_id for r in quality.score_documents(frame(spark, rows)).filter("kept").collect()}
    assert not [d for d in kept if d >= 1000]
    assert len(kept) >= 140


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus(4) + [(300, "Don't STOP!? é'll <|endoftext|> x1.2 日本\u0085a b c ΑΣ İx " * 40), (301, "the " * 5000)]
    out = packing.pack_documents(frame(spark, rows), path, 256).collect()
    tok = Tokenizer.from_file(path)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or at & (at - 1) == 0


def test_sharding(spark):
    rows = corpus(6)
    out = sharding.shard_documents(frame(spark, rows).select("doc_id", "text"), 7).collect()
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    again = sharding.shard_documents(frame(spark, rows).repartition(1).select("doc_id", "text"), 7).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}
    texts = dict(rows)
    for r in out:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 16, zlib.crc32(b))
    for n in (1, 2, 5, 1000):
        assert sorted(sharding.feistel(np.arange(n), n, 3).tolist()) == list(range(n))
    dup = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in sharding.shard_documents(dup, 2).collect()) == [(0, 0), (0, 1), (1, 0)]


def base_spans(t):
    out = []
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii(spark):
    rng = random.Random(5)
    texts = [None, "", "a@b.cd%x@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "001.2.3.255 256.1.1.1", "+1 (729) 555-7725 😀 4111 1111 1111 1111", "x" * 9000 + "@", "1" * 9000, "a@b" + ".c" * 900]
    texts += ["".join(rng.choice("ab.@+-% 0123456789()😀é_\n4111") for _ in range(n)) for n in (8, 30, 90) for _ in range(120)]
    texts += [f"key {i}: token = \"{i:040x}\" end" for i in range(20)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in pii.report(frame(spark, rows)).collect()}
    for d, t in rows:
        want = base_spans(t or "")
        coded = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(",".join(coded).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in want) for k in range(4))
        assert set(coded) <= set(r.spans.split(",")) | ({""} if not coded else set())
    assert sum("secret" in got[d].spans for d, t in rows if t and "token" in t) >= 15


def test_redaction(spark):
    rows = [(1, "mail a.b@c.de now 😀 4111 1111 1111 1111!"), (2, None), (3, "plain text 12"), (4, "+49 1111 111 117 x@y.zz")]
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert out[1] == "mail <email> now 😀 <card>!" and out[2] is None and out[3] == rows[2][1]
    assert "x@y" not in out[4] and "1111" not in out[4]


def test_decontamination(spark):
    item = "A train travels 120 km in 3 hours, so how fast does Alice go when she rides with Bob and 3 others to Paris?"
    bench = [(1, item), (2, None), (3, ""), (4, "tiny one here"), (1, item)]
    changed = item.replace("120", "250").replace("3", "5").replace("Alice", "Carol").replace("Bob", "Dave").replace("Paris", "London")
    rows = [(1, "Intro here. " + item + " Then more."), (2, "Well. " + changed), (3, changed.replace("5 others", "7 others")), (4, None), (5, ""), (6, "the quick brown fox " * 20), (7, "so: tiny one here ok"), (8, item[:40])]
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contamination(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(1, 1): "copied", (2, 1): "changed", (7, 4): "copied"}
    left = decontam.drop_contaminated(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 8] and left.columns == frame(spark, rows).columns


def test_decontamination_blocks(spark, monkeypatch):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    bench = [(i, " ".join(rng.choice(plain) for _ in range(20))) for i in range(9)]
    rows = [(i, "intro " + bench[i % 9][1] + " outro") for i in range(18)]
    one = decontam.contamination(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 150)
    many = decontam.contamination(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert len(one) == 18 and Counter(map(tuple, one)) == Counter(map(tuple, many))
