"""The conversation trie against a plain one, at parts and fans so small that conversations and nodes are cut everywhere."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusflow.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, role, key, text))
    turns = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in convs.items()}
    members, ends, kids = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = (*turns.get(c - c % 20, [])[:h], *own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    out = []
    for node in sorted(members, key=len, reverse=True):
        pass
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * words
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return out


def table(seed: int, n: int, longest: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["hello there", "how are you", "", None, "a\tb\nc", "fine   thanks", "x"]
    rows = []
    for c in range(n):
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # an absent base
        size = longest if longest and c == n // 2 else rng.choice((1, 1, 2, 3, 5, 8))
        same = rng.random() < 0.4
        for t in range(size):
            turn = None if rng.random() < 0.03 else t if rng.random() < 0.95 else 1
            rows.append((c, turn, "u" if same else rng.choice(("u", "a", None, "")), texts[t % 2] if same else rng.choice(texts)))
    rows += rng.sample(rows, min(len(rows), 5))
    rows += [(None, 1, "u", "hello there"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("z") for c in ("depth", "hi", "n", "part", "words", "key", "row", "pid")})
    got = trie.prefix_trie(df, **how)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows)))


@pytest.mark.parametrize("seed, n, longest, how", [(1, 90, 0, {}), (2, 70, 0, {"part_rows": 7, "fan": 2}), (3, 45, 120, {"part_rows": 5, "fan": 3}), (4, 3, 60, {"part_rows": 1, "fan": 2})])
def test_trie(spark, seed, n, longest, how):
    check(spark, table(seed, n, longest), **how)


def test_one_conversation_of_many_repeats(spark):
    check(spark, [(7, 1, "u", "same")] * 40 + [(8, 1, "u", "same")] * 3, part_rows=6, fan=2)


def test_copies(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(60) for t in range(4)] + [(c, 9, "a", "last") for c in range(0, 60, 7)]
    check(spark, rows, part_rows=11, fan=2)


def test_small_cases(spark):
    check(spark, [])
    check(spark, [(None, 1, "u", "x")])
    check(spark, [(3, None, None, None)])
    check(spark, [(c, 0, "u", "x y") for c in range(-25, 25)])  # some are left without turns, and negative ids have bases below


def test_sql(spark, duck, compare):
    compare(trie.prefix_trie(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"), part_rows=50, fan=2), duck.sql(trie.SQL))
