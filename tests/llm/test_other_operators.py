"""Conversations, archives, pages, the pipeline and the registered queries."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from locusflow.llm import chat, html_extract, queries, warc
from locusflow.llm.common import Scratch
from tests.conftest import SMALL


def test_chat(spark, duck):
    rows = []
    turns = [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), (None, None)]
    for conv, n in ((1, 2), (2, 4), (3, 4), (4, 5), (5, 1)):
        rows += [(conv, i, *turns[i]) for i in range(n)]
    rows += [(6, 0, "user", "a"), (6, 0, "user", "a"), (7, 0, "user", "x" * 3000), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("full", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.n_snapshots) for r in chat.format_chats(df).collect()}
    assert got == {4: (5, 1), 6: (1, 1), 7: (1, 1), None: (1, 1)}
    assert chat.format_chats(df.filter("conv_id in (2, 3)")).first()["n_snapshots"] == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).withColumn("refers_to_", F.lit(0))


def test_warc_round_trip(spark):
    rng = random.Random(1)
    bodies = ["", None, "<p>é\r\n\r\nWARC/1.1\r\nfake</p>", "<p>x</p>", "y" * 70_000]
    rows = [(i, rng.choice(["http://a/é x", None, "u\r\nv"]), rng.choice(bodies)) for i in range(40)]
    out = {r.page_id: r for r in warc.round_trip(pages(spark, rows)).collect()}
    assert len(out) == 40
    for i, _, h in rows:
        p = (h or "").encode()
        last = max(j for j, _, g in rows if (g or "") == (h or ""))
        r = out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", last))
    assert warc.round_trip(pages(spark, []).limit(0)).count() == 0


def records(n: int) -> list[bytes]:
    return [warc.record(i, "http://x", f"payload {i} ".encode() * (i + 1), None) + b"\r\n" for i in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    """Damage of every kind costs the record it hits, the rest is recovered, and gaps and records cover every byte."""
    whole = [gzip.compress(r) if packed else r for r in records(6)]
    for hit in range(6):
        for damage in ("cut", "flip", "junk", "head"):
            part = bytearray(whole[hit])
            if damage == "cut":
                part = part[: len(part) // 2]
            elif damage == "flip":
                part[len(part) - 12] ^= 0xFF
            elif damage == "junk":
                part = part + b"\0garbage" * 5
            else:
                part[:4] = b"XXXX"
            data = b"".join(bytes(part) if i == hit else w for i, w in enumerate(whole))
            found = list(warc.salvage(data))
            ids = [int(f[3]["x-page-id"]) for f in found if f[0] == "record"]
            assert set(ids) >= {i for i in range(6) if i != hit} and sorted(ids) == ids
            edges = [(f[1], f[2]) for f in found]
            assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
            assert any(f[0] == "gap" for f in found), (hit, damage)
    assert list(warc.salvage(b"")) == []


def test_salvage_in_files(spark, tmp_path):
    data = records(3)
    (tmp_path / "a.warc").write_bytes(data[0] + b"broken\r\n" + data[1])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in rows if r.gap is None) == [0, 0, 1, 1, 2]
    assert [(r.start, r.end) for r in rows if r.gap] == [(len(data[0]), len(data[0]) + 8)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- <p>no</p> --><article><h1>Head &amp; line</h1><p>First   <b>bold</b>
text.<p>Second &eacute; &#233;<br>line</p><aside>side</aside><div class="ad">Buy</div><form><label>Name</label><input></form><p>Be.</p></article>
<section id="comments"><p>I disagree with all of this, as a reader.</p></section><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "u", "<p>" + "long words here and more of them " * 30 + "</p><a href=x>y</a>"), (5, "u", "<div <p"), (6, "u", PAGE.replace("article", "main"))]
    out = {r.page_id: r for r in html_extract.extract_pages(pages(spark, rows)).collect()}
    want = "Head & line\nFirst bold text.\nSecond é é line\nBe."
    assert out[1].text == want and out[1].n_chars == len(want) and out[6].text == want
    assert out[2].text == "" and out[3].text == "" and out[5].n_chars == len(out[5].text)
    assert out[4].text.startswith("long words") and "y" not in out[4].text.split("\n")
    assert html_extract.extract_pages(pages(spark, []).limit(0)).count() == 0


def test_html_tree_held_out():
    """Accuracy on labelled pages that a tree was grown without."""
    import numpy as np

    data = [html_extract.labelled(p) for p in html_extract.PAGES]
    right = total = 0
    for i, (x, y) in enumerate(data):
        rest = [d for j, d in enumerate(data) if j != i]
        tree = html_extract.grow(np.concatenate([d[0] for d in rest]), np.concatenate([d[1] for d in rest]))
        right += int(((html_extract.judge(tree, x) >= 0.5) == (y > 0.5)).sum())
        total += len(y)
    assert right / total >= 0.95


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scratch, counts = Scratch(spark, "test"), []
    for i, (_, stage) in enumerate(p.STAGES[:-1]):
        new = scratch.keep(stage(spark, docs, SMALL), f"s{i}")
        assert new.columns == docs.columns
        counts.append((docs.count(), new.count()))
        docs = new
    assert counts[0][1] < counts[0][0] and counts[3][1] == counts[3][0]
    pieces = p.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert p.run(spark, SMALL).count() == pieces.count()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered(name, spark, duck, compare):
    df = queries.queries()[name](spark, SMALL)
    if name in queries.oracle_sql():
        compare(df, duck.sql(queries.oracle_sql()[name]))
    else:
        assert df.count() > 0


def test_warc_files_by_bytes(spark, tmp_path, monkeypatch):
    """Long pages have a file each; rows without page_id have record ids of their own."""
    from locusflow.llm import common, warc

    monkeypatch.setattr(warc, "SHARED_BYTES", 100)
    rows = [(i, f"u{i}", f"<p>{i}</p>" * (1 if i % 3 else 40)) for i in range(12)] + [(None, None, "<p>x</p>"), (None, "u", "<p>y</p>"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"), common.Scratch(spark, "bytes"))
    back = warc.read_warc(spark, str(tmp_path / "w")).filter("gap is null").collect()
    assert len(back) == 15 and len({r.record_id for r in back}) == 15
    per_file = {}
    for r in back:
        per_file.setdefault(r.file, []).append(r.payload_bytes)
    assert sum(len(v) == 1 and v[0] > 100 for v in per_file.values()) == 4 and sum(max(v) <= 100 for v in per_file.values()) == 1
