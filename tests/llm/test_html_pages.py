"""Pages that the tree was not grown on, and markup that must not cost main text."""

import time

import pytest

from locusflow.llm import html_extract

MARK = html_extract.MARK
#: Held out: written apart from the training pages; blocks of main text start with MARK.
HELD_OUT = (
    """<html><body><header><h2><a href=/>City radio</a></h2></header><nav><a href=1>Programme</a><a href=2>Music</a></nav><article><h1>@@New transmitter on the hill</h1><p>@@From Monday on the station can be heard in the whole county.</p>
<p>@@The old one goes to a museum.</p><div class="promo">Win two tickets for the summer concert by calling us before noon</div><p>@@Listeners need do nothing, as the frequency stays the same for all.</p></article><div>Listen live at any time on all of your devices</div><footer><p>City radio, Upper Street 5</p></footer></body></html>""",
    """<body><div id="nav"><a href=/>Start</a><a href=/a>All posts</a></div><div class="entry-content"><h2>@@Mending a chair</h2><p>@@One leg was loose.</p><p>@@I took it out, cleaned the joint of the old glue and set it in again with new glue and a wedge.</p></div><div class="comments"><p>Nice work, mine has the same fault and I never dared to take it apart.</p></div></body>""",
    """<body><main role="main"><h1>@@Opening hours</h1><table><tr><td>@@Monday</td><td>@@closed</td></tr><tr><td>@@Tuesday</td><td>@@10 to 5</td></tr></table><p>@@On holidays we are open as on Sundays.</p></main><aside><p>Buy your ticket here and skip the line at the door</p></aside><div class="social-links"><a href=1>f</a></div></body>""",
    """<body><p><a href=1>Home</a></p><h1>@@On keeping bees in town</h1><p>@@Bees do well in towns, where something is in flower from March to October and nobody sprays.</p><p>@@A hive needs sun in the morning and a path of flight that leads over the heads of people.</p><p>@@Start with two.</p><p>@@With one hive you cannot tell whether what you see is usual, and you cannot help it out with brood from the other.</p><p><a href=2>Next: tools</a></p></body>""",
    """<body><div role="navigation"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><article><h1>@@Minutes</h1><ol><li>@@The minutes of May were read and agreed.</li><li>@@The roof will be mended in June.</li></ol><p>@@Next meeting: 3 July</p></article><form><p>Write to the board</p></form></body>""",
    """<body><div class="masthead"><a href=/>Harbour news</a></div><div id="main-content"><h1>@@Ferry back in service</h1><p>@@The ferry runs again since Sunday.</p><p>@@It had been in the yard for six weeks, where its engine was taken out and a new one put in.</p><ul><li>@@First trip at 6</li><li>@@Last trip at 22</li></ul></div><div class="newsletter-box"><p>Get the times of the ferry in your mail each week, free of charge</p></div><div id="footer"><a href=1>Contact</a></div></body>""",
)


def test_held_out_pages():
    tree = html_extract.train()
    right = total = 0
    for page in HELD_OUT:
        x, y = html_extract.labelled(page)
        right += int(((html_extract.judge(tree, x) >= 0.5) == (y > 0.5)).sum())
        total += len(y)
    assert total > 40 and right / total >= 0.95


@pytest.mark.parametrize("page,want", [
    ('<article><p class="text hidden md:block">A a</p><p data-id="comment">B b</p><div class="tags">C</div><div class="form">D</div></article>', "A a\nB b\nC\nD"),
    ("<article><p title=it's>E e</p><p>F</p></article>", "E e\nF"),
    ('<div id="content"><h1>Hi</h1><p>Short one.</p><p>Two.</p></div>', "Hi\nShort one.\nTwo."),
    ("<body><h1>Hi</h1><p>Short.</p></body>", "Hi\nShort."),
    ("<article><p>" + "<b>" * 12 + "x<p>y</article>", "x\ny"),
    ("<article><ul><li>" + "<i>" * 20 + "a<li>b<ul><li>c</ul><li>d</ul></article>", "a\nb\nc\nd"),
    ('<article><p hidden>no</p><p style="display: none">no</p><p aria-hidden="true">no</p><p>yes</p></article>', "yes"),
    ("<article><p>a &lt;b&gt; &amp;amp; c</article>", "a <b> &amp; c"),
    ("<article><article><p>in</p></article><p>out</p></article><nav><article><p>menu</p></article></nav>", "in\nout"),
])
def test_main_text(page, want):
    assert html_extract.main_text(page, html_extract.train()) == want


def test_repeated_rows_and_long_pages(spark):
    long = "<article>" + "<p>some words of a long page</p>" * 90_000 + "</article>"
    rows = [(1, "u", "<article><p>x</p></article>")] * 2 + [(None, None, "<article><p>x</p></article>"), (2, "v", long)]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in out if r.page_id != 2) == [(0, "x"), (1, "x"), (1, "x")]
    assert [r.n_chars for r in out if r.page_id == 2] == [90_000 * 26 - 1]


@pytest.mark.parametrize("make", [lambda n: "<b>" * n + "</i>" * n + "<p>x", lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: '<p a="' * n, lambda n: "<li><i>" * n])
def test_linear(make):
    """Four times the page takes far less than sixteen times as long."""
    tree, took = html_extract.train(), []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        html_extract.main_text(make(n), tree)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2
