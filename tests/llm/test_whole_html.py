"""Pages without </head>."""

import pytest

from locusflow.llm import html_extract

BODY = "<article><h1>Line</h1><p>First text of the page.</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><body>{BODY}", f"<head><meta charset=utf-8><title>x</title><link rel=a href=b><style>p{{}}</style>{BODY}",
        f"<!doctype html><html><head><title>x</title><script>var a='<p>no</p>'</script><!-- c -->\n<BODY class=a>{BODY}</body></html>",
        f"<head><noscript><img src=a></noscript><template><p>no</p></template><body>{BODY}", f"<head><title>x</title><noscript><p>no</p><body>{BODY}",
        f"<html><head><title>x</title></head><body>{BODY}</body></html>",
    ],
)
def test_head_left_open(page):
    assert html_extract.main_text(page, html_extract.train()) == "Line\nFirst text of the page."


def test_text_ends_a_head():
    words = "many plain words of a page that has no tags at all after its title " * 4
    assert html_extract.main_text(f"<head><title>x</title>\n{words}", html_extract.train()) == words.strip()
    assert html_extract.main_text(f"<head><title>x</title>{words}<p>{words}", html_extract.train()) == f"{words.strip()}\n{words.strip()}"


def test_head_stays_out():
    assert html_extract.blocks("<head><title>x</title><noscript><p>no</p></noscript> <template><div>no</div></template></head>") == []


PARTS = ["The first paragraph has a fair number of plain words in it.", "So has the second one, which goes on for a while longer.", "And the third ends it all, with yet more words than before."]
TEXT = "".join(f"<p>{p}</p>" for p in PARTS)
NAV = "<nav><a href=/>Home</a> <a href=/b>Blog</a></nav>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><form id=aspnetForm>{NAV}<article><h1>T</h1>{TEXT}</article></form></body>", ["T", *PARTS]),
        (f"<body><div class='no-sidebar'>{NAV}<article><h1>T</h1>{TEXT}</article></div></body>", ["T", *PARTS]),
        (f"<body>{NAV}<article><h1>T</h1><div class='social-history'>{TEXT}</div></article></body>", ["T", *PARTS]),
        (f"<body>{NAV}<main><h1>T</h1>{TEXT}<section id='related-work'><h2>Related</h2>{TEXT}</section></main></body>", ["T", *PARTS, "Related", *PARTS]),
        (f"<body>{NAV}<article><h1>T</h1><fieldset>{TEXT}</fieldset></article></body>", ["T", *PARTS]),
        (f"<body>{NAV}<article><header><h1>Title here</h1><p>Press office</p></header>{TEXT}</article></body>", ["Title here", *PARTS]),
        # Comments stay out, however many words they have, and so do boxes within the article.
        (f"<body>{NAV}<article><h1>T</h1>{TEXT}</article><div id='comments'>{TEXT * 9}</div></body>", ["T", *PARTS]),
        (f"<body>{NAV}<article><h1>T</h1>{TEXT}</article><div id='comments'><article class='comment'>{TEXT * 4}</article></div></body>", ["T", *PARTS]),
        (f"<body><article><h1>T</h1>{TEXT}<div class='related-posts'><p>Other things to read here</p></div></article></body>", ["T", *PARTS]),
    ],
)
def test_marks_are_no_veto(page, want):
    assert html_extract.main_text(page, html_extract.train()) == "\n".join(want)
