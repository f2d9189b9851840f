"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read as one run of tags and text. Block-level tags end a block; each block has its words, its link density,
those of the blocks before and after it, and what surrounds it (article, menu, form, comments, ...). A CART tree, trained
on the blocks of the labelled pages of html_labelled, tells main text from the rest. A page on which it finds none gives the
blocks that no menu, form, advert or the like surrounds and that are not links, so a short page is not empty.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from locusflow.llm.common import chunks, tidy
from locusflow.llm.html_labelled import MARK, PAGES

#: A quote opens a value only after an equals sign, so one that stands elsewhere swallows nothing.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select option datalist head title".split())
RAW_TEXT = frozenset("script style textarea title iframe".split())  # whose content has no tags
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
BOILER = frozenset("nav header footer aside form menu dialog button".split())
MAIN = frozenset("article main".split())
#: Words in class or id that name something beside the article.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumb\w*|sidebar\w*|aside|widget\w*|footer|header|masthead|topbar|toolbar|"
    r"comment\w*|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|search|"
    r"pagination|pager|copyright)(?:$|[\s_-])", re.I
)
#: Words that may stand beside those of BESIDE in a name within the article; with others, as in social-history or
#: related-work, the name tells what the text is about.
USUAL = frozenset(
    "post posts article articles story stories link links button buttons list box bar form icon icons media content section block wrapper wrap"
    " container area item items news letter us this title count inner group row col item more top bottom left right main side text body panel"
    " unit slot ad ads google tags tag bookmarks tools toolbox feed stream thread".split()
)
#: Words in class or id of an element that holds the article where a page has neither article nor main.
CONTENT = re.compile(r"(?:^|\s)(?:content|main|main-content|page-content|(?:post|entry|article|story)(?:-?(?:content|body|text))?|articlebody)(?:$|\s)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
#: Elements that an opening block tag closes when they are still open (HTML's implied end tags).
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
#: What can stand in a head; text or any other tag ends one that is open (HTML lets </head> be left out).
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
SPACE = re.compile(r"\s+")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "boiler", "beside", "title")


def _beside(value: str, inside: bool) -> bool:
    """Whether a class or id names something beside the article; inside of it all words of the name must be usual ones."""
    if not inside:
        return BESIDE.search(value) is not None
    return any(
        BESIDE.search(name) and all(w in USUAL or w.isdigit() or BESIDE.search(w) for w in re.split(r"[_-]+", name.lower()) if w) for name in value.split()
    )


def _kind(tag: str, attrs: str, inside: bool = False) -> int:
    """What an element makes of its content: bits 1 raw or hidden, 2 main, 4 boilerplate element, 8 named as beside, 16 named as
    content; inside tells that it stands within the article."""
    k = (tag in RAW) | (tag in MAIN) << 1 | (tag in BOILER) << 2
    if not attrs:
        return k
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and HIDING.search(value)):
            k |= 1
        elif name == "role":
            roles = value.lower().split()
            k |= 2 * ("main" in roles) | 4 * (not ROLES.isdisjoint(roles))
        elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            k |= 8 * _beside(value, inside) | 16 * (CONTENT.search(value) is not None)
    return k


class Open:
    """The open elements: tag and bits of the surroundings of each, and where each tag and the block elements stand."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.bits = self.links = 0
        #: (number, bits 4 and 8, tag) of the open elements that have any, in order, and how many there were
        self.marks: tuple[tuple[int, int, str], ...] = ()
        self.marked = 0

    def push(self, tag: str, own: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, self.bits, self.marks))
        self.bits |= own & ~12
        if own & 12:
            self.marked += 1
            self.marks = (*self.marks, (self.marked, own & 12, tag))
        elif tag in ("h1", "h2") and self.bits & 2 and self.marks and self.marks[-1][2] == "header":
            self.marks = self.marks[:-1]  # the article's own title
        self.links += tag == "a"

    def close(self, at: int) -> None:
        """Ends the element at this place and all in it."""
        while len(self.stack) > at:
            tag, self.bits, self.marks = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.links -= tag == "a"

    def last(self, tag: str) -> int:
        """The place of the innermost element of this tag, or -1."""
        return self.places[tag][-1] if self.places.get(tag) else -1

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def imply(self, ended: set[str]) -> None:
        """Ends block elements of these tags, as long as the innermost block is one, inline elements in them included."""
        while self.blocks and self.stack[self.blocks[-1]][0] in ended:
            self.close(self.blocks[-1])


def blocks(page: str) -> list[tuple[str, float, int]]:
    """(text, share of its characters in links, context bits) of each block that has text."""
    out: list[tuple[str, float, int, tuple]] = []
    now = Open()
    text: list[str] = []
    in_link, block_bits, block_marks = 0, 0, ()

    def add(piece: str) -> None:
        nonlocal in_link, block_bits, block_marks
        if piece and now.top() == "head" and not piece.isspace():
            now.close(now.last("head"))
        if not piece or now.bits & 1:
            return
        if not text:
            block_bits, block_marks = now.bits, now.marks
        text.append(piece)
        in_link += len(piece) * (now.links > 0)

    def end() -> None:
        nonlocal text, in_link
        if text:
            raw = "".join(text)
            whole = SPACE.sub(" ", html.unescape(raw)).strip()
            if whole:
                out.append((whole, in_link / max(len(raw), 1), block_bits, block_marks))
            text, in_link = [], 0

    pos, size, lower = 0, len(page), None
    while pos < size:
        m = TOKEN.search(page, pos)
        if m is None:
            break
        a, b = m.span()
        add(page[pos:a])
        pos = b
        tag = m.group(2)
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m.group(1), m.group(3)
        head = now.last("head")
        if head >= 0 and not closing and tag not in IN_HEAD and (now.top() == "head" or tag == "body"):
            now.close(head)
        if tag == "br":
            if text:
                text.append(" ")
            continue
        if tag not in INLINE:
            end()
        if closing:
            at = now.last(tag)
            # An inline end tag does not close blocks.
            if at >= 0 and not (tag in INLINE and now.blocks and now.blocks[-1] > at):
                now.close(at)
            continue
        if tag in VOID or (attrs and attrs.endswith("/") and tag not in INLINE and tag not in RAW and not tag.isalpha()):
            continue
        if tag in IMPLIED:
            now.imply(IMPLIED[tag])
        now.push(tag, _kind(tag, attrs, bool(now.bits & 2)) if attrs or tag in RAW or tag in MAIN or tag in BOILER else 0)
        if tag in RAW_TEXT:
            lower = page.lower() if lower is None else lower
            stop = lower.find(f"</{tag}", b)
            pos = size if stop < 0 else stop
    add(page[pos:])
    end()
    return settled(out)


def settled(found: list[tuple[str, float, int, tuple]]) -> list[tuple[str, float, int]]:
    """Blocks with bits 4 and 8 of the marked elements around them, but for wrappers of the page.

    A marked element that holds half of the page's words and all of its article (or, on a page without one, four fifths of
    the words) is no menu or sidebar, whatever its name says: a form around the whole page, a wrapper named no-sidebar.
    """
    own = 2 if any(b & 2 for _, _, b, _ in found) else 16
    words = [t.count(" ") + 1 for t, *_ in found]
    total, main = sum(words), sum(n for n, (_, _, b, _) in zip(words, found, strict=True) if b & own)
    held: dict[int, list[int]] = {}
    for n, (_, _, b, marks) in zip(words, found, strict=True):
        for k, *_ in marks:
            at = held.setdefault(k, [0, 0])
            at[0] += n
            at[1] += n if b & own else 0
    void = {k for k, (n, m) in held.items() if (m == main and 2 * n >= total if main else 5 * n >= 4 * total)}
    return [(t, d, b | 4 * any(x & 4 for k, x, _ in marks if k not in void) | 8 * any(x & 8 for k, x, _ in marks if k not in void)) for t, d, b, marks in found]


def features(found: list[tuple[str, float, int]]) -> np.ndarray:
    """FEATURES of each block."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    x[:, 0] = [t.count(" ") + 1 for t, _, _ in found]
    x[:, 1] = [d for _, d, _ in found]
    x[1:, 2:4] = x[:-1, :2]
    x[:-1, 4:6] = x[1:, :2]
    bits = np.array([b for _, _, b in found])
    main = bits >> 1 & 1 if (bits & 2).any() else bits >> 4 & 1
    x[:, 6], x[:, 7], x[:, 8] = main, bits >> 2 & 1, bits >> 3 & 1
    x[:, 9] = main.any()
    return x


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES of the blocks of a labelled page, and whether each is main text: its text starts with MARK."""
    found = blocks(page)
    return features([(t.removeprefix(MARK), d, b) for t, d, b in found]), np.array([t.startswith(MARK) for t, _, _ in found], float)


SURROUNDINGS, TEXT = (7, 8, 9, 6), (1, 0, 2, 3, 4, 5)


def grow(x: np.ndarray, y: np.ndarray, least: int = 2):
    """A CART tree by Gini impurity: a share, or (feature, threshold, below or equal, above).

    The surroundings are split on first, as long as that lowers the impurity by a twentieth; then the text.
    """
    p = y.mean()
    if p in (0.0, 1.0) or len(y) < 2 * least:
        return float(p)
    impurity = len(y) * p * (1 - p)
    for group in (SURROUNDINGS, TEXT):
        best = None
        for f in group:
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                if least <= low.sum() <= len(y) - least:
                    gini = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[low], y[~low]))
                    if best is None or gini < best[0] - 1e-12:
                        best = (gini, f, t)
        if best and best[0] < 0.95 * impurity:
            break
    if best is None:
        return float(p)
    _, f, t = best
    low = x[:, f] <= t
    return f, float(t), grow(x[low], y[low], least), grow(x[~low], y[~low], least)


def judge(tree, x: np.ndarray) -> np.ndarray:
    """The tree's share of main text for each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    out = np.zeros(len(x))
    below = x[:, f] <= t
    out[below], out[~below] = judge(low, x[below]), judge(high, x[~below])
    return out


def train(pages: tuple[str, ...] = PAGES):
    x, y = zip(*map(labelled, pages), strict=True)
    return grow(np.concatenate(x), np.concatenate(y))


def main_text(page: str, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    x = features(found)
    keep = judge(tree, x) >= 0.5
    if not keep.any():
        keep = (x[:, 7] == 0) & (x[:, 8] == 0) & (x[:, 1] < 0.5)
    return "\n".join(t for (t, _, _), k in zip(found, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every row.

    Null or empty html gives an empty text; a long page is one step of its own and is read in linear time; tags cut off at the end of a page are dropped; repeated rows give a row each;
    other columns are not read and an empty table gives no rows.
    """
    tree = train()

    def run(batches):
        for (ids, urls), texts in chunks(batches, "html", ["page_id", "url"]):
            out = [main_text(t.decode("utf-8", "replace"), tree) for t in texts]
            cols = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
