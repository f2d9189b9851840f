"""Benchmark decontamination by templates.

Words become template tokens: numbers, units after a number and names (a run of them is one) turn into typed
placeholders. Windows of WINDOW tokens of the benchmark items are looked up for every window of every document. Matches on
one diagonal (document position minus item position), or on diagonals within SHIFT of each other where words were put in or
left out, that cover COVERAGE of the item's windows, or RUN of its words, mark the pair: at once if RUN words in a row, or
COVERAGE of the windows, are literally alike, slots included; else if the slots are consistent: one value in the item
always stands for one value in the document. So an item counts as found when its text was copied, in full or nearly, and
also when only its numbers and names were changed.

The benchmark is taken in blocks of at most BLOCK_BYTES of text, each sent to the tasks and held against all documents in
a scan of its own; documents are never shuffled.
"""

from __future__ import annotations

import gc
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import Numbers, Scratch, WordHashes, chunks, mix, tidy, without_rows

WINDOW, COVERAGE, RUN, SHIFT = 8, 0.5, 13, 3
#: Words, and a quarter of the match, that must be literally alike where slots differ.
LITERAL = 4
#: Items of fewer words are no evidence.
SHORTEST = 3
BLOCK_BYTES = 8 << 20
UNITS = frozenset(
    b"mm cm m km in ft mi inch inches foot feet mile miles metre metres meter meters mg g kg lb lbs oz ton tons gram grams"
    b" kilogram kilograms ml l litre litres liter liters s sec min h hr second seconds minute minutes hour hours day days"
    b" week weeks month months year years dollar dollars euro euros cent cents pound pounds usd eur percent degree degrees"
    b" mph kmh kph watt watts volt volts".split()
)
#: Words that begin sentences and are no names for their capital.
OPENERS = frozenset(
    b"a an the this that these those there it its he she they we you i his her their our your my one two three all both each every"
    b" some any no many most few if when while where what which who whose whom why how as after before because since until although"
    b" though and but or so then yet for of in on at by to from with without into over under between during is are was were do does"
    b" did has have had can could will would shall should may might must let find given suppose calculate compute determine consider"
    b" write explain describe name choose select assume now also not only here le la les un une des ce cette ces il elle ils elles nous"
    b" vous je on et mais ou si quand comme dans pour par sur avec sans que qui der die das den dem ein eine einen es er sie wir ihr"
    b" ich und aber oder wenn als wie auf mit von zu bei nach el los las una esto esta este ella ellos nosotros yo y pero o cuando"
    b" como en con sin por para que".split()
)
NUMBER, UNIT, NAME, WORD = 1, 2, 3, 0
DIGIT = re.compile(rb"[0-9]")
MARKS = tuple(bytes([c]) for c in b".,;:!?")
STRIP = b".,;:!?\"'()[]{}$%#*&|<>"
SCHEMA = "doc_id long, item_id long, n_windows long, n_item_windows long, doc_word long, n_slots long, n_changed_slots long, kind string"


class Templates:
    """Template codes of words: number, unit and name placeholders or the word's own hash."""

    def __init__(self, bound: int = 150_000):
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.at = Numbers()
        # hash of the lower-cased core, hash of the core as written, kind, whether a mark ends a run of names after the word
        self.known = [np.zeros(0, np.int64) for _ in range(4)]

    def learn(self, words: list[bytes]) -> None:
        h = WordHashes(7, len(words))
        rows = np.zeros((len(words), 4), np.int64)
        for i, raw in enumerate(words):
            core = raw.strip(STRIP) or raw
            if core.isalpha():
                low = core.lower()
                named = core != low and core[1:] == low[1:]
                kind = UNIT if low in UNITS else NAME if named and low not in OPENERS else WORD
            else:
                s = core.decode("utf-8", "replace")
                small = s.lower()
                low = small.encode()
                named = s[:1] != small[:1] and s[1:] == small[1:]
                kind = NUMBER if DIGIT.search(core) else UNIT if low in UNITS else NAME if named and low not in OPENERS else WORD
            rows[i] = h[low], h[core], kind, raw[-1:] in MARKS
        self.known = [np.concatenate([k, rows[:, c]]) for c, k in enumerate(self.known)]

    def of(self, words: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(template code, kind, value, first word) of each token and (hash) of each word; starts: where texts begin.

        A unit only follows a number. Names that follow each other in one text, no mark between, are one token.
        """
        if len(self.at) > self.bound:
            self.clear()
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        if self.at.new:
            self.learn(self.at.new)
            self.at.new = []
        low, value, kind, end = (k[at] for k in self.known)
        starts = starts[starts < len(at)]
        first, after = np.zeros(len(at), bool), np.zeros(len(at), bool)
        after[1:] = kind[:-1] == NUMBER
        first[starts], after[starts] = True, False
        kind = np.where((kind == UNIT) & ~after, WORD, kind)
        if not len(at):
            return low.view(np.uint64), kind, value, at, low
        more = np.zeros(len(at), bool)
        more[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (end[:-1] == 0)
        token = np.flatnonzero(~(more & ~first))
        step = np.arange(len(at)) - np.repeat(token, np.diff(np.append(token, len(at))))
        value = np.add.reduceat(mix(value.view(np.uint64) + step.astype(np.uint64)), token).view(np.int64)
        kind = kind[token]
        return np.where(kind == WORD, low[token], kind).view(np.uint64), kind, value, token, low


def windows(code: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(code) - k + 1), np.uint64)
    for j in range(k if len(out) else 0):
        out = mix(out + code[j : j + len(out)] + np.uint64(j + 1))
    return out


def filled(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The values of placeholders, 0 for plain words."""
    return np.where(kind == WORD, 0, value).view(np.uint64)


def consistent(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether each value in the item stands for one value in the document; two may stand for the same."""
    return len(set(zip(item.tolist(), doc.tolist(), strict=True))) == len(set(item.tolist()))


def copied(alike: np.ndarray, width: int, total: int) -> bool:
    """Whether RUN of the words in a row, or the windows that COVERAGE of total takes, are literally alike."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], alike, [0]]).astype(np.int8)))
    runs = edges[1::2] - edges[::2]
    return bool(len(runs)) and (int(runs.max()) >= RUN or int(np.maximum(runs - width + 1, 0).sum()) >= COVERAGE * total)


class Index:
    """Windows of one block of benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        t = Templates()
        self.ids, self.items, hashes, at, slots = [], [], [], [], []
        self.width = width
        for item_id, text in items:
            words = (text or "").encode().split()
            if not words:
                continue
            code, kind, value, first, low = t.of(words, np.zeros(1, np.int64))
            w = windows(code, min(width, len(code)))
            literal = windows(low.view(np.uint64), min(width, RUN, len(low)))
            self.items.append((code, kind, value, len(w), first, low, literal))
            self.ids.append(item_id)
            if len(code) >= width:
                hashes.append(w)
                slots.append(windows(filled(kind, value), width))
                at.append(np.stack([np.full(len(w), len(self.ids) - 1), np.arange(len(w))]))
            elif len(words) >= SHORTEST:  # an item shorter than a window is looked for as a whole, in windows of its own length
                self.short = getattr(self, "short", {})
                self.short.setdefault(len(code), []).append((w[0], len(self.ids) - 1, windows(filled(kind, value), len(code))[0]))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        p = np.concatenate(at, axis=1) if at else np.zeros((2, 0), np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.pos = h[order], p[0][order], p[1][order]
        self.slots = (np.concatenate(slots) if slots else h)[order]
        self.uniq, self.start, self.n = np.unique(self.hash, return_index=True, return_counts=True)
        self.short = getattr(self, "short", {})
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.uniq >> np.uint64(44)] = True

    def near(self, code: np.ndarray) -> np.ndarray:
        """Places of a run of words where a window may be one of the index."""
        out = [np.flatnonzero(self.marks[windows(code, self.width) >> np.uint64(44)])]
        out += [np.flatnonzero(np.isin(windows(code, size), np.array([h for h, *_ in entries]))) for size, entries in self.short.items()]
        return np.concatenate(out)

    def find(self, code: np.ndarray, kind: np.ndarray, value: np.ndarray, first: np.ndarray, low: np.ndarray):
        """Rows of (item, matched windows, item windows, first word, slots, changed slots, kind) of one document."""
        found: list[tuple[np.ndarray, ...]] = []  # item, place, place in the item, whether a placeholder's value differs
        w = windows(code, self.width)
        mine = filled(kind, value)
        if len(w) and len(self.uniq):
            k = np.searchsorted(self.uniq, w)
            k[k == len(self.uniq)] = 0
            hit = np.flatnonzero(self.uniq[k] == w)
            if len(hit):
                n = self.n[k[hit]]
                where = np.repeat(hit, n)
                ends = np.cumsum(n)
                j = np.repeat(self.start[k[hit]] - (ends - n), n) + np.arange(int(ends[-1]))
                found.append((self.item[j], where, self.pos[j], windows(mine, self.width)[where] != self.slots[j]))
        for size, entries in self.short.items():
            w, values = windows(code, size), windows(mine, size)
            for h, item, slots in entries:
                at = np.flatnonzero(w == h)
                if len(at):
                    found.append((np.full(len(at), item), at, np.zeros(len(at), np.int64), values[at] != slots))
        if not found:
            return
        item, where, pos, differs = (np.concatenate(x) for x in zip(*found, strict=True))
        diag = where - pos
        order = np.lexsort((where, diag, item))
        item, where, diag, differs = item[order], where[order], diag[order], differs[order]
        begin = np.concatenate([[0], np.flatnonzero((np.diff(item) != 0) | (np.diff(diag) != 0)) + 1])
        ends = np.append(begin[1:], len(item))
        may = self.may_count(item, diag, where, differs, begin, kind, first, low)
        line = lambda n: (int(item[begin[n]]), int(diag[begin[n]]), where[begin[n] : ends[n]])
        best: dict[int, tuple] = {}
        for n in np.flatnonzero(may).tolist():
            i, d, at = line(n)
            if row := self.judge(i, [(d, at)], code, kind, value, first, low):
                best[i] = max(best.get(i, row), row)
        # Items that no single diagonal shows: diagonals near each other, in one stretch of the document. They are SHIFT + 1
        # lines at most, one of which must be able to count.
        some = np.append(may, np.zeros(SHIFT, bool))
        for a in np.flatnonzero(np.any([some[k : k + len(may)] for k in range(SHIFT + 1)], axis=0)).tolist():
            i, d, at = line(a)
            if i in best:
                continue
            near = [(d, at)]
            for b in range(a + 1, len(begin)):
                j, e, other = line(b)
                if j != i or e > d + SHIFT:
                    break
                if abs(int(other[0]) - int(at[0])) <= len(self.items[i][0]) + SHIFT:
                    near.append((e, other))
            if len(near) > 1 and (row := self.judge(i, near, code, kind, value, first, low)):
                best[i] = max(best.get(i, row), row)
        for i, (got, changed, word, total, slots) in sorted(best.items()):
            yield self.ids[i], got, total, -word, slots, -changed, "changed" if changed else "copied"

    def may_count(self, item, diag, where, differs, begin, kind, first, low) -> np.ndarray:
        """Whether judge can take each line, alone or as one of several.

        It cannot where the windows cover their span without a plain word, some value differs, and no literal window of
        the item lies at the line's shift. Texts of numbers have such lines at every place.
        """
        plain = np.concatenate([[0], np.cumsum(kind == WORD)])
        width = np.minimum(self.width, np.array([len(x[0]) for x in self.items]))[item]
        gap = np.diff(where, prepend=where[:1]) > width
        gap[begin] = False
        words = (plain[where + width] > plain[where]) | gap
        # Names at an item's edge may differ and yet be its own.
        edge = np.array([[len(x[1]) and x[1][0] == NAME, len(x[1]) and x[1][-1] == NAME] for x in self.items], bool)
        last = np.array([x[3] - 1 for x in self.items])
        at_edge = (edge[item, 0] & (where == diag)) | (edge[item, 1] & (where - diag == last[item]))
        may = np.logical_or.reduceat(words | at_edge, begin) | ~np.logical_or.reduceat(differs, begin)
        rest = np.flatnonzero(~may)
        owner, at, d = item[begin[rest]], where[begin[rest]], diag[begin[rest]]
        grams: dict[int, np.ndarray] = {}
        for i in np.unique(owner).tolist():
            mine, literal = self.items[i][4], self.items[i][6]
            k = min(self.width, RUN, len(self.items[i][5]))
            if k not in grams:
                grams[k] = windows(low.view(np.uint64), k)
            places = np.flatnonzero(np.isin(grams[k], literal))
            shifts = [places[grams[k][places] == h] - p for p, h in enumerate(literal)]
            of = np.flatnonzero(owner == i)
            may[rest[of]] = np.isin(first[at[of]] - mine[at[of] - d[of]], np.concatenate(shifts))
        return may

    def at_edges(self, i: int, same: np.ndarray, d: int, ki, vi, value, first, ends, low) -> np.ndarray:
        """The document's values of slots. Where an item begins or ends with names, further names beside them in the document
        are no part of it: such a run counts as the item's if it ends or begins with it."""
        out, (c, _, _, _, mine, words, _) = value[same].copy(), self.items[i]
        for k in np.flatnonzero(((same - d == 0) | (same - d == len(c) - 1)) & (out != vi[same - d])).tolist():
            p, q = int(same[k]), int(same[k] - d)
            if ki[q] != NAME:
                continue
            own = words[mine[q] : mine[q + 1] if q + 1 < len(mine) else len(words)]
            a, b = int(first[p]), int(ends[p + 1])
            front = q == len(c) - 1 and np.array_equal(low[a : a + len(own)], own)
            back = q == 0 and b - a >= len(own) and np.array_equal(low[b - len(own) : b], own)
            if front and b - a >= len(own) or back:
                out[k] = vi[q]
        return out

    def judge(self, i: int, lines: list[tuple[int, np.ndarray]], code, kind, value, first, low) -> tuple | None:
        """(matched windows, -changed slots, -first word, item windows, slots) where the windows on these diagonals mark item i."""
        c, ki, vi, total, mine, words, _ = self.items[i]
        width = min(self.width, len(c))
        got = len(np.unique(np.concatenate([at - d for d, at in lines])))
        spans = [(int(at[0]), int(at[-1]) + width, d) for d, at in lines]
        begin, stop = min(a for a, *_ in spans), max(b for _, b, _ in spans)
        ends = np.append(first, len(low))
        if got < COVERAGE * total and int(ends[stop] - ends[begin]) < RUN:
            return None
        slots, there, literal, whole = [], [], 0, False
        for a, b, d in spans:
            fits, word = code[a:b] == c[a - d : b - d], kind[a:b] == WORD
            same = np.flatnonzero(fits & ~word) + a
            slots.append(vi[same - d])
            there.append(self.at_edges(i, same, d, ki, vi, value, first, ends, low))
            literal += int((fits & word).sum())
            if not whole:  # word by word, from the matches' first plain word on
                anchor = np.flatnonzero(fits & word)
                shift = int(first[a + anchor[0]] - mine[a - d + anchor[0]]) if len(anchor) else int(first[a] - mine[a - d])
                x, y = max(0, -shift), min(len(words), len(low) - shift)
                whole = y > x and copied(low[x + shift : y + shift] == words[x:y], min(self.width, len(words)), total)
        slots, there = np.concatenate(slots), np.concatenate(there)
        changed = int((slots != there).sum())
        if changed and not whole:
            if not consistent(slots, there) or literal < max(LITERAL, (stop - begin) // 4):
                return None  # placeholders alone fit anything
        return got, -changed, -int(first[begin]), total, len(slots)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row for each document and benchmark item found in it, with its best diagonal (SCHEMA).

    Null or empty texts match nothing, in either table; equal items are all reported; documents of equal id are reported
    each on its own, and those without id too, with a null id; items under WINDOW tokens must match as a whole, and items of
    fewer than SHORTEST words are not looked for: a word or a number says nothing about where it comes from. A long text is
    one step, whose memory grows with the product of equal windows in it and in an item. Other columns are not read.
    """
    return _keyed(docs, benchmark, width).drop("text_key")


def _keyed(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """contamination with common.text_key of each document found."""
    spark = docs.sparkSession
    total = benchmark.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        part = benchmark if blocks == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()]  # about BLOCK_BYTES of text
        found = _against(docs, items, width)
        out = found if out is None else out.unionByName(found)
    return out


def _against(docs: DataFrame, items: list[tuple[int, str]], width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))

    def run(batches):
        gc.disable()  # the memory of words has no cycles, only many objects to go over
        try:
            yield from held(batches)
        finally:
            gc.enable()

    def held(batches):
        index, templates = Index(shared.value, width), Templates()
        for (ids,), texts in chunks(batches, "text", ["doc_id"]):
            split = [t.split() for t in texts]
            ends = np.cumsum([0, *map(len, split)])
            code, kind, value, first, low = templates.of(list(chain.from_iterable(split)), ends[:-1])
            cut = np.searchsorted(first, ends)
            docs = np.unique(np.searchsorted(cut, index.near(code), side="right") - 1)
            rows = []
            for i in docs.tolist():
                a, b, x, y = cut[i], cut[i + 1], ends[i], ends[i + 1]
                key = hashlib.sha256(texts[i]).digest()
                rows += [(ids[i], *r, key) for r in index.find(code[a:b], kind[a:b], value[a:b], first[a:b] - x, low[x:y])]
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, {7: pa.string(), 8: pa.binary()}.get(k, pa.int64())) for k, c in enumerate(cols)],
                names=[*(x.split()[0] for x in SCHEMA.split(", ")), "text_key"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA + ", text_key binary")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs without the rows in which an item was found; rows of one doc_id, or without one, go each by its own text."""
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    return without_rows(docs, _keyed(docs, benchmark), scratch, "found")
