"""Near-verbatim copies are found whatever one of their slots says."""

import random

import numpy as np

from locusflow.llm import decontam

ITEM = (
    "A farmer named Alice keeps 3 hens in the old barn behind the house and every morning she walks down the hill to gather"
    " the fresh eggs before the sun is up so how many eggs will Alice have when 3 of them are sold"
)
SHORT = "they say Bob has 3 apples while Bob gave 3 away"


def test_one_value_changed(spark):
    slots = "Alice met Bob and 3 men of 4 towns then Alice met Bob and 3 men of 4 towns"
    bench = spark.createDataFrame([(1, ITEM), (2, SHORT), (3, slots)], "item_id long, text string")
    rows = [
        (1, "Intro. " + ITEM.replace("3 of", "5 of") + " end"), (2, ITEM.replace("will Alice", "will Alica")), (3, "Well, " + SHORT.replace("gave 3", "gave 5")),
        (4, "so Carol met Dave and 5 men of 6 towns then Erin met Fay and 7 men of 8 towns"),
    ]
    got = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(1, 1, "changed"), (2, 1, "changed"), (3, 2, "changed")}
    assert [r.n_changed_slots for r in sorted(got)] == [1, 1, 1]


def test_what_counts_as_copied():
    import numpy as np

    alike = lambda s: np.array([c == "x" for c in s])
    assert decontam.copied(alike("x" * 13), 8, 90) and not decontam.copied(alike("x" * 12 + "-" + "x" * 12), 8, 90)
    assert decontam.copied(alike("x" * 12), 8, 10) and not decontam.copied(alike("x" * 11), 8, 10)
    assert not decontam.copied(alike("-"), 1, 1) and not decontam.copied(alike(""), 8, 1)


def test_lines_that_cannot_count(monkeypatch):
    """Leaving out diagonals that judge cannot take changes no result, in texts of few words, numbers and names."""
    rng = random.Random(9)
    pool = ["7", "8", "12", "Ann", "Bob", "Li", "km", "red", "of", "oak", "x."]
    text = lambda n: " ".join(rng.choices(pool, [6, 6, 6, 2, 2, 1, 1, 1, 1, 1, 1], k=n))
    every = lambda self, item, diag, where, differs, begin, *_: np.ones(len(begin), bool)
    some = 0
    for trial in range(150):
        items = [(i, text(rng.randrange(3, 40))) for i in range(4)]
        doc = text(rng.randrange(200))
        if trial % 2:
            part = items[trial % 4][1].split()
            doc += " " + " ".join(w if rng.random() < 0.9 else rng.choice(pool) for w in part) + " " + text(9)
        words = doc.encode().split()
        t, index = decontam.Templates(), decontam.Index(items, decontam.WINDOW)
        code, kind, value, first, low = t.of(words, np.zeros(1, np.int64))
        got = list(index.find(code, kind, value, first, low))
        with monkeypatch.context() as m:
            m.setattr(decontam.Index, "may_count", every)
            assert got == list(index.find(code, kind, value, first, low))
        some += len(got)
    assert some > 40  # items of under four words are not looked for


def test_short_items_and_names_at_edges(spark):
    """A word or number marks nothing; names beside those that an item begins or ends with change no slot."""
    items = [(1, "yes"), (2, "42"), (3, "Paris"), (4, "Anna Berg walked over the old bridge and met her friend Tom Hill"), (5, "they all went home to Rome")]
    docs = [
        (1, "She said yes in Paris at 42 Main Street"), (2, "yes"), (3, "then Maria Anna Berg walked over the old bridge and met her friend Tom Hill Junior again"),
        (4, "then Maria Keller walked over the old bridge and met her friend Tom Hill again"), (5, "so they all went home to Rome Again and slept"), (6, "so they all went home to Oslo and slept"),
    ]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.kind) for r in got.collect()} == {(3, 4, "copied"), (4, 4, "changed"), (5, 5, "copied"), (6, 5, "changed")}
