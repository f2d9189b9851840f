"""Quality rules under weak supervision.

Each rule votes 1 (good), -1 (bad) or 0 (abstains) on a document. Vote patterns are counted over all documents (at most
3^rules patterns reach the driver), expectation-maximisation estimates the prior and how far each vote of a rule
can be trusted, and a document is kept when its posterior probability of being good reaches a half.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import Scratch, chunks, tidy, without_rows

#: Frequent function words of the four languages in the corpus.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for was on are as with be by at this from"
    b" de la le et les des en un une du que qui dans pour est au sur par pas avec"
    b" der die und den das von zu mit sich des auf ist im dem nicht ein eine als auch es"
    b" el los las una por con del su al lo como no se esta".split()
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shouts", "n_function")
SYMBOLS = b"#*$%&|<>"


def _byte_class() -> np.ndarray:
    """For each byte: columns of 0/1 for word_chars, symbols, letters, upper case, exclamation and question marks."""
    b = np.arange(256)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    head = (b < 0x80) | (b >= 0xC0)
    upper = (b >= 65) & (b <= 90)
    letter = upper | ((b >= 97) & (b <= 122)) | (b >= 0xC0)
    return np.stack([head & ~white, np.isin(b, list(SYMBOLS)), letter, upper, np.isin(b, list(b"!?"))]).astype(np.int64)


BYTE_CLASS = _byte_class()


def repeat_words(ids: np.ndarray, vocabulary: int) -> int:
    """Positions inside three-word windows that occur twice or more; ids are below vocabulary."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * vocabulary + ids[1:-1]
    if vocabulary >= 1 << 21:  # three ids don't fit into 63 bits
        pair, vocabulary = np.unique(pair, return_inverse=True)[1], max(vocabulary, len(ids))
    code = pair * vocabulary + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for j in range(3):
        covered[j : j + len(code)] |= twice
    return int(covered.sum())


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def text_features(docs: DataFrame, id_col: str = "doc_id", keyed: bool = False) -> DataFrame:
    """id and FEATURES (long) of every whole text; null and empty texts have zeros. keyed: with common.text_key as well."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for (ids,), texts in chunks(batches, "text", [id_col]):
            split = [t.split() for t in texts]
            at: dict[bytes, int] = {}
            coded = [np.fromiter((at.setdefault(w, len(at)) for w in ws), np.int64, len(ws)) for ws in split]
            base = len(at)
            known = np.fromiter((w.lower().strip(b".,;:!?") in FUNCTION_WORDS for w in at), bool, len(at))
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([0, *map(len, texts)])
            word_chars, symbols, letters, upper, shouts = (
                np.diff(np.concatenate([[0], np.cumsum(c[data])])[ends]) for c in BYTE_CLASS
            )
            lines, dups = zip(*map(dup_lines, texts), strict=True)
            repeats = [repeat_words(c, base) for c in coded]
            function = [
                int(known[np.fromiter((at[w] for w in ws), np.int64, len(ws))].sum()) if ws else 0 for ws in split
            ]
            cols = [list(map(len, split)), word_chars, symbols, dups, repeats, lines, letters, upper, shouts, function]
            key = [pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())] if keyed else []
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, pa.int64()) for c in cols), *key], names=[id_col, *FEATURES, *["text_key"][: len(key)]])

    return docs.select(id_col, "text").mapInArrow(tidy(run), f"{id_col} {kind}, " + ", ".join(f"{f} long" for f in FEATURES) + (", text_key binary" if keyed else ""))


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, Column]:
    """Votes; a rule abstains where it has nothing to go by."""
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    never = F.lit(False)
    return {
        "symbols": vote(ratio("n_symbols", "n_words") > 0.1, never),
        "repeats": vote(ratio("n_repeat_words", "n_words") > 0.3, ratio("n_repeat_words", "n_words") < 0.02),
        "dup_lines": vote(ratio("n_dup_lines", "n_lines") > 0.3, never),
        "upper": vote(ratio("n_upper", "n_letters") > 0.4, ratio("n_upper", "n_letters") < 0.1),
        "shouts": vote(ratio("n_shouts", "n_words") > 0.3, never),
        "function": vote(ratio("n_function", "n_words") < 0.04, ratio("n_function", "n_words") > 0.1),
        "word_length": vote(~ratio("word_chars", "n_words").between(2.8, 7.5), ratio("word_chars", "n_words").between(3.8, 6.5)),
        "letters": vote(ratio("n_letters", "word_chars") < 0.75, ratio("n_letters", "word_chars") > 0.9),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], steps: int = 100) -> tuple[float, list[dict[int, float]]]:
    """Prior log odds of good, and for each rule the log odds that a vote of -1 or 1 adds, by expectation-maximisation.

    Each rule has its own rates of votes in either class, so a rule may be trusted when it objects and not when it
    approves. It starts from one objection making a document bad at nine to one; rates are smoothed by one vote; an
    objection never speaks for a document nor an approval against it, and the prior stays within 0.05 and 0.95, which
    keeps the classes' meaning.
    """
    if not patterns:
        return 0.0, []
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    good = np.where((votes < 0).any(1), 0.1, 0.9)
    for _ in range(steps):
        prior = float(np.clip((good * n).sum() / n.sum(), 0.05, 0.95))
        logit = np.full(len(n), math.log(prior / (1 - prior)))
        adds = []
        for j in range(votes.shape[1]):
            odds = {}
            for v in (-1, 1):
                has = votes[:, j] == v
                rates = [((p * n)[has].sum() + 1) / ((p * n).sum() + 3) for p in (good, 1 - good)]
                odds[v] = v * max(0.0, v * math.log(rates[0] / rates[1]))
                logit[has] += odds[v]
            adds.append(odds)
        good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
    return math.log(prior / (1 - prior)), adds


def judged(features: DataFrame) -> tuple[DataFrame, dict]:
    """features with base_failed, one `vote_<rule>` each, p_good and kept; and the fitted model.

    The model is fitted on documents that the base rule leaves; features should be a stored table, since it is read twice.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    votes = rules()
    voted = features.withColumns({"base_failed": base} | {f"vote_{k}": v for k, v in votes.items()})
    names = [f"vote_{k}" for k in votes]
    counted = voted.filter(~F.col("base_failed")).groupBy(*names).count().collect()  # 3^rules rows at most
    prior, adds = fit(sorted((tuple(r[k] for k in names), r["count"]) for r in counted))
    logit = F.lit(prior)
    for k, odds in zip(names, adds, strict=False):
        logit = logit + F.when(F.col(k) == -1, odds[-1]).when(F.col(k) == 1, odds[1]).otherwise(0.0)
    out = voted.withColumn("p_good", 1 / (1 + F.exp(-logit)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)), {"prior": prior, "odds": dict(zip(votes, adds, strict=False))}


def score_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Features, votes, p_good, base_failed and kept of every row.

    Null or empty texts have no words and fail the base rule. Repeated rows and ids are judged each on its own; an empty
    table gives no rows; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    return judged(scratch.keep(text_features(docs), "features"))[0]


def keep_good(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs without the rejected rows; rows of one doc_id, or without one, stand or fall each by its own text."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    scored = judged(scratch.keep(text_features(docs, keyed=True), "features"))[0]
    return without_rows(docs, scored.filter(~F.col("kept")), scratch, "rejected")
