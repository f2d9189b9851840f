"""Fill-in-middle transformation: a text is cut at two units and its parts are given in another order, between sentinels.

A text is decoded to an array of UTF-32 code points. Neighbouring classes are compared; where they differ, a unit ends
(flatnonzero), so the units' bounds are one array and a rank of a unit is an index into it. The parts are slices of the
code points, encoded again. With unit `codepoint` each code point is a class of its own, so each is a unit; with
`class`, runs of white space, digits, letters and other signs are units.

Everything is decided by the id and the text of a row alone, so rows are independent, nothing is shuffled, and a lost
task is simply run again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import chunks, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def classes(codes: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; a unit is a run of one class."""
    if unit == "codepoint":
        return np.arange(len(codes))
    if unit != "class":
        raise ValueError(f"no such unit: {unit}")
    space = (codes == 0x20) | (codes >= 9) & (codes <= 13) | (codes == 0x85) | (codes == 0xA0) | (codes >= 0x2000) & (codes <= 0x200A) | (codes == 0x3000)
    digit = (codes >= 0x30) & (codes <= 0x39)
    sign = (codes > 0x20) & (codes < 0x7F) & ~digit & ~(((codes | 0x20) >= 0x61) & ((codes | 0x20) <= 0x7A))
    return np.select([space, digit, sign], [0, 1, 2], 3)


def bounds(codes: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin and end: n + 1 places for n units, 0 and the length among them; one place for no code points."""
    if not len(codes):
        return np.zeros(1, np.int64)
    kinds = classes(codes, unit)
    return np.concatenate(([0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(codes)]))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers named by the seed and the id; a null id counts as empty."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))


def transform(doc_id: int | None, text: str, seed: int, plain: int, spm: int, unit: str) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = bounds(codes, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= plain or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(x) for x in ends[sorted((h1 % (n + 1), h2 % (n + 1)))])
    prefix, middle, suffix = (codes[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(codes))))
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 90, spm: int = 20, unit: str = "codepoint") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    Of 100 values of the third draw those from `plain` on leave the text as it is; of 100 of the fourth those below
    `spm` put the suffix first. A null text counts as empty; empty texts, and texts that hold a sentinel, stay plain. A
    null id draws as an empty one; rows of equal id draw alike, each by its own text. Long texts are held whole, one at a
    time. An empty table gives no rows; other columns are not read. Bytes that are no UTF-8 become U+FFFD.
    """

    def run(batches):
        for (ids,), texts in chunks(batches, "text", ["doc_id"]):
            rows = [transform(d, t.decode("utf-8", "replace"), seed, plain, spm, unit) for d, t in zip(ids, texts, strict=True)]
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(tidy(run), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made of, from it and its form alone.

    No part holds a sentinel, and none can arise where a part meets one, since a sentinel's first sign occurs in it only
    there; so the first of each kind found is the one that was put in.
    """

    def parts(inner: str) -> tuple[Column, Column, Column]:
        a = F.call_function("locate", F.lit(inner), output, F.lit(4))
        b = F.call_function("locate", F.lit(MIDDLE), output, a + 3)
        return F.substring(output, F.lit(4), a - 4), F.substring(output, a + 3, b - a - 3), F.substring(output, b + 3, F.char_length(output))

    first, second, last = parts(SUFFIX)
    second_, first_, last_ = parts(PREFIX)
    return F.when(form == "psm", F.concat(first, last, second)).when(form == "spm", F.concat(first_, last_, second_)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The transformation of every document with digests of its output and of the text rebuilt from it."""
    done = fill_in_middle(docs)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
             sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS r1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS r2,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                  OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
             WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
v AS (SELECT doc_id, text, n, form, least(r1, r2) AS a, greatest(r1, r2) AS b FROM u),
w AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM w
"""
