"""Secondary structure: partners of dot-bracket strings, joined with a track."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "([{<", ")]}>"


#: Characters of structures that one numpy pass takes.
PASS = 1 << 20

_KINDS = np.full(128, -1, np.int8)
for _i, _pair in enumerate(zip(OPEN, CLOSE, strict=True)):
    _KINDS[[ord(c) for c in _pair]] = _i


def matched(code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of characters (code points) and the text that each is of: the index of every bracket in order of texts and places, its kind,
    and its partner's index (-1 if there is none)."""
    at = np.flatnonzero(code < len(_KINDS))
    at = at[_KINDS[code[at]] >= 0]
    kind, opens = _KINDS[code[at]], np.isin(code[at], [ord(c) for c in OPEN])
    group = text[at].astype(np.int64) * len(OPEN) + kind
    order = np.argsort(group, kind="stable")
    g, o = group[order], opens[order]
    run = np.cumsum(np.where(o, 1, -1))
    first = np.flatnonzero(np.diff(g, prepend=-1))
    base = np.append(0, run)[first]
    level = run - np.repeat(base, np.diff(np.append(first, len(g)))) + ~o
    low = int(level.min(initial=0))
    same = np.argsort(g * (int(level.max(initial=0)) - low + 1) + level - low, kind="stable")  # by group and level, in order of places
    here, after = same[:-1], same[1:]
    pair = (g[here] == g[after]) & (level[here] == level[after]) & o[here] & ~o[after]
    partner = np.full(len(at), -1, np.int64)
    i, j = order[here[pair]], order[after[pair]]
    partner[i], partner[j] = at[j], at[i]
    return at, kind, partner


def partners(structures: DataFrame) -> DataFrame:
    """id, place (from 0), kind (the opening bracket), partner (null if there is none) of every bracket. structures: id, structure.

    Brackets of one kind nest among themselves, so kinds may cross. The level of an opening bracket is the running sum
    after it, that of a closing one the sum before it; an opening bracket's partner is the next one on its level, which
    closes. This holds for strings that do not balance as well. Null structures give nothing. A structure is matched within its
    own row, so nothing is shuffled or sorted by Spark.
    """
    names = pa.array(list(OPEN))

    def run(batches):
        for b in batches:
            ids, texts = b.column("id"), [s or "" for s in b.column("structure").to_pylist()]
            lengths = np.array([len(s) for s in texts], np.int64)
            ends = np.cumsum(lengths)
            begin = 0
            while begin < len(lengths):  # rows of PASS characters, or one longer row
                stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] - lengths[begin] + PASS, "right")))
                size = lengths[begin:stop]
                code = np.frombuffer("".join(texts[begin:stop]).encode("utf-32-le", "surrogatepass"), np.uint32)
                text, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
                at, kind, partner = matched(code, text)
                own = starts[text[at]]
                columns = [ids.take(pa.array(text[at] + begin)), pa.array((at - own).astype(np.int32)), names.take(pa.array(kind)), pa.array((partner - own).astype(np.int32), mask=partner < 0)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "place", "kind", "partner"])
                begin = stop

    of = structures.schema["id"].dataType.simpleString()
    return structures.select("id", "structure").mapInArrow(run, f"id {of}, place int, kind string, partner int")


def annotated(structures: DataFrame, track: DataFrame) -> DataFrame:
    """id, place, base, symbol, partner, value: every place of a structure with its base, partner and track value (null where
    there is none). structures: id, seq, structure; track: id, rp, value."""
    places = structures.select("id", "seq", F.posexplode(F.split("structure", "")).alias("place", "symbol")).filter("symbol <> ''")
    places = places.select("id", "place", F.when(F.col("place") < F.length("seq"), F.substring(F.col("seq"), F.col("place") + 1, F.lit(1))).alias("base"), "symbol")
    out = places.join(partners(structures).select("id", "place", "partner"), ["id", "place"], "left")
    return out.join(track.select("id", F.col("rp").cast("int").alias("place"), "value"), ["id", "place"], "left")
