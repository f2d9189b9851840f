"""SentencePiece encoding and decoding through tables of distinct chunks.

A chunk is a run of white-space markers with what follows it up to the next one. Where no piece of the vocabulary has a
marker behind another sign, no merge can cross a chunk's start, so the ids of a text are those of its chunks in order.
Per step of about STEP bytes a task marks and cuts all its texts at once, takes the table of distinct chunks
(dictionary encoding), has the library segment each of them once, and joins the ids back by position (one take). Chunks
of up to KNOWN bytes stay in a memory of the task, whose size is bounded. The table is one for each task, not one for the
corpus: a join of a corpus-wide table would send every word of every text through a shuffle.

A vocabulary in which pieces can cross (or whose normaliser changes texts) is used text by text.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import chunks, tidy

MARK = "▁"
STEP, KNOWN, MEMORY = 1 << 20, 48, 400_000


class Pieces:
    """A SentencePiece model with its table of chunks; `path` names the model's file."""

    def __init__(self, path: str, memory: int = MEMORY):
        from sentencepiece import SentencePieceProcessor

        self.sp, self.memory = SentencePieceProcessor(model_file=path), memory
        self.ends = [self.sp.eos_id()] if self.sp.eos_id() >= 0 else []
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        odd = np.array([self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i) for i in range(len(names))])
        self.chunked = self._plain() and not any(MARK in x.lstrip(MARK) for x, o in zip(names, odd, strict=True) if not o)
        # Bytes of each id, as they stand in a text; byte pieces are bytes, control ids nothing.
        raw = [b"" if self.sp.is_control(i) else bytes([int(names[i][3:5], 16)]) if self.sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(len(names))]
        self.raw = pa.array(raw, pa.binary())
        self.marked = np.array([x.startswith(MARK) and not o for x, o in zip(names, odd, strict=True)])
        self.unknown = np.array([self.sp.is_unknown(i) or self.sp.is_unused(i) for i in range(len(names))])
        self.known: dict[bytes, bytes] = {}

    def _plain(self) -> bool:
        """Whether the normaliser takes texts as they are, but for blanks as markers and one marker before each."""
        probes = ["ﬁ é  A b\u3000c\t\nd ", " a", f"a{MARK}b", "  x\u0301\u200b "]
        return all(self.sp.normalize(t) == (MARK + t).replace(" ", MARK) for t in probes)

    def chunk_ids(self, found: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of chunks: n blanks and what follows, where the library puts the first blank itself."""
        new = [c for c in found if c not in self.known]
        if len(self.known) + len(new) > self.memory:
            self.known.clear()
            new = found
        got = {}
        for c, ids in zip(new, self.sp.encode([c[1:].decode("utf-8", "replace") for c in new], num_threads=1), strict=True):
            got[c] = np.array(ids if len(c) > 1 else [self.sp.piece_to_id(MARK)], np.int32).tobytes()
        out = [got[c] if c in got else self.known[c] for c in found]
        self.known.update((c, i) for c, i in got.items() if len(c) <= KNOWN)
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of texts, an end id after each."""
        if not self.chunked:
            each = [[*x, *self.ends] for x in self.sp.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)]
            return np.cumsum([0, *map(len, each)]), np.array([i for x in each for i in x], np.int32)
        blank, mark = b" ", MARK.encode()
        marked = [blank + (t.replace(mark, blank) if mark in t else t) if t else b"" for t in texts]
        data = np.frombuffer(b"".join(marked), np.uint8)
        first = np.cumsum([0, *map(len, marked)])
        is_blank = data == 32
        cut = is_blank.copy()
        cut[1:] &= ~is_blank[:-1]
        cut[first[:-1][first[:-1] < first[1:]]] = True  # a text's start, whatever ends the one before
        starts = np.flatnonzero(cut)
        per_text = np.searchsorted(starts, first)
        offsets = np.append(starts, len(data)).astype(np.int32)
        cells = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        table = cells.dictionary_encode()
        ids = self.chunk_ids(table.dictionary.to_pylist())
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        flat = lists.take(table.indices).flatten().to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int32)
        before = np.append(0, np.cumsum(sizes[table.indices.to_numpy(zero_copy_only=False)]))[per_text]  # ids before each text
        if self.ends:
            flat = np.insert(flat, before[1:], self.ends[0]).astype(np.int32)
        return before + len(self.ends) * np.arange(len(before)), flat

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of id lists, as the library's decode() has them.

        Bytes of pieces are joined by one take. The library is asked for lists whose first piece has no marker to drop,
        that hold unknown ids, or whose bytes are no UTF-8.
        """
        lengths = np.append(0, np.cumsum(pc.binary_length(self.raw).to_numpy()[ids], dtype=np.int64)) if len(ids) else np.zeros(1, np.int64)
        joined = self.raw.take(pa.array(ids)).buffers()[2].to_pybytes() if len(ids) else b""
        strange = np.append(0, np.cumsum(self.unknown[ids])) if len(ids) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            part = ids[a:b]
            real = part[:-1] if len(part) and self.ends and part[-1] == self.ends[0] else part
            if not len(real):
                out.append("")
                continue
            if self.chunked and self.marked[real[0]] and strange[a] == strange[b]:
                try:
                    out.append(joined[lengths[a] + 1 : lengths[b]].decode("utf-8"))
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(self.sp.decode(part.tolist()))
        return out


_models: dict[tuple[str, int], Pieces] = {}


def model(path: str) -> Pieces:
    """The model of a path, once for each worker process."""
    key = (path, os.getpid())
    if key not in _models:
        _models.clear()
        _models[key] = Pieces(path)
    return _models[key]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int, the end id last) of every text.

    A null text counts as empty and has the end id only. Repeated rows are encoded each; null ids pass through; an empty
    table gives no rows; other columns are not read. A long text is one step of its own; a word of any length is one
    chunk, segmented as a whole and not remembered. Bytes that are no UTF-8 become U+FFFD.
    """

    def run(batches):
        pieces = model(path)
        for (ids,), texts in chunks(batches, "text", ["doc_id"], STEP):
            offsets, flat = pieces.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """All columns of rows, and `decoded`: the text of the ids. Null ids give an empty text, as an empty list does."""
    if "decoded" in rows.columns:
        raise ValueError("decoded is the name of the result's column")

    def run(batches):
        pieces = model(path)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + STEP, side="right")))
                part = batch.slice(at, stop - at)
                flat = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                texts = pieces.decode(np.append(0, ends[at:stop] - done), flat)
                at = stop
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string"
    return rows.mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the text decoded from them."""
    done = decode(encode(docs, path), path)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
