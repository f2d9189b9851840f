"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Each task packs its own stream of documents in groups of about GROUP_TOKENS tokens, so memory is bounded and nothing is
shuffled. Within a group, a piece of n tokens costs LINEAR * n + QUADRATIC * n^2 (attention). Pieces are taken in
descending order of cost and go to the sequence of lowest cost that has room; only where none has room, the piece is cut
at the capacity of the cheapest that is not full. A group's last tokens fill sequences whose lengths are powers of
two, which need no padding.
"""

from __future__ import annotations

import gc
import heapq
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from locusflow.llm.common import Numbers, chunks, tidy

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_TOKENS = 2_000_000
#: Text bytes that are tokenised at a time.
STEP = 1 << 20
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def capacities(total: int, length: int) -> list[int]:
    """Full sequences, then powers of two for what is left (length itself must be a power of two for no padding at all)."""
    left = total % length
    return [length] * (total // length) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(sizes: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) for every piece; sizes are token counts, all positive."""
    full = np.array(capacities(sum(sizes), length), np.int64)
    room, spent = full.copy(), np.zeros(len(full))
    pieces: list[tuple[float, int, int, int]] = []  # -cost, document, start, tokens
    for d, n in enumerate(sizes):
        for s in range(0, n, length):
            take = min(length, n - s)
            pieces.append((-cost(take), d, s, take))
    heapq.heapify(pieces)
    out = []
    while pieces:
        _, d, s, n = heapq.heappop(pieces)
        q = int(np.where(room >= n, spent, np.inf).argmin())  # of equal cost the longer, then the first
        if room[q] < n:
            q = int(np.where(room > 0, spent, np.inf).argmin())
        take = min(n, int(room[q]))
        out.append((d, s, take, q, int(full[q] - room[q])))
        room[q] -= take
        spent[q] += cost(take)
        if take < n:
            heapq.heappush(pieces, (-cost(n - take), d, s + take, n - take))
    return out


def _byte_letters() -> dict[str, int]:
    """The usual one-letter names of bytes in byte-level vocabularies, back to the bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def fast_words(path: str):
    """A function from the lower-case letters of a word to its ids, or None where the vocabulary has no such form.

    The word's end mark becomes one byte, 255, which UTF-8 never has, so that a byte-pair encoder in compiled code does
    the merges. That needs ids in the order of the merges and a plain end-of-word suffix, which is checked.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab["".join(m)] for m in merges]
    if not suffix or model["type"] != "BPE" or made != sorted(set(made)):
        return None
    letters = _byte_letters()
    ranks: dict[bytes, int] = {b"\xff": max(vocab.values()) + 1}
    for token, i in vocab.items():
        body = token.removesuffix(suffix)
        if not body or not all(c in letters for c in body) or b"\xff" in (raw := bytes(letters[c] for c in body)):
            continue
        ranks[raw + b"\xff" if body != token else raw] = i
    firsts = [i for t, i in ranks.items() if len(t.rstrip(b"\xff")) == 1]
    if len(firsts) < 2 * 255 or made[0] < max(firsts):
        return None
    core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return lambda w: core.encode_single_piece(w + b"\xff")


def latin_letters(w: bytes) -> bool:
    """Whether a word is lower-case Latin letters only, in composed form."""
    if w.isalpha():
        return w.islower()
    s = w.decode("utf-8", "replace")
    return s.isalpha() and max(s) < "\u0250" and s == s.lower()


class WordTokens:
    """Token ids of texts through a memory of words.

    White space always separates tokens in the vocabularies meant here (it is dropped, as is case), so the ids of a text
    are those of its words in order, and those of letters followed by punctuation are the ids of the two. Words are cut at
    ASCII white space only; other white space stays inside and is left to the tokenizer. A vocabulary for which that does
    not hold on PROBE is used as it is, text by text.
    """

    PROBE = "Don't STOP,\t  caf\u00e9!! \u00c9T\u00c9 x1.2 #tag\n\n a_b \u65e5\u672c \u00a0\u0085 tail... (x) \u00dcber-\u00e9l\u00e8ve "

    MARKS = b".,;:!?%$#*&"
    BETWEEN = "<|endoftext|>"

    def __init__(self, path: str, bound: int = 200_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(self.BETWEEN)
        self.bound = bound
        self.fast, self.whole = fast_words(path), False
        self.clear()
        probe = [self.PROBE.encode(), self.PROBE.strip().lower().encode(), b"", b" the Quick  brown fox.\n"]
        self.whole = self.ids(probe, None)[0].tolist() != self.plain(probe, None)[0].tolist()
        self.clear()

    def clear(self) -> None:
        self.at = Numbers()
        self.cores: dict[bytes, bytes] = {}  # ids as packed uint32
        self.flat = np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, words: list[bytes]) -> None:
        """Remembers the ids of each word: letters by the fast way; of others many at once, a special token in between."""
        if self.fast:
            fast, cores = self.fast, self.cores
            rest = []
            for w in words:
                if latin_letters(w):
                    cores[w] = array("I", fast(w)).tobytes()
                else:
                    rest.append(w)
            words = rest
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            ids = self.tokenizer.encode(self.BETWEEN.join(w.decode("utf-8", "replace") for w in some), add_special_tokens=False).ids
            out: list[list[int]] = [[]]
            for i in ids:
                if i == self.between:
                    out.append([])
                else:
                    out[-1].append(i)
            if len(out) != len(some):  # a word that holds the special token itself
                out = [self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in some]
            self.cores.update((w, array("I", ids).tobytes()) for w, ids in zip(some, out, strict=True))

    def learn(self, words: list[bytes]) -> None:
        parts = []
        for w in words:
            low = w.lower()
            core = low.rstrip(self.MARKS)
            whole = len(core) == len(low) or not core or not (core.isalpha() or core.decode("utf-8", "replace").isalpha())
            parts.append((low, b"") if whole else (core, low[len(core) :]))
        cores = self.cores
        self.encode([w for w in dict.fromkeys(x for p in parts for x in p if x) if w not in cores])
        cores[b""] = b""
        ids = [cores[a] + cores[b] for a, b in parts]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])

    def plain(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """What ids gives, from the tokenizer alone."""
        out = [e.ids + ([] if end is None else [end]) for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(out), np.uint32, sum(map(len, out))), np.fromiter(map(len, out), np.int64, len(out))

    def ids(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by `end` if given, and the count of each text."""
        if self.whole:
            return self.plain(texts, end)
        if len(self.at) > self.bound:
            self.clear()
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.at.new:
            self.learn(self.at.new)
            self.at.new = []
        size, first = self.size[at], self.first[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(first - (ends - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if end is None:
            return flat, np.diff(bounds)
        out = np.empty(total + len(texts), np.uint32)
        lengths = np.diff(bounds) + 1
        stop = np.cumsum(lengths) - 1
        keep = np.ones(len(out), bool)
        keep[stop] = False
        out[stop] = end
        out[keep] = flat
        return out, lengths


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents (null text: empty, so the end id alone), with the sequence and the offset of each.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens. Repeated ids or texts
    are packed each on its own; an empty table gives no rows; other columns are not read. sequence_id is
    (task's partition << 32) + a running number, so a task that is run again gives the same rows.
    """

    def run(batches):
        gc.disable()  # the memory of words has no cycles, only many objects to go over
        try:
            yield from packed(batches)
        finally:
            gc.enable()

    def packed(batches):
        tokens, part, seq = WordTokens(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        total = 0

        def flush():
            nonlocal held, total, seq
            flat = held
            sizes = [len(i) for _, i in flat]
            room = capacities(sum(sizes), length)
            rows = [
                (flat[k][0], s, n, zlib.crc32(flat[k][1][s : s + n].tobytes()), sizes[k], (part << 32) + seq + q, o, room[q])
                for k, s, n, q, o in pack(sizes, length)
            ]
            seq += len(room)
            held, total = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for (ids,), texts in chunks(batches, "text", ["doc_id"], STEP):
            flat, sizes = tokens.ids(texts, end_id)
            for d, piece in zip(ids, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                held.append((d, piece.astype("<u4")))
                total += len(piece)
                if total >= GROUP_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)
