"""Shared helpers: scratch tables in the cluster's shared folder, bounded Arrow chunks, 64-bit hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step holds at most, unless a single text is longer.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a new temporary one, but only in local mode: the executors of
    a cluster would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.locusflow.scratch", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="locusflow-")
            spark.conf.set("spark.locusflow.scratch", at)
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor never costs more than the step under way."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/locusflow/{label}-{uuid.uuid4().hex}"
        self.marked = False

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return the stored table."""
        df.write.mode("overwrite").parquet(self.path(name))
        if not self.marked:  # gone when the application ends, if not before
            base = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            self.marked = base.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(base)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of finished steps."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Jobs started inside send Arrow batches of about `most` bytes, for steps whose rows are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without_ids(docs: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """docs without the rows whose doc_id (null included) is among the one column of ids."""
    drop = scratch.keep(ids.toDF("_drop").distinct(), name)
    small = drop.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(drop) if small else drop, docs["doc_id"].eqNullSafe(drop["_drop"]), "left_anti")


def text_key(text: Column) -> Column:
    """SHA-256 of a text, null as empty: what hashlib gives for the bytes of as_bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


#: Up to so many pairs of an id and a text's hash are broadcast.
BROADCAST_ROWS = 100_000


def without_rows(docs: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """docs without the rows whose doc_id (null included) and text are among rows, of columns doc_id and text_key."""
    drop = scratch.keep(rows.select(F.col("doc_id").alias("_drop"), F.col("text_key").alias("_key")).distinct(), name)
    small = drop.count() <= BROADCAST_ROWS
    same = docs["doc_id"].eqNullSafe(drop["_drop"]) & text_key(docs["text"]).eqNullSafe(drop["_key"])
    return docs.join(F.broadcast(drop) if small else drop, same, "left_anti")


def tidy(run):
    """run (a function over batches), after which a reused worker gives the memory of the task back to the system."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # the C library may have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return task


def as_bytes(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b if b is not None else b"" for b in col.cast(kind).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], text: str, keep: list[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[list[list], list[bytes]]]:
    """Columns `keep` and the texts of the batches, cut to about `limit` bytes of text a piece."""
    for batch in batches:
        col = batch.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield [part.column(c).to_pylist() for c in keep], as_bytes(part.column(text))
            start = stop


class WordHashes(dict):
    """word (bytes) -> 64-bit hash as a signed int, remembered up to a bound."""

    def __init__(self, seed: int = 0, bound: int = 150_000):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w, self.seed)
        self[w] = h = h - (1 << 64) if h >= 1 << 63 else h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.bound:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)


class Numbers(dict):
    """word -> running number; new words are noted in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        self.new.append(w)
        return n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows in order; of the whole sequence where it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(width * 0x9E3779B97F4A7C15 & (1 << 64) - 1), np.uint64)
    for j in range(width):
        out = mix(out + words[j : j + n - width + 1])
    return out
