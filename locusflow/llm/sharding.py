"""Sharding by a keyed Feistel permutation of global row numbers.

Row i (rows ordered by id) goes to place p = P(i), where P is a balanced Feistel network on the smallest even number of
bits that holds the row count, walked along its cycle until it lands below the count. Then shard = p mod S and
slot = p div S: both are computable from i alone, shards differ by one row at most, and slots have no gaps.

Row numbers need no total sort in one place: a range partitioning by id is stored once, per-partition counts (one row a
partition) give offsets, and each partition numbers its own rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.llm.common import Scratch, mix

ROUNDS = 6


def feistel(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each row number i < n under the permutation of 0..n-1 that the seed names."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << half) | right

    out = once(i.astype(np.uint64))
    while (walk := out >= np.uint64(n)).any():
        out[walk] = once(out[walk])
    return out


def numbered(df: DataFrame, order: list[str], scratch: Scratch, name: str = "numbered") -> tuple[DataFrame, int]:
    """df with `row_number` from 0 in the given order, and the row count.

    Equal keys are ordered by the other listed columns; rows alike in all of them are interchangeable.
    """
    pid, first = (next(n for n in (f"{base}{'_' * i}" for i in range(len(df.columns) + 1)) if n not in df.columns) for base in ("_pid", "_first"))
    ranged = scratch.keep(df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()), name)
    # One row for each partition, however many rows there are.
    counts = sorted((r[pid], r["n"]) for r in ranged.groupBy(pid).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    spark = df.sparkSession
    starts = spark.createDataFrame(offsets or [(0, 0)], f"{pid} int, {first} long")
    local = F.row_number().over(Window.partitionBy(pid).orderBy(*order)) - 1
    out = ranged.join(F.broadcast(starts), pid).withColumn("row_number", F.col(first) + local).drop(pid, first)
    return out, total


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """df with `row_number`, `shard` (int) and `slot` (long).

    Nulls in the order columns sort first; repeated rows each get a place of their own; an empty table gives no rows.
    Extra columns pass through; the three names above must not occur in df, which is checked.
    """
    if clash := {"row_number", "shard", "slot"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are names of the result")
    scratch = scratch or Scratch(df.sparkSession, "shard")
    rows, total = numbered(df, order, scratch)

    def place(batches):
        for b in batches:
            p = feistel(b.column("row_number").to_numpy(zero_copy_only=False), total, seed)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array((p % np.uint64(shards)).astype(np.int32)), pa.array((p // np.uint64(shards)).astype(np.int64))],
                names=[*b.schema.names, "shard", "slot"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", shard int, slot long"
    return rows.mapInArrow(place, schema)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """The place of every document: size is its UTF-8 bytes (null: none) plus 16; the law is `rows`, so grown_shard is null."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).cast("long").alias("text_crc32")
    )
    placed = shard_rows(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
