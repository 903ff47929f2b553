"""Shards and slots from a keyed permutation of global row numbers.

Rows are numbered by their sorted keys, a Feistel network with cycle walking permutes the numbers, and the permuted
number gives the shard (its remainder) and the slot (its quotient). So shards differ by one row at most, the order is
a shuffle that the key reproduces, and a row's place can be computed without looking at other rows.

Null texts have no bytes; null keys sort first. Rows equal in every sort column are interchangeable and get neighbouring
numbers. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.llm.arrow_text import mixed
from twinframe.session import stage

ROUNDS = 8


class Permutation:
    """A keyed bijection of 0..n-1 on whole arrays: a balanced Feistel network over the next even power of two, walked
    until the value is below n (at most four times n values, so four steps on average at worst)."""

    def __init__(self, n: int, key: str) -> None:
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        digest = hashlib.blake2b(key.encode(), digest_size=8 * ROUNDS).digest()
        self.keys = [np.uint64(int.from_bytes(digest[8 * i : 8 * i + 8], "little")) for i in range(ROUNDS)]

    def _rounds(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in keys:
            left, right = right, left ^ (mixed(right * np.uint64(0x9E3779B97F4A7C15) + key) & self.mask)
        return (left << np.uint64(self.half)) | right

    def _swap(self, x: np.ndarray) -> np.ndarray:
        return ((x & self.mask) << np.uint64(self.half)) | (x >> np.uint64(self.half))

    def _walk(self, values: np.ndarray, step) -> np.ndarray:
        out = step(values.astype(np.uint64))
        while len(outside := np.flatnonzero(out >= np.uint64(self.n))):
            out[outside] = step(out[outside])
        return out.astype(np.int64)

    def forward(self, values: np.ndarray) -> np.ndarray:
        return self._walk(values, lambda x: self._rounds(x, self.keys))

    def backward(self, values: np.ndarray) -> np.ndarray:
        """The row numbers that ``forward`` takes to ``values``."""
        return self._walk(values, lambda x: self._swap(self._rounds(self._swap(x), self.keys[::-1])))


def numbered(rows: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """``rows`` with global numbers from 0 in the given order.

    Rows are range-partitioned and sorted, written once, counted per partition, and each partition's rows are numbered
    from the sum of the counts before it. A salt that is written before the sort splits runs of equal keys, so a key
    with many rows does not fill one partition. Only one count per partition is broadcast.
    """
    salted = stage(rows.withColumn("__salt", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())), "unsorted")
    parts = salted.repartitionByRange(*order, F.col("__salt")).sortWithinPartitions(*order, F.col("__salt"))
    local = F.monotonically_increasing_id()
    placed = stage(
        parts.withColumn("__part", F.shiftright(local, 33)).withColumn("__at", local.bitwiseAND(F.lit((1 << 33) - 1))), "sorted"
    )
    sizes = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    begins = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    table = placed.sparkSession.createDataFrame(
        [(p, begins[i]) for i, (p, _) in enumerate(sizes)], "__part long, __begin long"
    )
    return (
        placed.join(F.broadcast(table), "__part")
        .withColumn(name, F.col("__begin") + F.col("__at"))
        .drop("__part", "__at", "__begin", "__salt")
    )


def sharded(rows: DataFrame, order: list[str], shards: int = 8, key: str = "shuffle-1") -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards``-1) and ``slot`` (gapless from 0 in each shard)."""
    listed = stage(numbered(rows.drop("shard", "slot", "__number"), [F.col(c) for c in order], "__number"), "numbered")
    n = listed.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Permutation(n, key)
        for batch in batches:
            at = permutation.forward(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            columns = [pa.array((at % shards).astype(np.int32)), pa.array(at // shards)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "shard", "slot"])

    kept = [f for f in listed.schema.fields if f.name != "__number"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "shard int", "slot long"])
    return listed.select(*(F.col(f"`{f.name}`") for f in kept), "__number").mapInArrow(place, schema)


def write_shards(rows: DataFrame, order: list[str], path: str, shards: int = 8, key: str = "shuffle-1") -> None:
    """Writes a folder for each shard, its rows in slot order over files of bounded size."""
    placed = sharded(rows, order, shards, key)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
