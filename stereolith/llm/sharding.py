"""Sharding by jump consistent hashing (Lamping and Veach, arXiv:1406.2294).

A stable key and the number of shards decide a row's shard; there is no ring
table. When a shard is appended, about ``1/(n+1)`` of the keys move, all of
them into the new shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, tied

_STEP = np.uint64(2862933555777941757)  # the multiplier of the published generator


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, for all keys at once."""
    if shards < 1:
        raise ValueError("there must be one shard at least")
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    jump = np.zeros(len(key), np.int64)
    while len(todo):
        shard[todo] = jump
        key = key * _STEP + np.uint64(1)
        draw = ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = ((shard[todo] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        on = jump < shards
        todo, key, jump = todo[on], key[on], jump[on]
    return shard.astype(np.int32)


def assign_shards(df: DataFrame, *, key: str, shards: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Give each row its shard, its slot there and its shard if there were one more.

    Returns ``key``, the ``carry`` columns, ``shard int``, ``slot long`` (gapless
    from 0 in each shard) and ``grown_shard int``. One row comes out for each row
    that goes in, repeated rows too; other columns, whatever their names, are not
    read. The key is hashed by its text form, a null key as the empty text, so
    that a key of any type has one stable place.

    Slots need no task that holds a whole shard: each input part numbers its own
    rows by shard, and prefix sums over the parts' counts give the offsets.
    """
    rows = df.select(
        F.col(key), *[F.col(c) for c in carry], F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("__hash")
    )
    kept = rows.schema.fields[:-1]
    schema = T.StructType(
        [*kept, T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("__part", T.IntegerType()), T.StructField("__local", T.LongType())]
    )
    names = schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        filled = np.zeros(shards, np.int64)
        for batch in batches:
            key64 = batch.column("__hash").to_numpy(zero_copy_only=False).view(np.uint64)
            shard = jump_hash(key64, shards)
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count)
            local += filled[shard]
            filled += count
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(shard), pa.array(jump_hash(key64, shards + 1)), pa.array(np.full(len(shard), part, np.int32)), pa.array(local)],
                names=names,
            )

    placed = materialize(rows.mapInArrow(place, schema), "shards")
    counts = placed.groupBy("__part", "shard").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", "shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    slots = placed.join(offsets, ["__part", "shard"]).select(
        *[f.name for f in kept], "shard", (F.col("__before") + F.col("__local")).alias("slot"), "grown_shard"
    )
    return tied(slots, placed)
