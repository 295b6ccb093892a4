"""Exact top-k inner products over norm-sorted, rotated vectors.

An orthogonal rotation from the singular vectors of the whole table moves most
of each vector's length into its leading components. The table is dealt by ranges
of length and each part lies by descending length, so a task can stop where the
lengths alone rule out all that follows. A partial product over the leading components plus the
Cauchy-Schwarz bound on the rest rules most other pairs out, and what is left is
scored exactly. Queries come in blocks of a fixed number of bytes, each scanned against all rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_folder, release, tied

QUERY_BYTES = 16 << 20  # of query vectors that one scan answers and every executor gets
SEEDS = 4096  # longest vectors that give each query its first threshold
_ROWS = 1024
_QUERIES = 1024
_KEEP = 1 << 18


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of doubles, short ones filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _best(query: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each query's k best: by score, then by the smaller id."""
    order = np.lexsort((ident, -score, query))
    sorted_query = query[order]
    first = np.searchsorted(sorted_query, sorted_query, side="left")
    return order[np.arange(len(order)) - first < k]


class Block:
    """A block of queries, and what rules out their candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.vectors, self.rotation, self.k = ids, vectors, rotation, k
        self.rotated = vectors @ rotation
        self.steps = [m for m in (8, 16, 32) if m < vectors.shape[1]]
        self.rest = {m: np.sqrt((self.rotated[:, m:] ** 2).sum(1)) for m in [0, *self.steps]}
        self.floor = np.full(len(ids), -np.inf)  # no candidate scoring below it is among a query's best
        # Scores are integers, so a bound that rounding has lowered by less than a half still rules out nothing that counts.

    def scores(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query index, candidate index, score`` of every pair that the bounds leave."""
        rotated = vectors @ self.rotation
        rest = {m: np.sqrt((rotated[:, m:] ** 2).sum(1)) for m in [0, *self.steps]}
        found = []
        for low in range(0, len(self.ids), _QUERIES):
            part = slice(low, low + _QUERIES)
            floor = self.floor[part] - 0.5
            # By descending length: a query whose bound fails for the longest vector is done with the block.
            asks = np.flatnonzero(self.rest[0][part] * rest[0][0] >= floor)
            if not len(asks):
                continue
            if self.steps:
                m = self.steps[0]
                bound = self.rotated[part][asks, :m] @ rotated[:, :m].T
                bound += self.rest[m][part][asks, None] * rest[m][None, :]
                q, c = np.nonzero(bound >= floor[asks, None])
                q = asks[q]
                partial = None
                for before, m in zip(self.steps, self.steps[1:]):
                    if partial is None:
                        partial = np.einsum("ij,ij->i", self.rotated[part][q, :before], rotated[c, :before])
                    partial = partial + np.einsum("ij,ij->i", self.rotated[part][q, before:m], rotated[c, before:m])
                    on = partial + self.rest[m][part][q] * rest[m][c] >= floor[q]
                    q, c, partial = q[on], c[on], partial[on]
            else:
                q, c = (x.ravel() for x in np.meshgrid(asks, np.arange(len(ids)), indexing="ij"))
            q = q + low
            on = self.ids[q] != ids[c]
            q, c = q[on], c[on]
            score = np.empty(len(q))
            for k in range(0, len(q), _KEEP):
                score[k : k + _KEEP] = np.einsum("ij,ij->i", self.vectors[q[k : k + _KEEP]], vectors[c[k : k + _KEEP]])
            found.append((q, c, score.astype(np.int64)))
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))

    def done(self, length: float | None) -> bool:
        """Whether no vector of this squared length or less can be among any query's best."""
        return length is not None and bool(np.all(self.rest[0] * np.sqrt(length) < self.floor - 0.5))

    def raise_floor(self, query: np.ndarray, score: np.ndarray) -> None:
        """Take what are k candidates' scores of a query, at most, as its threshold where there are k."""
        count = np.bincount(query, minlength=len(self.ids))
        least = np.full(len(self.ids), np.inf)
        np.minimum.at(least, query, score)
        full = count >= self.k
        self.floor[full] = np.maximum(self.floor[full], least[full])


def top_k(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """Each query's ``k`` highest integer inner products: ``query_id, rank, vec_id, score``.

    Components are turned into ``floor(scale * x)``. Candidates are all rows of
    another id; ties go to the smaller id. Rows whose id or vector is null, or
    whose vector holds a null or non-finite component, take no part; a vector that
    is shorter than the longest counts as filled up with zeros. Each query row is
    answered, repeated ones too. Scores are exact: where ``width * (scale * x) ** 2``
    could reach 2**52 a ``ValueError`` says so. Other columns are not read; an empty
    table gives no rows.
    """
    spark = df.sparkSession
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cells = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = df.where(F.col(id_col).isNotNull() & vector.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), cells.alias("v"), is_query.alias("ask"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.withColumn("length", length)
    # Without a count the range shuffle follows the session's number of parts and what AQE makes of it.
    rows = materialize(rows.repartitionByRange(F.col("length").desc(), "id").sortWithinPartitions(F.col("length").desc(), "id"), "vectors")
    head = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most")).first()
    width = head.width or 0
    if width * (head.most or 0.0) ** 2 >= 2.0**52:
        raise ValueError("inner products of these vectors go past what doubles hold exactly")
    block_rows = max(1, QUERY_BYTES // (8 * max(1, width)))
    out = T.StructType([T.StructField("at", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    path = new_folder(spark, "topk")
    spark.createDataFrame([], out).write.parquet(path)
    rotation = _rotation(rows, width)
    longest = rows.orderBy(F.col("length").desc(), "id").select("id", "v").limit(SEEDS).toArrow() if width else None
    asked = rows.where("ask").select("id", "v")
    held: list = []
    at = 0

    def answer() -> None:
        nonlocal at
        block = Block(np.array([r.id for r in held], np.int64), np.array([r.v + [0.0] * (width - len(r.v)) for r in held]).reshape(len(held), width), rotation, k)
        if longest is not None:
            seed_ids = longest["id"].to_numpy()
            seeds = _matrix(longest["v"].combine_chunks(), width)
            kept = [np.empty(0, np.int64)] * 3
            for low in range(0, len(seed_ids), _ROWS):
                q, c, s = block.scores(seed_ids[low : low + _ROWS], seeds[low : low + _ROWS])
                kept = [np.concatenate(x) for x in zip(kept, (q, seed_ids[low : low + _ROWS][c], s))]
                best = _best(kept[0], kept[2], kept[1], k)
                kept = [x[best] for x in kept]
                block.raise_floor(kept[0], kept[2])
        _scan(rows, block, at, width, out).write.mode("append").parquet(path)
        at += len(held)
        held.clear()

    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == block_rows:
            answer()
    if held:
        answer()
    by = Window.partitionBy("at").orderBy(F.col("score").desc(), "vec_id")
    release(rows)
    return tied(spark.read.schema(out).parquet(path).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), path)


def _rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table, by descending singular value, from its ``width`` x ``width`` Gram matrix."""
    if not width:
        return np.zeros((0, 0))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            total += m.T @ m
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "x"])

    total = np.zeros((width, width))
    for r in rows.select("v").mapInArrow(gram, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        total[r.i, r.j] = r.x
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _scan(rows: DataFrame, block: Block, at: int, width: int, schema: T.StructType) -> DataFrame:
    """Each task's best candidates of every query of the block."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = copy.copy(sent.value)
        block.floor = block.floor.copy()  # raised here, for this task alone
        kept = [np.empty(0, np.int64)] * 3
        for batch in batches:
            ids = batch.column("id").to_numpy()
            vectors = _matrix(batch.column("v"), width)
            for low in range(0, len(ids), _ROWS):
                part = slice(low, low + _ROWS)
                q, c, s = block.scores(ids[part], vectors[part])
                if not len(q):
                    continue
                kept = [np.concatenate(x) for x in zip(kept, (q, ids[part][c], s))]
                best = _best(kept[0], kept[2], kept[1], block.k)
                kept = [x[best] for x in kept]
                block.raise_floor(kept[0], kept[2])
            if block.done(float(batch.column("length")[-1].as_py()) if len(ids) else None):
                break  # the rest of this part is shorter still
        yield pa.RecordBatch.from_arrays([pa.array(kept[0] + at), pa.array(block.ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=schema.names)

    return rows.select("id", "v", "length").mapInArrow(run, schema)
