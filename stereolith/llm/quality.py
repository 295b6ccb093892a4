"""Quality classifier on random-indexing word vectors.

Every word has a sparse random index vector; its context vector is the sum of
its neighbours' index vectors over all documents. Documents pool the vectors of
their words, and a two-layer network turns the pool into a probability, which a
temperature from held-back rows calibrates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SUM_SCHEMA, slices, small_batches, sum_rows, text_column, tree_sum

BUCKETS = 1 << 15
WIDTH = 32
TRAIN_ROWS = 20_000  # labelled rows that the network is fitted on, at most: those whose id hashes lowest
_NONZERO = 4
_SEED = 20_240_501
_RUN = 1 << 16
_SLICE = 1 << 20  # bytes of text at a time; what is computed of them takes many times as much
_PARTS = re.compile(r"\w+|[^\w\s]+")
_REPEAT, _CAPITALS = 0, 1  # buckets of the two marks that aren't words


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of each bucket's index vector."""
    draw = np.random.default_rng(_SEED)
    return np.argsort(draw.random((BUCKETS, WIDTH)), axis=1)[:, :_NONZERO], draw.choice([-1, 1], (BUCKETS, _NONZERO))


@lru_cache(maxsize=1 << 15)
def _buckets(word: str) -> tuple[int, ...]:
    """The buckets of a space-separated word: its runs of letters and digits, its runs of signs, and a mark for capitals."""
    import xxhash

    found = [2 + xxhash.xxh64_intdigest(p, _SEED) % (BUCKETS - 2) for p in _PARTS.findall(word.lower())]
    if len(word) > 1 and word.isupper():
        found.append(_CAPITALS)
    return tuple(found) or (2,)


def _streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bucket streams in one array, and where each text's ends. A word like the one before it becomes a mark."""
    split = pc.split_pattern_regex(texts, r"\s+")
    words = pc.dictionary_encode(split.flatten())
    codes = words.indices.to_numpy().astype(np.int64)
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    lists = [_buckets(w) if w else () for w in words.dictionary.to_pylist()] + [(_REPEAT,)]
    counts = np.array([len(x) for x in lists], np.int64)
    flat = np.array([b for x in lists for b in x], np.int64)
    first = np.cumsum(counts) - counts
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    heads = bounds[:-1]
    same[heads[heads < len(codes)]] = False
    codes[same] = len(lists) - 1
    n = counts[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    stream = flat[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])]
    return stream, ends[bounds[1:]]


def context_vectors(df: DataFrame, *, text_col: str) -> np.ndarray:
    """The unit context vector of every bucket, from all rows: ``BUCKETS`` x ``WIDTH``, whatever the input.

    Sums are of integers, so their order doesn't matter; they are added up in a
    tree, so no task gets more than 64 tasks' sums.
    """
    rows = df.select(text_column(text_col).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _index_vectors()
        total = np.zeros(BUCKETS * WIDTH, np.int64)
        for batch in slices(batches, "__text", _SLICE):
            stream, ends = _streams(batch.column("__text"))
            inside = np.ones(max(len(stream) - 1, 0), bool)
            last = ends[(ends > 0) & (ends < len(stream))] - 1
            inside[last] = False
            a, b = stream[:-1][inside], stream[1:][inside]
            for x, y in ((a, b), (b, a)):
                for k in range(_NONZERO):
                    total += np.bincount(x * WIDTH + places[y, k], weights=signs[y, k], minlength=len(total)).astype(np.int64)
        yield from sum_rows("context", TaskContext.get().partitionId(), total)

    found = tree_sum(rows.mapInArrow(count, SUM_SCHEMA), rows.rdd.getNumPartitions())
    vectors = found.get("context", np.zeros(BUCKETS * WIDTH)).astype(np.float64)
    vectors = vectors.reshape(BUCKETS, WIDTH)
    size = np.sqrt((vectors**2).sum(1, keepdims=True))
    return (vectors / np.where(size > 0, size, 1)).astype(np.float32)


def _pooled(rows: DataFrame, vectors: np.ndarray, *, text_col: str, schema: str | None, network: Network | None = None, drop_text: bool = True) -> DataFrame:
    """``rows`` with each text's pool in ``__pool``, or, given a network, its score in the column that ``schema`` names.

    A pool is the mean and the mean square of the words' vectors and the log of
    their number. The text goes to Python once, and back only if it is kept.
    """
    sent = rows.sparkSession.sparkContext.broadcast(np.hstack([vectors, vectors**2]))
    keep = [f for f in rows.schema.fields if f.name != text_col or not drop_text]
    out = T.StructType([*keep, T.StructField("__pool", T.BinaryType()) if network is None else T.StructField(schema, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sent.value
        for batch in slices(batches, text_col, _SLICE):
            stream, ends = _streams(pc.fill_null(batch.column(text_col), ""))
            starts = np.concatenate([[0], ends[:-1]])
            sums = np.zeros((len(ends), both.shape[1]))
            owner = np.repeat(np.arange(len(ends)), ends - starts)
            for k in range(0, len(stream), _RUN):
                own = owner[k : k + _RUN]
                heads = np.flatnonzero(np.diff(own, prepend=-1))
                sums[own[heads]] += np.add.reduceat(both[stream[k : k + _RUN]], heads, axis=0)
            n = ends - starts
            pool = np.hstack([sums / np.maximum(n, 1)[:, None], np.log1p(n)[:, None]])
            last = pa.array([x.tobytes() for x in pool], pa.binary()) if network is None else pa.array(network.probability(pool))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], last], names=out.names)

    return rows.mapInArrow(run, out)


class Network:
    """Two layers, fitted by Adam on all given rows; deterministic."""

    hidden = 32

    def __init__(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 30, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4):
        draw = np.random.default_rng(_SEED)
        width = x.shape[1]
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
        self.w = [draw.normal(0, 1 / math.sqrt(width), (width, self.hidden)), np.zeros(self.hidden), draw.normal(0, 1 / math.sqrt(self.hidden), self.hidden), np.zeros(1)]
        self.temperature = 1.0
        if not len(x):
            self.w[2][:] = 0
            return
        order = draw.permutation(len(x))
        held, rest = order[: len(x) // 10], order[len(x) // 10 :]
        z = (x - self.mean) / self.scale
        m, v = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        step = 0
        for _ in range(epochs):
            draw.shuffle(rest)
            for k in range(0, len(rest), batch):
                own = rest[k : k + batch]
                h = np.tanh(z[own] @ self.w[0] + self.w[1])
                error = (_sigmoid(h @ self.w[2] + self.w[3]) - y[own]) / len(own)
                back = np.outer(error, self.w[2]) * (1 - h**2)
                step += 1
                for i, g in enumerate((z[own].T @ back, back.sum(0), h.T @ error, np.array([error.sum()]))):
                    g = g + decay * self.w[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if len(held):
            logits = self.logits(x[held])
            grid = np.exp(np.linspace(math.log(0.25), math.log(8), 81))
            losses = [np.mean(np.logaddexp(0, -np.where(y[held] > 0.5, 1, -1) * logits / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(losses))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_quality(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_from: Column | None = None, train_rows: int = TRAIN_ROWS, carry: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """``id_col``, the ``carry`` columns and ``score_col``, the probability of label 1, of every row of ``df``.

    Word vectors come from all texts. The network is fitted on labelled rows for
    which ``learn_from`` (over ``labels``) holds, at most ``train_rows`` of them.
    Null labels and ids aren't learnt from; an id with several labels counts with
    its highest. Null, empty and blank texts pool to zeros and are scored like any
    other. Without labels every score is one half. One row comes out for each that
    goes in; columns not named are not read. An empty table gives no rows.
    """
    small_batches(df.sparkSession)
    vectors = context_vectors(df, text_col=text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn_from is not None:
        known = known.where(learn_from)
    known = known.groupBy(id_col).agg(F.max(label_col).alias("__y")).select(F.col(id_col).alias("__id"), "__y")
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    learnt = rows.join(F.broadcast(chosen), "__id")  # train_rows rows at most
    sample = _pooled(learnt.select("__id", "__y", "__text"), vectors, text_col="__text", schema=None).toArrow()
    ids, pools = sample["__id"].to_pylist(), sample["__pool"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], pools[i]))  # rows that tie in both are alike
    x = np.frombuffer(b"".join(pools), np.float64).reshape(-1, 2 * WIDTH + 1)[order]
    network = Network(x, sample["__y"].to_numpy().astype(np.float64)[order])
    return _pooled(df.select(id_col, *[c for c in carry if c != id_col], *([] if text_col in carry else [text_col])), vectors, text_col=text_col, schema=score_col, network=network, drop_text=text_col not in carry)
