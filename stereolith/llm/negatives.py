"""Hard negatives by ball trees with bounds on both sides.

The rows are dealt by label and cut into runs of at most ``TREE_ROWS``, each of
which becomes a balanced ball tree. For an anchor ``q`` and a ball of centre ``c``
and radius ``r`` every inner product lies in ``q.c - |q| r`` to ``q.c + |q| r``. The
search for positives prunes balls whose upper bound is strictly under the anchor's
current kth score; the search for negatives also prunes balls that lie wholly
above the score window of each of the anchor's positives, or wholly under it. Balls of
one label alone are skipped by the label.

Anchors come in blocks of a fixed number of bytes, and each block is answered by
all trees: a stated query set against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_folder, release, tied
from .topk import _best, _matrix

TREE_ROWS = 8192
LEAF_ROWS = 64
ANCHOR_BYTES = 16 << 20  # of anchors' vectors that one pass answers and every executor gets
_ANCHORS = 2048  # anchors that meet a tree at once
_NONE = np.empty(0, np.int64)


class BallTree:
    """A balanced tree over rows of vectors: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        depth = 0
        while len(ids) > LEAF_ROWS << depth:
            depth += 1
        order = np.arange(len(ids))
        spans = [(0, len(ids))]
        for level in range(depth):
            below = []
            for low, high in spans:
                own = order[low:high]
                middle = (high - low) // 2
                if high - low > 1:
                    v = vectors[own]
                    # Along the line between two far ends of the ball, split at the median.
                    a = v[np.argmax(((v - v.mean(0)) ** 2).sum(1))]
                    b = v[np.argmax(((v - a) ** 2).sum(1))]
                    order[low:high] = own[np.argsort(v @ (b - a), kind="stable")]
                below += [(low, low + middle), (low + middle, high)]
            spans = below
        self.ids, self.labels, self.vectors, self.depth = ids[order], labels[order], vectors[order], depth
        self._measure()

    def _measure(self) -> None:
        """Spans, centres, radii and labels of all nodes."""
        levels = [[(0, len(self.ids))]]
        for _ in range(self.depth):
            levels.append([x for low, high in levels[-1] for x in ((low, low + (high - low) // 2), (low + (high - low) // 2, high))])
        self.spans = [x for level in levels for x in level]
        n, width = len(self.spans), self.vectors.shape[1]
        self.centres, self.radii = np.zeros((n, width)), np.zeros(n)
        self.lowest, self.highest = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for i, (low, high) in enumerate(self.spans):
            if high > low:
                v = self.vectors[low:high]
                self.centres[i] = v.mean(0)
                # A little more than the farthest row, for what rounding takes off.
                self.radii[i] = np.sqrt(((v - self.centres[i]) ** 2).sum(1).max()) * (1 + 1e-9) + 1e-6
                self.lowest[i], self.highest[i] = self.labels[low:high].min(), self.labels[low:high].max()

    def row(self) -> tuple[bytes, bytes, bytes, int]:
        """Ids, labels and vectors in the tree's order, and its depth."""
        return self.ids.astype("<i8").tobytes(), self.labels.astype("<i8").tobytes(), self.vectors.astype("<i4").tobytes(), self.depth

    @classmethod
    def from_row(cls, ids: bytes, labels: bytes, vectors: bytes, depth: int) -> BallTree:
        tree = cls.__new__(cls)
        tree.ids, tree.labels, tree.depth = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), depth
        tree.vectors = np.frombuffer(vectors, "<i4").reshape(len(tree.ids), -1).astype(np.float64)
        tree._measure()
        return tree

    def leaves(self, anchors: np.ndarray, keep) -> Iterator[tuple[int, int, np.ndarray]]:
        """``low, high, anchors that may find something there`` of each leaf, from the best upper bound on.

        ``keep(anchors, node, under, over)`` says which of the given anchors go into
        a ball whose inner products lie between ``under`` and ``over``.
        """
        lengths = np.sqrt((anchors**2).sum(1))
        going: list[tuple[int, np.ndarray]] = [(0, np.arange(len(anchors)))]
        ends: list[tuple[float, int, np.ndarray, np.ndarray, np.ndarray]] = []
        while going:
            node, asks = going.pop()
            low, high = self.spans[node]
            if high == low:
                continue
            middle, reach = anchors[asks] @ self.centres[node], lengths[asks] * self.radii[node]
            on = keep(asks, node, middle - reach, middle + reach)
            if not on.any():
                continue
            if 2 * node + 1 < len(self.spans):
                going += [(2 * node + 1, asks[on]), (2 * node + 2, asks[on])]
            else:
                ends.append((float(np.mean((middle + reach)[on])), node, asks[on], (middle - reach)[on], (middle + reach)[on]))
        for _, node, asks, under, over in sorted(ends, key=lambda e: -e[0]):
            on = keep(asks, node, under, over)  # thresholds have risen since
            if on.any():
                yield *self.spans[node], asks[on]


class Anchors:
    """A block of anchors and, for the second search, the windows of their positives."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors

    def positives(self, trees: Iterator[BallTree], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``anchor, id, score`` of the best k rows of an anchor's label, its own id's apart, among these trees."""
        floor = np.full(len(self.ids), -np.inf)
        kept = [_NONE] * 3
        for tree in trees:
            for low in range(0, len(self.ids), _ANCHORS):
                part = slice(low, min(low + _ANCHORS, len(self.ids)))
                labels = self.labels[part]
                keep = lambda asks, node, under, over: (over >= floor[part][asks] - 0.5) & (tree.lowest[node] <= labels[asks]) & (labels[asks] <= tree.highest[node])  # noqa: B023, E731
                for begin, end, asks in tree.leaves(self.vectors[part], keep):
                    scores = self.vectors[part][asks] @ tree.vectors[begin:end].T
                    good = (tree.labels[begin:end] == labels[asks, None]) & (tree.ids[begin:end] != self.ids[part][asks, None]) & (scores >= floor[part][asks, None])
                    a, x = np.nonzero(good)
                    if len(a):
                        kept = self._merge(kept, (asks[a] + low, tree.ids[begin:end][x], scores[a, x].astype(np.int64)), k, floor)
        return tuple(kept)

    def set_windows(self, owner: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> None:
        """The score windows that the second search asks for; ``owner`` is each one's anchor, ascending."""
        self.owner, self.lowest, self.highest = owner, lowest, highest
        self.first = np.searchsorted(owner, np.arange(len(self.ids) + 1))

    def negatives(self, trees: Iterator[BallTree], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``window, id, score`` of the best k rows of another label than the window's anchor's, among these trees."""
        floor = np.full(len(self.owner), -np.inf)
        kept = [_NONE] * 3
        asked = np.flatnonzero(np.diff(self.first))
        if not len(asked):
            return tuple(kept)
        starts = self.first[asked]
        top = np.maximum.reduceat(self.highest, starts)
        least = np.minimum.reduceat(np.maximum(self.lowest, floor), starts)  # under this an anchor has no use for a row
        for tree in trees:
            for low in range(0, len(asked), _ANCHORS):
                part = slice(low, min(low + _ANCHORS, len(asked)))
                own = asked[part]
                labels, vectors = self.labels[own], self.vectors[own]
                keep = lambda asks, node, under, over: (over >= least[part][asks] - 0.5) & (under <= top[part][asks] + 0.5) & ~((tree.lowest[node] == labels[asks]) & (tree.highest[node] == labels[asks]))  # noqa: B023, E731
                for begin, end, asks in tree.leaves(vectors, keep):
                    scores = vectors[asks] @ tree.vectors[begin:end].T
                    good = (tree.labels[begin:end] != labels[asks, None]) & (scores >= least[part][asks, None]) & (scores <= top[part][asks, None])
                    a, x = np.nonzero(good)
                    if not len(a):
                        continue
                    # Each row that some window of its anchor may want, once for each of these windows.
                    anchor, ids, score = own[asks[a]], tree.ids[begin:end][x], scores[a, x].astype(np.int64)
                    count = self.first[anchor + 1] - self.first[anchor]
                    window = np.repeat(self.first[anchor] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    ids, score = np.repeat(ids, count), np.repeat(score, count)
                    on = (score >= self.lowest[window]) & (score <= self.highest[window]) & (score >= floor[window])
                    if on.any():
                        kept = self._merge(kept, (window[on], ids[on], score[on]), k, floor)
                        least = np.minimum.reduceat(np.maximum(self.lowest, floor), starts)
        return tuple(kept)

    @staticmethod
    def _merge(kept: list[np.ndarray], found: tuple[np.ndarray, ...], k: int, floor: np.ndarray) -> list[np.ndarray]:
        """The best k of each query among both; ``floor`` rises to the kth score of queries that have as many."""
        touched = np.isin(kept[0], found[0])
        own = [np.concatenate([x[touched], y]) for x, y in zip(kept, found)]
        best = _best(own[0], own[2], own[1], k)
        own = [x[best] for x in own]
        full, first, count = np.unique(own[0], return_index=True, return_counts=True)
        last = first + count - 1  # _best leaves a query's rows together, best first
        enough = count >= k
        floor[full[enough]] = own[2][last[enough]]
        return [np.concatenate([x[~touched], y]) for x, y in zip(kept, own)]


def _trees(rows: DataFrame, width: int) -> DataFrame:
    """The trees of ``rows`` (``id, label, v``), by ranges of labels, written down."""
    spread = F.xxhash64("id", "v")
    dealt = rows.select("id", "label", "v", spread.alias("spread"), F.monotonically_increasing_id().alias("row")).repartitionByRange("label", "spread", "row").sortWithinPartitions("label", "spread").select("id", "label", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def grown() -> pa.RecordBatch:
            ids, labels, vectors = (np.concatenate(x) for x in zip(*held))
            out = [pa.array([x], t) for x, t in zip(BallTree(ids, labels, vectors).row(), (pa.binary(), pa.binary(), pa.binary(), pa.int32()))]
            return pa.RecordBatch.from_arrays(out, names=["ids", "labels", "vectors", "depth"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, TREE_ROWS - count)
                held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"), width)))
                at += part.num_rows
                count += part.num_rows
                if count == TREE_ROWS:
                    yield grown()
                    held, count = [], 0
        if count:
            yield grown()

    return materialize(dealt.mapInArrow(run, "ids binary, labels binary, vectors binary, depth int"), "balls")


def _search(trees: DataFrame, block: Anchors, k: int, what: str) -> DataFrame:
    """Each task's best ``at, id, score`` by anchor (``positives``) or window (``negatives``)."""
    sent = trees.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (BallTree.from_row(*row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        at, ids, score = getattr(sent.value, what)(own, k)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["at", "id", "score"])

    return trees.mapInArrow(run, "at long, id long, score long")


def hard_negatives(
    df: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", is_anchor: Column, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95, scale: int = 256
) -> DataFrame:
    """Each anchor's best positives, and for each of them the best rows of other labels in its window.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. Components become ``floor(scale * x)``; a score is an integer
    inner product; higher ones come first and ties go to the smaller id. Positives
    are the first ``positives`` rows of the anchor's label with another id than its own.
    Negatives of a positive of score p are the first ``negatives`` rows of any other
    label whose score n satisfies ``lowest * p <= 100 * n <= highest * p``, so that none
    do where p is negative. A positive without such rows gives none.

    Rows whose id, label or vector is null, or whose vector holds a null or
    non-finite component, take no part; a vector that is shorter than the longest
    counts as filled up with zeros. Each anchor row is answered, repeated ones too. Other
    columns are not read; an empty table gives no rows. Scores are exact: where
    ``width * (scale * x) ** 2`` could reach 2**52 a ``ValueError`` says so, and also
    where a component passes 2**31.
    """
    spark = df.sparkSession
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cells = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull() & ~bad
    rows = df.where(good).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), cells.alias("v"), is_anchor.alias("ask"))
    head = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most")).first()
    width, most = head.width or 0, head.most or 0.0
    if width * most**2 >= 2.0**52 or most >= 2.0**31:
        raise ValueError("inner products of these vectors go past what doubles hold exactly")
    trees = _trees(rows, width)
    schema = "anchor_id long, positive_id long, window long, positive_score long, id long, score long"
    path = new_folder(spark, "negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    block_rows = max(1, ANCHOR_BYTES // (8 * max(1, width)))
    held: list = []
    done = 0

    def answer() -> None:
        nonlocal done
        vectors = np.array([r.v + [0.0] * (width - len(r.v)) for r in held]).reshape(len(held), width)
        block = Anchors(np.array([r.id for r in held], np.int64), np.array([r.label for r in held], np.int64), vectors)
        held.clear()
        first = Window.partitionBy("at").orderBy(F.col("score").desc(), "id")
        # ``positives`` rows for each anchor of the block.
        found = _search(trees, block, positives, "positives").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives).orderBy("at", "rank").toArrow()
        owner, ids, score = (found[c].to_numpy() for c in ("at", "id", "score"))
        block.set_windows(owner, -(-lowest * score // 100), highest * score // 100)
        if len(owner):
            known = pa.table({"at": pa.array(np.arange(len(owner))), "anchor_id": pa.array(block.ids[owner]), "positive_id": pa.array(ids), "positive_score": pa.array(score)})
            known = known.append_column("window", pa.array(np.arange(len(owner)) + done))
            done += len(owner)
            own = _search(trees, block, negatives, "negatives")
            # Every window of the block: as bounded as the block.
            own.join(F.broadcast(spark.createDataFrame(known)), "at").select("anchor_id", "positive_id", "window", "positive_score", "id", "score").write.mode("append").parquet(path)

    for row in rows.where("ask").select("id", "label", "v").toLocalIterator():
        held.append(row)
        if len(held) == block_rows:
            answer()
    if held:
        answer()
    release(trees)
    by = Window.partitionBy("window").orderBy(F.col("score").desc(), "id")
    best = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    return tied(best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), path)
