"""Joins that the engine needs beyond plain equality.

Ranges and tolerances become equality on buckets with the exact predicate after
it, so that Spark shuffles on a key instead of comparing all pairs.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def visible_at(items: DataFrame, times: DataFrame, *, start: str, duration: str, fade: str, t: str, width: float) -> DataFrame:
    """Every item beside every time at which it is shown, [start, start + duration + fade).

    An item goes to each bucket of ``width`` seconds that it touches and a time to
    its one, so a pair meets once. Choose ``width`` near a usual duration.
    """
    end = F.col(start) + F.col(duration) + F.col(fade)
    spread = items.where(end > F.col(start)).withColumn("__b", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(end, width))))
    return spread.join(times.withColumn("__b", _bucket(F.col(t), width)), "__b").where((F.col(start) <= F.col(t)) & (F.col(t) < end)).drop("__b")


def within(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of equal ``keys`` whose ``a`` and ``b`` differ by less than ``tolerance``.

    The left row goes to its bucket and both beside it, the right to its one.
    """
    spread = left.withColumn("__b", F.explode(F.array(*[_bucket(F.col(a), tolerance) + k for k in (-1, 0, 1)])))
    return spread.join(right.withColumn("__b", _bucket(F.col(b), tolerance)), [*keys, "__b"]).where(F.abs(F.col(a) - F.col(b)) < tolerance).drop("__b")


SMALL_ROWS = 100_000  # rows of a clip table up to which every executor gets it


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be sent to every executor if it is small."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def other_clips(points: DataFrame, clips: DataFrame, *, clip: str, project: str) -> DataFrame:
    """Every point beside every other clip of its project, as ``other``."""
    others = clips.select(F.col(project), F.col(clip).alias("other"))
    return points.join(_small(others), project).where(F.col(clip) != F.col("other"))


def unpaired(points: DataFrame, clips: DataFrame, *, point: str, clip: str, project: str) -> DataFrame:
    """Every point beside the other clips of its project on which it has not been clicked.

    A point's clicks come together once, and a project's clips are one array.
    """
    every = clips.groupBy(project).agg(F.collect_set(clip).alias("__clips"))
    rows = points.groupBy(point, project).agg(F.collect_list(F.struct(*points.columns)).alias("__rows"), F.collect_set(clip).alias("__clicked"))
    open_ = rows.join(_small(every), project).select("__rows", F.explode(F.array_except("__clips", "__clicked")).alias("other"))
    return open_.select(F.explode("__rows").alias("__row"), "other").select("__row.*", "other").where(F.col(clip) != F.col("other"))


def not_attached(all_objects: DataFrame, bridge: DataFrame, event: object, *, obj: str = "object_id", event_col: str = "event_id") -> DataFrame:
    """Objects that an event doesn't have."""
    return all_objects.join(bridge.where(F.col(event_col) == event).select(obj).distinct(), obj, "left_anti")


def same_type_others(objects: DataFrame, *, key: str, kind: str, of: object | None = None) -> DataFrame:
    """The object ``of`` beside the others of its type, as ``other``; without one every object, which is quadratic in a type's size."""
    own = objects if of is None else objects.where(F.col(key) == of)
    return own.join(objects.select(F.col(key).alias("other"), F.col(kind)), kind).where(F.col(key) != F.col("other"))


def nearest(queries: DataFrame, points: DataFrame, *, query: str, point: str, coordinates: tuple[tuple[str, str], ...], cell: float, reach: float, least: float = 1e-4, crowd: int = 64) -> DataFrame:
    """Each query's nearest point, farther than ``least``: ``query``, ``point``, ``distance``.

    ``coordinates`` pairs a query's columns with a point's. The first two are cut
    into cells; a query looks into those that its reach touches. Queries that find none
    look again four times as far, until the points' whole extent has been seen. Ties go to the smaller point.

    Points at one place count once, as do queries. Where a cell holds more than ``crowd`` places, the first
    look is at smaller cells, so crowded regions are settled before wider looks. A row without finite coordinates takes no part.
    """
    if cell <= 0 or reach <= 0:
        raise ValueError("cell and reach must be positive")
    if any(name.startswith("__") for name in (query, point)):
        raise ValueError("names that begin with two underscores are taken")
    at = [f"__x{i}" for i in range(len(coordinates))]
    to = [f"__y{i}" for i in range(len(coordinates))]
    asked = queries.select(F.col(query).alias("__query"), *[F.col(q).cast("double").alias(n) for (q, _), n in zip(coordinates, at)]).where(_finite(at))
    places = points.select(F.col(point).alias("__point"), *[F.col(p).cast("double").alias(n) for (_, p), n in zip(coordinates, to)]).where(_finite(to))
    places = _cut(places.groupBy(*to).agg(F.min("__point").alias("__point")))
    sites = _cut(asked.select(*at).distinct())
    spans = [df.agg(*[f(c) for c in names for f in (F.min, F.max)]).first() for df, names in ((sites, at), (places, to))]
    if any(x is None for r in spans for x in r):
        extent = 0.0
    else:
        extent = sum((max(r[2 * i + 1] for r in spans) - min(r[2 * i] for r in spans)) ** 2 for i in range(len(at))) ** 0.5
    while cell > extent / (1 << 24) > 0:
        full = places.groupBy(*[_bucket(F.col(c), cell).alias(c) for c in to[:2]]).count().agg(F.max("count")).first()[0]
        if full <= crowd:
            break
        cell, reach = cell / 4, reach / 4
    left, n = sites, sites.count()
    found = None
    while n:
        now = _cut(_nearest_within(left, places, at, to, cell, reach, least))
        found = now if found is None else found.unionByName(now)
        n -= now.count()
        if reach >= extent:
            break
        left = left.join(now.select(*at), at, "left_anti")
        cell, reach = cell * 4, reach * 4
    if found is None:
        found = _nearest_within(sites, places, at, to, cell, reach, least)
    return asked.join(found, at).select(F.col("__query").alias(query), F.col("__point").alias(point), F.col("__distance").alias("distance"))


def _finite(names: list[str]) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.abs(F.col(n)) < float("inf"))
    return ok


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written once in the cluster's folder for checkpoints, so that what reads it does not start over."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="stereolith-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _nearest_within(sites: DataFrame, places: DataFrame, at: list[str], to: list[str], cell: float, reach: float, least: float) -> DataFrame:
    seen = sites
    for i, q in enumerate(at[:2]):
        seen = seen.withColumn(f"__c{i}", F.explode(F.sequence(_bucket(F.col(q) - reach, cell), _bucket(F.col(q) + reach, cell))))
    placed = places
    for i, p in enumerate(to[:2]):
        placed = placed.withColumn(f"__c{i}", _bucket(F.col(p), cell))
    cells = [f"__c{i}" for i in range(len(at[:2]))]
    square = sum(((F.col(q) - F.col(p)) ** 2 for q, p in zip(at[1:], to[1:])), (F.col(at[0]) - F.col(to[0])) ** 2)
    pairs = seen.join(placed, cells).withColumn("__distance", F.sqrt(square)).where((F.col("__distance") > least) & (F.col("__distance") <= reach))
    best = F.min(F.struct("__distance", "__point")).alias("m")
    return pairs.groupBy(*at).agg(best).select(*at, F.col("m.__point").alias("__point"), F.col("m.__distance").alias("__distance"))


def nearest_vector(vectors: DataFrame, queries: DataFrame, *, key: str, vector: str, least: float = 1e-4, block_bytes: int = 16 << 20) -> DataFrame:
    """Each query vector's nearest other vector: ``query``, ``key``, ``distance``. Exact, for a stated query set.

    Queries are sent to the executors in blocks of ``block_bytes``. A task keeps its best row for each query of a
    block, so what is shuffled has a row for each query and task, not for each pair. Ties go to the smaller key.
    Rows and queries whose key or vector is null, or whose vector holds a null or non-finite component, take no part.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame, name: str) -> DataFrame:
        cells = df.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("v"))
        return cells.where(F.col(name).isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    rows = sound(vectors, "key")
    schema = f"query {queries.schema[key].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, distance double"

    kinds = [to_arrow_type(df.schema[key].dataType) for df in (queries, vectors)] + [pa.float64()]

    def scan(ids: list, asked: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, asked))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = sent.value
            best: list[tuple[float, object] | None] = [None] * len(ids)
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.array(batch.column("key").to_pylist(), object)
                matrix = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
                for i, (own, q) in enumerate(zip(ids, asked)):
                    far = np.sqrt(((matrix - q) ** 2).sum(1))
                    far[(far <= least) | (keys == own)] = np.inf
                    low = far.min()
                    if np.isfinite(low) and (best[i] is None or low <= best[i][0]):
                        found = (float(low), min(keys[far == low]))
                        best[i] = found if best[i] is None else min(best[i], found)
            out = [(q, b[1], b[0]) for q, b in zip(ids, best) if b is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["query", key, "distance"])

        return rows.mapInArrow(run, schema)

    found, ids, held = [], [], []
    for row in sound(queries, "k").toLocalIterator():
        ids.append(row.k)
        held.append(row.v)
        if 8 * len(held) * len(row.v) >= block_bytes:
            found.append(scan(ids, np.array(held)))
            ids, held = [], []
    if held or not found:
        found.append(scan(ids, np.array(held)))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("query").agg(F.min(F.struct("distance", key)).alias("m")).select("query", F.col(f"m.{key}").alias(key), F.col("m.distance").alias("distance"))


def screen_point_of(points: DataFrame, screen_points: DataFrame, clip: object, *, point: str, clip_col: str, index: str) -> DataFrame:
    """Each point with its first screen point on a clip, or nulls."""
    first = Window.partitionBy(point).orderBy(index)
    own = screen_points.where(F.col(clip_col) == clip).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return points.join(own, point, "left")
