"""Operators over points in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, timecode
from . import shared


def segments(points: DataFrame, *, event: str, order: tuple[str, ...], coordinates: tuple[str, ...], t: str) -> DataFrame:
    """Length and speed from each point of an event to the next: adds ``length`` and ``speed``.

    The point before is the one before in order, even if it has no coordinates;
    pairs that lack some on either side are left out then. Speed is null where no
    time passes.
    """
    by = Window.partitionBy(event).orderBy(*order)
    moved = points.select("*", *[F.lag(c).over(by).alias(f"__{c}") for c in (*coordinates, t)])
    length = geometry.distance(tuple(F.col(c) for c in coordinates), tuple(F.col(f"__{c}") for c in coordinates))
    passed = F.abs(F.col(t) - F.col(f"__{t}"))
    out = moved.withColumn("length", length).withColumn("speed", F.when(passed != 0, F.col("length") / passed))
    return out.where(F.col("length").isNotNull()).drop(*[f"__{c}" for c in (*coordinates, t)])


def next_index(points: DataFrame, *, group: str, index: str) -> DataFrame:
    """The index that a new point of each group gets."""
    return points.groupBy(group).agg((F.coalesce(F.max(index), F.lit(0)) + 1).alias("next_index"))


def roll_over(points: DataFrame, *, event: str, order: tuple[str, ...], most: int) -> DataFrame:
    """Adds ``part`` and ``index``: a new event begins when one holds ``most`` points; 0 means never."""
    n = F.row_number().over(Window.partitionBy(event).orderBy(*order)) - 1
    if most <= 0:
        return points.withColumn("part", F.lit(0)).withColumn("index", n + 1)
    return points.withColumn("__n", n).withColumn("part", F.floor(F.col("__n") / most).cast("int")).withColumn("index", F.col("__n") % most + 1).drop("__n")


def roll_over_by_time(points: DataFrame, *, event: str, t: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``part``: a new event begins when a point's time differs from that of the event so far; points come by ``order``, or else by time."""
    return roll_over_both(points, event=event, order=order or (t,), most=0, t=t).drop("index")


def roll_over_both(points: DataFrame, *, event: str, order: tuple[str, ...], most: int, t: str, tolerance: float = timecode.SAME_FRAME) -> DataFrame:
    """Adds ``part`` and ``index``: in the order of clicks a new event begins when one holds ``most`` points (0: never) or the time changes.

    A click has an event's time if it is less than ``tolerance`` from the event's first. A gap
    of twice that to the click before always begins a new event, so clicks are cut there into
    runs that are placed by themselves. A run within the tolerance needs its clicks' numbers alone; only one that
    drifts, with steps under twice the tolerance each, is folded click by click. A null time is a run of its own.
    """
    by = Window.partitionBy(event).orderBy(*order)
    gap = F.abs(F.col(t) - F.lag(t).over(by))
    cut = F.coalesce(gap >= 2 * tolerance, F.lit(True)).cast("int")
    runs = points.withColumn("__cut", cut).withColumn("__run", F.sum("__cut").over(by))
    own = Window.partitionBy(event, "__run")
    runs = runs.withColumn("__n", F.row_number().over(own.orderBy(*order))).withColumn("__drifts", F.coalesce(F.max(t).over(own) - F.min(t).over(own) >= tolerance, F.lit(False)))
    n = F.col("__n") - 1
    numbered = runs.withColumn("index", ((n % most if most > 0 else n) + 1).cast("int"))
    drifting = numbered.where("__drifts").repartition(event, "__run").sortWithinPartitions(event, "__run", "__n")
    at = [numbered.columns.index(c) for c in ("__n", t, "index")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = 0
        for batch in batches:
            found = []
            for place, when in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).cast(pa.float64()).to_pylist(), strict=True):
                if place == 1 or held == most > 0 or abs(when - first) >= tolerance:
                    first, held = when, 0
                held += 1
                found.append(held)
            columns = list(batch.columns)
            columns[at[2]] = pa.array(found, pa.int32())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    both = numbered.where("not __drifts").unionByName(drifting.mapInArrow(fold, numbered.schema))
    opened = F.sum((F.col("index") == 1).cast("int")).over(Window.partitionBy(event).orderBy("__run", "__n"))
    return both.withColumn("part", (opened - 1).cast("int")).drop("__cut", "__run", "__n", "__drifts")


def placed(rows: DataFrame, *, first: str, rest: tuple[str, ...], name: str = "place") -> DataFrame:
    """Adds each row's place from 1 in the order of ``first`` and then ``rest``, nulls first.

    Rows are dealt by ranges of the whole order, sorted and written down; each range numbers its own, and only
    the ranges' counts, one row for each part, are summed in one task.
    """
    number = shared.fresh(rows.columns, "__number")
    dealt = rows.repartitionByRange(first, *rest).sortWithinPartitions(first, *rest)
    # The high bits are the part, the low 33 the row's number in it.
    kept = shared.written(dealt.withColumn(number, F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned(F.col(number), 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__c"))
    starts = counts.select("__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    place = (F.col("__start") + F.col(number).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name)
    return kept.join(starts, part == F.col("__part")).select(*rows.columns, place)


def lowest_without(points: DataFrame, screen_points: DataFrame, *, point: str, event: str, index: str, clip_col: str, clip: object, near: Column, shown: str | None = None) -> DataFrame:
    """Each event's lowest point for which ``near`` holds and that lacks a screen point on ``clip``, or its ``shown`` column."""
    taken = screen_points.where(F.col(clip_col) == clip).select(point).distinct()
    return points.where(near).join(taken, point, "left_anti").groupBy(event).agg(F.min_by(shown or point, index).alias(shown or point))


def tip_to_tip(points: DataFrame, *, line: str, order: str, x: str, y: str) -> DataFrame:
    """The first and last point of each ordered line, and the distance between them."""
    at = F.struct(x, y)
    ends = points.groupBy(line).agg(F.min_by(at, order).alias("a"), F.max_by(at, order).alias("b"))
    return ends.select(line, *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in (x, y)]).withColumn("tip_distance", F.hypot(F.col(f"b_{x}") - F.col(f"a_{x}"), F.col(f"b_{y}") - F.col(f"a_{y}")))


def grid_spacing(points: DataFrame, *, group: str, axes: tuple[str, ...]) -> DataFrame:
    """The least over the axes of the gap between the two lowest distinct values; null with fewer than two."""
    lowest = points.groupBy(group).agg(*[F.min(a).alias(f"__{a}") for a in axes])
    above = points.join(lowest, group).groupBy(group).agg(*[(F.min(F.when(F.col(a) > F.col(f"__{a}"), F.col(a))) - F.first(f"__{a}")).alias(f"__{a}") for a in axes])
    return above.select(group, F.least(*[F.col(f"__{a}") for a in axes]).alias("spacing"))


def first_range(items: DataFrame, *, group: str, width: int = 1 << 16) -> DataFrame:
    """Where each group's items begin in the list of all, and how many they are; ``group`` is a number.

    Groups are summed in ranges of ``width`` numbers, and only the ranges' sums in one task.
    """
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("length")).withColumn("__range", F.floor(F.col(group) / width))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("__range").agg(F.sum("length").alias("__sum")).select("__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    before = Window.partitionBy("__range").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("__inside", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return inside.join(ranges, "__range").select(group, (F.col("__start") + F.col("__inside")).alias("start"), "length")
