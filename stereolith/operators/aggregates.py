"""Sums over points, lines and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry


def count_related(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Each parent's number of children, 0 without any."""
    return parents.select(key).join(children.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def type_counts(events: DataFrame, kind: str) -> DataFrame:
    """Events by type name; nameless ones aren't counted."""
    return events.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def earliest(points: DataFrame, *, event: str, t: str, shown: Column) -> DataFrame:
    """The text of each event's earliest time, ``None`` if it has no time."""
    return points.groupBy(event).agg(F.coalesce(F.min_by(shown, t), F.lit("None")).alias("earliest"))


def centroid_scale(points: DataFrame, *, group: str, x: str, y: str) -> DataFrame:
    """Each group's centroid and the scale that brings the mean distance from it to the root of 2."""
    centre = points.groupBy(group).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    far = points.join(centre, group).groupBy(group).agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.avg(F.hypot(F.col(x) - F.col("cx"), F.col(y) - F.col("cy"))).alias("mean"))
    return far.select(group, "cx", "cy", (F.sqrt(F.lit(2.0)) / F.nullif("mean", F.lit(0.0))).alias("scale"))


def mean_distance(points: DataFrame, *, group: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """The mean distance between two positions of each point: pixel and world residuals."""
    return points.groupBy(group).agg(F.avg(F.hypot(F.col(a[0]) - F.col(b[0]), F.col(a[1]) - F.col(b[1]))).alias("residual"))


def line_residuals(points: DataFrame, *, line: tuple[str, ...], x: str, y: str) -> DataFrame:
    """Each line's number of points and least sum of squared distances from a straight line.

    One aggregate of central moments, which keep their digits.
    """
    moments = points.groupBy(*line).agg(F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"))
    n, zero = F.col("n"), F.lit(0.0)
    return moments.select(*line, "n", geometry.orthogonal_residual(n, zero, zero, n * F.col("xx"), n * F.col("yy"), n * F.col("xy")).alias("ssq"))


def distortion_quality(initial: Column, final: Column, n: Column) -> Column:
    """RMS per point of a fit, and by what fraction it reduced the sum of squares."""
    return F.struct(F.sqrt(final / n).alias("rms"), ((initial - final) / F.nullif(initial, F.lit(0.0))).alias("reduction"))


def meeting_points(lines: DataFrame, *, group: str, front: tuple[str, str, str], back: tuple[str, str, str], also: Sequence[Column] = ()) -> DataFrame:
    """The point nearest to all lines of each group of two or more: ``group, n, x, y, z`` and the aggregates ``also``.

    Sums the projections off each line's way, nine numbers for a group, and solves
    a 3x3 system; null where all lines are parallel.
    """
    f, b = tuple(F.col(c) for c in front), tuple(F.col(c) for c in back)
    way = geometry.subtract(b, f)
    length = F.nullif(geometry.norm(way), F.lit(0.0))
    unit = tuple(w / length for w in way)
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    off = {(i, j): (F.lit(1.0) if i == j else F.lit(0.0)) - unit[i] * unit[j] for i, j in pairs}
    moved = [sum((off[min(i, j), max(i, j)] * f[j] for j in range(1, 3)), off[0, i] * f[0]) for i in range(3)]
    sums = lines.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(off[p]).alias(f"__m{p[0]}{p[1]}") for p in pairs], *[F.sum(moved[i]).alias(f"__v{i}") for i in range(3)], *also)
    m = [F.col(f"__m{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)]
    x, y, z = geometry.solve3(m, tuple(F.col(f"__v{i}") for i in range(3)))
    return sums.where("n > 1").withColumns({"x": x, "y": y, "z": z}).drop(*[c for c in sums.columns if c.startswith("__")])


def meet_lines(lines: DataFrame, *, group: str, front: tuple[str, str, str], back: tuple[str, str, str]) -> DataFrame:
    """As :func:`meeting_points`, with the lines' mean distance from the point as ``pld``. Groups may be of any size."""
    f, b = tuple(F.col(c) for c in front), tuple(F.col(c) for c in back)
    meeting = meeting_points(lines, group=group, front=front, back=back)
    gap = geometry.to_line((F.col("x"), F.col("y"), F.col("z")), f, b)
    return lines.join(meeting, group).groupBy(group).agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in "xyz"], F.avg(gap).alias("pld"))


def nearest_camera(points: DataFrame, cameras: DataFrame, *, point: str, key: str) -> DataFrame:
    """Each point's least distance from the cameras of its ``key``; both have x, y, z (cameras: cx, cy, cz)."""
    far = geometry.distance(tuple(F.col(c) for c in "xyz"), tuple(F.col(f"c{c}") for c in "xyz"))
    return points.join(cameras, key).groupBy(point).agg(F.min(far).alias("camera_distance"))


def box(points: DataFrame, *, group: str, x: str, y: str) -> DataFrame:
    return points.groupBy(group).agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


def none_synced(clips: DataFrame, *, project: str, synced: str, is_master: str) -> DataFrame:
    """Whether no clip of a project but its master is locked to it."""
    return clips.groupBy(project).agg((~F.coalesce(F.bool_or(F.when(~F.col(is_master), F.col(synced))), F.lit(False))).alias("none_synced"))
