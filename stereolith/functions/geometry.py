"""Geometry as column expressions: everything here stays in whole-stage codegen, but for the rays that refract, which are bisected in Arrow batches.

Points are pairs or triples of columns. A 3x3 matrix is nine numbers by rows, of
columns or constants; a line in space is the point on the front plane and the
point on the back plane.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def subtract(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return reduce(add, (x * y for x, y in zip(a, b, strict=True)))


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def distance(a: Vector, b: Vector) -> Column:
    return norm(subtract(a, b))


def determinant(m: Sequence[Column]) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Sequence[Column]) -> tuple[Column, ...]:
    """The adjugate over the determinant; null for a singular matrix."""
    d = F.nullif(determinant(m), F.lit(0.0))
    cells = (
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    )
    return tuple(c / d for c in cells)


def multiply(a: Sequence[Column], b: Sequence[Column], *, transpose_a: bool = False, transpose_b: bool = False) -> tuple[Column, ...]:
    at = (lambda i, k: a[3 * k + i]) if transpose_a else (lambda i, k: a[3 * i + k])
    of = (lambda k, j: b[3 * j + k]) if transpose_b else (lambda k, j: b[3 * k + j])
    return tuple(reduce(add, (at(i, k) * of(k, j) for k in range(3))) for i in range(3) for j in range(3))


def nested(cells: Sequence[Column]) -> Column:
    """Nine cells as an array of rows."""
    return F.array(*[F.array(*cells[3 * i : 3 * i + 3]) for i in range(3)])


def project(m: Sequence[Column], p: Vector) -> Vector:
    """A homography of the plane; null where the image is at infinity."""
    w = F.nullif(m[6] * p[0] + m[7] * p[1] + m[8], F.lit(0.0))
    return ((m[0] * p[0] + m[1] * p[1] + m[2]) / w, (m[3] * p[0] + m[4] * p[1] + m[5]) / w)


@dataclass(frozen=True)
class Distortion:
    """A centre, radial coefficients k1 to k7 of even powers, and decentering ones p1 to p4."""

    cx: float
    cy: float
    k: tuple[float, ...] = ()
    p: tuple[float, ...] = ()

    @property
    def available(self) -> bool:
        """Without a first coefficient nothing is corrected."""
        return bool(self.k) and self.k[0] != 0


def undistort(d: Distortion, p: Vector) -> Vector:
    """A screen point as an ideal lens would show it."""
    if not d.available:
        return p
    x, y = p[0] - d.cx, p[1] - d.cy
    r2 = x * x + y * y
    radial = F.lit(0.0)
    for k in reversed(d.k):
        radial = (radial + k) * r2
    q = (*d.p, 0.0, 0.0, 0.0, 0.0)[:4]
    tail = 1 + (q[2] + q[3] * r2) * r2
    return (
        p[0] + x * radial + (q[0] * (r2 + 2 * x * x) + 2 * q[1] * x * y) * tail,
        p[1] + y * radial + (2 * q[0] * x * y + q[1] * (r2 + 2 * y * y)) * tail,
    )


#: Which of x, y, z the frame's horizontal, vertical and depth axes are.
AXES = {"x,y": "xyz", "x,z": "xzy", "y,x": "yxz", "y,z": "yzx", "z,x": "zxy", "z,y": "zyx"}


def depth_axis(horizontal: Column, vertical: Column) -> Column:
    """The axis that is left; null if the two aren't different axes."""
    pair = F.concat(F.lower(horizontal), F.lit(","), F.lower(vertical))
    found = F.lit(None).cast("string")
    for axes, order in AXES.items():
        found = F.when(pair == axes, order[2]).otherwise(found)
    return found


def to_space(axes: str, h: Column, v: Column, plane: Column) -> Vector:
    """Frame coordinates as x, y, z."""
    at = dict(zip(AXES[axes], (h, v, plane), strict=True))
    return (at["x"], at["y"], at["z"])


def to_frame(axes: str, p: Vector) -> Vector:
    """x, y, z as horizontal, vertical and depth."""
    at = dict(zip("xyz", p, strict=True))
    return tuple(at[a] for a in AXES[axes])


def on_plane(front: Vector, back: Vector, depth: Column, axis: int = 2) -> Vector:
    """Where a line meets the plane at ``depth`` along an axis; null if it runs beside it."""
    t = (depth - front[axis]) / F.nullif(back[axis] - front[axis], F.lit(0.0))
    return tuple(f + t * (b - f) for f, b in zip(front, back, strict=True))


def to_line(p: Vector, front: Vector, back: Vector) -> Column:
    """A point's distance from a line; rounding can't make it the root of a negative."""
    way, off = subtract(back, front), subtract(p, front)
    return F.sqrt(F.greatest(F.lit(0.0), dot(off, off) - dot(off, way) * dot(off, way) / F.nullif(dot(way, way), F.lit(0.0))))


def _bisected(lateral: np.ndarray, outside: np.ndarray, behind: float, thickness: float, n_medium: float, n_surface: float, steps: int) -> np.ndarray:
    """The ``n * sin`` of each ray that gets ``lateral`` aside."""
    low, high = np.zeros_like(lateral), np.full_like(lateral, min(n_medium, n_surface) * (1 - 1e-12))
    for _ in range(steps):
        middle = (low + high) / 2
        square = middle * middle
        short = (outside + behind) * (middle / np.sqrt(n_medium * n_medium - square)) + thickness * (middle / np.sqrt(n_surface * n_surface - square)) < lateral
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    return (low + high) / 2


def apparent_position(real: Vector, camera: Vector, *, front: float, back: float, thickness: float, n_medium: float, n_surface: float, steps: int = 60) -> Vector:
    """Where a point on the back plane seems to lie behind a slab, seen from ``camera`` (h, v, depth).

    The surfaces are parallel, so a ray stays in the plane of the point, the camera
    and the normal, and ``n * sin`` is the same in every layer: ``steps`` bisections find
    it. Equal indices leave the point where it is. The halving runs on Arrow batches: as a fold over a sequence it
    is interpreted, a millisecond for each point.
    """
    way = subtract(real, camera[:2])
    lateral = F.hypot(*way)
    outside, behind = F.abs(front - camera[2]), abs(back - front) - thickness

    @F.pandas_udf("double")
    def sine(aside: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series(_bisected(aside.to_numpy(float), before.to_numpy(float), behind, thickness, n_medium, n_surface, steps))

    def tangent(s: Column, n: float) -> Column:
        return s / F.sqrt(n * n - s * s)

    found = sine(lateral.cast("double"), outside.cast("double"))
    scale = F.when(lateral > 0, tangent(found, n_medium) * (outside + abs(back - front)) / lateral).otherwise(1.0)
    return tuple(c + w * scale for c, w in zip(camera[:2], way, strict=True))


def orthogonal_residual(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """The least sum of squared distances of points from any line, from their moments."""
    xx, yy, xy = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    return F.greatest(F.lit(0.0), (xx + yy - F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2)


def solve3(m: Sequence[Column], v: Vector) -> Vector:
    """The solution of a 3x3 system; null if it is singular."""
    inv = inverse(m)
    return tuple(dot(tuple(inv[3 * i : 3 * i + 3]), v) for i in range(3))


def extend_to_frame(a: Vector, b: Vector, width: Column, height: Column) -> Column:
    """The two points in which a line crosses a frame's edges, by x then y; null unless it crosses twice."""
    dx, dy = b[0] - a[0], b[1] - a[1]

    def at(t: Column) -> Column:
        return F.struct(F.round(a[0] + t * dx, 9).alias("x"), F.round(a[1] + t * dy, 9).alias("y"))

    ts = [(edge - a[0]) / F.nullif(dx, F.lit(0.0)) for edge in (F.lit(0.0), width)] + [(edge - a[1]) / F.nullif(dy, F.lit(0.0)) for edge in (F.lit(0.0), height)]
    points = F.array_distinct(F.filter(F.array(*[F.when(t.isNotNull(), at(t)) for t in ts]), lambda p: p.isNotNull() & p["x"].between(0, width) & p["y"].between(0, height)))
    return F.when(F.size(points) == 2, F.array_sort(points))


def to_overlay(p: Vector, video: Vector, overlay: Vector) -> Vector:
    """Video coordinates on an overlay of another size."""
    return tuple(x * o / v for x, v, o in zip(p, video, overlay, strict=True))


def rectangle(ax: Column, ay: Column, bx: Column, by: Column, height: Column) -> Column:
    """The rectangle of two corners, with the y axis turned over."""
    return F.struct(F.least(ax, bx).alias("x"), (height - F.greatest(ay, by)).alias("y"), F.abs(bx - ax).alias("width"), F.abs(by - ay).alias("height"))


def label_angle(dx: Column, dy: Column) -> Column:
    """The angle, in degrees, at which a label along a line isn't upside down."""
    return F.when(dx == 0, F.lit(90.0)).otherwise(F.degrees(F.atan(dy / F.nullif(dx, F.lit(0.0)))))


def plane_points(axes: str, depth: Column) -> tuple[Vector, Vector, Vector]:
    """Three points that span the plane at ``depth``: its origin and a step along each of its axes, z first where it has that, else x."""
    zero, one = F.lit(0.0), F.lit(1.0)
    first = "z" if "z" in AXES[axes][:2] else "x"
    steps = ((one, zero), (zero, one)) if AXES[axes][0] == first else ((zero, one), (one, zero))
    return tuple(to_space(axes, h, v, depth) for h, v in ((zero, zero), *steps))


def line_samples(a: Vector, b: Vector, width: float, height: float, step: float, pad: float = 0.0) -> Column:
    """Samples of the line through two screen points, every ``step`` in x and every ``step`` in y, inside the padded frame.

    An array of ``struct<x, y>`` by descending x (then y). An upright line has only the samples in y, a level one only
    those in x; a line without direction has none.
    """
    dx, dy = b[0] - a[0], b[1] - a[1]

    def along(size: float, start: Column, way: Column) -> Column:
        count = int((size + 2 * pad) // step)
        return F.when(way != 0, F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: (F.lit(-pad) + i * F.lit(step) - start) / way)).otherwise(F.array().cast("array<double>"))

    places = F.transform(F.concat(along(width, a[0], dx), along(height, a[1], dy)), lambda t: F.struct((a[0] + t * dx).alias("x"), (a[1] + t * dy).alias("y")))
    inside = F.filter(places, lambda p: p["x"].between(-pad - 1e-9, width + pad + 1e-9) & p["y"].between(-pad - 1e-9, height + pad + 1e-9))
    return F.reverse(F.array_sort(inside))
