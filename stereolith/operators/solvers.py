"""Numerical solvers, the one part of the engine that runs in Python.

Each takes numpy arrays and is vectorized over points where it can be; the
DataFrame wrappers at the end run them by Arrow batches or by clip.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Distortion


def _shift(d: Distortion, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where undistorting takes coordinates about the centre."""
    r2 = x * x + y * y
    radial = np.zeros_like(r2)
    for k in reversed(d.k):
        radial = (radial + k) * r2
    p1, p2, p3, p4 = (*d.p, 0.0, 0.0, 0.0, 0.0)[:4]
    tail = 1 + (p3 + p4 * r2) * r2
    return x + x * radial + (p1 * (r2 + 2 * x * x) + 2 * p2 * x * y) * tail, y + y * radial + (2 * p1 * x * y + p2 * (r2 + 2 * y * y)) * tail


def undistort(d: Distortion, p: np.ndarray) -> np.ndarray:
    """Ideal positions of screen points (n x 2)."""
    if not d.available:
        return p.astype(float)
    centre = np.array([d.cx, d.cy])
    x, y = (p - centre).T
    return np.column_stack(_shift(d, x, y)) + centre


def redistort(d: Distortion, p: np.ndarray, *, rounds: int = 60, residual: float = 1e-10) -> np.ndarray:
    """The screen points that :func:`undistort` takes to ``p``, by damped Newton steps for all points at once; NaN where none is found."""
    if not d.available:
        return p.astype(float)
    centre = np.array([d.cx, d.cy])
    tx, ty = (p - centre).T
    x, y = tx.copy(), ty.copy()
    h = 1e-4
    fx, fy = _shift(d, x, y)
    for _ in range(rounds):
        ex, ey = fx - tx, fy - ty
        error = np.hypot(ex, ey)
        if np.all(error < residual):
            break
        ax, ay = _shift(d, x + h, y)
        bx, by = _shift(d, x - h, y)
        cx, cy = _shift(d, x, y + h)
        gx, gy = _shift(d, x, y - h)
        a, c, b, e = (ax - bx) / (2 * h), (ay - by) / (2 * h), (cx - gx) / (2 * h), (cy - gy) / (2 * h)
        det = a * e - b * c
        det = np.where(np.abs(det) < 1e-12, 1e-12, det)
        sx, sy = (e * ex - b * ey) / det, (a * ey - c * ex) / det
        scale = np.ones_like(x)
        for _ in range(8):
            nx, ny = x - scale * sx, y - scale * sy
            hx, hy = _shift(d, nx, ny)
            worse = np.hypot(hx - tx, hy - ty) > error
            if not worse.any():
                break
            scale = np.where(worse, scale / 2, scale)
        x, y, fx, fy = nx, ny, hx, hy
    bad = np.hypot(fx - tx, fy - ty) > 1e-5
    return np.where(bad[:, None], np.nan, np.column_stack([x, y]) + centre)


def homography(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """The 3x3 matrix from ``source`` to ``target`` (n x 2, n from 4 on), last cell positive, and the residual of the normalized system per point.

    Direct linear transform: both sides are moved to their centroid and scaled to a
    mean distance of the root of 2. The system is reduced to its triangular factor
    first, nine columns whatever the number of points; the last vector of the full right singular
    basis of that is taken, which four points need.
    """
    if len(source) < 4:
        raise ValueError("a homography needs four points")

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(0)
        s = np.sqrt(2) / np.mean(np.hypot(*(p - c).T))
        return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    (a, ta), (b, tb) = normal(source), normal(target)
    m, residual = _from_factors(stacked_factors(transform_rows(a, b), np.zeros(2 * len(a), int)), np.array([len(a)]), ta[None], tb[None])
    return m[0], float(residual[0])


def transform_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rows of the direct linear transform's system for normalized points, the horizontal ones of all points before the vertical ones."""
    one, zero = np.ones((len(a), 1)), np.zeros((len(a), 3))
    p = np.hstack([a, one])
    return np.vstack([np.hstack([p, zero, -b[:, :1] * p]), np.hstack([zero, p, -b[:, 1:] * p])])


def stacked_factors(rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The triangular factors (n x 9 x 9) of many systems at once; ``owner`` has each row's system, from 0 on without gaps.

    Systems of like size are filled up with rows of zeros, which leave a factor as it is.
    """
    sizes = np.bincount(owner)
    order = np.argsort(owner, kind="stable")
    place = np.arange(len(order)) - (np.cumsum(sizes) - sizes)[owner[order]]
    widths = 2 ** np.ceil(np.log2(np.maximum(sizes, 9))).astype(int)
    out = np.empty((len(sizes), 9, 9))
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        at = np.full(len(sizes), -1)
        at[own] = np.arange(len(own))
        mine = at[owner[order]] >= 0
        filled = np.zeros((len(own), width, 9))
        filled[at[owner[order[mine]]], place[mine]] = rows[order[mine]]
        out[own] = np.linalg.qr(filled, mode="r")
    return out


def _moves(scale: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The matrices (n x 3 x 3) that move points from a centroid and scale them."""
    m = np.zeros((len(scale), 3, 3))
    m[:, 0, 0] = m[:, 1, 1] = scale
    m[:, 0, 2], m[:, 1, 2], m[:, 2, 2] = -scale * x, -scale * y, 1
    return m


def _from_factors(factors: np.ndarray, n: np.ndarray, ta: np.ndarray, tb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices and residuals of many systems, each from its factor."""
    h = np.linalg.svd(factors, full_matrices=True)[2][:, 8]
    m = np.linalg.inv(tb) @ h.reshape(-1, 3, 3) @ ta
    m = m / np.linalg.norm(m, axis=(1, 2), keepdims=True) * np.where(m[:, 2:, 2:] >= 0, 1, -1)
    return m, np.linalg.norm((factors @ h[:, :, None])[:, :, 0], axis=1) / n


def apply_homography(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.hstack([p, np.ones((len(p), 1))]) @ m.T
    return q[:, :2] / q[:, 2:]


def meet(front: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, float]:
    """The point nearest to all lines (n x 3 each) and its mean distance from them."""
    way = back - front
    unit = way / np.linalg.norm(way, axis=1, keepdims=True)
    off = np.eye(3) - unit[:, :, None] * unit[:, None, :]
    x = np.linalg.solve(off.sum(0), (off @ front[:, :, None]).sum(0)[:, 0])
    return x, float(np.mean(np.linalg.norm(np.cross(x - front, unit), axis=1)))


def nelder_mead(cost: Callable[[np.ndarray], float], start: np.ndarray, steps: np.ndarray, *, size: float, most: int) -> tuple[np.ndarray, float, int]:
    """The downhill simplex: the best point, its cost and the rounds taken. Stops at a mean vertex distance under ``size``."""
    n = len(start)
    simplex = np.vstack([start, start + np.diag(steps)])
    values = np.array([cost(p) for p in simplex])
    for turn in range(1, most + 1):
        order = np.argsort(values, kind="stable")
        simplex, values = simplex[order], values[order]
        centre = simplex[:-1].mean(0)
        if np.mean(np.linalg.norm(simplex - simplex.mean(0), axis=1)) < size:
            return simplex[0], float(values[0]), turn
        mirrored = 2 * centre - simplex[-1]
        v = cost(mirrored)
        if v < values[0]:
            far = 3 * centre - 2 * simplex[-1]
            w = cost(far)
            simplex[-1], values[-1] = (far, w) if w < v else (mirrored, v)
        elif v < values[-2]:
            simplex[-1], values[-1] = mirrored, v
        else:
            toward = mirrored if v < values[-1] else simplex[-1]
            inner = (centre + toward) / 2
            w = cost(inner)
            if w < min(v, values[-1]):
                simplex[-1], values[-1] = inner, w
            else:
                simplex[1:] = (simplex[1:] + simplex[0]) / 2
                values[1:] = [cost(p) for p in simplex[1:]]
    best = int(np.argmin(values))
    return simplex[best], float(values[best]), most


def straightness(x: np.ndarray, y: np.ndarray, line: np.ndarray) -> float:
    """The sum over lines (numbered from 0) of the least squared distances from a straight line."""
    n = np.bincount(line).astype(float)
    n[n == 0] = 1
    dx, dy = x - (np.bincount(line, x) / n)[line], y - (np.bincount(line, y) / n)[line]
    xx, yy, xy = np.bincount(line, dx * dx), np.bincount(line, dy * dy), np.bincount(line, dx * dy)
    return float(np.sum((xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2))


#: Scales that bring the coefficients of a lens of about a thousand pixels near one; fixed values.
COEFFICIENT_SCALES = np.array([1.0, 1.0, 1e-8, 1e-14, 1e-20, 1e-26, 1e-32, 1e-38, 1e-44, 1e-6, 1e-6, 1e-8, 1e-14])


@dataclass(frozen=True)
class DistortionFit:
    distortion: Distortion
    initial: float
    final: float
    rounds: int
    points: int

    @property
    def rms(self) -> float:
        return float(np.sqrt(self.final / self.points))

    @property
    def reduction(self) -> float:
        return (self.initial - self.final) / self.initial if self.initial else 0.0


def fit_distortion(p: np.ndarray, line: np.ndarray, centre: tuple[float, float], *, most: int = 10_000, size: float = 1e-10) -> DistortionFit:
    """The coefficients that make plumb lines straightest, by downhill simplex from no distortion about the frame's centre."""
    line = np.unique(line, return_inverse=True)[1]

    def lens(v: np.ndarray) -> Distortion:
        c = v * COEFFICIENT_SCALES
        return Distortion(c[0], c[1], tuple(c[2:9]), tuple(c[9:13]))

    def cost(v: np.ndarray) -> float:
        d = lens(v)
        x, y = _shift(d, p[:, 0] - d.cx, p[:, 1] - d.cy)
        return straightness(x, y, line)

    start = np.array([*centre, *np.zeros(11)])
    best, value, rounds = nelder_mead(cost, start, np.array([25.0, 25.0, *np.full(11, 0.5)]), size=size, most=most)
    again, lower, more = nelder_mead(cost, best, np.array([5.0, 5.0, *np.full(11, 0.1)]), size=size, most=max(1, most - rounds))
    if lower < value:
        best, value = again, lower
    return DistortionFit(lens(best), cost(start), value, rounds + more, len(p))


def apparent_position(real: np.ndarray, camera: np.ndarray, front: float, thickness: float, n_medium: float, n_surface: float, back: float) -> np.ndarray:
    """Where back-plane points (n x 2: h, v) seem to lie behind a slab, seen from ``camera`` (h, v, depth).

    The surfaces are parallel, so a ray stays in the plane of the point, the camera
    and the normal, and ``n * sin`` is the same in every layer. Bisection finds it
    for all points at once. Equal indices leave the points where they are.
    """
    way = real - camera[:2]
    lateral = np.hypot(*way.T)
    outside, behind = abs(front - camera[2]), abs(back - front) - thickness
    low, high = np.zeros_like(lateral), np.full_like(lateral, min(n_medium, n_surface) * (1 - 1e-12))

    def tangent(s: np.ndarray, n: float) -> np.ndarray:
        return s / np.sqrt(n * n - s * s)

    for _ in range(100):
        s = (low + high) / 2
        short = (outside + behind) * tangent(s, n_medium) + thickness * tangent(s, n_surface) < lateral
        low, high = np.where(short, s, low), np.where(short, high, s)
    seen = tangent((low + high) / 2, n_medium) * (outside + abs(back - front))
    return camera[:2] + way * np.where(lateral > 0, seen / np.where(lateral > 0, lateral, 1), 1)[:, None]


@dataclass(frozen=True)
class Frame:
    """The calibration frame: its two planes' depth, and the slab in front if it refracts."""

    front: float
    back: float
    thickness: float = 0.0
    n_medium: float = 1.0
    n_surface: float = 1.0
    refracts: bool = False


def reproject(points: np.ndarray, camera: np.ndarray, to_screen: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Screen positions (n x 2) of points (n x 3: h, v, depth), each by its own camera, front-plane-to-screen matrix and front depth."""
    t = (depth - camera[:, 2]) / (points[:, 2] - camera[:, 2])
    h = camera[:, :2] + t[:, None] * (points[:, :2] - camera[:, :2])
    q = np.einsum("nij,nj->ni", to_screen, np.column_stack([h, np.ones(len(h))]))
    return q[:, :2] / q[:, 2:]


def triangulate(start: np.ndarray, owner: np.ndarray, screen: np.ndarray, camera: np.ndarray, to_screen: np.ndarray, depth: np.ndarray, *, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Points with the least squared reprojection error, and its root mean square per view.

    ``start`` (n x 3) are linear solutions, the other arrays have a row for each view
    and ``owner`` says of which point. Damped Gauss-Newton steps for all points at
    once; a step that makes a point worse is undone and damped more, and a point whose
    step no longer matters is left alone.
    """
    x = start.copy()
    n = len(x)
    views = np.bincount(owner, minlength=n)
    damping = np.full(n, 1e-3)
    cost = np.full(n, np.nan)
    going, of = np.arange(n), owner  # the points not settled yet, and whose each of their views is
    for turn in range(rounds):
        own = x[going]
        m = len(going)

        def errors(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            e = reproject(at[of], camera, to_screen, depth) - screen
            return e, np.bincount(of, (e**2).sum(1), m)

        e, value = errors(own)
        if not turn:
            cost[:] = value
        scale = 1e-6 * np.maximum(1, np.abs(own).max(1, initial=0))
        slopes = np.empty((len(of), 2, 3))
        for k in range(3):
            moved = own.copy()
            moved[:, k] += scale
            slopes[:, :, k] = (errors(moved)[0] - e) / scale[of][:, None]
        gram, grad = np.empty((m, 3, 3)), np.empty((m, 3))
        for i in range(3):
            grad[:, i] = np.bincount(of, (slopes[:, :, i] * e).sum(1), m)
            for j in range(i, 3):
                gram[:, i, j] = gram[:, j, i] = np.bincount(of, (slopes[:, :, i] * slopes[:, :, j]).sum(1), m)
        heavier = gram + damping[going, None, None] * (np.einsum("nii->ni", gram)[:, :, None] * np.eye(3) + 1e-12 * np.eye(3))
        step = np.linalg.solve(heavier, grad[:, :, None])[:, :, 0]
        new_value = errors(own - step)[1]
        better = new_value < value
        x[going[better]] -= step[better]
        cost[going] = np.where(better, new_value, value)
        damping[going] = np.where(better, damping[going] / 10, damping[going] * 10)
        small = np.abs(step).max(1, initial=0) <= 1e-12 * (1 + np.abs(own).max(1, initial=0))
        on = ~(small | (~better & (damping[going] > 1e6)) | np.isnan(value))
        if not on.any():
            break
        if not on.all():
            rows = on[of]
            of = (np.cumsum(on) - 1)[of[rows]]
            going, screen, camera, to_screen, depth = going[on], screen[rows], camera[rows], to_screen[rows], depth[rows]
    return x, np.sqrt(cost / views)


# DataFrame wrappers.


def homographies(points: DataFrame, *, group: str, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
    """A matrix for each clip and plane with four points at least: ``group``, ``matrix``, ``residual``.

    Centroids and scales are aggregates. Each batch of points then gives the
    triangular factor of its part of a group's system, and only these 9 x 9 factors come together, so
    a group may have any number of points.
    """
    named = points.select(F.col(group).alias("g"), *[F.col(c).cast("double").alias(n) for n, c in zip(("ax", "ay", "bx", "by"), (*source, *target))])
    centre = named.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("ax", "ay", "bx", "by")]).where("n >= 4")
    far = [F.avg(F.hypot(F.col(f"{s}x") - F.col(f"m{s}x"), F.col(f"{s}y") - F.col(f"m{s}y"))) for s in "ab"]
    keep = ["n", "max", "may", "mbx", "mby"]
    scaled = named.join(centre, "g").groupBy("g").agg(*[F.first(c).alias(c) for c in keep], *[(F.sqrt(F.lit(2.0)) / x).alias(f"s{s}") for s, x in zip("ab", far)])
    keep += ["sa", "sb"]
    kind = points.schema[group].dataType.simpleString()

    def factors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            owner = pd.factorize(frame["g"])[0]
            ones = frame.loc[~pd.Series(owner, frame.index).duplicated(), ["g", *keep]]
            a, b = ((frame[[f"{s}x", f"{s}y"]].to_numpy() - frame[[f"m{s}x", f"m{s}y"]].to_numpy()) * frame[[f"s{s}"]].to_numpy() for s in "ab")
            yield ones.assign(factor=list(stacked_factors(transform_rows(a, b), np.concatenate([owner, owner])).reshape(len(ones), 81)))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [np.concatenate(f).reshape(-1, 9) for f in frame["factors"]]
            if not parts:
                continue
            whole = stacked_factors(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
            of = {c: frame[c].to_numpy(float) for c in keep}
            m, r = _from_factors(whole, of["n"], _moves(of["sa"], of["max"], of["may"]), _moves(of["sb"], of["mbx"], of["mby"]))
            yield pd.DataFrame({group: frame["g"], "matrix": m.tolist(), "residual": r})

    parts = named.join(scaled, "g").mapInPandas(factors, f"g {kind}, n long, {', '.join(f'{c} double' for c in keep[1:])}, factor array<double>")
    whole = parts.groupBy("g").agg(*[F.first(c).alias(c) for c in keep], F.collect_list("factor").alias("factors"))
    return whole.mapInPandas(merge, f"`{group}` {kind}, matrix array<array<double>>, residual double")


#: What a view of a point has: where it was clicked, the camera, the front plane's projection by rows and its depth.
VIEW = ("screen_x", "screen_y", "camera_h", "camera_v", "camera_d", "to_screen", "front_depth")


def triangulate_points(views: DataFrame, *, point: str) -> DataFrame:
    """3-D points from their views: ``point``, ``h``, ``v``, ``depth``, ``rms``.

    ``views`` has a row for each calibrated view: ``point``, a linear solution
    ``h0, v0, d0`` of the point, and :data:`VIEW`.
    Points with under two views are left out. A point's views come together in one row.
    """
    rows = views.groupBy(point).agg(*[F.first(c).alias(c) for c in ("h0", "v0", "d0")], F.sort_array(F.collect_list(F.struct(*VIEW))).alias("views")).where(F.size("views") >= 2)
    return triangulate_rows(rows).select(point, "h", "v", "depth", "rms")


def triangulate_rows(rows: DataFrame) -> DataFrame:
    """Adds ``h``, ``v``, ``depth`` and ``rms`` to rows that have a linear solution ``h0, v0, d0`` and an array ``views`` of :data:`VIEW`.

    ``views`` and the linear solution are dropped. Batches of points are solved at once.
    """
    width = len(VIEW) + 8
    flat = F.flatten(F.transform("views", lambda v: F.concat(*[v[c] if c == "to_screen" else F.array(v[c]) for c in VIEW])))
    kept = [c for c in rows.columns if c not in ("h0", "v0", "d0", "views")]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} double" for c in ("h", "v", "depth", "rms")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column("__flat").offsets.to_numpy()) // width
            one = batch.column("__flat").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            start = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("h0", "v0", "d0")])
            x, rms = triangulate(start, np.repeat(np.arange(len(sizes)), sizes), one[:, :2], one[:, 2:5], one[:, 5:14].reshape(-1, 3, 3), one[:, 14])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(c) for c in (*x.T, rms)], names=[*kept, "h", "v", "depth", "rms"])

    return rows.select(*kept, "h0", "v0", "d0", flat.alias("__flat")).mapInArrow(run, schema)
