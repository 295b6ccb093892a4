"""Plumb lines from detected corners, and the lens that makes such lines straight.

A frame's corners are capped by a top-k in Spark, so a frame is a bounded group.
In it the lattice grows from corner to corner; neighbours are looked up in cells
of the size of the mean spacing, so that the work grows with the corners and not
with their square.

The lens fit never holds a clip in one task. A line's points are one row; each round
sums, by clip, the normal equations of all lines at the clip's present coefficients,
13 x 13 numbers for each batch, and all clips take their damped step together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import DEFAULTS
from . import shared

_SAME = 1e-4  # corners that are nearer than this are one


class Corners:
    """A frame's corners (n x 2) by cells."""

    def __init__(self, points: np.ndarray):
        self.points = points
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(2)
        self.cell = float(max(np.sqrt(max(spread[0], 1e-9) * max(spread[1], 1e-9) / max(1, len(points))), spread.max(initial=0.0) / max(1, len(points)), 1e-9))
        self.origin = tuple((points.min(0) if len(points) else np.zeros(2)).tolist())
        at = np.floor((points - self.origin) / self.cell).astype(np.int64)
        self.extent = at.max(0).tolist() if len(points) else [0, 0]
        self.places = [tuple(q) for q in points.tolist()]  # plain numbers: arrays of two take ten times as long
        self.cells: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(map(tuple, at.tolist())):
            self.cells.setdefault(key, []).append(i)

    def _ring(self, x: int, y: int, r: int) -> Iterator[tuple[int, int]]:
        """The cells at a distance of ``r`` cells that can hold a corner."""
        right, top = self.extent
        for i in range(max(0, x - r), min(right, x + r) + 1):
            if abs(i - x) == r:
                yield from ((i, j) for j in range(max(0, y - r), min(top, y + r) + 1))
            else:
                yield from ((i, j) for j in {y - r, y + r} if 0 <= j <= top)

    def nearest(self, p: np.ndarray, *, reach: float = np.inf, least: float = -1.0) -> tuple[int | None, float]:
        """The nearest corner that is farther than ``least`` and nearer than ``reach``, the first one of a tie, and its distance."""
        px, py = float(p[0]), float(p[1])
        right, top = self.extent
        if reach < self.cell:  # the few cells in reach, without rings
            (ox, oy), cell = self.origin, self.cell
            left, low = int((px - reach - ox) // cell), int((py - reach - oy) // cell)
            rightmost, upper = int((px + reach - ox) // cell), int((py + reach - oy) // cell)
            best, found = reach, None
            for i in range(max(left, 0), min(rightmost, right) + 1):
                for j in range(max(low, 0), min(upper, top) + 1):
                    for k in self.cells.get((i, j), ()):
                        qx, qy = self.places[k]
                        far = math.hypot(qx - px, qy - py)
                        if far > least and (far < best or (far == best and found is not None and k < found)):
                            best, found = far, k
            return found, best if found is not None else np.inf
        x, y = (math.floor((a - o) / self.cell) for a, o in zip((px, py), self.origin, strict=True))
        # From a place beside all cells the rings begin where they meet these.
        r = max(0, -x, x - right, -y, y - top)
        last = max(abs(x), abs(x - right), abs(y), abs(y - top))
        best, found = reach, None
        places, cells = self.places, self.cells
        while r <= last and (r - 1) * self.cell <= best:
            for key in self._ring(x, y, r):
                for i in cells.get(key, ()):
                    qx, qy = places[i]
                    far = math.hypot(qx - px, qy - py)
                    if far > least and (far < best or (far == best and found is not None and i < found)):
                        best, found = far, i
            r += 1
        return found, best if found is not None else np.inf


def grow_line(corners: Corners, first: int, second: int, *, tolerance: float = 0.3, margin: float = 4.0, size: tuple[float, float] = (np.inf, np.inf)) -> list[int]:
    """The corners of a chessboard line through two of them, in order.

    From two corners the next is expected a step on; the nearest one is taken if
    it lies within ``tolerance`` of a step, else one two steps on is tried, which
    jumps a missing corner. The line ends there, or ``margin`` pixels from the
    frame's edge, and then grows from its other end.
    """
    places = corners.places
    right, top = size[0] - margin, size[1] - margin
    line, taken = [first, second], {first, second}
    for _ in range(2):
        going = True
        while going:
            (ax, ay), (bx, by) = places[line[-2]], places[line[-1]]
            dx, dy = bx - ax, by - ay
            reach = tolerance * math.hypot(dx, dy)
            for jump in (1, 2):
                i, _ = corners.nearest((bx + jump * dx, by + jump * dy), reach=reach)
                going = i is not None and i not in taken and margin < places[i][0] < right and margin < places[i][1] < top
                if going:
                    line.append(i)
                    taken.add(i)
                    break
        line.reverse()
    return line


def crossing_lines(corners: Corners, line: list[int], **options) -> Iterator[list[int]]:
    """For each corner of a line, the line that leaves it at a right angle; of one that has no corner there, none of them is left but the corner."""
    points = corners.points
    for k, i in enumerate(line):
        way = points[line[0]] - points[line[1]] if k == 0 else points[i] - points[line[k - 1]]
        aside, _ = corners.nearest(points[i] + np.array([-way[1], way[0]]))
        yield grow_line(corners, i, aside, **options) if aside is not None and np.hypot(*(points[aside] - points[i])) > _SAME else [i]


def lattice(points: np.ndarray, *, seed: np.ndarray | None = None, least: int = DEFAULTS.least_line_corners, **options) -> list[list[int]]:
    """All lines of a chessboard's corners, each as indexes in order.

    The first line leads from the corner nearest to the centroid to the corner nearest to that,
    or through the corners nearest to the two points of ``seed``. Its crossing lines are found, and then those
    that cross the middle one of them, which are the first line's like. Lines of ``least`` corners or fewer are left out.
    """
    if len(points) < 2:
        return []
    corners = Corners(points)
    a, _ = corners.nearest(points.mean(0) if seed is None else seed[0])
    b, _ = corners.nearest(points[a], least=_SAME) if seed is None else corners.nearest(seed[1])
    if b is None or a == b:
        return []
    first = grow_line(corners, a, b, **options)
    across = list(crossing_lines(corners, first, **options))
    middle = across[len(first) // 2]
    along = list(crossing_lines(corners, middle, **options)) if len(middle) > 1 else []
    return [line for line in [*across, *along] if len(line) > least]


def strongest(corners: DataFrame, *, frame: str, x: str, y: str, quality: str | None = None, most: int | None = DEFAULTS.most_corners) -> DataFrame:
    """The corners that have a place, of each frame the ``most`` strongest: by descending ``quality``, then by place.

    Each task keeps its own ``most`` before anything is shuffled.
    """
    known = corners.where(F.col(frame).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    if most is None:
        return known
    by = Window.partitionBy(frame).orderBy(*([F.col(quality).desc_nulls_last()] if quality else []), x, y)
    place = shared.fresh(corners.columns, "__place")
    return known.withColumn(place, F.row_number().over(by)).where(F.col(place) <= most).drop(place)


def plumb_lines(
    corners: DataFrame,
    *,
    frame: str,
    x: str,
    y: str,
    quality: str | None = None,
    most: int | None = DEFAULTS.most_corners,
    seeds: DataFrame | None = None,
    tolerance: float = DEFAULTS.corner_tolerance,
    margin: float = DEFAULTS.corner_margin,
    least: int = DEFAULTS.least_line_corners,
    size: tuple[float, float] = (float("inf"), float("inf")),
) -> DataFrame:
    """The lines of each frame's chessboard: ``frame, line, index, x, y``, lines and places from 0.

    ``seeds`` has ``frame, ax, ay, bx, by`` for frames in which two points are
    given to start from, one row each; the others start by themselves. Rows without a frame or a place take no
    part, corners at one place are one, and a frame without lines gives no rows.
    """
    kept = strongest(corners, frame=frame, x=x, y=y, quality=quality, most=most).select(frame, F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    if seeds is None:
        rows = kept.withColumn("seed", F.lit(None).cast("array<double>"))
    else:
        given = seeds.groupBy(frame).agg(F.min(F.array(*[F.col(c).cast("double") for c in ("ax", "ay", "bx", "by")])).alias("seed"))
        rows = kept.join(given, frame, "left")
    kind = corners.schema[frame].dataType.simpleString()

    def run(own: pd.DataFrame) -> pd.DataFrame:
        given = own["seed"].iloc[0]
        points = np.unique(own[["px", "py"]].to_numpy(float), axis=0)  # by x, then y
        lines = lattice(points, seed=None if given is None else np.asarray(given).reshape(2, 2), least=least, tolerance=tolerance, margin=margin, size=size)
        sizes = [len(line) for line in lines]
        at = points[[j for line in lines for j in line]].reshape(-1, 2)
        number, index = np.repeat(np.arange(len(lines)), sizes), np.concatenate([np.arange(n) for n in (0, *sizes)])
        return pd.DataFrame({frame: own[frame].iloc[:1].repeat(len(at)).array, "line": number, "index": index, x: at[:, 0], y: at[:, 1]})

    return rows.groupBy(frame).applyInPandas(run, f"`{frame}` {kind}, line int, index int, `{x}` double, `{y}` double")


def grow_lines(corners: DataFrame, seeds: DataFrame, *, frame: str, x: str, y: str, tolerance: float = DEFAULTS.corner_tolerance, margin: float = DEFAULTS.corner_margin, least: int = DEFAULTS.least_line_corners, size: tuple[float, float] = (float("inf"), float("inf"))) -> DataFrame:
    """The lines that grow in each frame from pairs of corners ``(ax, ay), (bx, by)``: ``frame, line, index, x, y``.

    Lines of ``least`` corners or fewer are left out. Pairs are numbered by their place.
    """
    kind = corners.schema[frame].dataType.simpleString()

    def run(key, points: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(points[[x, y]].to_numpy(float), axis=0)
        index, out = Corners(p), []
        for number, s in enumerate(starts.sort_values(["ax", "ay", "bx", "by"]).itertuples()):
            a, b = (index.nearest(np.array(q))[0] for q in ((s.ax, s.ay), (s.bx, s.by)))
            grown = grow_line(index, a, b, tolerance=tolerance, margin=margin, size=size) if a is not None and a != b else []
            if len(grown) > least:
                out += [(key[0], number, i, *p[j]) for i, j in enumerate(grown)]
        return pd.DataFrame(out, columns=[frame, "line", "index", x, y])

    known = strongest(corners, frame=frame, x=x, y=y, most=None)
    return known.groupBy(frame).cogroup(seeds.groupBy(frame)).applyInPandas(run, f"`{frame}` {kind}, line int, index int, `{x}` double, `{y}` double")


def insert_lines(old: DataFrame, found: DataFrame, *, clip: str, line: str = "line") -> DataFrame:
    """``old`` with the lines of ``found`` after those that their clips have, numbered on without gaps."""
    last = old.groupBy(clip).agg(F.max(line).alias("__last"))
    by = Window.partitionBy(clip).orderBy(line)
    moved = found.withColumn("__n", F.dense_rank().over(by)).join(last, clip, "left")
    at = (F.coalesce(F.col("__last") + 1, F.lit(0)) + F.col("__n") - 1).cast(old.schema[line].dataType)
    return old.unionByName(moved.withColumn(line, at).select(*old.columns))


def append_points(points: DataFrame, new: DataFrame, *, line: tuple[str, ...], index: str = "index", order: str) -> DataFrame:
    """``points`` with those of ``new`` at their lines' ends, in the order of ``order``, numbered on; a line that is not there yet begins at 0."""
    last = points.groupBy(*line).agg(F.max(index).alias("__last"))
    added = new.withColumn("__n", F.row_number().over(Window.partitionBy(*line).orderBy(order))).join(last, list(line), "left")
    at = (F.coalesce("__last", F.lit(-1)) + F.col("__n")).cast(points.schema[index].dataType)
    return points.unionByName(added.withColumn(index, at).select(*points.columns))


# The lens that makes lines straight.

PARAMETERS = 13  # centre, seven radial coefficients, four decentering ones
_POINTS = 1 << 14  # points whose sums are computed at once, but for longer lines
_SUMS = PARAMETERS * PARAMETERS + PARAMETERS + 3  # normal matrix, gradient, cost, points, cost without a lens


def _bend(v: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where coefficients take points, both in units of half the frame."""
    x, y = x - v[0], y - v[1]
    r2 = x * x + y * y
    radial = np.zeros_like(r2)
    for k in v[8:1:-1]:
        radial = (radial + k) * r2
    tail = 1 + (v[11] + v[12] * r2) * r2
    return x + x * radial + (v[9] * (r2 + 2 * x * x) + 2 * v[10] * x * y) * tail + v[0], y + y * radial + (2 * v[9] * x * y + v[10] * (r2 + 2 * y * y)) * tail + v[1]


def _slopes(v: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The derivatives (13 x n) of :func:`_bend` along ``nx, ny`` by each coefficient."""
    out = np.empty((PARAMETERS, len(x)))
    x, y = x - v[0], y - v[1]
    r2 = x * x + y * y
    radial, slope = np.zeros_like(r2), np.zeros_like(r2)
    for i in range(7, 0, -1):
        radial, slope = (radial + v[i + 1]) * r2, slope * r2 + i * v[i + 1]
    tail, bow = 1 + (v[11] + v[12] * r2) * r2, v[11] + 2 * v[12] * r2
    both = 2 * x * y
    px, py = r2 + 2 * x * x, r2 + 2 * y * y
    a, b = v[9] * px + v[10] * both, v[9] * both + v[10] * py
    mixed = both * slope + 2 * (v[9] * y + v[10] * x) * tail
    xx, xy = radial + 2 * x * x * slope + (6 * v[9] * x + 2 * v[10] * y) * tail + 2 * x * a * bow, mixed + 2 * y * a * bow
    yx, yy = mixed + 2 * x * b * bow, radial + 2 * y * y * slope + (2 * v[9] * x + 6 * v[10] * y) * tail + 2 * y * b * bow
    out[0], out[1] = -(xx * nx + yx * ny), -(xy * nx + yy * ny)
    power = x * nx + y * ny
    for i in range(2, 9):
        power = power * r2
        out[i] = power
    out[9], out[10] = (px * nx + both * ny) * tail, (both * nx + py * ny) * tail
    out[11] = (a * nx + b * ny) * r2
    out[12] = out[11] * r2
    return out


def line_sums(trials: np.ndarray, owner: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The parts of lines in their clips' normal equations, summed by clip: a row for each row of ``trials``.

    ``trials`` has the coefficients of each clip and ``owner`` each line's clip, ascending; ``sizes`` are the lines'
    points, which ``x, y`` hold one line after another.
    """
    first = np.cumsum(sizes) - sizes
    line = np.repeat(np.arange(len(sizes)), sizes)
    v = np.ascontiguousarray(trials.T)[:, owner[line]]
    total = lambda c: np.add.reduceat(c, first, axis=-1)

    def centred(px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, ...]:
        px, py = px - (total(px) / sizes)[line], py - (total(py) / sizes)[line]
        return px, py, total(px * px), total(py * py), total(px * py)

    px, py, xx, yy, xy = centred(*_bend(v, x, y))
    angle = np.arctan2(2 * xy, xx - yy) / 2
    c, s = np.cos(angle)[line], np.sin(angle)[line]
    off, along = py * c - px * s, px * c + py * s
    slope = _slopes(v, x, y, -s, c)
    # The line follows its points: what moves or turns it is no error.
    slope -= (total(slope) / sizes)[:, line]
    slope -= (total(slope * along) / np.maximum(total(along * along), 1e-300))[:, line] * along
    _, _, xx, yy, xy = centred(x, y)
    plain = np.maximum(0.0, (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2)
    off2 = total(off * off)
    out = np.zeros((len(trials), _SUMS))
    square = PARAMETERS * PARAMETERS
    ends = np.searchsorted(owner[line], np.arange(len(trials) + 1))
    for i in range(len(trials)):
        part = slope[:, ends[i] : ends[i + 1]]
        out[i, :square] = (part @ part.T).ravel()
        out[i, square : square + PARAMETERS] = part @ off[ends[i] : ends[i + 1]]
    for k, value in enumerate((off2, sizes, plain)):
        out[:, square + PARAMETERS + k] = np.bincount(owner, value, len(trials))
    return out


def fit_lenses(points: DataFrame, *, clip: str, line: str, x: str, y: str, centre: tuple[float, float], scale: float | None = None, rounds: int = 60) -> DataFrame:
    """Each clip's lens from its plumb lines: ``clip, cx, cy, k, p, initial_rms, rms, reduction, rounds, points``.

    The sum over lines of squared distances from the best straight line is made least,
    from no distortion about ``centre`` on, by damped Gauss-Newton steps; ``scale``, half the
    frame's diagonal by default that of twice the centre, brings all coefficients near one. A step that makes a clip worse is
    undone and damped more; a clip whose cost no longer falls by a hundred-millionth is done and its lines
    are read no more. Rows without a place take no part, and neither do lines of two points or fewer, which are always straight; a
    clip without others gives no row.
    """
    spark = points.sparkSession
    half = scale or float(np.hypot(*centre))
    known = points.where(F.col(clip).isNotNull() & F.col(line).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    at = F.struct(((F.col(x) - centre[0]) / half).alias("x"), ((F.col(y) - centre[1]) / half).alias("y"))
    kind = points.schema[clip].dataType
    # A line has at most a frame's corners.
    lines = known.groupBy(F.col(clip).alias("clip"), F.col(line).alias("line")).agg(F.sort_array(F.collect_list(at)).alias("at")).where(F.size("at") > 2)
    lines = shared.written(lines.select("clip", F.col("at.x").alias("x"), F.col("at.y").alias("y")), "lines")
    state_schema = T.StructType(
        [T.StructField("clip", kind), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("best", "trial", "sums")], *[T.StructField(n, T.DoubleType()) for n in ("initial", "cost", "points", "damping")], T.StructField("rounds", T.IntegerType()), T.StructField("done", T.BooleanType())]
    )
    zero = F.array_repeat(F.lit(0.0), PARAMETERS)
    state = lines.select("clip").distinct().select("clip", zero.alias("best"), zero.alias("trial"), F.lit(None).cast("array<double>").alias("sums"), *[F.lit(None).cast("double").alias(n) for n in ("initial", "cost", "points")], F.lit(1e-3).alias("damping"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))
    state = shared.written(state, "state")
    sums = T.StructType([T.StructField("clip", kind), *[T.StructField(f"s{i}", T.DoubleType()) for i in range(_SUMS)]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("clip").dictionary_encode()
            owner = coded.indices.to_numpy()
            sizes = np.diff(batch.column("x").offsets.to_numpy())
            cut = np.searchsorted(np.cumsum(sizes), np.arange(_POINTS, sizes.sum(), _POINTS))
            # Slices of whole lines, so that what is computed for their points stays small.
            for part in np.split(np.arange(len(sizes)), np.unique(cut)):
                if not len(part):
                    continue
                rows = batch.slice(int(part[0]), len(part))
                order = np.argsort(owner[part], kind="stable")
                rows = rows.take(pa.array(order))
                clips, at, own = np.unique(owner[part][order], return_index=True, return_inverse=True)
                trials = rows.column("trial").flatten().to_numpy().reshape(-1, PARAMETERS)[at]
                cells = line_sums(trials, own, sizes[part][order], *[rows.column(c).flatten().to_numpy() for c in "xy"])
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(clips)), *[pa.array(c) for c in cells.T]], names=sums.names)

    def step(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                out.append(_step(row))
            yield pd.DataFrame(out, columns=state_schema.names)

    for turn in range(rounds):
        open_ = state.where(~F.col("done"))
        parts = lines.join(open_.select("clip", "trial"), "clip").mapInArrow(add, sums)
        new = parts.groupBy("clip").agg(F.array(*[F.sum(f"s{i}") for i in range(_SUMS)]).alias("new"))
        before, state = state, shared.written(state.join(new, "clip", "left").mapInPandas(step, state_schema), "state")
        shared.delete(before)
        if state.where(~F.col("done")).isEmpty():
            break
    v = [F.col("best")[i] for i in range(PARAMETERS)]
    k = F.array(*[v[i] * half ** (-2.0 * (i - 1)) for i in range(2, 9)])
    p = F.array(v[9] / half, v[10] / half, v[11] * half**-2.0, v[12] * half**-4.0)
    rms = lambda c: F.sqrt(F.col(c) / F.col("points")) * half
    fall = F.when(F.col("initial") > 0, (F.col("initial") - F.col("cost")) / F.col("initial")).otherwise(0.0)
    shared.delete(lines)
    return state.select(F.col("clip").alias(clip), (v[0] * half + centre[0]).alias("cx"), (v[1] * half + centre[1]).alias("cy"), k.alias("k"), p.alias("p"), rms("initial").alias("initial_rms"), rms("cost").alias("rms"), fall.alias("reduction"), "rounds", F.col("points").cast("long").alias("points"))


def _step(row) -> tuple:
    """A clip's state after the sums at its trial coefficients have come in."""
    if row.done:
        return tuple(row)[:-1]
    new = np.array(row.new)
    square = PARAMETERS * PARAMETERS
    cost, n, plain = new[square + PARAMETERS :]
    initial = plain if row.rounds == 0 else row.initial
    better = row.rounds == 0 or cost < row.cost
    best, sums, now, damping, done = row.best, row.sums, row.cost, row.damping, False
    if better:
        done = row.rounds > 0 and row.cost - cost <= 1e-8 * row.cost
        best, sums, now = row.trial, new.tolist(), float(cost)
        damping = damping if row.rounds == 0 else max(damping / 10, 1e-12)
    else:
        damping *= 10
        done = damping > 1e9
    have = np.array(sums)
    matrix, slope = have[:square].reshape(PARAMETERS, PARAMETERS), have[square : square + PARAMETERS]
    trial = np.array(best) - np.linalg.solve(matrix + damping * (np.diag(np.diag(matrix)) + 1e-9 * (1 + np.trace(matrix)) * np.eye(PARAMETERS)), slope)
    return row.clip, list(best), trial.tolist(), list(sums), float(initial), float(now), float(n), float(damping), int(row.rounds) + 1, bool(done or now <= 1e-24 * n)
