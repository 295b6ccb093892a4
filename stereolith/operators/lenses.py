"""Lenses as a table: each row's point goes through the lens of its own clip.

A lens is a struct ``cx, cy, k, p``: centre, radial and decentering coefficients, as
:func:`.plumblines.fit_lenses` gives them. Without a first coefficient nothing is
corrected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

STEPS = 8  # Newton steps, which double the right digits each


def with_lens(points: DataFrame, lenses: DataFrame, *, clip: str, name: str = "lens") -> DataFrame:
    """``points`` with their clip's lens, null where there is none."""
    own = lenses.groupBy(clip).agg(F.any_value(F.struct("cx", "cy", "k", "p")).alias(name))
    return points.join(own, clip, "left")


def _terms(lens: Column, x: Column, y: Column) -> dict[str, Column]:
    """The sums that a point's place and slopes are made of, about the lens's centre."""
    k = [F.coalesce(F.get(lens["k"], F.lit(i)), F.lit(0.0)) for i in range(7)]
    p = [F.coalesce(F.get(lens["p"], F.lit(i)), F.lit(0.0)) for i in range(4)]
    r2 = x * x + y * y
    radial, slope = F.lit(0.0), F.lit(0.0)
    for i in range(7, 0, -1):
        radial = (radial + k[i - 1]) * r2
        slope = slope * r2 + i * k[i - 1]
    return {"radial": radial, "slope": slope, "tail": 1 + (p[2] + p[3] * r2) * r2, "bow": p[2] + 2 * p[3] * r2, "a": p[0] * (r2 + 2 * x * x) + 2 * p[1] * x * y, "b": 2 * p[0] * x * y + p[1] * (r2 + 2 * y * y), "p1": p[0], "p2": p[1]}


def _corrects(lens: Column) -> Column:
    return F.coalesce(F.get(lens["k"], F.lit(0)), F.lit(0.0)) != 0


def undistorted(points: DataFrame, *, x: str, y: str, lens: str = "lens", out: tuple[str, str] = ("ideal_x", "ideal_y")) -> DataFrame:
    """Adds where an ideal lens would show each point."""
    c = F.col(lens)
    t = _terms(c, F.col(x) - c["cx"], F.col(y) - c["cy"])
    ux = F.col(x) + (F.col(x) - c["cx"]) * t["radial"] + t["a"] * t["tail"]
    uy = F.col(y) + (F.col(y) - c["cy"]) * t["radial"] + t["b"] * t["tail"]
    return points.withColumns({out[0]: F.when(_corrects(c), ux).otherwise(F.col(x)), out[1]: F.when(_corrects(c), uy).otherwise(F.col(y))})


def redistorted(points: DataFrame, *, x: str, y: str, lens: str = "lens", out: tuple[str, str] = ("screen_x", "screen_y"), steps: int = STEPS, residual: float = 1e-5) -> DataFrame:
    """Adds the screen point that :func:`undistorted` takes to each ideal point, by ``steps`` Newton steps from that point on.

    Null where the steps don't come within ``residual`` pixels, as happens far off the screen. The steps run on
    Arrow batches: as a column expression they would be copied by every filter that is pushed through them.
    """
    c = F.col(lens)

    @F.pandas_udf("struct<x double, y double>")
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        cells = rows.to_numpy(float).T
        at = newton(cells[0], cells[1], np.nan_to_num(cells[2:]), steps, residual)
        return pd.DataFrame({"x": at[0], "y": at[1]})

    # Coefficients as plain numbers: arrays would be unpacked row by row.
    coefficients = [F.coalesce(F.get(c[n], F.lit(i)), F.lit(0.0)).cast("double").alias(f"{n}{i}") for n, most in (("k", 7), ("p", 4)) for i in range(most)]
    given = F.struct((F.col(x) - c["cx"]).cast("double").alias("x"), (F.col(y) - c["cy"]).cast("double").alias("y"), *coefficients)
    found = shared.fresh(points.columns, "__found")
    bent = F.when(_corrects(c), solve(given))
    solved = points.withColumn(found, bent)
    shown = {o: F.when(_corrects(c), F.when(~F.isnan(F.col(found)[a]), F.col(found)[a] + c[m])).otherwise(F.col(i)) for o, a, m, i in zip(out, "xy", ("cx", "cy"), (x, y))}
    return solved.withColumns(shown).drop(found)


def newton(tx: np.ndarray, ty: np.ndarray, c: np.ndarray, steps: int, residual: float) -> tuple[np.ndarray, np.ndarray]:
    """The points that lenses (columns of ``c``: seven radial coefficients, four decentering ones) take to ``tx, ty``, all about their centres; NaN where the steps don't lead there."""

    used = max((i for i in range(1, 8) if c[i - 1].any()), default=0)  # radial coefficients up to the last that any lens has

    def terms(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        r2 = x * x + y * y
        radial, slope = np.zeros_like(r2), np.zeros_like(r2)
        for i in range(used, 0, -1):
            radial, slope = (radial + c[i - 1]) * r2, slope * r2 + i * c[i - 1]
        tail, bow = 1 + (c[9] + c[10] * r2) * r2, c[9] + 2 * c[10] * r2
        a, b = c[7] * (r2 + 2 * x * x) + 2 * c[8] * x * y, 2 * c[7] * x * y + c[8] * (r2 + 2 * y * y)
        return radial, slope, tail, bow, a, b, x + x * radial + a * tail - tx, y + y * radial + b * tail - ty

    x, y = tx.copy(), ty.copy()
    with np.errstate(all="ignore"):
        for _ in range(steps):
            radial, slope, tail, bow, a, b, ex, ey = terms(x, y)
            mixed = 2 * x * y * slope + 2 * (c[7] * y + c[8] * x) * tail
            xx = 1 + radial + 2 * x * x * slope + (6 * c[7] * x + 2 * c[8] * y) * tail + 2 * x * a * bow
            yy = 1 + radial + 2 * y * y * slope + (2 * c[7] * x + 6 * c[8] * y) * tail + 2 * y * b * bow
            xy, yx = mixed + 2 * y * a * bow, mixed + 2 * x * b * bow
            d = xx * yy - xy * yx
            x, y = x - (yy * ex - xy * ey) / d, y - (xx * ey - yx * ex) / d
        *_, ex, ey = terms(x, y)
        bad = ~(np.hypot(ex, ey) <= residual)
    return np.where(bad, np.nan, x), np.where(bad, np.nan, y)
