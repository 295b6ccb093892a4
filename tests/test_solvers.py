"""Solvers against known truth: synthetic cameras, round trips and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolith.functions import geometry
from stereolith.functions.geometry import Distortion
from stereolith.operators import lenses, plumblines, solvers

LENS = Distortion(960.0, 540.0, (5e-8, 1e-14), (1e-6, -2e-6))


def test_redistort_undoes_undistort():
    p = np.random.default_rng(0).uniform([0, 0], [1920, 1080], (500, 2))
    assert np.allclose(solvers.redistort(LENS, solvers.undistort(LENS, p)), p, atol=1e-6)


def test_no_distortion_is_the_identity():
    p = np.array([[3.0, 4.0]])
    assert (solvers.undistort(Distortion(0, 0), p) == p).all() and (solvers.redistort(Distortion(0, 0), p) == p).all()


@pytest.mark.parametrize("n", [4, 5, 30])
def test_homography_from_four_points_on(n):
    m = np.array([[1.1, 0.02, 3], [-0.03, 0.9, 5], [1e-4, 2e-4, 1]])
    p = np.random.default_rng(n).uniform(0, 500, (n, 2))
    found, residual = solvers.homography(p, solvers.apply_homography(m, p))
    assert np.allclose(found / found[2, 2], m, atol=1e-6) and residual < 1e-9
    with pytest.raises(ValueError):
        solvers.homography(p[:3], p[:3])


def test_meet_moves_with_its_lines():
    rng = np.random.default_rng(1)
    front, back = rng.normal(size=(5, 3)), rng.normal(size=(5, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    x, pld = solvers.meet(front, back)
    y, moved = solvers.meet(front @ turn.T + 2, back @ turn.T + 2)
    assert np.allclose(y, x @ turn.T + 2) and np.isclose(pld, moved)


def test_equal_indices_refract_nothing():
    p = np.array([[0.1, 0.2], [0.5, 0.0], [0.0, 0.0]])
    seen = solvers.apparent_position(p, np.array([0.0, 0.0, -1.0]), 0.0, 0.01, 1.33, 1.33, 0.4)
    assert np.allclose(seen, p, atol=1e-9)


def test_refraction_obeys_snell():
    camera, real = np.array([0.0, 0.0, -1.0]), np.array([[0.3, 0.4]])
    n, glass, thick, back = 1.3364, 1.585, 0.0095, 0.44
    seen = solvers.apparent_position(real, camera, 0.0, thick, n, glass, back)[0]
    assert 0 < np.hypot(*seen) - 0.5 < 0.01  # the denser slab bends the ray inwards, so it comes in from farther out
    sine = np.sin(np.arctan(np.hypot(*seen) / (back + 1)))
    inner = np.arcsin(n * sine / glass)
    reached = np.tan(np.arcsin(sine)) * (1 + back - thick) + np.tan(inner) * thick
    assert np.isclose(reached, 0.5, atol=1e-9)


def test_triangulation_recovers_noisy_points_better_than_the_start():
    rng = np.random.default_rng(2)
    cameras = np.array([[0.1, 0.2, -1.5], [0.7, 0.1, -1.4], [0.4, -0.3, -1.6]])
    screens = np.array([[[900 + 20 * i, 5 * i, 300], [-4 * i, -880, 600], [0.02 * i, 0.01, 1]] for i in range(3)], float)
    truth = rng.uniform([0, 0, 0.05], [1, 1, 0.4], (40, 3))
    owner = np.repeat(np.arange(40), 3)
    c, m, z = np.tile(cameras, (40, 1)), np.tile(screens, (40, 1, 1)), np.zeros(120)
    seen = solvers.reproject(truth[owner], c, m, z)
    x, rms = solvers.triangulate(truth + rng.normal(0, 0.02, truth.shape), owner, seen, c, m, z)
    assert np.allclose(x, truth, atol=1e-6) and (rms < 1e-4).all()
    noisy = seen + rng.normal(0, 0.5, seen.shape)
    y, rms = solvers.triangulate(truth, owner, noisy, c, m, z)
    before = np.sqrt(np.bincount(owner, ((seen - noisy) ** 2).sum(1)) / 3)
    assert (rms <= before + 1e-9).all()


def test_nelder_mead_finds_a_minimum():
    x, value, _ = solvers.nelder_mead(lambda v: (v[0] - 3) ** 2 + 10 * (v[1] + 1) ** 2, np.zeros(2), np.ones(2), size=1e-9, most=1000)
    assert np.allclose(x, [3, -1], atol=1e-6) and value < 1e-10


def test_straightness_of_level_and_upright_lines_is_zero():
    x = np.array([0.0, 1, 2, 5, 5, 5])
    y = np.array([7.0, 7, 7, 0, 1, 2])
    assert abs(solvers.straightness(x, y, np.array([0, 0, 0, 1, 1, 1]))) < 1e-12


def test_fit_straightens_a_bent_grid():
    lines = [(i, x, y) for i, y in enumerate(np.linspace(80, 1000, 8)) for x in np.linspace(60, 1860, 15)]
    line, p = np.array([r[0] for r in lines]), np.array([r[1:] for r in lines])
    fit = solvers.fit_distortion(solvers.redistort(LENS, p), line, (960.0, 540.0), most=2500)
    assert fit.reduction > 0.99 and fit.rms < 0.2


def test_refraction_in_columns_runs_on_batches(spark):
    """As a fold over a sequence each point took a millisecond."""
    frame = {"front": 0.0, "back": 0.44, "thickness": 0.0095, "n_medium": 1.3364, "n_surface": 1.585}
    camera = np.array([0.1, 0.2, -1.5])
    p = np.random.default_rng(3).uniform(-1, 1, (200, 2))
    p[0] = camera[:2]
    rows = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)] + [(200, None, 1.0)], "i int, h double, v double")
    at = geometry.apparent_position((F.col("h"), F.col("v")), tuple(F.lit(float(c)) for c in camera), **frame)
    seen = rows.select("i", at[0].alias("x"), at[1].alias("y"))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan.lower()
    *found, blank = seen.orderBy("i").collect()
    assert blank.x is None
    assert np.allclose([(r.x, r.y) for r in found], solvers.apparent_position(p, camera, 0.0, 0.0095, 1.3364, 1.585, 0.44), atol=1e-9)


def test_factors_of_many_systems_at_once():
    rng = np.random.default_rng(4)
    owner = rng.permutation(np.repeat(np.arange(6), [1, 3, 8, 9, 40, 500]))
    rows = rng.normal(size=(len(owner), 9))
    found = solvers.stacked_factors(rows, owner)
    for i in range(6):
        own = rows[owner == i]
        assert np.allclose(found[i].T @ found[i], own.T @ own)


def test_matrices_of_many_clips_in_one_batch(spark):
    """Clips of four points and of many, whose matrices are solved side by side."""
    m = np.array([[1.1, 0.02, 3], [-0.03, 0.9, 5], [1e-4, 2e-4, 1]])
    rng = np.random.default_rng(5)
    rows = []
    for clip in range(50):
        p = rng.uniform(0, 500, (3 + clip, 2))
        turned = m + np.outer([1, 0, 0], [0.01 * clip, 0, 0])
        rows += [(f"c{clip}", *map(float, (*a, *b))) for a, b in zip(p, solvers.apply_homography(turned, p))]
    points = spark.createDataFrame(rows, "clip string, ax double, ay double, bx double, by double")
    solved = solvers.homographies(points, group="clip", source=("ax", "ay"), target=("bx", "by"))
    assert "FlatMapGroups" not in solved._jdf.queryExecution().executedPlan().toString()  # a task of its own for each clip took a millisecond
    found = {r.clip: np.array(r.matrix) for r in solved.collect()}
    assert sorted(found) == sorted(f"c{i}" for i in range(1, 50))
    assert all(np.isclose((x / x[2, 2])[0, 0], 1.1 + 0.01 * int(c[1:]), atol=1e-5) for c, x in found.items())


def test_line_sums_of_clips_beside_each_other():
    """The sums of a clip's lines don't depend on the lines beside them, and follow the cost's differences."""
    rng = np.random.default_rng(6)
    sizes, owner = np.array([3, 5, 40, 7]), np.array([0, 0, 1, 1])
    x, y = rng.uniform(-1, 1, (2, sizes.sum()))
    trials = rng.normal(0, 0.01, (2, plumblines.PARAMETERS))
    both = plumblines.line_sums(trials, owner, sizes, x, y)
    alone = plumblines.line_sums(trials[1:], np.zeros(2, int), sizes[2:], x[8:], y[8:])
    assert np.allclose(both[1], alone[0])
    square = plumblines.PARAMETERS**2
    for i in range(plumblines.PARAMETERS):
        h = np.zeros(plumblines.PARAMETERS)
        h[i] = 1e-6
        up, down = (plumblines.line_sums(trials + d, owner, sizes, x, y)[:, square + plumblines.PARAMETERS] for d in (h, -h))
        assert np.allclose((up - down) / 4e-6, both[:, square + i], atol=1e-5)


def test_near_corners_are_looked_up_without_rings(monkeypatch):
    p = np.array([(10.0 * i + 0.1 * j, 10.0 * j) for i in range(12) for j in range(12)])
    corners = plumblines.Corners(p)
    monkeypatch.setattr(corners, "_ring", None)
    assert len(plumblines.grow_line(corners, 0, 12, tolerance=0.2, margin=-1.0)) == 12


def test_coefficients_reach_the_solver_as_numbers(spark):
    """As arrays they were unpacked row by row."""
    rows = spark.createDataFrame([(100.0, 50.0, (90.0, 40.0, [1e-5, None], [1e-6])), (100.0, 50.0, None)], "x double, y double, lens struct<cx: double, cy: double, k: array<double>, p: array<double>>")
    bent = lenses.redistorted(lenses.undistorted(rows, x="x", y="y"), x="ideal_x", y="ideal_y")
    assert all(math.isclose(r.screen_x, 100.0) and math.isclose(r.screen_y, 50.0) for r in bent.collect())
    plan = bent._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [solve(struct(" in plan
