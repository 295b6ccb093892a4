"""Plumb lines against a search of all corners, lens fits against known lenses, recalculation against a full one."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolith import queries
from stereolith.functions.geometry import Distortion
from stereolith.operators import changes, joins, lenses, plumblines, sequences, shared, solvers
from stereolith.plans import measure, reports
from stereolith.sources import exports

DATA = "/root/testdata/sf0.001"


# Lines from corners. Every corner is looked at, for every step.


def all_nearest(points, p, *, least=-1.0):
    far = [(float(np.hypot(q[0] - p[0], q[1] - p[1])), i) for i, q in enumerate(points)]
    return min((f for f in far if f[0] > least), default=(np.inf, None))


def plain_line(points, a, b, tolerance, margin=4.0):
    line = [a, b]
    for _ in range(2):
        while True:
            step = points[line[-1]] - points[line[-2]]
            for jump in (1, 2):
                far, i = all_nearest(points, points[line[-1]] + jump * step)
                if far < tolerance * np.hypot(*step) and i not in line and min(points[i]) > margin:
                    line.append(i)
                    break
            else:
                break
        line = line[::-1]
    return line


def plain_lattice(points, tolerance, least):
    points = np.array(sorted({tuple(p) for p in points}))
    if len(points) < 2:
        return []
    a = all_nearest(points, points.mean(0))[1]
    b = all_nearest(points, points[a], least=1e-4)[1]
    if b is None:
        return []

    def across(line):
        out = []
        for k, i in enumerate(line):
            dx, dy = points[line[0]] - points[line[1]] if k == 0 else points[i] - points[line[k - 1]]
            j = all_nearest(points, (points[i][0] - dy, points[i][1] + dx))[1]
            out.append([i] if j == i else plain_line(points, i, j, tolerance))
        return out

    first = plain_line(points, a, b, tolerance)
    over = across(first)
    middle = over[len(first) // 2]
    back = across(middle) if len(middle) > 1 else []
    return [[tuple(points[i]) for i in line] for line in over + back if len(line) > least]


def found_lines(rows):
    lines = {}
    for r in sorted(rows, key=lambda r: (r.line, r["index"])):
        lines.setdefault(r.line, []).append((r.x, r.y))
    return [lines[k] for k in sorted(lines)]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_lattices_of_all_frames(spark):
    corners = queries._corners(spark, DATA).toPandas()
    rows = queries.v1_plumb_lines(spark, DATA).collect()
    assert len({r.line for r in rows}) > 20
    for frame, own in corners.groupby("frame"):
        assert found_lines([r for r in rows if r.frame == frame]) == plain_lattice(own[["x", "y"]].to_numpy(float), 0.2, 4)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_lines_from_seeds(spark):
    corners = queries._corners(spark, DATA).toPandas()
    rows = queries.w9_grow_lines(spark, DATA).collect()
    assert rows
    for frame, own in corners.groupby("frame"):
        near = own[(own.y > 92) & (own.y < 120) & (own.x < 150)].sort_values(["x", "y"])
        points = np.array(sorted({tuple(p) for p in own[["x", "y"]].to_numpy(float)}))
        want = []
        if len(near) > 1:
            a, b = (all_nearest(points, q)[1] for q in near[["x", "y"]].to_numpy()[:2])
            line = plain_line(points, a, b, 0.2)
            want = [[tuple(points[i]) for i in line]] if len(line) > 4 else []
        assert found_lines([r for r in rows if r.frame == frame]) == want


def test_growing_jumps_one_missing_corner_and_stops_at_the_edge():
    p = np.array([(20.0 + 30 * c, 50.0) for c in range(8) if c != 4] + [(20.0, 500.0)])
    corners = plumblines.Corners(p)
    assert {float(p[i][0]) for i in plumblines.grow_line(corners, 1, 2)} == {20.0, 50.0, 80.0, 110.0, 170.0, 230.0}
    inner = {float(p[i][0]) for i in plumblines.grow_line(corners, 1, 2, size=(200.0, 600.0))}
    assert 230.0 not in inner and 20.0 in inner


def test_cells_find_what_a_full_search_finds():
    rnd = np.random.default_rng(5)
    for points in (rnd.uniform(0, 900, (400, 2)), np.column_stack([np.arange(50.0), np.zeros(50)]), np.array([[3.0, 4.0]]), np.repeat([[1.0, 2.0]], 7, 0)):
        corners = plumblines.Corners(points)
        for p in rnd.uniform(-300, 1200, (200, 2)):
            far, i = all_nearest(points, p)
            assert corners.nearest(p) == (i, pytest.approx(far))
            assert corners.nearest(p, reach=40.0)[0] == (i if far < 40 else None)


def test_large_frame_is_not_searched_all_against_all(monkeypatch):
    side = 316
    points = np.array([(20.0 + 30 * c, 20.0 + 30 * r) for c in range(side) for r in range(side)])
    looked = [0]
    plain = plumblines.Corners._ring

    def counted(self, *at):
        for key in plain(self, *at):
            looked[0] += len(self.cells.get(key, ()))
            yield key

    monkeypatch.setattr(plumblines.Corners, "_ring", counted)
    lines = plumblines.lattice(points, tolerance=0.2)
    assert len(lines) == 2 * side and all(len(x) == side for x in lines)
    assert looked[0] < 40 * len(points) * 2


def test_frames_without_lines_caps_and_seeds(spark):
    rows = [(1, None, 2.0, 9.0), (2, 10.0, 10.0, 1.0), (None, 5.0, 5.0, 1.0), (3, float("nan"), 1.0, 1.0)]
    rows += [(4, 20.0 + 30 * c, 20.0 + 30 * r, float(r)) for c in range(7) for r in range(7)] * 2
    rows += [(4, 500.0 + i, 900.0 - 3 * i, -1.0) for i in range(30)]  # weak ones, beyond the cap
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "frame int, x double, y double, quality double, line int, seed string")
    found = plumblines.plumb_lines(df, frame="frame", x="x", y="y", quality="quality", most=98).collect()
    assert {r.frame for r in found} == {4} and len(found) == 98 and len({r.line for r in found}) == 14
    assert max(r.x for r in found) < 300
    seeds = spark.createDataFrame([(4, 50.0, 50.0, 80.0, 80.0)], "frame int, ax double, ay double, bx double, by double")
    aslant = found_lines(plumblines.plumb_lines(df, frame="frame", x="x", y="y", quality="quality", most=98, seeds=seeds).collect())
    assert any(abs(line[1][0] - line[0][0]) == abs(line[1][1] - line[0][1]) == 30 for line in aslant) and aslant != found_lines(found)
    assert plumblines.plumb_lines(df.where("frame = 9"), frame="frame", x="x", y="y").collect() == []


# Lenses.


@pytest.mark.parametrize("lens", [Distortion(957.0, 538.0, (5e-8, 1e-14), (1e-6, -5e-7)), Distortion(975.0, 530.0, (-8e-8, 2e-14), (0.0, 1e-6, 1e-8))])
def test_lens_is_found_again(spark, lens):
    lines = [(i, x, 80.0 + 80 * i + 0.03 * i * x) for i in range(9) for x in np.linspace(60, 1860, 25)] + [(20 + i, 100.0 + 200 * i, y) for i in range(9) for y in np.linspace(40, 1040, 18)]
    bent = solvers.redistort(lens, np.array([r[1:] for r in lines]))
    rows = [(7, r[0], float(p[0]), float(p[1])) for r, p in zip(lines, bent)] + [(8, r[0], *r[1:]) for r in lines] + [(7, 99, None, 1.0), (7, 98, 1.0, 1.0), (7, 98, 2.0, 9.0), (None, 1, 1.0, 1.0), (9, 1, 1.0, 1.0)]
    df = spark.createDataFrame([(*map(lambda v: v if v is None else (int(v) if isinstance(v, np.integer) else v), r), "x") for r in [(a, b, None if c is None else float(c), float(e)) for a, b, c, e in rows]], "clip int, line int, x double, y double, trial string").repartition(5)
    fits = {r.clip: r for r in plumblines.fit_lenses(df, clip="clip", line="line", x="x", y="y", centre=(960.0, 540.0)).collect()}
    assert set(fits) == {7, 8}
    index = np.array([r[0] for r in lines])
    plain = solvers.straightness(bent[:, 0], bent[:, 1], np.unique(index, return_inverse=True)[1])
    assert fits[7].points == len(lines) and fits[7].initial_rms == pytest.approx(np.sqrt(plain / len(lines)), rel=1e-9)
    assert fits[7].rms < 1e-3 and fits[7].reduction > 0.999999
    found = Distortion(fits[7].cx, fits[7].cy, tuple(fits[7].k), tuple(fits[7].p))
    ideal = solvers.undistort(found, bent)
    again = solvers.straightness(ideal[:, 0], ideal[:, 1], np.unique(index, return_inverse=True)[1])
    assert np.sqrt(max(0.0, again) / len(lines)) == pytest.approx(fits[7].rms, abs=1e-6)
    assert fits[8].rms < 1e-6


def test_fit_is_no_worse_than_the_simplex(spark):
    rnd = np.random.default_rng(3)
    lines = [(i, x, y) for i, y in enumerate(np.linspace(80, 1000, 8)) for x in np.linspace(60, 1860, 15)]
    bent = solvers.redistort(Distortion(960.0, 540.0, (4e-8, 1e-14)), np.array([r[1:] for r in lines])) + rnd.normal(0, 0.3, (len(lines), 2))
    simplex = solvers.fit_distortion(bent, np.array([r[0] for r in lines]), (960.0, 540.0), most=2500)
    df = spark.createDataFrame([(1, r[0], float(p[0]), float(p[1])) for r, p in zip(lines, bent)], "clip int, line int, x double, y double")
    (fit,) = plumblines.fit_lenses(df, clip="clip", line="line", x="x", y="y", centre=(960.0, 540.0)).collect()
    assert fit.rms <= simplex.rms * 1.0001


def test_every_row_has_its_own_lens(spark):
    rnd = random.Random(2)
    made = [Distortion(rnd.uniform(200, 300), rnd.uniform(100, 200), (rnd.uniform(-1e-7, 2e-7), 1e-13), (1e-6, -1e-6, 1e-8, 1e-14)) for _ in range(6)]
    rows = [(i, rnd.uniform(0, 500), rnd.uniform(0, 400)) for i in range(6) for _ in range(20)] + [(50, 3.0, 4.0), (0, None, 1.0)]
    table = spark.createDataFrame([(i, m.cx, m.cy, list(m.k), list(m.p)) for i, m in enumerate(made)] + [(51, 1.0, 1.0, [], [])], "clip long, cx double, cy double, k array<double>, p array<double>")
    df = lenses.with_lens(spark.createDataFrame(rows, "clip long, x double, y double"), table, clip="clip")
    for r in lenses.redistorted(lenses.undistorted(df, x="x", y="y"), x="x", y="y").collect():
        if r.x is None:
            assert r.screen_x is None and r.ideal_x is None
        elif r.clip == 50:
            assert (r.ideal_x, r.screen_y) == (r.x, r.y)
        else:
            p = np.array([[r.x, r.y]])
            assert np.allclose(solvers.undistort(made[r.clip], p)[0], (r.ideal_x, r.ideal_y), atol=1e-9)
            assert np.allclose(solvers.redistort(made[r.clip], p)[0], (r.screen_x, r.screen_y), atol=1e-6)
    far = lenses.redistorted(df.where("clip = 0 and x is not null").withColumn("x", F.lit(1e7)), x="x", y="y").collect()
    assert all(r.screen_x is None for r in far)


# Calibration, recalculation.


def test_calibration_of_one_plane_and_of_incomplete_clips(spark):
    nodes = [(h, v) for h in (0.0, 0.3, 0.7) for v in (0.0, 0.5)]
    rows = [(1, "front", 100 * h + 5, 90 * v + 7, h, v) for h, v in nodes] + [(1, "back", 80 * h + 15, 70 * v + 12, h, v) for h, v in nodes]
    rows += [(2, "back", 80 * h, 70 * v, h, v) for h, v in nodes] + [(3, "front", 1.0, 1.0, 0.0, 0.0)]
    rows += [(4, "front", 100 * h, 90 * v, h, v) for h, v in nodes] + [(4, "front", None, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "clip_id long, surface string, screen_x double, screen_y double, world_h double, world_v double")
    status = {r.clip_id: r.status for r in measure.calibration_status(df).collect()}
    assert status == {1: "both", 2: "back", 3: "too few", 4: "incomplete"}
    frame = solvers.Frame(0.0, 0.44)
    assert [r.clip_id for r in measure.calibrate_clips(df, frame).collect()] == [1]
    two = {r.clip_id: r for r in measure.calibrate_clips(df, frame, one_plane=True).collect()}
    assert set(two) == {1, 2} and two[2].to_front is None and two[2].camera_h is None and two[2].back_world < 1e-9
    assert two[1].front_pixel < 1e-9 and two[1].camera_pld is not None
    seen = spark.createDataFrame([(5, 1, 35.0, 52.0), (5, 2, 24.0, 35.0), (6, 9, 1.0, 1.0)], "point_id long, clip_id long, screen_x double, screen_y double")
    cameras = measure.calibrate_clips(df, frame, one_plane=True)
    on = {(r.point_id, r.clip_id): r for r in measure.plane_coordinates(seen, cameras).collect()}
    assert on[5, 1].front_h == pytest.approx(0.3) and on[5, 2].back_v == pytest.approx(0.5) and on[5, 2].front_h is None and on[6, 9].back_h is None
    assert measure.recalculate(seen, cameras, frame).collect() == []  # one view with both planes is too few


def test_lens_of_each_clip_takes_part_in_its_calibration(spark):
    lens = Distortion(50.0, 40.0, (1e-6,), ())
    nodes = [(h, v) for h in (0.0, 0.3, 0.7) for v in (0.0, 0.5, 0.9)]
    ideal = np.array([(100 * h + 5, 90 * v + 7) for h, v in nodes])
    rows = [(1, s, float(p[0]), float(p[1]), h, v) for s in ("front", "back") for p, (h, v) in zip(solvers.redistort(lens, ideal), nodes)]
    df = spark.createDataFrame(rows, "clip_id long, surface string, screen_x double, screen_y double, world_h double, world_v double")
    table = spark.createDataFrame([(1, 50.0, 40.0, [1e-6], [0.0])], "clip_id long, cx double, cy double, k array<double>, p array<double>")
    (bent,), (straight,) = (measure.calibrate_clips(df, solvers.Frame(0.0, 0.4), t).collect() for t in (None, table))
    assert bent.front_pixel > 1e-4 and straight.front_pixel < 1e-6


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_changed_points_alone_are_solved_again(spark, tmp_path, monkeypatch):
    cameras = queries._plain_cameras(spark)
    views = queries._views(spark, DATA)
    noise = (F.xxhash64("point_id", "clip_id") % 100) / 50.0
    views = views.withColumn("screen_x", F.col("screen_x") + noise).withColumn("screen_y", F.col("screen_y") - noise)
    first = measure.recalculate_changed(None, views, cameras, queries.FRAME)
    first.write.parquet(str(tmp_path / "solved"))
    clean = reports.export_projects(spark.createDataFrame([(1, "a")], "project_id int, name string"), spark.read.parquet(str(tmp_path / "solved")), str(tmp_path / "xml"))
    assert clean.where("dirty").count() == 0
    asked = []
    plain = measure.recalculate
    monkeypatch.setattr(measure, "recalculate", lambda v, *a, **k: (asked.append(v), plain(v, *a, **k))[1])
    edited = views.withColumn("screen_x", F.when(F.col("point_id") == 8, F.col("screen_x") + 3).otherwise(F.col("screen_x"))).where("not (point_id = 9 and clip_id > 0) and point_id <> 10")
    edited = edited.unionByName(edited.where("point_id = 8").withColumn("point_id", F.lit(10**9)))
    moved = cameras.withColumn("camera_h", F.when(F.col("clip_id") == 7, 0.0).otherwise(F.col("camera_h")))
    now = measure.recalculate_changed(clean, edited, moved, queries.FRAME).orderBy("point_id").collect()
    assert {r.point_id for r in asked[0].select("point_id").distinct().collect()} == {8, 9, 10**9}
    assert {r.point_id for r in now if r.dirty} == {8, 9, 10**9} and all(r.point_id != 10 for r in now)
    full = {r.point_id: r for r in measure.recalculate_changed(None, edited, moved, queries.FRAME).collect()}
    assert len(full) == len(now)
    for r in now:
        same = full[r.point_id]
        for c in measure.SOLVED:
            assert (r[c] is None and same[c] is None) or r[c] == pytest.approx(same[c], rel=1e-9, abs=1e-12)
    assert next(r for r in now if r.point_id == 9).h is None
    # A camera that moves makes all its points dirty.
    shifted = cameras.withColumn("camera_h", F.col("camera_h") + F.when(F.col("clip_id") == 1, 0.01).otherwise(0.0))
    assert measure.recalculate_changed(clean, views, shifted, queries.FRAME).where("not dirty").count() == 0


# Answers that were wrong.


def plain_places(clicks, most, tolerance=0.004):
    out, part, held, first = [], -1, 0, None
    for key, t in clicks:
        if part < 0 or (most and held == most) or t is None or first is None or abs(t - first) >= tolerance:
            part, held, first = part + 1, 0, t
        held += 1
        out.append((key, part, held))
    return out


@pytest.mark.parametrize("most", [0, 1, 3])
def test_clicks_are_placed_in_their_order(spark, most):
    rnd = random.Random(most)
    events = {0: [10.0, 20.0, 10.0, 20.002], 1: [0.003 * i for i in range(40)], 2: [5.0] * 11, 3: [None, 1.0, None, None, 1.0, 1.001], 4: [round(rnd.choice([1.0, 1.002, 1.0035, 1.006, 7.0]), 4) for _ in range(300)]}
    rows = [(e, i, t, 0, 1) for e, ts in events.items() for i, t in enumerate(ts)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "event int, click int, t double, first int, run int").repartition(3)
    placed = sequences.roll_over_both(df, event="event", order=("click",), most=most, t="t")
    for e, ts in events.items():
        assert sorted((r.click, r.part, r["index"]) for r in placed.where(F.col("event") == e).collect()) == plain_places(list(enumerate(ts)), most)


def test_roll_over_by_time_goes_by_clicks(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([10.0, 20.0, 10.0, 10.001])], "event int, click int, t double")
    assert [r.part for r in sequences.roll_over_by_time(df, event="event", t="t", order=("click",)).orderBy("click").collect()] == [0, 1, 2, 2]


def test_new_rows_of_a_group_get_different_indexes(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2)], "g string, i int")
    new = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "g string, v string")
    both = changes.append_row(old.withColumn("v", F.lit("w")), new, group="g", index="i")
    assert sorted((r.g, r.i, r.v) for r in both.collect()) == [("a", 1, "w"), ("a", 2, "w"), ("a", 3, "x"), ("a", 4, "y"), ("b", 1, "z")]


def test_nodes_of_frames_stay_apart(spark):
    df = spark.createDataFrame([(1, "0,1\nx\n2,3"), (2, "4,5\r\n6,7"), (3, None), (4, "")], "frame int, t string")
    assert sorted(tuple(r) for r in exports.nodes(df, "t", keys=("frame",)).collect()) == [(1, 1, 0.0, 1.0), (1, 2, 2.0, 3.0), (2, 1, 4.0, 5.0), (2, 2, 6.0, 7.0)]


def test_nearest_vector_of_rows_with_nulls(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [0.0, 0.5])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    found = joins.nearest_vector(df, df, key="k", vector="v").collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 1.0), (2, 1, 1.0)]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_linear_residuals_against_a_full_decomposition(spark):
    p = queries.points(spark, DATA).toPandas()
    off = (p.event_id % 11 - 5) * 0.2
    m = np.array(queries.MATRIX).reshape(3, 3)
    target = solvers.apply_homography(m, p[["x", "y"]].to_numpy())
    source = np.column_stack([p.x + off, p.y - off / 2])
    for r in queries.a19_linear_residuals(spark, DATA).collect():
        own = (p.event_type == r.event_type).to_numpy()
        a, b = (((q - q.mean(0)) * (np.sqrt(2) / np.mean(np.hypot(*(q - q.mean(0)).T)))) for q in (source[own], target[own]))
        rows = [row for (x, y), (u, v) in zip(a, b) for row in ((x, y, 1, 0, 0, 0, -u * x, -u * y, -u), (0, 0, 0, x, y, 1, -v * x, -v * y, -v))]
        assert r.residual == pytest.approx(np.linalg.svd(np.array(rows))[1][-1] / own.sum(), abs=2e-8)


def test_nothing_stays_once_released(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "a int, b int")
    placed = sequences.placed(df, first="b", rest=("a",))
    assert sorted(r.place for r in placed.collect()) == list(range(1, 21))
    folder = Path(shared.folder(spark).removeprefix("file:")) / "stereolith"
    assert any(p.name.startswith("placed") for p in folder.iterdir())
    shared.release_all()
    assert not any(p.name.startswith("placed") for p in folder.iterdir())


def test_places_of_nulls_ties_and_many_equal_keys(spark):
    rows = [(None, 3), (None, 1)] + [(5, i % 2) for i in range(50)] + [(-1, None)]
    got = sequences.placed(spark.createDataFrame(rows, "a int, b int").repartition(6), first="a", rest=("b",)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 54))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
    assert sequences.placed(spark.createDataFrame([], "a int, b int"), first="a", rest=("b",)).collect() == []
