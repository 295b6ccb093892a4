"""Edges of the operators, the sources and the streams."""

import math

import numpy as np
from pyspark.sql import functions as F

from stereolith.functions import geometry, text, timecode
from stereolith.operators import aggregates, changes, joins, selection, sequences
from stereolith.plans import reports
from stereolith.sources import exports, plists
from stereolith.streaming import visible


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_timecodes(spark):
    r = one(spark, *[timecode.seconds(F.lit(c)) for c in ("0:01:02.300/600", "-0:00:01.300/600", "1:00:00", "nonsense", "0:00:00.1/0")])
    assert list(r) == [62.5, -1.5, 3600.0, None, None]
    assert one(spark, timecode.render(F.lit(-37500), F.lit(600)))[0] == "-0:01:02.300/600"
    assert one(spark, timecode.rescale(F.lit(-5), F.lit(2), F.lit(1)))[0] == -3


def test_fade(spark):
    args = [F.lit(x) for x in (10.0, 1.0, 0.5)]
    assert list(one(spark, *[timecode.opacity(F.lit(t), *args) for t in (10.0, 11.0, 11.25, 12.0)])) == [1.0, 1.0, 0.5, 0.0]
    assert list(one(spark, *[timecode.is_visible(F.lit(t), *args) for t in (10.0, 11.49, 11.5)])) == [True, True, False]


def test_labels(spark):
    r = one(spark, text.label(F.lit("Fish"), F.lit(3), F.lit(None)), text.label(F.lit("Fish"), F.lit(3), F.lit("")), text.label_with_notes(F.lit("Fish"), F.lit(3), F.lit("Bo"), F.lit("old")), text.measure(F.lit(0.0123), F.lit(1000.0), 1, F.lit("mm")))
    assert list(r) == ["Fish 3", "Fish 3", "Fish 3 (Bo) (Notes: old)", "12.3 mm"]
    assert one(spark, text.join_parts(F.lit(""), F.lit(None), F.lit("")))[0] == "Untitled"
    assert one(spark, text.matrix_text(F.array(F.array(F.lit(1.0), F.lit(0.5)))))[0] == "1.000000e+00, 5.000000e-01"


def test_all_axis_orders_go_there_and_back(spark):
    for axes, order in geometry.AXES.items():
        h, v = axes.split(",")
        back = geometry.to_frame(axes, geometry.to_space(axes, F.lit(1), F.lit(2), F.lit(3)))
        assert list(one(spark, *back, geometry.depth_axis(F.lit(h), F.lit(v)))) == [1, 2, 3, order[2]]
    assert one(spark, geometry.depth_axis(F.lit("x"), F.lit("x")))[0] is None


def test_degenerate_geometry_is_null(spark):
    zero = [F.lit(0.0)] * 9
    assert one(spark, geometry.inverse(zero)[0])[0] is None
    beside = geometry.on_plane((F.lit(0.0), F.lit(0.0), F.lit(1.0)), (F.lit(1.0), F.lit(0.0), F.lit(1.0)), F.lit(2.0))
    assert one(spark, beside[0])[0] is None
    level = geometry.orthogonal_residual(F.lit(3.0), F.lit(3.0), F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(0.0))
    assert one(spark, level)[0] == 0.0
    crossing = one(spark, geometry.extend_to_frame((F.lit(1.0), F.lit(1.0)), (F.lit(2.0), F.lit(2.0)), F.lit(10), F.lit(10)))[0]
    assert [(p.x, p.y) for p in crossing] == [(0.0, 0.0), (10.0, 10.0)]


def test_segments_take_the_point_before_even_without_coordinates(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, None, None, 1.0), (1, 3, 3.0, 4.0, 2.0), (1, 4, 3.0, 4.0, 2.0)], "e int, i int, x double, y double, t double")
    rows = sequences.segments(p, event="e", order=("i",), coordinates=("x", "y"), t="t").collect()
    assert [(r.i, r.length, r.speed) for r in rows] == [(4, 0.0, None)]


def test_no_rollover_without_a_most(spark):
    p = spark.createDataFrame([(1, i) for i in range(4)], "e int, i int")
    assert {r.part for r in sequences.roll_over(p, event="e", order=("i",), most=0).collect()} == {0}


def test_visible_pairs_meet_once(spark):
    items = spark.createDataFrame([(1, 0.0, 100.0, 5.0), (2, 50.0, 0.0, 0.0)], "id int, s double, d double, f double")
    times = spark.createDataFrame([(0.0,), (99.0,), (104.9,), (105.0,)], "t double")
    rows = joins.visible_at(items, times, start="s", duration="d", fade="f", t="t", width=10.0).collect()
    assert sorted((r.id, r.t) for r in rows) == [(1, 0.0), (1, 99.0), (1, 104.9)]


def test_tolerance_is_strict_and_symmetric(spark):
    a = spark.createDataFrame([(1.0,), (-0.001,)], "a double")
    b = spark.createDataFrame([(1.0039,), (1.004,), (0.001,)], "b double")
    assert sorted((r.a, r.b) for r in joins.within(a, b, "a", "b", 0.004).collect()) == [(-0.001, 0.001), (1.0, 1.0039)]


def test_nearest_looks_farther_until_it_finds(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 99.0, 99.0)], "q int, qx double, qy double")
    p = spark.createDataFrame([(7, 0.0, 0.0), (9, 1.0, 0.0), (8, -1.0, 0.0)], "p int, x double, y double")
    rows = joins.nearest(q, p, query="q", point="p", coordinates=(("qx", "x"), ("qy", "y")), cell=2.0, reach=3.0).collect()
    assert [(r.q, r.p, round(r.distance, 6)) for r in rows] == [(1, 8, 1.0), (2, 9, round((98**2 + 99**2) ** 0.5, 6))]
    assert joins.nearest(q, p.limit(0), query="q", point="p", coordinates=(("qx", "x"), ("qy", "y")), cell=2.0, reach=3.0).count() == 0


def test_nearest_point_in_crowds(spark):
    rng = np.random.default_rng(5)
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(np.concatenate([rng.normal(0, 0.05, (400, 2)), rng.uniform(-90, 90, (40, 2))]), 3))]
    copies = [(1000 + i, 0.01, 0.01) for i in range(300)] + [(2000, None, 1.0), (2001, float("nan"), 1.0), (2002, float("inf"), 1.0)]
    p = spark.createDataFrame(spots + copies, "p long, x double, y double")
    asked = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(np.concatenate([rng.normal(0, 0.05, (80, 2)), rng.uniform(-300, 300, (20, 2)), np.zeros((50, 2)) + 0.01]), 3))] + [(900, None, 0.0)]
    q = spark.createDataFrame(asked, "q long, qx double, qy double")
    found = joins.nearest(q, p, query="q", point="p", coordinates=(("qx", "x"), ("qy", "y")), cell=1.0, reach=1.0, crowd=8).collect()
    every = [r for r in spots + copies if r[1] is not None and math.isfinite(r[1])]
    want = {}
    for k, x, y in asked[:-1]:
        far = [(math.sqrt((x - px) ** 2 + (y - py) ** 2), n) for n, px, py in every]
        want[k] = min(f for f in far if f[0] > 1e-4)
    assert {r.q: r.p for r in found} == {k: n for k, (_, n) in want.items()}
    assert all(abs(r.distance - want[r.q][0]) < 1e-9 for r in found)


def test_parallel_lines_meet_nowhere(spark):
    rows = [("a", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("a", 1.0, 0.0, 0.0, 1.0, 0.0, 1.0), ("b", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double, e double, f double")
    found = aggregates.meet_lines(df, group="g", front=("a", "b", "c"), back=("d", "e", "f")).collect()
    assert [(r.g, r.x) for r in found] == [("a", None)]


def test_changes(spark):
    bridge = spark.createDataFrame([(1, 10), (2, 10), (1, 11)], "object_id int, event_id int")
    events = spark.createDataFrame([(10,), (11,), (12,)], "event_id int")
    left, links = changes.delete_object(events, bridge, 1)
    assert sorted(r.event_id for r in left.collect()) == [10, 12] and [tuple(r) for r in links.collect()] == [(2, 10)]
    points = spark.createDataFrame([(10, 5.0), (10, 50.0), (11, 20.0)], "event_id int, t double")
    split = changes.split_object(bridge, points, 1, 10.0, 9)
    assert sorted(map(tuple, split.collect())) == [(1, 10), (2, 10), (9, 11)]
    assert one(spark, changes.merged_notes(F.lit(None), F.lit("b")), changes.merged_notes(F.lit("a"), F.lit("b")))[0] == "b"


def test_plists_round_trip(spark, tmp_path):
    import plistlib

    frame = tmp_path / "frame"
    frame.write_bytes(plistlib.dumps(["0,0\nbad\n0.1, 0.2", "1,1", 0.0, 0.439, True, 0.0095, 1.585, 1.3364]))
    df = plists.read(spark, "frame", str(frame))
    row = df.first()
    assert (row.plane_back, row.refraction, row.medium_index) == (0.439, True, 1.3364)
    plists.write("frame", row, str(tmp_path / "again"))
    assert plistlib.loads((tmp_path / "again").read_bytes()) == plistlib.loads(frame.read_bytes())
    assert [tuple(r) for r in exports.nodes(df, "front_text").orderBy("index").collect()] == [(1, 0.0, 0.0), (2, 0.1, 0.2)]
    short = tmp_path / "short"
    short.write_bytes(plistlib.dumps(["", "", 0.0, 1.0]))
    assert plists.read(spark, "frame", str(short)).first().thickness is None

    legacy = tmp_path / "lens"
    legacy.write_bytes(plistlib.dumps([9.0, 8.0, 1e-8, 0.0, 0.0, 1e-6, 0.0, 0.0, [["0:00:01", [[1.0, 2.0, 2], [3.0, 4.0, 1]]]]]))
    lens = plists.read(spark, "distortion", str(legacy)).first()
    assert len(lens.k) == 7 and len(lens.p) == 4 and [p.x for p in lens.lines[0].points] == [3.0, 1.0]
    plists.write("distortion", lens, str(tmp_path / "lens2"))
    again = plists.read(spark, "distortion", str(tmp_path / "lens2")).first()
    assert (again.k, again.lines) == (lens.k, lens.lines)

    clip = tmp_path / "clip"
    clip.write_bytes(plistlib.dumps(["a", "b", 0.0, 1.0, "x", "y", [[1.0, 2.0, 0.1, 0.2, 1]], [[3.0, 4.0, 0.3, 0.4, 1]], False, "0:00:01"]))
    read = plists.read(spark, "calibration", str(clip)).first()
    assert [p.surface for p in read.points] == ["front", "back"] and read.timecode == "0:00:01"
    plists.write("calibration", read, str(tmp_path / "clip2"))
    assert plistlib.loads((tmp_path / "clip2").read_bytes()) == plistlib.loads(clip.read_bytes())

    kinds = tmp_path / "types"
    kinds.write_bytes(plistlib.dumps([[{"name": "Fish", "notes": "nil", "color": {"red": 1.0, "green": 0.0, "blue": 0.0, "alpha": 1.0}}], [{"name": "Bite", "maxNumPoints": 2, "requiresSameTimecode": True}]]))
    rows = plists.read(spark, "types", str(kinds)).collect()
    assert [(r.name, r.is_event, r.show_length) for r in rows] == [("Fish", False, False), ("Bite", True, False)]
    plists.write_types(rows, str(tmp_path / "types2"))
    assert [r.name for r in plists.read(spark, "types", str(tmp_path / "types2")).collect()] == ["Fish", "Bite"]


def test_exports_quote_and_nest(spark, tmp_path):
    p = spark.createDataFrame([("a 1, b 2", "say \"x\"", 1.5)], "objects string, event string, x double")
    exports.write_points_csv(p, str(tmp_path / "csv"), ["x"])
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first().objects == "a 1, b 2"
    exports.write_lines_tsv(p, str(tmp_path / "tsv"), ["x"])
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv")).count() == 1
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id int, i int, name string")
    nested = exports.nest(parent, child, "id", "events", "i").orderBy("id").collect()
    assert [[e.name for e in r.events] for r in nested] == [["a", "b"], []]
    exports.write_project_xml(exports.nest(parent, child, "id", "events", "i"), str(tmp_path / "xml"))
    assert any("<project>" in f.read_text() for f in (tmp_path / "xml").glob("part-*"))


def test_stream_of_ticks(spark, tmp_path):
    spark.createDataFrame([(0.5,), (3.0,)], "t double").write.parquet(str(tmp_path / "ticks"))
    items = spark.createDataFrame([(1, 0.0, 1.0, 0.0), (2, 2.0, 1.0, 0.5)], "id int, s double, d double, f double")
    shown = visible.visible(visible.ticks(spark, str(tmp_path / "ticks")), items, start="s", duration="d", fade="f", width=1.0)
    q = shown.writeStream.format("memory").queryName("shown").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.t) for r in spark.sql("SELECT * FROM shown").collect()) == [(1, 0.5), (2, 3.0)]
    assert not math.isnan(visible.TICK)


def test_numbers_as_text(spark):
    shown = one(spark, *[text.number(F.lit(x), d) for x, d in ((100.0, 0), (100.0, 2), (0.5, 3), (-1.25, 1), (0.0, 2))], text.number(F.lit(None).cast("double"), 2))
    assert list(shown) == ["100", "100", "0.5", "-1.3", "0", None]
    empty = F.lit(None).cast("double")
    cell = one(spark, text.screen_point_cell(F.lit("L"), (F.lit(1.0), F.lit(2.5)), (empty, empty), (F.lit(0.0), empty), (empty, F.lit(3.0))))[0]
    assert cell == "L: screen={1,2.5} undistorted={,} calibrationFrameFront={0,} calibrationFrameBack={,3}"


def test_line_samples(spark):
    def along(a, b):
        return [(round(p.x, 6), round(p.y, 6)) for p in one(spark, geometry.line_samples(tuple(map(F.lit, a)), tuple(map(F.lit, b)), 100.0, 60.0, 50.0))[0]]

    assert along((0.0, 10.0), (10.0, 10.0)) == [(100.0, 10.0), (50.0, 10.0), (0.0, 10.0)]
    assert along((20.0, 0.0), (20.0, 5.0)) == [(20.0, 50.0), (20.0, 0.0)]
    assert along((20.0, 5.0), (20.0, 5.0)) == []
    assert along((0.0, -500.0), (1.0, -500.0)) == []


def test_point_rows_of_bare_events(spark):
    points = spark.createDataFrame([(1, 1, "0:00:02.0/600", 0.0, 1.0, 2.0, 0.1, 0.2, 0.3), (1, 2, None, None, None, None, None, None, None), (2, 1, None, 5.0, 1.0, 2.0, None, None, None)], "event_id long, index int, timecode string, x double, y double, z double, pld_error double, reprojection_error double, nearest_camera_distance double")
    events = spark.createDataFrame([(1, "Fish", 3, "", "seen"), (2, "Fish", 4, "Ann", None)], "event_id long, type string, index int, name string, notes string")
    bridge = spark.createDataFrame([(1, 10), (1, 9)], "event_id long, object_id long")
    objects = spark.createDataFrame([(9, "B", 1, None), (10, "A", 2, "x")], "object_id long, type string, index int, name string")
    screen = spark.createDataFrame([(1, 1, "R", "r"), (1, 1, "L", "l")], "event_id long, index int, clip string, cell string")
    rows = {r.event_id: r for r in reports.point_rows(points, events, bridge, objects, screen).collect()}
    assert set(rows) == {1, 2}  # a coordinate of zero counts, one that is missing does not
    assert (rows[1].objects, rows[1].event, rows[1].time, rows[1].screen_coordinates) == ("A 2 (x), B 1", "Fish 3", 2.0, "l r")
    assert (rows[2].objects, rows[2].event, rows[2].time, rows[2].screen_coordinates) == ("", "Fish 4 (Ann)", None, "")

def test_point_rows_are_dealt_once(spark):
    """Points and their cells are shuffled once, and by event."""
    points = spark.createDataFrame([(1, 1, None, 0.0), (1, 1, None, 7.0), (1, None, None, 1.0), (2, 1, None, None)], "event_id long, index int, timecode string, x double").select("*", *[F.lit(0.0).alias(c) for c in ("y", "z", "pld_error", "reprojection_error", "nearest_camera_distance")])
    events = spark.createDataFrame([(1, "Fish", 3, None, None), (2, "Fish", 4, None, None)], "event_id long, type string, index int, name string, notes string")
    bridge = spark.createDataFrame([(1, 9)], "event_id long, object_id long")
    objects = spark.createDataFrame([(9, "B", 1, None)], "object_id long, type string, index int, name string")
    screen = spark.createDataFrame([(1, 1, "R", 5), (1, 1, "L", 7), (1, None, "L", 8), (1, 2, "L", 9)], "event_id long, index int, clip string, n int").withColumn("cell", F.concat("clip", F.col("n").cast("string")))
    rows = reports.point_rows(points, events, bridge, objects, screen)
    assert sorted((r.x, r.objects, r.screen_coordinates) for r in rows.collect()) == [(0.0, "B 1", "L7 R5"), (1.0, "B 1", ""), (7.0, "B 1", "L7 R5")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reports.point_rows(points, events, bridge, objects, screen)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 5  # points with cells, events, both sides of the bridge, its labels


def test_project_documents_as_xml(spark, tmp_path):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    whole = reports.project_documents(
        df([(1, "p"), (2, "q")], "project_id int, name string"), df([(1, 1, "A", 1), (2, 1, "A", 2)], "object_id int, project_id int, type string, index int"),
        df([(1, 1), (2, 2)], "event_id int, index int"), df([(1, 1), (2, 1), (2, 2)], "object_id int, event_id int"), df([(1, 1, 2), (2, 1, 1), (3, 2, 1)], "point_id int, event_id int, index int"),
        df([(1, "R", 1.0), (1, "L", 2.0)], "point_id int, clip string, x double"), df([(1, 1, "L")], "clip_id int, project_id int, name string"), df([], "clip_id int, timecode string"),
    )
    rows = {r.project_id: r for r in whole.collect()}
    first = rows[1].objects[0].events[0]
    assert [p["index"] for p in first.points] == [1, 2] and [s.clip for s in first.points[1].screenpoints] == ["L", "R"] and [o["index"] for o in first.objects] == [1, 2]
    assert rows[1].videoClips[0].annotations == [] and rows[2].objects == [] and rows[2].videoClips == []
    exports.write_project_xml(whole, str(tmp_path / "x"))
    written = "".join(p.read_text() for p in (tmp_path / "x").glob("part*"))
    assert written.count("<screenpoints>") == 4 and written.count("<project>") == 2


def test_project_documents_in_bounded_parts(spark):
    """A project of many elements is many rows, which together hold each element once."""
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    def documents(**sizes):
        return reports.project_documents(
            df([(1, "p"), (2, "q"), (3, "r"), (None, "s")], "project_id int, name string"), df([(i, i % 2 + 1, "A", -i) for i in range(6)], "object_id int, project_id int, type string, index int"),
            df([(i, i) for i in range(9)], "event_id int, index int"), df([(i % 6, i % 9) for i in range(18)] + [(0, 0)], "object_id int, event_id int"),
            df([(i, i % 4, -i) for i in range(40)], "point_id int, event_id int, index int"), df([(min(i % 50, 39), "LR"[i % 2], i) for i in range(150)], "point_id int, clip string, x int"),
            df([(i, i % 2 + 1, f"c{9 - i}") for i in range(5)], "clip_id int, project_id int, name string"), df([(i % 3, str(i)) for i in range(40)], "clip_id int, timecode string"), **sizes,
        ).collect()

    def joined(elements, child):
        """Elements in order, those that go on joined to what they go on from."""
        found = []
        for x in elements:
            x = x.asDict(recursive=False)
            if x.pop("continued"):
                for c in child:
                    found[-1][c] = found[-1][c] + x.pop(c)
                assert x.items() <= found[-1].items()
            else:
                found.append(x)
        return found

    def merged(rows):
        whole = {}
        for r in sorted(rows, key=lambda r: (r.name, r.part)):
            objects, clips = whole.setdefault((r.project_id, r.name), ([], []))
            objects += r.objects
            clips += r.videoClips
        out = {}
        for key, (objects, clips) in whole.items():
            nested = joined(objects, ("events",))
            for o in nested:
                o["events"] = joined(o["events"], ("points", "objects"))
                for e in o["events"]:
                    e["points"] = joined(e["points"], ("screenpoints",))
            out[key] = nested, joined(clips, ("annotations",))
        return out

    plain, cut = documents(), documents(most=4, piece=3)
    assert len(plain) == 4 and merged(plain) == merged(cut)
    events = [e for r in plain for o in r.objects for e in o.events]
    assert len(events) == 19 and sum(len(e.objects) for e in events) == 41 and sum(len(e.points) for e in events) == 90
    for r in cut:
        inside = [e for o in r.objects for e in o.events]
        assert len(r.objects) + len(inside) + len(r.videoClips) + sum(len(e.points) + len(e.objects) for e in inside) <= 4 + 2
        assert all(len(p.screenpoints) <= 3 for e in inside for p in e.points) and all(len(c.annotations) <= 3 for c in r.videoClips)


def test_changed_screen_points(spark):
    points = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "p int, x double")
    before = spark.createDataFrame([(1, "L", 1.0), (2, "L", 1.0), (3, "L", 1.0)], "p int, clip string, sx double")
    after = spark.createDataFrame([(1, "L", 1.0), (2, "L", 2.0), (4, "L", None)], "p int, clip string, sx double")
    assert {r.p: r.x for r in changes.change_screen_points(points, before, after, point="p", solved=("x",)).collect()} == {1: 1.0, 2: None, 4: None}


def test_texts_of_screen_points(spark):
    rows = spark.createDataFrame([(1, "R", 1.0, 2.0), (1, "L", 3.456, 0.0), (2, "L", None, 1.0)], "p int, clip string, x double, y double")
    assert [tuple(r) for r in selection.screen_points_text(rows, point="p", clip="clip", x="x", y="y").collect()] == [(1, "L: {3.46,0.00}   R: {1.00,2.00}   ")]
