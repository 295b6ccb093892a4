"""From clicked screen points to measured points in space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import aggregates, lenses, shared, solvers

SURFACES = ("front", "back")
CAMERA = (
    "clip_id long, to_front array<double>, to_back array<double>, front_to_screen array<double>, camera_h double, camera_v double, camera_d double, "
    "camera_pld double, front_pixel double, front_world double, back_pixel double, back_world double, front_dlt double, back_dlt double"
)


def calibration_status(points: DataFrame) -> DataFrame:
    """What each clip's calibration points (``clip_id, surface, screen_x, screen_y``) allow: ``clip_id, front, back, status``.

    A plane needs four points. ``both`` planes give a calibration in space, ``front``
    or ``back`` alone one on that plane, fewer are ``too few``; a clip with a
    point on such a plane that has no place on the screen yet is ``incomplete``.
    """
    blank = F.col("screen_x").isNull() | F.col("screen_y").isNull()
    counts = [F.count_if(F.col("surface") == s).alias(s) for s in SURFACES]
    lacking = [F.count_if((F.col("surface") == s) & blank).alias(f"{s}_blank") for s in SURFACES]
    found = points.groupBy("clip_id").agg(*counts, *lacking)
    enough = {s: F.col(s) >= 4 for s in SURFACES}
    lacks = (enough["front"] & (F.col("front_blank") > 0)) | (enough["back"] & (F.col("back_blank") > 0))
    status = F.when(~enough["front"] & ~enough["back"], "too few").when(lacks, "incomplete").when(enough["front"] & enough["back"], "both").when(enough["front"], "front").otherwise("back")
    return found.select("clip_id", *SURFACES, status.alias("status"))


def _cells(matrix: str) -> list[Column]:
    return [F.get(matrix, F.lit(i)) for i in range(9)]


def _sight(points: DataFrame, frame: solvers.Frame) -> DataFrame:
    """Lines of sight through points with both planes' matrices: the ends ``fh, fv, fd`` and ``bh, bv, bd``."""
    p = (F.col("screen_x"), F.col("screen_y"))
    (fh, fv), (bh, bv) = geometry.project(_cells("to_front"), p), geometry.project(_cells("to_back"), p)
    return points.select("*", fh.alias("fh"), fv.alias("fv"), F.lit(frame.front).alias("fd"), bh.alias("bh"), bv.alias("bv"), F.lit(frame.back).alias("bd"))


def calibrate_clips(points: DataFrame, frame: solvers.Frame, lens_table: DataFrame | None = None, *, one_plane: bool = False, passes: int = 4) -> DataFrame:
    """A calibration for each clip with four points on both planes, or on one if ``one_plane``.

    ``points`` has ``clip_id, surface`` (front or back), ``screen_x, screen_y,
    world_h, world_v``; ``lens_table`` has ``clip_id, cx, cy, k, p``. Matrices are solved from factors that
    parts of a clip's points give, and cameras meet their lines of sight in sums, so a clip may have any number of points.
    The back plane's points seem to lie elsewhere behind a refracting slab, which depends on the
    camera's position: with refraction it takes ``passes`` passes, the first without, and each is written down.
    On one plane a clip has neither a camera nor the other matrix; refraction is left out then.
    Clips of too few or incomplete points give no row.
    """
    wanted = ("both", *(SURFACES if one_plane else ()))
    status = calibration_status(points).where(F.col("status").isin(*wanted)).select("clip_id", "status")
    own = points.select("clip_id", "surface", "screen_x", "screen_y", "world_h", "world_v").join(status, "clip_id").where((F.col("status") == "both") | (F.col("status") == F.col("surface")))
    if lens_table is not None:
        ideal = lenses.undistorted(lenses.with_lens(own, lens_table, clip="clip_id"), x="screen_x", y="screen_y")
        own = ideal.withColumn("screen_x", F.col("ideal_x")).withColumn("screen_y", F.col("ideal_y")).drop("lens", "ideal_x", "ideal_y")
    seen = shared.written(own, "calibration")
    source = ("screen_x", "screen_y")

    def matrices(rows: DataFrame, target: tuple[str, str], name: str) -> DataFrame:
        found = solvers.homographies(rows, group="clip_id", source=source, target=target)
        return found.select("clip_id", F.flatten("matrix").alias(f"to_{name}"), F.col("residual").alias(f"{name}_dlt"))

    front = shared.written(matrices(seen.where("surface = 'front'"), ("world_h", "world_v"), "front"), "front")
    back = seen.where("surface = 'back'").withColumns({"target_h": F.col("world_h"), "target_v": F.col("world_v")})
    target, last = back, None
    for turn in range(passes if frame.refracts else 1):
        if turn:
            camera = tuple(F.col(c) for c in ("x", "y", "z"))
            at = geometry.apparent_position((F.col("world_h"), F.col("world_v")), camera, front=frame.front, back=frame.back, thickness=frame.thickness, n_medium=frame.n_medium, n_surface=frame.n_surface)
            known = back.join(last.select("clip_id", "x", "y", "z"), "clip_id", "left")
            target = known.withColumns({f"target_{a}": F.coalesce(c, F.col(f"world_{a}")) for a, c in zip("hv", at)}).drop("x", "y", "z")
            target = shared.written(target, "target")
        own = shared.written(matrices(target, ("target_h", "target_v"), "back"), "back")
        lines = _sight(target.join(front, "clip_id").join(own, "clip_id"), frame)
        met = aggregates.meeting_points(lines, group="clip_id", front=("fh", "fv", "fd"), back=("bh", "bv", "bd")).select("clip_id", "x", "y", "z")
        last = shared.written(own.join(met, "clip_id", "left"), "camera")
    cameras = status.join(front, "clip_id", "left").join(last, "clip_id", "left")
    placed = seen.where("surface = 'front'").withColumns({"target_h": F.col("world_h"), "target_v": F.col("world_v")}).unionByName(target.select(*back.columns))
    on = placed.join(cameras.drop("status"), "clip_id")
    here, there = (F.col("screen_x"), F.col("screen_y")), (F.col("target_h"), F.col("target_v"))
    gaps = []
    for side in SURFACES:
        cells, is_side = _cells(f"to_{side}"), F.col("surface") == side
        gaps += [F.avg(F.when(is_side, geometry.distance(geometry.project(cells, here), there))).alias(f"{side}_world"), F.avg(F.when(is_side, geometry.distance(geometry.project(geometry.inverse(cells), there), here))).alias(f"{side}_pixel")]
    lines = _sight(on, frame)
    off = geometry.to_line((F.col("x"), F.col("y"), F.col("z")), (F.col("fh"), F.col("fv"), F.col("fd")), (F.col("bh"), F.col("bv"), F.col("bd")))
    residuals = lines.groupBy("clip_id").agg(*gaps, F.avg(F.when(F.col("surface") == "back", off)).alias("camera_pld"))
    back_to = F.when(F.col("to_front").isNotNull(), F.array(*geometry.inverse(_cells("to_front"))))
    whole = cameras.join(residuals, "clip_id").withColumns({"front_to_screen": back_to, "camera_h": F.col("x"), "camera_v": F.col("y"), "camera_d": F.col("z")})
    return whole.select(*[f.split()[0] for f in CAMERA.split(", ")])


TASK_VIEWS = 200_000  # views that one task brings together, about a kilobyte each


def recalculate(screen_points: DataFrame, cameras: DataFrame, frame: solvers.Frame, *, iterative: bool = True, views: int | None = None) -> DataFrame:
    """Every point of ``screen_points`` (``point_id, clip_id, screen_x, screen_y``: undistorted) in space.

    Lines of sight, the linear meeting point with its mean distance, and, if asked
    for, the point with the least reprojection error; with the error's root mean
    square and the nearest camera's distance. A point needs two calibrated views.
    Its views come together once, in one shuffle, in parts of some :data:`TASK_VIEWS`; they are no more than its project's
    clips. ``views`` is the number of clicks at most, where it is known; else they are counted.
    Clips that are calibrated on one plane only give no view.
    """
    parts = (screen_points.count() if views is None else views) // TASK_VIEWS + 1
    seen = screen_points.join(cameras.where(F.col("to_front").isNotNull() & F.col("to_back").isNotNull()), "clip_id")
    p = (F.col("screen_x"), F.col("screen_y"))
    front = geometry.project([F.col("to_front")[i] for i in range(9)], p)
    back = geometry.project([F.col("to_back")[i] for i in range(9)], p)
    sights = seen.select("point_id", "clip_id", "screen_x", "screen_y", "camera_h", "camera_v", "camera_d", "front_to_screen", front[0].alias("fh"), front[1].alias("fv"), back[0].alias("bh"), back[1].alias("bv"))
    # Dealt before they are gathered: as parts of an aggregate they would be sorted where they are read, however many that are.
    # Their order makes the sums come out alike, to the last digit, whatever else is solved beside them.
    lines = sights.repartition(parts, "point_id").sortWithinPartitions("point_id", "clip_id", "screen_x", "screen_y").withColumns({"fd": F.lit(frame.front), "bd": F.lit(frame.back)})
    here = F.struct("fh", "fv", "fd", "bh", "bv", "bd", "screen_x", "screen_y", "camera_h", "camera_v", "camera_d", F.col("front_to_screen").alias("to_screen"), F.lit(frame.front).alias("front_depth"))
    met = aggregates.meeting_points(lines, group="point_id", front=("fh", "fv", "fd"), back=("bh", "bv", "bd"), also=[F.sort_array(F.collect_list(here)).alias("views")])
    at = (F.col("x"), F.col("y"), F.col("z"))
    gaps = F.transform("views", lambda v: geometry.to_line(at, (v["fh"], v["fv"], v["fd"]), (v["bh"], v["bv"], v["bd"])))
    linear = met.withColumn("pld", F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g) / F.col("n"))
    cameras_of = F.transform("views", lambda v: F.array(v["camera_h"], v["camera_v"], v["camera_d"]))
    if iterative:
        rows = linear.select("point_id", "n", "pld", F.col("x").alias("h0"), F.col("y").alias("v0"), F.col("z").alias("d0"), "views", cameras_of.alias("cameras"))
        solved = solvers.triangulate_rows(rows)
    else:
        solved = linear.select("point_id", "n", "pld", F.col("x").alias("h"), F.col("y").alias("v"), F.col("z").alias("depth"), F.lit(None).cast("double").alias("rms"), cameras_of.alias("cameras"))
    near = F.array_min(F.transform("cameras", lambda c: geometry.distance((F.col("h"), F.col("v"), F.col("depth")), (c[0], c[1], c[2]))))
    return solved.select("point_id", "n", "pld", "h", "v", "depth", "rms", near.alias("camera_distance"))


SOLVED = ("n", "pld", "h", "v", "depth", "rms", "camera_distance")


def view_digests(screen_points: DataFrame, cameras: DataFrame) -> DataFrame:
    """A number for each point that changes with its views and with their cameras: ``point_id, digest``. Sums, in any order."""
    of = [c for c in cameras.columns if c != "clip_id"]
    seen = screen_points.join(cameras.select("clip_id", F.xxhash64(*of).alias("__camera")), "clip_id", "left")
    one = F.xxhash64("clip_id", "screen_x", "screen_y", "__camera")
    sums = seen.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(F.shiftrightunsigned(one, 16)).alias("s"))
    return sums.select("point_id", F.xxhash64("n", "x", "s").alias("digest"))


def recalculate_changed(solved: DataFrame | None, screen_points: DataFrame, cameras: DataFrame, frame: solvers.Frame, *, iterative: bool = True) -> DataFrame:
    """``solved`` brought up to the given views and cameras: ``point_id``, :data:`SOLVED`, ``digest, dirty``.

    A point whose views or cameras differ from those that it was solved from is
    solved again and becomes dirty; only such points' views reach the solver. New points are solved, those
    without a view go, the others stay as they are. A point with under two
    calibrated views has nulls for all that is solved. ``solved`` is this function's own earlier
    result, or None for the first time.
    """
    now = view_digests(screen_points, cameras)
    if solved is None:
        again, kept = now, None
    else:
        both = now.join(solved.select("point_id", F.col("digest").alias("__old")), "point_id", "left")
        again = both.where(~F.col("digest").eqNullSafe(F.col("__old"))).select("point_id", "digest")
        kept = solved.join(both.where(F.col("digest").eqNullSafe(F.col("__old"))).select("point_id"), "point_id", "left_semi")
    views = screen_points if kept is None else screen_points.join(again.select("point_id"), "point_id", "left_semi")
    # All clicks are counted, not those of what changed, which would take the search for them twice.
    found = recalculate(views, cameras, frame, iterative=iterative, views=screen_points.count())
    fresh = again.join(found, "point_id", "left").select("point_id", *SOLVED, "digest", F.lit(True).alias("dirty"))
    return fresh if kept is None else kept.select(*fresh.columns).unionByName(fresh)


def plane_coordinates(screen_points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each click on each calibrated plane of its clip: adds ``front_h, front_v, back_h, back_v``, null on a plane that is not calibrated.

    ``screen_points`` is undistorted and has ``clip_id, screen_x, screen_y``; clicks on clips without a calibration have nulls.
    """
    p = (F.col("screen_x"), F.col("screen_y"))
    seen = screen_points.join(cameras.select("clip_id", "to_front", "to_back"), "clip_id", "left")
    planes = {f"{side}_{a}": c for side in SURFACES for a, c in zip("hv", geometry.project(_cells(f"to_{side}"), p))}
    return seen.withColumns(planes).drop("to_front", "to_back")


def reprojected(points: DataFrame, screen_points: DataFrame, cameras: DataFrame, lens_table: DataFrame, frame: solvers.Frame) -> DataFrame:
    """Where each click's solved point falls on the clip's screen, bent by the clip's lens: ``point_id, clip_id, screen_x, screen_y``.

    ``points`` has ``point_id, h, v, depth``; those without a place give no row.
    """
    there = screen_points.select("point_id", "clip_id").join(points.where("h is not null and v is not null and depth is not null").select("point_id", "h", "v", "depth"), "point_id")
    seen = there.join(cameras.select("clip_id", "front_to_screen", "camera_h", "camera_v", "camera_d"), "clip_id")
    camera = (F.col("camera_h"), F.col("camera_v"), F.col("camera_d"))
    h, v, _ = geometry.on_plane(camera, (F.col("h"), F.col("v"), F.col("depth")), F.lit(frame.front))
    x, y = geometry.project(_cells("front_to_screen"), (h, v))
    ideal = seen.select("point_id", "clip_id", x.alias("ideal_x"), y.alias("ideal_y"))
    bent = lenses.redistorted(lenses.with_lens(ideal, lens_table, clip="clip_id"), x="ideal_x", y="ideal_y")
    return bent.select("point_id", "clip_id", "screen_x", "screen_y")


def hint_lines(screen_points: DataFrame, targets: DataFrame, cameras: DataFrame, lens_table: DataFrame, *, key: str, width: float, height: float, step: float, pad: float) -> DataFrame:
    """The lines of sight of clicks as other clips show them: ``key, clip_id, to_clip, place, screen_x, screen_y``.

    ``screen_points`` has ``key, clip_id, screen_x, screen_y`` as clicked and ``targets`` the pairs ``clip_id, to_clip``. A click is
    undistorted by its clip's lens and meets both planes; the two points are projected to the other clip,
    the straight line through them is sampled every ``step`` pixels in x and in y inside the padded frame, and
    the samples are bent by the other clip's lens. ``place`` counts from 1 by descending x. Samples that the lens can't reach
    have null coordinates.
    """
    ideal = lenses.undistorted(lenses.with_lens(screen_points, lens_table, clip="clip_id"), x="screen_x", y="screen_y").select(key, "clip_id", F.col("ideal_x").alias("screen_x"), F.col("ideal_y").alias("screen_y"))
    planes = plane_coordinates(ideal, cameras).select(key, "clip_id", *[f"{s}_{a}" for s in SURFACES for a in "hv"])
    other = cameras.select(F.col("clip_id").alias("to_clip"), *[F.when(F.col(f"to_{s}").isNotNull(), F.array(*geometry.inverse(_cells(f"to_{s}")))).alias(f"from_{s}") for s in SURFACES])
    both = planes.join(targets, "clip_id").join(other, "to_clip")
    ends = [geometry.project(_cells(f"from_{s}"), (F.col(f"{s}_h"), F.col(f"{s}_v"))) for s in SURFACES]
    lines = both.select(key, "clip_id", "to_clip", *[c.alias(f"__{n}{a}") for n, e in zip("ab", ends) for a, c in zip("xy", e)])
    a, b = (tuple(F.col(f"__{n}{x}") for x in "xy") for n in "ab")
    samples = lines.select(key, "clip_id", "to_clip", F.posexplode(geometry.line_samples(a, b, width, height, step, pad)).alias("place", "at"))
    flat = samples.select(key, "clip_id", "to_clip", (F.col("place") + 1).alias("place"), F.col("at.x").alias("ideal_x"), F.col("at.y").alias("ideal_y"))
    own = lens_table.select(F.col("clip_id").alias("to_clip"), "cx", "cy", "k", "p")
    return lenses.redistorted(lenses.with_lens(flat, own, clip="to_clip"), x="ideal_x", y="ideal_y").select(key, "clip_id", "to_clip", "place", "screen_x", "screen_y")
