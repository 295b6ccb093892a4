"""What a project looks like outside: wide rows for tables, and one nested document for each project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, timecode
from ..operators import sequences, shared
from ..sources import exports

#: The columns of the point export, in order.
POINT_COLUMNS = ("objects", "event", "timecode", "time", "x", "y", "z", "pld_error", "reprojection_error", "nearest_camera_distance")


def object_labels(bridge: DataFrame, objects: DataFrame) -> DataFrame:
    """Each event's objects as one text, by type and index: ``event_id, objects``.

    ``objects`` has ``object_id, type, index, name``, ``bridge`` has ``event_id, object_id``. Texts are made once an
    event's objects are together, so that they aren't shuffled.
    """
    named = bridge.join(objects, "object_id").groupBy("event_id").agg(F.collect_list(F.struct("type", "index", "name")).alias("o"))
    shown = F.transform("o", lambda o: F.struct(o["type"].alias("type"), o["index"].alias("index"), text.label(o["type"], o["index"], o["name"]).alias("shown")))
    return named.select("event_id", F.array_join(F.transform(F.array_sort(shown), lambda o: o["shown"]), ", ").alias("objects"))


def point_rows(points: DataFrame, events: DataFrame, bridge: DataFrame, objects: DataFrame, screen_points: DataFrame | None = None) -> DataFrame:
    """A row for each point with coordinates, with :data:`POINT_COLUMNS` after ``event_id`` and ``index``.

    ``points`` has ``event_id, index, timecode, x, y, z, pld_error, reprojection_error, nearest_camera_distance``, ``events``
    ``event_id, type, index, name, notes``. With ``screen_points`` (``event_id, index, clip, cell``) the cells of each
    point by clip follow as ``screen_coordinates``. An event without objects has an empty text. Points and cells are dealt once, by event.
    """
    labels = object_labels(bridge, objects)
    rows = points.where(F.col("x").isNotNull())
    columns = [F.col(c) for c in POINT_COLUMNS]
    if screen_points is not None:
        # In one table, points and what belongs to them meet in a sum by (event, index) of what is dealt by event alone; a join would deal both again.
        kept = [c for c in points.columns if c not in ("event_id", "index")]
        dealt = rows.select("event_id", "index", F.struct(*kept).alias("__p")).unionByName(screen_points.select("event_id", F.col("index"), F.struct("clip", "cell").alias("__s")), allowMissingColumns=True)
        held = dealt.repartition("event_id").groupBy("event_id", "index").agg(F.collect_list("__p").alias("__p"), F.collect_list("__s").alias("__s"))
        rows = held.select("event_id", "index", F.explode("__p").alias("__p"), F.when(F.col("index").isNotNull(), F.col("__s")).alias("__s")).select("event_id", "index", "__p.*", "__s")
        columns.append(F.coalesce(F.array_join(F.transform(F.array_sort("__s"), lambda s: s["cell"]), " "), F.lit("")).alias("screen_coordinates"))
    shown = events.select("event_id", F.struct("type", F.col("index"), "name", "notes").alias("__e"))
    rows = rows.join(shown, "event_id").join(labels, "event_id", "left")
    event = text.label_with_notes(*[F.col(f"__e.{c}") for c in ("type", "index", "name", "notes")])
    return rows.withColumns({"event": event, "objects": F.coalesce("objects", F.lit("")), "time": timecode.seconds(F.col("timecode"))}).select("event_id", "index", *columns)


def line_rows(segments: DataFrame, events: DataFrame, bridge: DataFrame, objects: DataFrame) -> DataFrame:
    """A row for each segment of an event whose type has its lengths labelled: ``event_id, index, object, event, length, speed``.

    ``segments`` has ``event_id, index, length, speed``, ``events`` also ``length_labeled``.
    """
    shown = events.where(F.coalesce("length_labeled", F.lit(0)) != 0).select("event_id", text.label(F.col("type"), F.col("index"), F.col("name")).alias("event"))
    rows = segments.join(shown, "event_id").join(object_labels(bridge, objects), "event_id", "left")
    return rows.select("event_id", "index", F.coalesce("objects", F.lit("")).alias("object"), "event", "length", "speed")


def project_documents(projects: DataFrame, objects: DataFrame, events: DataFrame, bridge: DataFrame, points: DataFrame, screen_points: DataFrame, clips: DataFrame, annotations: DataFrame, *, most: int = 5_000, piece: int = 1_000) -> DataFrame:
    """Projects as nested rows: objects with their events, points and screen points, and clips with their annotations.

    Children are keyed by ``project_id``, ``object_id``, ``event_id``, ``point_id`` and ``clip_id``; each level is an array
    by ``index`` (screen points by ``clip``, clips and annotations by ``name`` and ``timecode``). An event of several
    objects is in each of them, with short forms of all its objects beside its points. Calibrations, plumb lines and
    other columns that ``clips`` has come along as they are.

    A project is one row for each ``most`` of its elements in the document's order, numbered from 0 in ``part``, so a
    row is bounded whatever a project holds. An object or event that goes on in the next part stands there again as ``continued``; so does
    a point or clip after each ``piece`` of its screen points or annotations.
    """
    project, place = F.col("project_id").alias("__project"), ("__side", "__o", "__e", "__kind")

    def at(side, o, e, kind):
        return [F.lit(side).alias("__side"), o.cast("long").alias("__o"), e.cast("long").alias("__e"), F.lit(kind).alias("__kind")]

    def element(df, order, *without, name):
        return F.struct(order, *[c for c in df.columns if c not in (order, *without)]).alias(name)

    none, o, e = F.lit(None), F.col("__o"), F.col("__e")
    shot = exports.nest_in_pieces(points, screen_points, "point_id", "screenpoints", "clip", piece, "__piece")
    filmed = exports.nest_in_pieces(clips, annotations, "clip_id", "annotations", "timecode", piece, "__piece")
    short = bridge.join(objects.select("object_id", "type", "index"), "object_id").select("event_id", "index", "type")
    things = sequences.placed(objects.select(project, "object_id", element(objects, "index", "project_id", name="__object")), first="__project", rest=("__object",), name="__o")
    timed = bridge.join(events, "event_id")
    timed = timed.select("object_id", "event_id", element(timed, "index", "object_id", name="__event")).join(things.select("object_id", "__project", "__o"), "object_id")
    happened = sequences.placed(timed.select("__project", "__o", "event_id", "__event"), first="__o", rest=("__event",), name="__e")
    where = happened.select("event_id", "__project", "__o", "__e")

    stream = [
        projects.select(project, *at(0, none, none, 0)).distinct(),
        things.select("__project", *at(1, o, none, 0), "__object"),
        happened.select("__project", *at(1, o, e, 0), "__event"),
        shot.join(where, "event_id").select("__project", *at(1, o, e, 1), element(points, "index", "event_id", name="__point"), "__piece", "screenpoints"),
        short.join(where, "event_id").select("__project", *at(1, o, e, 2), F.struct("index", "type").alias("__short")),
        filmed.select(project, *at(2, none, none, 0), element(clips, "name", "project_id", name="__clip"), "__piece", "annotations"),
    ]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), stream).where(F.col("__project").isNotNull())
    rows = sequences.placed(rows, first="__project", rest=(*place, "__point", "__short", "__clip", "__piece"), name="__place")
    begins = shared.written(rows.groupBy("__project").agg(F.min("__place").alias("__begin")), "begins")
    cut = rows.join(begins, "__project").withColumn("part", F.floor((F.col("__place") - F.col("__begin")) / most)).drop("__begin")

    # What is open where a part begins stands in it again, as the projects do in all their parts.
    opened = shared.written(cut.groupBy("__project", "part").agg(F.min_by(F.struct(*place), "__place").alias("f")).select("__project", "part", "f.*"), "opened")
    again, still = ["__project", "part"], F.lit(True).alias("__continued")
    heads = [
        opened.where("__e is not null").select(*again, "__o").join(things.drop("__project"), "__o").select(*again, *at(1, o, none, 0), "__object", still),
        opened.where("__kind > 0").select(*again, "__e").join(happened.drop("__project"), "__e").select(*again, *at(1, o, e, 0), "__event", still),
        opened.select(*again).join(projects.select(project, F.struct(*projects.columns).alias("__whole")), "__project").select(*again, *at(0, none, none, 0), "__whole"),
    ]
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [cut, *heads]).repartition("__project", "part")

    def listed(test, key, value):
        pairs = F.array_sort(F.collect_list(F.when(test, F.struct(F.col(key).alias("k"), value.alias("v")))))
        return F.transform(pairs, lambda x: x["v"])

    def whole(name, fields, *more):
        return F.struct(*[F.col(f"{name}.{c}") for c in fields], *more)

    names = {n: both.schema[n].dataType.names for n in ("__object", "__event", "__point", "__clip")}
    later = F.coalesce(F.col("__piece") > 0, F.lit(False)).alias("continued")
    level = both.groupBy(*again, "__side", "__o", "__e").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("__object", "__event")], F.coalesce(F.bool_or("__continued"), F.lit(False)).alias("continued"),
        listed(F.col("__point").isNotNull(), "__place", whole("__point", names["__point"], "screenpoints", later)).alias("points"),
        F.array_sort(F.collect_list("__short")).alias("objects"),
        listed(F.col("__clip").isNotNull(), "__place", whole("__clip", names["__clip"], "annotations", later)).alias("videoClips"),
        F.collect_list("__whole").alias("__wholes"),
    )
    level = level.groupBy(*again, "__side", "__o").agg(
        F.first("__object", ignorenulls=True).alias("__object"), F.coalesce(F.bool_or(F.when(e.isNull(), F.col("continued"))), F.lit(False)).alias("continued"),
        listed(e.isNotNull(), "__e", whole("__event", names["__event"], "points", "objects", "continued")).alias("events"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("videoClips", "__wholes")],
    )
    level = level.groupBy(*again).agg(
        listed(o.isNotNull(), "__o", whole("__object", names["__object"], "events", "continued")).alias("objects"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("videoClips", "__wholes")],
    )
    found = level.withColumn("__whole", F.explode("__wholes")).select("__whole.*", "part", "objects", "videoClips")
    bare = [F.array().cast(found.schema[c].dataType).alias(c) for c in ("objects", "videoClips")]
    return found.unionByName(projects.where(F.col("project_id").isNull()).select("*", F.lit(0).cast("long").alias("part"), *bare))


def comparison(clicked: DataFrame, reprojected: DataFrame, keys: list[str]) -> DataFrame:
    """Where each screen point was clicked and where its solved point falls, with the distance between: ``keys, screen_x, screen_y, ideal_x, ideal_y, off``."""
    both = clicked.join(reprojected.select(*keys, F.col("screen_x").alias("ideal_x"), F.col("screen_y").alias("ideal_y")), keys)
    return both.select(*keys, "screen_x", "screen_y", "ideal_x", "ideal_y", F.hypot(F.col("ideal_x") - F.col("screen_x"), F.col("ideal_y") - F.col("screen_y")).alias("off"))


def export_projects(documents: DataFrame, points: DataFrame, path: str, *, flag: str = "dirty") -> DataFrame:
    """Write the project documents as XML under ``path``; returns the points with no flag set, as they now stand in a file. A failed write raises and leaves the flags."""
    exports.write_project_xml(documents, path)
    return points.withColumn(flag, F.lit(False))
