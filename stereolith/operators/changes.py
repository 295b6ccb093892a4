"""Changes to the tables, each a function from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecode
from ..settings import DEFAULTS


def add_links(bridge: DataFrame, links: DataFrame) -> DataFrame:
    """The links of both, each once."""
    return bridge.unionByName(links).distinct()


def remove_links(bridge: DataFrame, links: DataFrame) -> DataFrame:
    """The links without those given."""
    return bridge.join(links, list(links.columns), "left_anti")


def upsert_types(old: DataFrame, new: DataFrame, *, name: str = "name", flags: tuple[str, ...] = (), notes: str = "notes", order: Column | None = None) -> DataFrame:
    """``old`` with the types of ``new`` in: those of a known name are overwritten, all of that name; others are added.

    Flags that a new type lacks become false. Notes that read ``nil`` or are null
    keep the old ones. Of a name that ``new`` has twice the last row by ``order`` counts,
    as a whole; without an order the greatest.
    """
    rest = [c for c in new.columns if c != name]
    row = F.struct(*rest)
    last = new.groupBy(name).agg(F.max_by(row, row if order is None else F.struct(order.alias("at"), row.alias("row"))).alias("__row"))
    once = last.select(name, *[F.col("__row")[c].alias(f"__{c}") for c in rest], F.lit(True).alias("__given"))

    def value(c: str) -> Column:
        given = F.col(f"__{c}")
        if c in flags:
            given = F.coalesce(given, F.lit(False))
        if c == notes:
            return F.when(F.col("__given") & given.isNotNull() & (given != "nil"), given).otherwise(F.col(c))
        return F.when(F.col("__given"), given).otherwise(F.col(c))

    return old.join(once, name, "full").select(name, *[value(c).alias(c) for c in rest])


def split_object(bridge: DataFrame, points: DataFrame, obj: object, at: float, new: object, *, obj_col: str = "object_id", event: str = "event_id", t: str = "t") -> DataFrame:
    """The links with an object's later events moved to a new object.

    An event moves if its earliest point is after ``at``; one without points stays.
    """
    first = points.groupBy(event).agg(F.min(t).alias("__first"))
    moves = (F.col(obj_col) == obj) & (F.col("__first") > at)
    return bridge.join(first, event, "left").withColumn(obj_col, F.when(moves, F.lit(new)).otherwise(F.col(obj_col))).drop("__first").select(*bridge.columns)


def merge_objects(bridge: DataFrame, kept: object, dropped: object, *, obj_col: str = "object_id") -> DataFrame:
    """The links with one object's events given to another, each link once."""
    return bridge.withColumn(obj_col, F.when(F.col(obj_col) == dropped, F.lit(kept)).otherwise(F.col(obj_col))).distinct()


def merged_notes(kept: Column, dropped: Column) -> Column:
    return F.concat_ws("\n", kept, dropped)


def delete_object(events: DataFrame, bridge: DataFrame, obj: object, *, obj_col: str = "object_id", event: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """The events and links without an object: events that no other object has go with it."""
    shared = bridge.groupBy(event).agg(F.count_distinct(obj_col).alias("n"), F.bool_or(F.col(obj_col) == obj).alias("has"))
    gone = shared.where("has and n = 1").select(event)
    return events.join(gone, event, "left_anti"), bridge.where(F.col(obj_col) != obj)


def deletable(types: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Types that no row depends on."""
    return types.join(rows.select(key).distinct(), key, "left_anti")


def blocking(rows: DataFrame, *, key: str, shown: str, most: int = 10) -> DataFrame:
    """For each type, the names that stand in the way of its deletion: the first ``most``, and how many more."""
    names = F.array_sort(F.collect_set(shown))
    return rows.groupBy(key).agg(names.alias("all")).select(key, F.slice("all", 1, most).alias("first"), F.greatest(F.size("all") - most, F.lit(0)).alias("more"))


def prune_points(points: DataFrame, screen_points: DataFrame, point: str) -> DataFrame:
    """Points that still have a screen point."""
    return points.join(screen_points.select(point).distinct(), point, "left_semi")


def nudge(df: DataFrame, where: Column, dx: float, dy: float, *, x: str = "screen_x", y: str = "screen_y", by: float = DEFAULTS.nudge_pixels) -> DataFrame:
    """Moves the chosen points by steps of ``by`` pixels."""
    return df.withColumn(x, F.when(where, F.col(x) + dx * by).otherwise(F.col(x))).withColumn(y, F.when(where, F.col(y) + dy * by).otherwise(F.col(y)))


def clear_coordinates(df: DataFrame, where: Column, *, x: str = "screen_x", y: str = "screen_y") -> DataFrame:
    """Deleting a calibration point leaves it without screen coordinates."""
    return df.withColumn(x, F.when(~where, F.col(x))).withColumn(y, F.when(~where, F.col(y)))


def null_origin(df: DataFrame, *, x: str = "screen_x", y: str = "screen_y", old: Column | None = None) -> DataFrame:
    """(0, 0) stands for no coordinates in old data: null it once, when reading.

    Where ``old`` is given, it tells the rows of old data; in others (0, 0) is a place like any other.
    """
    origin = (F.col(x) == 0) & (F.col(y) == 0)
    return clear_coordinates(df, origin if old is None else origin & old, x=x, y=y)


def fill_next(points: DataFrame, group: str, index: str, *, x: str = "screen_x") -> DataFrame:
    """The point that the next click fills: each group's first without coordinates."""
    return points.where(F.col(x).isNull()).groupBy(group).agg(F.min(index).alias(index))


def clone(df: DataFrame, where: Column, *, key: str, new_key: Column) -> DataFrame:
    """Copies of the chosen rows under new keys, beside all rows."""
    return df.unionByName(df.where(where).withColumn(key, new_key.cast(df.schema[key].dataType)))


def set_master(clips: DataFrame, master: object, *, clip: str = "clip_id", offset: str = "sync_offset") -> DataFrame:
    """Makes a clip the master, whose offset is zero."""
    own = F.col(clip) == master
    return clips.withColumn("is_master", own).withColumn(offset, F.when(own, F.lit(0.0)).otherwise(F.col(offset)))


def remove_clip(clips: DataFrame, gone: Column, *, project: str, clip: str = "clip_id", offset: str = "sync_offset") -> DataFrame:
    """The clips without those ``gone``; the last clip left of a project becomes its master, whose offset is zero."""
    left = clips.where(~gone)
    single = left.groupBy(project).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1")
    joined = left.join(single, project, "left")
    last = F.col("__n").isNotNull()
    return joined.withColumn("is_master", F.col("is_master") | last).withColumn(offset, F.when(last, F.lit(0.0)).otherwise(F.col(offset))).select(*clips.columns)


def propagate_sync(clips: DataFrame, *, project: str, locked: str = "sync_is_locked") -> DataFrame:
    """A master counts as locked if any other clip of its project is."""
    others = clips.where(~F.col("is_master")).groupBy(project).agg(F.bool_or(locked).alias("__any"))
    return clips.join(others, project, "left").withColumn(locked, F.when(F.col("is_master"), F.coalesce("__any", F.lit(False))).otherwise(F.col(locked))).select(*clips.columns)


def append_row(rows: DataFrame, values: DataFrame, *, group: str, index: str, order: str | None = None) -> DataFrame:
    """``rows`` and, for each row of ``values``, one more of its group, with the next indexes there.

    Several new rows of a group are numbered by ``order``, or else by their other columns.
    """
    last = rows.groupBy(group).agg(F.max(index).alias("__last"))
    by = [order] if order else [c for c in values.columns if c not in (group, index)] or [group]
    new = values.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*by)))
    added = new.join(last, group, "left").withColumn(index, (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast(rows.schema[index].dataType))
    return rows.unionByName(added.select(*rows.columns))


def add_lines(old: DataFrame, new: DataFrame, *, clip: str, line: str, just_add: bool) -> DataFrame:
    """Imported plumb lines: instead of the old ones of their clips, or numbered after them."""
    if not just_add:
        return old.join(new.select(clip).distinct(), clip, "left_anti").select(*old.columns).unionByName(new)
    last = old.groupBy(clip).agg(F.max(line).alias("__last"))
    moved = new.join(last, clip, "left").withColumn(line, (F.col(line) + F.coalesce("__last", F.lit(0))).cast(old.schema[line].dataType))
    return old.unionByName(moved.select(*old.columns))


def clear_lines(lines: DataFrame, clips: DataFrame, *, clip: str) -> DataFrame:
    """The plumb lines without those of the given clips."""
    return lines.join(clips.select(clip).distinct(), clip, "left_anti")


def mark_dirty(points: DataFrame, solved: DataFrame, *, point: str, flag: str = "dirty") -> DataFrame:
    """Sets the flag of each point that was solved anew; others keep theirs."""
    again = solved.select(point).distinct().withColumn("__again", F.lit(True))
    return points.join(again, point, "left").withColumn(flag, F.col(flag) | F.col("__again").isNotNull()).select(*points.columns)


def relocate(clips: DataFrame, where: Column, path: Column, is_valid: Column, *, path_col: str = "path") -> DataFrame:
    """Points the chosen clips to another file, unless that isn't a valid one."""
    return clips.withColumn(path_col, F.when(where & is_valid, path).otherwise(F.col(path_col)))


def lock_sync(clips: DataFrame, master_time: float, *, clip_time: str, where: Column, offset: str = "sync_offset", locked: str = "sync_is_locked") -> DataFrame:
    """Locks clips at what they show now: the offset is the master's time less the clip's."""
    return clips.withColumn(offset, F.when(where, master_time - F.col(clip_time)).otherwise(F.col(offset))).withColumn(locked, F.when(where, F.lit(True)).otherwise(F.col(locked)))


def set_values(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Gives the chosen rows new values, such as a project's calibration time or the start and end of a capture."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def nudge_shown(df: DataFrame, where: Column, now: Column, dx: float, dy: float, *, t: str, x: str = "screen_x", y: str = "screen_y", by: float = DEFAULTS.nudge_pixels) -> DataFrame:
    """Moves the chosen screen points that were made at the time shown now; others stay."""
    return nudge(df, where & timecode.same_time(F.col(t), now), dx, dy, x=x, y=y, by=by)


def change_screen_points(points: DataFrame, before: DataFrame, after: DataFrame, *, point: str, solved: tuple[str, ...]) -> DataFrame:
    """The points after their screen points changed from ``before`` to ``after``.

    A point without a screen point goes. Of one whose screen points differ, what was solved is null until it is solved
    again; others keep it.
    """
    columns = [c for c in before.columns if c != point]
    state = [F.array_sort(F.collect_list(F.struct(*columns))).alias("s")]
    old = before.groupBy(point).agg(*state).withColumnRenamed("s", "__old")
    new = after.groupBy(point).agg(*state).withColumnRenamed("s", "__new")
    joined = points.join(new, point).join(old, point, "left")
    same = F.col("__old").eqNullSafe(F.col("__new"))
    return joined.withColumns({c: F.when(same, F.col(c)) for c in solved}).select(*points.columns)


def numbered(rows: DataFrame, key: str, *, width: int = 1 << 16) -> DataFrame:
    """``key`` and ``n``, its place from 1 among all distinct keys; keys are whole numbers.

    Places are counted within ranges of ``width`` keys, and only the ranges' counts are summed in one task.
    """
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__range", F.floor(F.col(key) / width))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keys.groupBy("__range").agg(F.count(F.lit(1)).alias("__c")).select("__range", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return keys.withColumn("__own", own).join(ranges, "__range").select(key, (F.col("__before") + F.col("__own")).alias("n"))


def deep_clone(tables: dict[str, DataFrame], where: Column, *, keys: dict[str, str | None], links: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """All tables with copies of the chosen rows of the first one and of all that hangs on them.

    ``tables`` come parents first. ``keys`` names each table's own key, a whole number, or None, and
    ``links`` for each table its columns that point to another: ``{table: {column: parent}}``. A row is copied if any
    row that it points to is; a link to a row that is not copied, or that is null, stays as it is. Copies' keys go on without
    gaps after the highest one, in the order of the old keys, and links between copies lead to copies.
    """
    new_keys: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for place, (name, rows) in enumerate(tables.items()):
        columns = rows.columns
        moved, chosen = rows, where if place == 0 else F.lit(False)
        for i, (column, parent) in enumerate(links.get(name, {}).items()):
            if parent not in new_keys:
                continue
            moved = moved.join(new_keys[parent].select(F.col("old").alias(column), F.col("new").alias(f"__new{i}")), column, "left")
            chosen = chosen | F.col(f"__new{i}").isNotNull()
        copies = moved.where(chosen)
        for i, column in enumerate(links.get(name, {})):
            if f"__new{i}" in copies.columns:
                copies = copies.withColumn(column, F.coalesce(F.col(f"__new{i}").cast(rows.schema[column].dataType), F.col(column)))
        key = keys.get(name)
        if key is not None:
            last = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("__last"))
            ids = numbered(copies, key).crossJoin(F.broadcast(last)).select(F.col(key).alias("old"), (F.col("__last") + F.col("n")).alias("new"))  # beside one row
            new_keys[name] = ids
            copies = copies.join(ids.withColumnRenamed("old", key), key).withColumn(key, F.col("new").cast(rows.schema[key].dataType))
        out[name] = rows.unionByName(copies.select(*columns))
    return out


def delete_screen_points(points: DataFrame, screen_points: DataFrame, where: Column, *, point: str) -> tuple[DataFrame, DataFrame]:
    """Points and screen points without the chosen clicks; a point that has none left goes with them."""
    left = screen_points.where(~F.coalesce(where, F.lit(False)))
    touched = screen_points.where(where).select(point).distinct()
    gone = touched.join(left.select(point).distinct(), point, "left_anti")
    return points.join(gone, point, "left_anti"), left


def delete_line_points(points: DataFrame, where: Column, *, line: tuple[str, ...], index: str = "index") -> DataFrame:
    """Plumb points without the chosen ones, those of a line numbered anew from 0; a line that has none left is gone."""
    left = points.where(~F.coalesce(where, F.lit(False)))
    again = F.row_number().over(Window.partitionBy(*line).orderBy(index)) - 1
    return left.withColumn(index, again.cast(points.schema[index].dataType))


def stamp_saved(projects: DataFrame, where: Column, *, saved: Column, folder: Column, home: str, date_col: str = "date_last_saved", paths: dict[str, str]) -> DataFrame:
    """The chosen projects as they are when saved: with the date, and with ``folder`` for each path of ``paths`` that is not set.

    ``paths`` has the default folder below ``home`` of each path column; a path that is null, empty or this default counts as not set.
    """
    out = {date_col: F.when(where, saved).otherwise(F.col(date_col))}
    for column, default in paths.items():
        unset = F.col(column).isNull() | F.col(column).isin("", f"{home}/{default}")
        out[column] = F.when(where & unset, folder).otherwise(F.col(column))
    return projects.withColumns(out)
