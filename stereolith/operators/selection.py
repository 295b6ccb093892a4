"""Which rows take part: filters of clips, lines and events, and the orders in which they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, timecode


def the_only(df: DataFrame) -> DataFrame | None:
    """``df`` if it has exactly one row, else nothing."""
    return df if df.limit(2).count() == 1 else None


def clips_to_export(clips: DataFrame, name: str | None = None, *, name_col: str = "name") -> DataFrame:
    """All clips, or those of a name."""
    return clips if name is None else clips.where(F.col(name_col) == name)


def lines_shown(lines: DataFrame, now: Column | None = None, *, t: str = "t") -> DataFrame:
    """All lines, or those made at a time."""
    return lines if now is None else lines.where(timecode.same_time(F.col(t), now))


def is_calibrated(front: Column, back: Column) -> Column:
    """A clip is calibrated once both its planes have a matrix."""
    return front.isNotNull() & back.isNotNull()


def at_calibration_time(now: Column, calibration: Column, offset: Column) -> Column:
    """Whether a clip shows the frame of its calibration; its own time is the master's less its offset."""
    return timecode.same_time(timecode.clip_time(now, offset), calibration)


def responds_to_controls(is_master: Column, locked: Column) -> Column:
    """The master always follows the common controls, other clips while they are locked to it."""
    return is_master | F.coalesce(locked, F.lit(False))


def exports_length(labelled: Column) -> Column:
    """Whether an event's type has its lengths labelled, and so exported."""
    return F.coalesce(labelled, F.lit(0)) != 0


def draws_line(kind: Column, points: Column) -> Column:
    return (F.coalesce(kind, F.lit("None")) != "None") & (points > 1)


def labels_line(labelled: Column, is_master: Column) -> Column:
    """1 labels a line on all clips, 2 on the master alone."""
    return (labelled == 1) | ((labelled == 2) & is_master)


def inside(x: Column, y: Column, width: float, height: float, pad: float) -> Column:
    """Whether a sample lies in a frame that is widened by ``pad`` on each side."""
    return x.between(-pad, width + pad) & y.between(-pad, height + pad)


def members(rows: DataFrame, *, group: str, index: str) -> DataFrame:
    """One row of each group, that of the least index, where any would do."""
    row = F.struct(*rows.columns)
    return rows.groupBy(group).agg(F.min_by(row, index).alias("__row")).select("__row.*")


def event_order(points: DataFrame, *, event: str, t: str) -> DataFrame:
    """Events with their earliest time, by which they are ordered."""
    return points.groupBy(event).agg(F.min(t).alias("earliest"))


def samples_by_x(x: Column, y: Column) -> Column:
    """Samples of a line from two spacings in one array, by descending x."""
    both = F.arrays_zip(x.alias("x"), y.alias("y"))
    return F.reverse(F.array_sort(both))


def _texts(points: DataFrame, point: str, clip: str, shown: Column, name: str) -> DataFrame:
    """Each point's texts ``shown`` one after another, by the clip's name; those that are null are left out."""
    own = F.struct(F.col(clip), shown.alias("shown"))
    return points.groupBy(point).agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda p: p["shown"]), "").alias(name))


def screen_points_text(points: DataFrame, *, point: str, clip: str, x: str, y: str, digits: int = 2) -> DataFrame:
    """Each point's screen points as text, ``clip: {x,y}`` and three blanks, by the clip's name."""
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return _texts(known, point, clip, F.concat(F.col(clip), F.lit(": "), text.pair(F.col(x), F.col(y), digits), F.lit("   ")), "screen_points")


def frame_points_text(points: DataFrame, *, point: str, clip: str, front: tuple[str, str], back: tuple[str, str], has_front: Column, has_back: Column, digits: int = 4) -> DataFrame:
    """Each point's coordinates on the frame's planes as text, by the clip's name; of each clip the planes that are calibrated."""

    def side(word: str, at: tuple[str, str], ok: Column) -> Column:
        shown = F.concat(F.col(clip), F.lit(f"{word}: "), text.pair(F.col(at[0]), F.col(at[1]), digits), F.lit("   "))
        return F.when(ok, F.coalesce(shown, F.lit(""))).otherwise("")

    return _texts(points, point, clip, F.concat(side("Front", front, has_front), side("Back", back, has_back)), "frame_points")


def measured_points(points: DataFrame, *, order: tuple[str, ...], shown: dict[str, Column]) -> DataFrame:
    """The export of points: those with coordinates, with the columns shown, in order."""
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*order, *[c.alias(n) for n, c in shown.items() if n not in order]).orderBy(*order)


def clip_problems(clips: DataFrame, *, project: str, name: str = "name", path: str = "path", found: str = "found", tracks: str = "video_tracks", playable: str = "playable", timescale: str = "timescale", is_master: str = "is_master") -> DataFrame:
    """Clips with ``is_usable`` and ``problem``, the message on opening one; null where there is nothing to say.

    A clip whose file is missing, has no video track or can't be played is not usable; the first of these
    counts, and what is not known counts as so. One whose time scale differs from its project's master's is usable, with a warning.
    """
    master = clips.where(F.col(is_master)).groupBy(project).agg(F.min(timescale).alias("__master"))
    place = F.concat(F.lit("clip '"), F.col(name), F.lit("' at location "), F.col(path))
    lost = ~F.coalesce(F.col(found), F.lit(False))
    no_video = F.coalesce(F.col(tracks), F.lit(0)) < 1
    still = ~F.coalesce(F.col(playable), F.lit(False))
    differs = F.col(timescale) != F.col("__master")
    message = (
        F.when(lost, F.concat(F.lit("No file was found for "), place, F.lit(".")))
        .when(no_video, F.concat(F.lit("A file was found for "), place, F.lit(", but it is not recognized as a playable video.")))
        .when(still, F.concat(F.lit("A video file was found for "), place, F.lit(", but it is not playable.")))
        .when(differs, F.concat(F.lit("The time scale of clip '"), F.col(name), F.lit("' differs from the master clip's.")))
    )
    return clips.join(master, project, "left").withColumn("is_usable", ~(lost | no_video | still)).withColumn("problem", message).drop("__master")
