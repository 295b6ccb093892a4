"""Labels, file names and other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_file_name(name: Column) -> Column:
    """Without the characters that file systems forbid."""
    return F.translate(name, '/\\?%*|"<>', "")


def readable_time(code: Column) -> Column:
    """A time code that can stand in a file name."""
    return F.translate(code, ":/", "-+")


def join_parts(*parts: Column) -> Column:
    """The parts that aren't empty, joined by `` - ``; ``Untitled`` if none is left."""
    return F.coalesce(F.nullif(F.concat_ws(" - ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit("")), F.lit("Untitled"))


def label(kind: Column, index: Column, name: Column) -> Column:
    """``kind index (name)``, the name left out if there is none."""
    return F.concat(kind, F.lit(" "), index.cast("string"), F.when(name.isNotNull() & (name != ""), F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(""))


def label_with_notes(kind: Column, index: Column, name: Column, notes: Column) -> Column:
    """As :func:`label`, with the notes of a named item after it."""
    named = name.isNotNull() & (name != "") & notes.isNotNull() & (notes != "")
    return F.concat(label(kind, index, name), F.when(named, F.concat(F.lit(" (Notes: "), notes, F.lit(")"))).otherwise(""))


def number(value: Column, digits: int) -> Column:
    """A number with at most ``digits`` digits after the point, without zeros at the end."""
    fixed = F.format_string(f"%.{digits}f", value.cast("double"))
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def measure(value: Column, multiplier: Column, digits: int, unit: Column) -> Column:
    """A length or speed in the type's unit, with at most ``digits`` digits after the point."""
    return F.concat(number(value * multiplier, digits), F.lit(" "), unit)


def pair(x: Column, y: Column, digits: int) -> Column:
    """Two coordinates as ``{x,y}`` with a fixed number of digits."""
    return F.format_string(f"{{%.{digits}f,%.{digits}f}}", x.cast("double"), y.cast("double"))


def screen_point_cell(clip: Column, screen: tuple[Column, Column], ideal: tuple[Column, Column], front: tuple[Column, Column], back: tuple[Column, Column], digits: int = 15) -> Column:
    """A screen point as it stands in one cell of an export; a coordinate that is missing stays empty."""

    def braces(p: tuple[Column, Column]) -> Column:
        return F.concat(F.lit("{"), *[c for i, v in enumerate(p) for c in ((F.lit(","),) if i else ()) + (F.coalesce(number(v, digits), F.lit("")),)], F.lit("}"))

    return F.concat(clip, F.lit(": screen="), braces(screen), F.lit(" undistorted="), braces(ideal), F.lit(" calibrationFrameFront="), braces(front), F.lit(" calibrationFrameBack="), braces(back))


def resolution(width: Column, height: Column) -> Column:
    return F.concat(width.cast("int").cast("string"), F.lit("x"), height.cast("int").cast("string"))


def annotation(notes: Column, has_timer: Column, elapsed: Column) -> Column:
    """An annotation's text, with the time code of what has elapsed on a line of its own if it has a timer."""
    return F.concat(F.coalesce(notes, F.lit("")), F.when(F.coalesce(has_timer, F.lit(False)), F.concat(F.lit("\n"), elapsed)).otherwise(""))


def capture_name(project: Column, time: Column, custom: Column, clip: Column, extension: str) -> Column:
    """The file name of a capture: project, time in brackets, own text and clip, each left out where null or empty."""
    times = F.when(time.isNotNull() & (time != ""), F.concat(F.lit("("), readable_time(time), F.lit(")")))
    return F.concat(join_parts(project, times, custom, clip), F.lit(f".{extension}"))


def portrait_name(project: Column, kind: Column, index: Column, name: Column, clip: Column, time: Column) -> Column:
    """The path of a portrait below the folder for stills."""
    safe = readable_time(project)
    return F.concat(safe, F.lit(" Portraits/"), label(kind, index, name), F.lit(" from "), safe, F.lit(" ("), clip, F.lit(") at "), readable_time(time), F.lit(".jpg"))


def rate_description(rate: Column) -> Column:
    """What a playback rate is called; the texts are fixed values."""
    return F.when(rate < 1, "(slow motion)").when(rate > 1, "(fast forward/reverse)").when(rate == 1, "(normal speed playback)")


def matrix_text(matrix: Column) -> Column:
    """A matrix as text: cells by comma, rows by semicolon, in scientific notation."""
    return F.array_join(F.transform(matrix, lambda row: F.array_join(F.transform(row, lambda x: F.format_string("%.6e", x)), ", ")), "; ")


def parse_node(line: Column) -> Column:
    """``struct<h, v>`` of a text ``h,v``; null if it isn't one."""
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    form = rf"^\s*({number})\s*,\s*({number})"
    return F.when(line.rlike(form), F.struct(F.regexp_extract(line, form, 1).cast("double").alias("h"), F.regexp_extract(line, form, 2).cast("double").alias("v")))


def export_preset(width: Column) -> Column:
    """The quality to encode again with, by a frame's width."""
    return F.when(width >= 1920, "1080p").when(width >= 1280, "720p").when(width >= 960, "540p").otherwise("480p")
