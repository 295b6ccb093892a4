"""Exports: points and lines as delimited text, projects as nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import sequences, shared


def nodes(frames: DataFrame, text_col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The lines ``h,v`` of each frame's text as points: those that parse, numbered from 1 in their frame, beside the frame's ``keys``.

    A row is a frame, so nothing is shuffled. A frame whose text is null or has no such line gives no row.
    """
    parsed = F.filter(F.transform(F.split(text_col, "\r\n|\n|\r"), text.parse_node), lambda n: n.isNotNull())
    numbered = frames.select(*keys, F.posexplode(parsed).alias("__i", "__n"))
    return numbered.select(*keys, (F.col("__i") + 1).alias("index"), F.col("__n.h").alias("world_h"), F.col("__n.v").alias("world_v"))


def write_points_csv(points: DataFrame, path: str, order: list[str], title: str | None = None, sep: str = ",") -> bool:
    """The point table as delimited text with a header, quoted where a field holds the separator; nothing for an empty table.

    With a ``title`` that is the first line, before the header. Returns whether anything was written.
    """
    if points.isEmpty():
        return False
    if title is None:
        points.orderBy(*order).write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
        return True
    options = {"sep": sep, "quote": '"', "escape": '"'}
    lines = points.orderBy(*order).select(F.to_csv(F.struct(*points.columns), options).alias("line"))
    head = points.sparkSession.createDataFrame([(i, line) for i, line in enumerate((title, sep.join(points.columns)))], "i int, line string").coalesce(1).sortWithinPartitions("i").select("line")
    head.unionByName(lines).write.text(path)  # the parts of a union keep their order
    return True


def write_lines_tsv(lines: DataFrame, path: str, order: list[str]) -> None:
    """The line table as tab-separated text with a header."""
    lines.orderBy(*order).write.option("header", True).option("sep", "\t").csv(path)


def write_project_xml(documents: DataFrame, path: str, *, root: str = "projects", row: str = "project") -> None:
    """Nested rows as XML."""
    documents.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)


def nest(parent: DataFrame, child: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """``parent`` with its children as an array of structs by ``order``; an empty one without any."""
    fields = [c for c in child.columns if c != key]
    own = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias(name))
    empty = F.array().cast(own.schema[name].dataType)
    return parent.join(own, key, "left").withColumn(name, F.coalesce(name, empty))


def nest_in_pieces(parent: DataFrame, child: DataFrame, key: str, name: str, order: str, most: int, piece: str) -> DataFrame:
    """As :func:`nest`, but a parent of more than ``most`` children is as many rows as they need, numbered from 0 in ``piece``.

    Only children of such parents are placed, by ranges of their order, so no parent sits whole in one task.
    """
    fields = [c for c in child.columns if c not in (key, order)]
    large = shared.written(child.groupBy(key).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > most).select(key), "large")
    rows = child.withColumn(piece, F.lit(0).cast("long"))
    if not large.isEmpty():
        at = sequences.placed(child.join(large, key, "left_semi"), first=key, rest=(order, *fields), name="__at")
        begins = shared.written(at.groupBy(key).agg(F.min("__at").alias("__begin")), "begins")
        cut = at.join(begins, key).withColumn(piece, F.floor((F.col("__at") - F.col("__begin")) / most))
        rows = rows.join(large, key, "left_anti").unionByName(cut.select(*rows.columns))
    own = rows.groupBy(key, piece).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))
    empty = F.array().cast(own.schema[name].dataType)
    joined = parent.join(own, key, "left")
    return joined.select(*parent.columns, F.coalesce(name, empty).alias(name), F.coalesce(piece, F.lit(0)).alias(piece))


def export_name(project: Column, date: Column, time: Column, custom: Column) -> Column:
    """The name of an exported file."""
    return text.sanitize_file_name(text.join_parts(project, date, time, custom))


def frame_spine(spans: DataFrame, *, start: str, end: str, step: str) -> DataFrame:
    """A row for each frame time from start to end, both included, as ``frame`` and ``t``."""
    count = F.floor((F.col(end) - F.col(start)) / F.col(step) + 1e-9).cast("int")
    return spans.where(count >= 0).withColumn("frame", F.explode(F.sequence(F.lit(0), count))).withColumn("t", F.col(start) + F.col("frame") * F.col(step))
