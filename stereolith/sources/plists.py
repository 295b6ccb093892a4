"""Property-list files: frame geometry, calibration, distortion and types.

Each is a Python data source for reading and a small writer. The formats are
positional arrays whose age shows in their number of elements.
"""

from __future__ import annotations

import plistlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAME = "path string, front_text string, back_text string, plane_front double, plane_back double, refraction boolean, thickness double, surface_index double, medium_index double"
CALIBRATION = FRAME.replace("plane_back double,", "plane_back double, axis_horizontal string, axis_vertical string, is_master boolean, timecode string,") + (
    ", points array<struct<surface:string,screen_x:double,screen_y:double,world_h:double,world_v:double,index:int>>"
)
DISTORTION = "path string, cx double, cy double, k array<double>, p array<double>, lines array<struct<timecode:string,points:array<struct<x:double,y:double,index:int>>>>"
TYPES = (
    "path string, is_event boolean, name string, notes string, shape string, duration double, fade_time double, size double, color array<double>, "
    "max_num_points int, requires_same_timecode boolean, line_type string, length_labeled int, thickness double, font_size double, digits int, multiplier double, units string, show_length boolean, show_speed boolean"
)


def _frame(path: str, v: list) -> Iterator[tuple]:
    more = (bool(v[4]), float(v[5]), float(v[6]), float(v[7])) if len(v) >= 8 else (False, None, None, None)
    yield (path, v[0], v[1], float(v[2]), float(v[3]), *more)


def _calibration(path: str, v: list) -> Iterator[tuple]:
    points = [(s, float(p[0]), float(p[1]), float(p[2]), float(p[3]), int(p[4])) for s, own in (("front", v[6]), ("back", v[7])) for p in own]
    more = (bool(v[10]), float(v[11]), float(v[12]), float(v[13])) if len(v) >= 14 else (False, None, None, None)
    yield (path, v[0], v[1], float(v[2]), float(v[3]), v[4], v[5], bool(v[8]), v[9], *more, points)


def _distortion(path: str, v: list) -> Iterator[tuple]:
    radial, decentering = (7, 4) if len(v) >= 14 else (3, 3)
    k = [float(x) for x in v[2 : 2 + radial]] + [0.0] * (7 - radial)
    p = [float(x) for x in v[2 + radial : 2 + radial + decentering]] + [0.0] * (4 - decentering)
    lines = [(t, sorted(((float(x), float(y), int(i)) for x, y, i in own), key=lambda q: q[2])) for t, own in v[2 + radial + decentering]]
    yield (path, float(v[0]), float(v[1]), k, p, lines)


def _types(path: str, v: list) -> Iterator[tuple]:
    for is_event, own in ((False, v[0]), (True, v[1])):
        for d in own:
            color = d.get("color")
            if isinstance(color, dict):
                color = [float(color.get(c, 1.0)) for c in ("red", "green", "blue", "alpha")]
            line = "connectingLine"
            yield (
                path, is_event, d.get("name"), d.get("notes"), d.get("shape"), _number(d, "duration"), _number(d, "fadeTime"), _number(d, "size"), color,
                _whole(d, "maxNumPoints"), bool(d["requiresSameTimecode"]) if "requiresSameTimecode" in d else None, d.get(f"{line}Type"), _whole(d, f"{line}LengthLabeled"),
                _number(d, f"{line}Thickness"), _number(d, f"{line}LengthLabelFontSize"), _whole(d, f"{line}LengthLabelFractionDigits"), _number(d, f"{line}LengthLabelUnitMultiplier"), d.get(f"{line}LengthLabelUnits"),
                bool(d.get(f"{line}LabelShowLength", False)), bool(d.get(f"{line}LabelShowSpeed", False)),
            )


def _number(d: dict, key: str) -> float | None:
    return float(d[key]) if d.get(key) is not None else None


def _whole(d: dict, key: str) -> int | None:
    return int(d[key]) if d.get(key) is not None else None


KINDS = {"frame": (FRAME, _frame), "calibration": (CALIBRATION, _calibration), "distortion": (DISTORTION, _distortion), "types": (TYPES, _types)}


class _Files(DataSourceReader):
    def __init__(self, paths: list[str], rows):
        self.paths, self.rows = paths, rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as file:
            yield from self.rows(partition.value, plistlib.load(file))


class PlistSource(DataSource):
    """``spark.read.format("plist").option("kind", ...).load(file or folder)``; a task reads each file."""

    @classmethod
    def name(cls) -> str:
        return "plist"

    def schema(self) -> str:
        return KINDS[self.options["kind"]][0]

    def reader(self, schema) -> DataSourceReader:
        path = Path(self.options["path"])
        return _Files(sorted(map(str, path.iterdir())) if path.is_dir() else [str(path)], KINDS[self.options["kind"]][1])


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    spark.dataSource.register(PlistSource)
    return spark.read.format("plist").option("kind", kind).load(path)


def write(kind: str, row, path: str) -> None:
    """One frame, calibration or distortion row as a file."""
    if kind == "frame":
        value = [row.front_text, row.back_text, row.plane_front, row.plane_back, *_slab(row)]
    elif kind == "calibration":
        own = {s: [[p.screen_x, p.screen_y, p.world_h, p.world_v, p["index"]] for p in sorted((p for p in row.points if p.surface == s), key=lambda p: p["index"])] for s in ("front", "back")}
        value = [row.front_text, row.back_text, row.plane_front, row.plane_back, row.axis_horizontal, row.axis_vertical, own["front"], own["back"], row.is_master, row.timecode, *_slab(row)]
    elif kind == "distortion":
        lines = [[line.timecode, [[p.x, p.y, p["index"]] for p in sorted(line.points, key=lambda p: p["index"])]] for line in row.lines]
        value = [row.cx, row.cy, *row.k, *row.p, lines]
    else:
        raise ValueError(f"no plist of kind {kind}")
    with open(path, "wb") as file:
        plistlib.dump(value, file)


def _slab(row) -> list:
    return [] if row.thickness is None else [row.refraction, row.thickness, row.surface_index, row.medium_index]


def write_types(rows: list, path: str) -> None:
    """Type rows as a file: object types, then event types, each by name; null notes as ``nil``."""
    line = "connectingLine"
    own: tuple[list, list] = ([], [])
    for r in sorted(rows, key=lambda r: r.name):
        d = {"name": r.name, "notes": r.notes if r.notes is not None else "nil", "shape": r.shape, "duration": r.duration, "fadeTime": r.fade_time, "size": r["size"]}
        if r.color is not None:
            d["color"] = dict(zip(("red", "green", "blue", "alpha"), r.color))
        if r.is_event:
            d |= {
                "maxNumPoints": r.max_num_points, "requiresSameTimecode": r.requires_same_timecode, f"{line}Type": r.line_type, f"{line}LengthLabeled": r.length_labeled, f"{line}Thickness": r.thickness,
                f"{line}LengthLabelFontSize": r.font_size, f"{line}LengthLabelFractionDigits": r.digits, f"{line}LengthLabelUnitMultiplier": r.multiplier, f"{line}LengthLabelUnits": r.units,
                f"{line}LabelShowLength": r.show_length, f"{line}LabelShowSpeed": r.show_speed,
            }
        own[r.is_event].append({k: v for k, v in d.items() if v is not None})
    with open(path, "wb") as file:
        plistlib.dump(list(own), file)
