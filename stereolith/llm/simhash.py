"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common point within half the
radius of both. Every distinct fingerprint emits all points of its own half
ball; one shuffle brings those with a common point together. Copies share one
fingerprint, so a large group of copies emits no more than one document does,
and a point is emitted by no more fingerprints than its half ball has points.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, plain_names, release, slices, text_column, tied
from .components import connected_components

SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted; 0 if it has no word."""
    import xxhash

    words = text.lower().split()  # of bytes: only A-Z and ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = [len(w) for w in words]
    starts = list(accumulate((n + 1 for n in sizes), initial=0))
    last = shingle - 1
    ones = np.zeros(64, np.int64)
    total = len(words) - last
    for k in range(0, total, _BLOCK):
        stop = min(k + _BLOCK, total)
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[k:stop], starts[k + shingle : stop + shingle])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(df: DataFrame, *, id_col: str, text_col: str, shingle: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``__id``, the ``carry`` columns and ``fp`` (the fingerprint's bits as a long) of every row, written down."""
    rows = df.select(F.col(id_col).alias("__id"), *[F.col(c) for c in carry], text_column(text_col).cast("binary").alias("__text"))
    keep = rows.schema.fields[:-1]
    schema = T.StructType([*keep, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            made = np.array([fingerprint(t, shingle) for t in batch.column("__text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], names=schema.names)

    return materialize(rows.mapInArrow(run, schema), "fingerprints")


def ball(radius: int, width: int = 64) -> list[int]:
    """All masks of ``width`` bits of which at most ``radius`` are set, as signed integers of that width."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
    return [m - (1 << width) if m >> (width - 1) else m for m in masks]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges ``a, b`` between the distinct fingerprints of column ``fp`` that join all within ``radius``.

    Fingerprints at one point are all within twice its half ball of each other.
    For an even radius that is the radius, and a chain through them joins what
    all the pairs would; every link of the chain is verified. An odd radius needs
    the half ball rounded up, where a chain could break, so it is refused.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    points = F.transform(F.array(*[F.lit(m) for m in ball(radius // 2)]), lambda m: F.col("fp").bitwiseXOR(m))
    emitted = prints.select("fp", F.explode(points).alias("point"))
    before = F.lag("fp").over(Window.partitionBy("point").orderBy("fp"))
    chain = emitted.select("fp", before.alias("near")).where(F.col("near").isNotNull())
    return chain.select(F.col("fp").alias("a"), F.col("near").alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Each row's ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the least id reachable over links of ``radius`` bits or
    fewer. One row comes out for each row that goes in. Null and empty texts, and
    those of white space alone, have the fingerprint 0, which links like any
    other. Rows with a null id are grouped too; a group of nothing else has a null
    component. Other columns, whatever their names, are not read. An empty table
    gives an empty result.
    """
    made = fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle)
    named = _classes(made, "__id", radius)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return tied(made.join(named, "fp").select(F.col("__id").alias(id_col), digits.alias("fingerprint"), F.col("least").alias("component_id")), made, named)


def _classes(made: DataFrame, value: str, radius: int) -> DataFrame:
    """Every ``fp`` with the ``least`` of ``value`` over all rows of its component."""
    classes = materialize(made.groupBy("fp").agg(F.min(value).alias("own")), "classes")
    components = connected_components(links(classes, radius))
    members = components.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "own")
    roots = members.groupBy("root").agg(F.min("own").alias("shared"))
    linked = members.join(roots, "root").select("fp", "shared", F.lit(True).alias("is_linked"))
    named = materialize(classes.join(linked, "fp", "left").select("fp", F.when(F.col("is_linked"), F.col("shared")).otherwise(F.col("own")).alias("least")), "named")
    release(classes, components)
    return named


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``df`` with one row of each near-duplicate component: that of the smallest id.

    Rows with a null id come after all others; of repeated rows one stays. Columns
    and their order are kept, whatever their names. An empty table stays empty.
    """
    columns = df.columns
    placed = placed_rows(df)
    made = fingerprints(placed, id_col=f"c{columns.index(id_col)}", text_col=f"c{columns.index(text_col)}", shingle=shingle, carry=("__file", "__row"))
    keys = made.select("fp", F.struct(F.col("__id").isNull(), "__id", "__file", "__row").alias("key"))
    named = _classes(keys, "key", radius)
    stay = marked(named.select("least.__file", "least.__row"))
    release(made, named)
    return kept_rows(placed, stay, columns)


def placed_rows(df: DataFrame) -> DataFrame:
    """``df`` with columns ``c0``, ``c1`` ... and each row's place: the hash of its file's name and its number there, which stay however often it is read.

    Rows that don't lie in files are written down first.
    """
    place = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    renamed = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    if "_metadata" not in {c.lower() for c in df.columns} and _in_files(df):
        return df.select(*renamed, *place)
    made = materialize(plain_names(df), "rows")
    return tied(made.select("*", *place), made)


def _in_files(df: DataFrame) -> bool:
    """Whether the rows have a place in files, which the analyser alone can tell."""
    try:
        return bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def marked(places: DataFrame) -> DataFrame:
    """``places`` (``__file, __row``) as bitmaps, 4 KB for each 32,768 rows of a file, written down."""
    block, bit = F.bitmap_bucket_number("__row").alias("__block"), F.bitmap_bit_position("__row")
    return materialize(places.groupBy("__file", block).agg(F.bitmap_construct_agg(bit).alias("__marks")), "marks")


def at_places(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The ``rows`` whose place is in the bitmaps of :func:`marked`; these are broadcast, so that the rows stay where they are."""
    byte = "conv(hex(substring(__marks, cast(bitmap_bit_position(__row) div 8 + 1 as int), 1)), 16, 10)"
    found = rows.withColumn("__block", F.bitmap_bucket_number("__row")).join(F.broadcast(marks), ["__file", "__block"])
    return found.where(f"shiftright(cast({byte} as int), cast(bitmap_bit_position(__row) % 8 as int)) & 1 = 1").select(*rows.columns)


def kept_rows(placed: DataFrame, stay: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of :func:`placed_rows` whose place is in ``stay`` (see :func:`marked`), under their own names."""
    rows = at_places(placed, stay).select(*[f"c{i}" for i in range(len(columns))])
    return tied(rows.toDF(*columns), placed, stay)
