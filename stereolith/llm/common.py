"""What the operators of this subpackage share: the work folder and Arrow slicing."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder stands in, but only in
    local mode: on a cluster executors can't see the driver's disk.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="stereolith-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and both passes of a two-pass operator see the same rows in the same parts.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return tied(spark.read.schema(df.schema).parquet(path), path)


_kept: set[str] = set()  # folders of tables that have not been released


def new_folder(spark: SparkSession, tag: str) -> str:
    """The name of a folder in the shared one, for a table to be written there."""
    path = f"{work_dir(spark)}/stereolith/{tag}-{uuid.uuid4().hex}"
    _kept.add(path)
    return path


def tied(df: DataFrame, *owners: str | DataFrame) -> DataFrame:
    """``df``, which reads the folders of ``owners``: :func:`release` of it deletes them."""
    df._folders = [f for o in owners for f in ([o] if isinstance(o, str) else getattr(o, "_folders", []))]
    return df


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`materialize` that nothing reads any more."""
    for df in tables:
        for folder in getattr(df, "_folders", []):
            _delete(df.sparkSession, folder)


def release_all(spark: SparkSession) -> None:
    """Delete whatever operators have written for results that are lazily read; call it once those results are stored."""
    for folder in list(_kept):
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _kept.discard(folder)


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``c0``, ``c1`` and so on, so that no helper's name clashes with one of them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_column(name: str):
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 15 << 18


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches of the session cut at 3.75 MB, so that a slice holds one, unless it sets a size itself.

    A batch stands in the executor and in the Python worker at once, and one of 10,000
    long texts takes tens of megabytes in each, for every task that runs.
    """
    if BATCHES not in spark.conf.getAll:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice holds over ``limit`` bytes of text, unless it is one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        first = total = 0
        for i, n in enumerate(sizes):
            if i > first and total + (n or 0) > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n or 0
        if first < len(sizes):
            yield batch.slice(first)


FAN_IN = 64
SUM_SCHEMA = "name string, block int, part int, sums binary"


def pack_integers(values: np.ndarray) -> bytes:
    """Integers by their bytes, the high ones of which are mostly zero, compressed."""
    width = values.dtype.itemsize
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T), 1)


def unpack_integers(packed: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(width, -1).T).view(kind).ravel()


def sum_rows(name: str, part: int, total: np.ndarray, cut: int = 1 << 16, kind: type = np.int64) -> Iterator[pa.RecordBatch]:
    """One task's integer sums as rows for :func:`tree_sum`, a row for each ``cut`` cells."""
    flat = total.ravel().astype(kind)
    for block, k in enumerate(range(0, len(flat), cut)):
        packed = pack_integers(flat[k : k + cut])
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["name", "block", "part", "sums"])


def tree_sum(rows: DataFrame, parts: int, merge: dict[str, Callable[[list[np.ndarray]], np.ndarray]] | None = None) -> dict[str, np.ndarray]:
    """The sums of all tasks' arrays by name; ``merge`` has other ways for names of 32-bit arrays, applied in the order of the parts.

    They are added up in a tree: no task gets more than ``FAN_IN`` tasks' blocks,
    and the driver gets arrays whose size the caller fixes, whatever the input.
    """

    ways = merge or {}
    kind_of = lambda name: np.uint32 if name in ways else np.int64

    def add(table: pa.Table) -> pa.Table:
        name = table.column("name")[0].as_py()
        arrays = (unpack_integers(x, kind_of(name)) for _, x in sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist(), strict=True), key=lambda r: r[0]))
        total = ways[name](list(arrays)) if name in ways else sum(arrays)
        group = table.column("part")[0].as_py() // FAN_IN
        return pa.table({"name": table.column("name")[:1], "block": table.column("block")[:1], "part": pa.array([group], pa.int32()), "sums": pa.array([pack_integers(total)], pa.binary())})

    while True:
        rows = rows.groupBy("name", "block", F.expr(f"part div {FAN_IN}")).applyInArrow(add, SUM_SCHEMA)
        parts = math.ceil(parts / FAN_IN)
        if parts <= 1:
            break
    found: dict[str, list] = {}
    for r in rows.collect():
        found.setdefault(r.name, []).append((r.block, unpack_integers(r.sums, kind_of(r.name))))
    return {name: np.concatenate([x for _, x in sorted(blocks, key=lambda b: b[0])]) for name, blocks in found.items()}
