"""Tables that an iterative operator writes down between its rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder stands in, in local mode alone.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="stereolith-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


_kept: dict[str, SparkSession] = {}  # folders of tables that have not been deleted


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written to the shared folder and read from there: a lost executor costs a read, not the rounds before."""
    path = f"{folder(df.sparkSession)}/stereolith/{tag}-{uuid.uuid4().hex}"
    _kept[path] = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def delete(df: DataFrame) -> None:
    """Delete the files of a table from :func:`written` that nothing reads any more."""
    _delete(df.sparkSession, df._folder)


def release_all() -> None:
    """Delete what operators have written for results that are lazily read; call it once those results are stored."""
    for path, spark in list(_kept.items()):
        _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _kept.pop(folder, None)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
