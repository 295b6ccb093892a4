"""What is shown at each tick of a clock, as a stream of ticks against a table of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK = 0.03  # seconds between two looks while playing; a fixed value


def ticks(spark: SparkSession, path: str) -> DataFrame:
    """A stream of master times ``t`` from Parquet files as they arrive."""
    return spark.readStream.schema("t double").parquet(path)


def clock(spark: SparkSession, rate: float = 1.0) -> DataFrame:
    """A stream of master times that plays at ``rate``."""
    return spark.readStream.format("rate").option("rowsPerSecond", round(1 / TICK)).load().select((F.col("value") * TICK * rate).alias("t"))


def visible(stream: DataFrame, items: DataFrame, *, start: str, duration: str, fade: str, width: float) -> DataFrame:
    """Every tick beside every item that it shows; a stream-static equality join on time buckets."""
    end = F.col(start) + F.col(duration) + F.col(fade)
    low, high = F.floor(F.col(start) / width).cast("long"), F.floor(end / width).cast("long")
    spread = items.where(end > F.col(start)).withColumn("__b", F.explode(F.sequence(low, high)))
    placed = stream.withColumn("__b", F.floor(F.col("t") / width).cast("long"))
    return placed.join(spread, "__b").where((F.col(start) <= F.col("t")) & (F.col("t") < end)).drop("__b")
