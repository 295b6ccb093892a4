"""Playback that stops by itself, as a stream of commands with state and as a table.

Commands are rows ``key, wall, order, kind, at, rate, stop``: at ``wall`` seconds a
project starts to play (kind ``play``) from the place ``at`` at ``rate``, backwards if that is
negative, until it reaches ``stop``, or is paused (kind ``pause``). The log has a row for
each start, each pause of something that plays and each stop: ``key, wall, what, place``.

A stop falls due ``(stop - at) / rate`` seconds after its start, at once if the stop is
already behind, and never without a stop or at no rate; then the place is the stop. One that is due when the next
command comes counts before it. Commands of other kinds, or without a key or a time, count for nothing; a start
without a place begins at zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, inf

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ("play", "pause")


def _known(commands: DataFrame) -> DataFrame:
    """Commands in the types that the state has."""
    sound = F.col("key").isNotNull() & F.col("wall").isNotNull() & F.col("kind").isin(*KINDS)
    number = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("at", "rate")]
    return commands.where(sound).select("key", F.col("wall").cast("double").alias("wall"), F.col("order").cast("long").alias("order"), "kind", *number, F.col("stop").cast("double").alias("stop"))


def log(commands: DataFrame, until: float | None = None) -> DataFrame:
    """The log of a table of commands; stops that are due after ``until`` have not happened yet."""
    by = Window.partitionBy("key").orderBy("wall", "order")
    left = (F.col("stop") - F.col("at")) / F.nullif(F.col("rate"), F.lit(0.0))
    due = F.when((F.col("kind") == "play") & left.isNotNull(), F.col("wall") + F.greatest(left, F.lit(0.0)))
    rows = _known(commands).withColumn("due", due).select("*", F.lead("wall").over(by).alias("next"), F.lag(F.struct("kind", "wall", "at", "rate", "due")).over(by).alias("last"))

    def entry(wall: Column, what: str, place: Column) -> Column:
        return F.struct(wall.alias("wall"), F.lit(what).alias("what"), place.alias("place"))

    started = F.when(F.col("kind") == "play", entry(F.col("wall"), "playing", F.col("at")))
    over = F.coalesce(F.col("next"), F.lit(inf if until is None else until))
    stopped = F.when(F.col("due") <= over, entry(F.col("due"), "stopped", F.col("stop")))
    last = F.col("last")
    still = (F.col("kind") == "pause") & (last["kind"] == "play") & (last["due"].isNull() | (last["due"] > F.col("wall")))
    paused = F.when(still, entry(F.col("wall"), "paused", last["at"] + (F.col("wall") - last["wall"]) * last["rate"]))
    return rows.select("key", F.explode(F.array_compact(F.array(started, stopped, paused))).alias("e")).select("key", "e.*")


def follow(commands: DataFrame, *, delay: str = "0 seconds") -> DataFrame:
    """The same log of a stream of commands, which come in order by project.

    A project's state is what it plays, from where, since when and until when. A timer on the
    watermark, which trails the times by ``delay``, stops what is due, so that a stop is logged
    once, whether or not a command follows, and also where the stream was restarted from its
    checkpoint in between.
    """
    kind = commands.schema["key"].dataType.simpleString()
    timed = _known(commands).withColumn("seen", F.timestamp_micros((F.col("wall") * 1_000_000).cast("long"))).withWatermark("seen", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        playing, wall, at, rate, due, end = state.get if state.exists else (False, 0.0, 0.0, 0.0, inf, 0.0)
        out: list[tuple] = []
        if state.hasTimedOut:
            if playing:
                out.append((due, "stopped", end))
            state.remove()
        else:
            for row in pd.concat(list(batches)).sort_values(["wall", "order"]).itertuples():
                if playing and due <= row.wall:
                    out.append((due, "stopped", end))
                    playing = False
                if row.kind == "pause":
                    if playing:
                        out.append((row.wall, "paused", at + (row.wall - wall) * rate))
                    playing = False
                    continue
                left = (row.stop - row.at) / row.rate if row.rate and not pd.isna(row.stop) else None
                playing, wall, at, rate = True, row.wall, row.at, row.rate
                due, end = (inf, 0.0) if left is None else (row.wall + max(left, 0.0), row.stop)
                out.append((row.wall, "playing", row.at))
            if playing:
                state.update((playing, wall, at, rate, due, end))
                if due < inf:
                    state.setTimeoutTimestamp(max(ceil(due * 1000), state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", "wall", "what", "place"])

    held = "playing boolean, wall double, at double, rate double, due double, place double"
    return timed.groupBy("key").applyInPandasWithState(step, f"key {kind}, wall double, what string, place double", held, "append", GroupStateTimeout.EventTimeTimeout)
