"""Playback as a stream against the same log of a table, seeded draws, deep copies."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stereolith import queries
from stereolith.functions import draws
from stereolith.operators import changes
from stereolith.streaming import playback

DATA = "/root/testdata/sf0.001"
SCHEMA = "key long, wall double, order long, kind string, at double, rate double, stop double"


def test_log_of_commands(spark):
    rows = [
        (1, 0.0, 0, "play", 10.0, 2.0, 20.0),  # due at 5
        (1, 3.0, 1, "pause", None, None, None),
        (1, 4.0, 2, "pause", None, None, None),  # nothing plays
        (1, 6.0, 3, "play", 16.0, -1.0, 10.0),  # due at 12, with the next command
        (1, 12.0, 4, "pause", None, None, None),
        (1, 13.0, 5, "play", 5.0, 1.0, 1.0),  # the stop is behind
        (1, 14.0, 6, "play", 5.0, 0.0, 9.0),  # never gets there
        (2, 1.0, 0, "play", None, 1.0, None),
        (2, 2.0, 1, "look", 1.0, 1.0, 1.0),
        (None, 1.0, 0, "play", 1.0, 1.0, 2.0),
        (3, None, 0, "play", 1.0, 1.0, 2.0),
        (4, 0.0, 0, "play", 0.0, 1.0, 100.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [(1, 0.0, "playing", 10.0), (1, 3.0, "paused", 16.0), (1, 6.0, "playing", 16.0), (1, 12.0, "stopped", 10.0), (1, 13.0, "playing", 5.0), (1, 13.0, "stopped", 1.0), (1, 14.0, "playing", 5.0), (2, 1.0, "playing", 0.0), (4, 0.0, "playing", 0.0), (4, 100.0, "stopped", 100.0)]
    assert sorted(tuple(r) for r in playback.log(df).collect()) == want
    assert sorted(tuple(r) for r in playback.log(df, until=50.0).collect()) == want[:-1]
    assert playback.log(df.where("key = 9")).collect() == []


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_stream_stops_once_also_after_a_restart(spark, tmp_path):
    commands = queries._commands(spark, DATA).where("key < 12")
    want = playback.log(commands)
    latest = max(r.wall for r in want.collect())
    bounds = [r.wall for r in commands.selectExpr("explode(percentile(wall, array(0.2, 0.4, 0.6, 0.8))) as wall").collect()]
    flush = spark.createDataFrame([(10**6, latest + 100.0 + i, i, "pause", None, None, None) for i in range(1)], SCHEMA)
    edges = [float("-inf"), *bounds, float("inf")]
    steps = [commands.where((F.col("wall") > a) & (F.col("wall") <= b)) for a, b in zip(edges, edges[1:])] + [flush]
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for rows in steps:  # each is a run of its own, from the checkpoint of the one before
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        playback.follow(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    rounded = lambda df: sorted((r.key, round(r.wall, 6), r.what, round(r.place, 6)) for r in df.collect())
    assert rounded(spark.read.parquet(sink)) == rounded(want)
    assert want.where("what = 'stopped'").count() > 20


def test_draws_do_not_depend_on_the_layout(spark):
    df = spark.range(20_000).withColumn("u", draws.uniform(5, F.col("id"), low=2.0, high=10.0))
    few, many = ({r.id: r.u for r in df.repartition(n).collect()} for n in (1, 16))
    assert few == many and all(2.0 <= u < 10.0 for u in few.values())
    cells = [0] * 16
    for u in few.values():
        cells[int((u - 2.0) * 2)] += 1
    assert sum((c - 1250) ** 2 / 1250 for c in cells) < 38  # chi-square of 15 degrees, one in a thousand
    other = df.withColumn("v", draws.uniform(6, F.col("id"))).withColumn("w", draws.uniform(5, F.col("id"), 1))
    assert abs(other.corr("u", "v")) < 0.03 and abs(other.corr("u", "w")) < 0.03
    assert spark.sql("select cast(null as long) as id").select(draws.uniform(5, F.col("id"))).first()[0] is None
    assert {r.p for r in df.select(draws.pick(1, F.col("id"), F.lit(3)).alias("p")).distinct().collect()} == {0, 1, 2}


def test_deep_copies_keep_their_links(spark):
    people = spark.createDataFrame([(1, "a"), (70_000, "b"), (200_000, "c")], "id long, name string")
    notes = spark.createDataFrame([(10, 1, None), (11, 70_000, 1), (12, 200_000, 70_000), (13, None, None)], "id long, owner long, reader long")
    lines = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z"), (99, "w")], "note long, text string")
    out = changes.deep_clone({"people": people, "notes": notes, "lines": lines}, F.col("id") > 1000, keys={"people": "id", "notes": "id"}, links={"notes": {"owner": "people", "reader": "people"}, "lines": {"note": "notes"}})
    got = {n: sorted((tuple(r) for r in t.collect()), key=str) for n, t in out.items()}
    assert got["people"] == sorted([(1, "a"), (70_000, "b"), (200_000, "c"), (200_001, "b"), (200_002, "c")], key=str)
    assert got["notes"] == sorted([(10, 1, None), (11, 70_000, 1), (12, 200_000, 70_000), (13, None, None), (14, 200_001, 1), (15, 200_002, 200_001)], key=str)
    assert got["lines"] == sorted([(10, "x"), (11, "y"), (12, "z"), (99, "w"), (14, "y"), (15, "z")], key=str)
