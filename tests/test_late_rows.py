"""Streams whose rows arrive out of order, repeat, or come too late."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stakewise.plans.streams import PARTITIONS, partitioned, rocksdb, streamed_late
from stakewise.sources.readers import scratch
from stakewise.streaming.replay import late_inventory, late_mass

ROW = "g string, ts timestamp, i int, inning int, outcome string"
START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def runs(spark, batches, replay):
    source, state, out = (scratch(spark, n) for n in ("source", "state", "out"))
    seen = []
    with rocksdb(spark):
        for batch in batches:
            spark.createDataFrame(batch, ROW).coalesce(1).write.mode("append").parquet(source)
            stream = replay(spark.readStream.schema(ROW).parquet(source))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
            seen.append({(r.g, r.i): (r.before, r.after, r.invalid) for r in spark.read.schema(stream.schema).parquet(out).collect()})
    assert len(seen[-1]) == spark.read.schema(stream.schema).parquet(out).count()
    return seen


def test_rows_wait_for_their_turn(spark):
    batches = [
        # Out of order; 3 and 4 share a time; the null key has rows of its own.
        [("a", at(30), 3, 1, "upheld"), ("a", at(10), 1, 1, "upheld"), ("a", at(30), 4, 1, "upheld"), (None, at(10), 1, 1, None), ("b", at(100), 1, 1, "upheld")],
        # 2 lies before rows that are there; 4 is fetched again with another outcome; a row without a time never counts.
        [("a", at(20), 2, 1, None), ("a", at(30), 4, 1, "overturned"), ("a", None, 9, 1, "upheld"), ("b", at(200), 2, 1, "upheld")],
        # Too late: a new row, and a row that has counted, with another outcome.
        [("a", at(5), 0, 1, "upheld"), ("a", at(10), 1, 1, "overturned"), ("b", at(2000), 3, 1, None)],
        [("c", at(9000), 1, 1, None)],
    ]
    seen = runs(spark, batches, lambda s: late_inventory(s, ["g"], "ts", ["i"], "2 hours"))
    assert seen[0] == {}
    a = {("a", 1): (2, 1, False), ("a", 2): (1, 1, False), ("a", 3): (1, 0, False), ("a", 4): (0, 0, True)}
    null = {(None, 1): (2, 2, False)}
    assert seen[1] == a | null
    assert seen[2] == a | null | {("b", 1): (2, 1, False), ("b", 2): (1, 0, False)}
    assert seen[3] == seen[2] | {("b", 3): (0, 0, False)}


def test_empty_table(spark):
    rows = spark.createDataFrame([], "game string, team long, ts timestamp, event_id long, pitch_order int, inning int, p1 double, p2 double, success boolean, stake double")
    assert streamed_late(spark, rows, late_mass).count() == 0
    assert streamed_late(spark, rows.select("game", "team", "ts", "event_id", "pitch_order", "inning", F.lit("x").alias("outcome")), late_inventory).count() == 0


def test_late_rows_need_no_state_store_of_their_own(spark):
    source, state, out = (scratch(spark, n) for n in ("source", "state", "out"))
    for batch in ([("a", at(30), 2, 1, "upheld"), ("a", at(10), 1, 1, None)], [(None, at(9000), 1, 1, None)]):
        spark.createDataFrame(batch, ROW).coalesce(1).write.mode("append").parquet(source)
        stream = late_inventory(spark.readStream.schema(ROW).parquet(source), ["g"], "ts", ["i"], "2 hours")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert {(r.g, r.i): (r.before, r.after) for r in spark.read.schema(stream.schema).parquet(out).collect()} == {("a", 1): (2, 2), ("a", 2): (2, 1)}


def test_state_has_partitions_by_rows(spark):
    before = spark.conf.get(PARTITIONS)
    cores = spark.sparkContext.defaultParallelism
    try:
        spark.conf.set(PARTITIONS, "200")
        for count, want in ((0, cores), (1_000_000, 20), (10**9, 200)):
            with partitioned(spark, count):
                assert spark.conf.get(PARTITIONS) == str(want)
        assert spark.conf.get(PARTITIONS) == "200"
    finally:
        spark.conf.set(PARTITIONS, before)
