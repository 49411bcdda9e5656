"""Keyed streams over the stand-in timeline, in two runs or more from one checkpoint, against the SQL of the batch folds."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from stakewise.plans import sequential  # noqa: F401  registers the folds whose SQL holds here too
from stakewise.plans.base import KEYS, ORDER, SQL, nearest, query, rounded, table, timeline
from stakewise.sources.readers import scratch
from stakewise.streaming.replay import late_inventory, late_mass, stream_inventory, stream_mass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
#: Rows of the whole stream for each partition of its state.
ROWS_A_PARTITION = 50_000
#: Rows of the whole stream for each bucket of keys.
ROWS_A_BUCKET = 5_000


@contextlib.contextmanager
def settings(spark, wanted: dict[str, str]):
    """Settings of the streams started inside."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def rocksdb(spark):
    """RocksDB as the state store of the streams started inside, off the executors' heaps."""
    return settings(spark, {PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})


def partitioned(spark, count: int):
    """A state of as many partitions as ``count`` rows need, one a core at least and the session's number at most: each is a task
    and a committed file in every batch, and the number stays with the checkpoint."""
    cores, most = spark.sparkContext.defaultParallelism, int(spark.conf.get(PARTITIONS))
    return settings(spark, {PARTITIONS: str(min(most, max(cores, -(-count // ROWS_A_PARTITION))))})


def bucketed(spark, count: int) -> int:
    """As many buckets of keys as ``count`` rows need, four a core at least."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-count // ROWS_A_BUCKET))


def streamed(spark, rows, replay, cut: int = 8):
    """What ``replay`` makes of ``rows`` as a stream: those up to ``cut`` arrive first, the others in a second run."""
    source, state, out = (scratch(spark, n) for n in ("source", "state", "out"))
    rows = rows.cache()
    count = rows.count()
    with partitioned(spark, count):
        for part in (F.col("pitch_order") <= cut, F.col("pitch_order") > cut):
            rows.filter(part).write.mode("append").parquet(source)
            stream = replay(spark.readStream.schema(rows.schema).parquet(source), KEYS, ORDER, buckets=bucketed(spark, count))
            run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            run.awaitTermination()
    rows.unpersist()
    return spark.read.schema(stream.schema).parquet(out)


@query("st1_inventory_stream", SQL["q1_inventory_replay"])
def inventory_stream(spark, sf):
    """ST1: the inventory replay with its state kept between runs of a stream."""
    return rounded(streamed(spark, timeline(spark, sf).select(*KEYS, *ORDER, "inning", "outcome"), stream_inventory))


@query("st2_mass_stream", SQL["q4_expected_mass_replay"])
def mass_stream(spark, sf):
    """ST2: the expected replay with its state kept between runs of a stream."""
    rows = timeline(spark, sf).select(*KEYS, *ORDER, "inning", (F.col("p") * 0.5).alias("p1"), F.col("p").alias("p2"), "success", "stake")
    out = streamed(spark, rows, stream_mass)
    return out.select(*KEYS, F.col("pitch_order").cast("long").alias("pitch_order"), *[nearest(F.col(c), 8).alias(c) for c in ("m0", "m1", "m2", "challenges")], nearest(F.col("captured"), 6).alias("captured"))


def streamed_late(spark, rows, replay, hours: int = 6):
    """What ``replay`` makes of ``rows`` as a stream out of order, in runs from one checkpoint.

    A row arrives up to ``hours`` after its ``ts``, by a hash; the first run ends in the middle of the time, the second at
    its end. One row in eight is fetched again in the run after its own, waiting or long past. A last run brings a row
    without a key that lies beyond the delay, so that the watermark passes all rows.
    """
    source, state, out = (scratch(spark, n) for n in ("source", "state", "out"))
    dice, late = F.xxhash64("event_id"), hours * 3_600_000_000
    arrives = F.unix_micros("ts") + F.pmod(dice, F.lit(late))
    rows = rows.cache()
    first, last, count = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts")), F.count("*")).first()
    if first is None:
        return spark.createDataFrame([], replay(rows, KEYS, "ts", ORDER, f"{hours} hours").schema)
    middle = (first + last) // 2
    again = F.pmod(F.shiftright(dice, 40), F.lit(8)) == 0
    closing = spark.range(1).select(*[(F.timestamp_micros(F.lit(last + 2 * late)) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    parts = [rows.filter(arrives <= middle), rows.filter((arrives > middle) | again), rows.filter(again).unionByName(closing)]
    with rocksdb(spark), partitioned(spark, count):
        for part in parts:
            part.write.mode("append").parquet(source)
            stream = replay(spark.readStream.schema(rows.schema).parquet(source), KEYS, "ts", ORDER, f"{hours} hours", buckets=bucketed(spark, count))
            run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            run.awaitTermination()
    rows.unpersist()
    return spark.read.schema(stream.schema).parquet(out)


def timed(spark, sf):
    return timeline(spark, sf).join(table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "event_id")


@query("st1_late_inventory", SQL["q1_inventory_replay"])
def late_inventory_stream(spark, sf):
    """ST1: the inventory replay of rows that arrive out of order and repeat; they wait for the watermark in keyed state."""
    return rounded(streamed_late(spark, timed(spark, sf).select(*KEYS, *ORDER, "event_id", "ts", "inning", "outcome"), late_inventory))


@query("st2_late_mass", SQL["q4_expected_mass_replay"])
def late_mass_stream(spark, sf):
    """ST2: the expected replay of rows that arrive out of order and repeat."""
    rows = timed(spark, sf).select(*KEYS, *ORDER, "event_id", "ts", "inning", (F.col("p") * 0.5).alias("p1"), F.col("p").alias("p2"), "success", "stake")
    out = streamed_late(spark, rows, late_mass)
    return out.select(*KEYS, F.col("pitch_order").cast("long").alias("pitch_order"), *[nearest(F.col(c), 8).alias(c) for c in ("m0", "m1", "m2", "challenges")], nearest(F.col("captured"), 6).alias("captured"))
