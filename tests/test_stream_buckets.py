"""Streams call Python and keep state by buckets of keys, and give each key what its own rows give."""

from datetime import datetime, timedelta

import pytest

from stakewise.plans import streams
from stakewise.sources.readers import scratch
from stakewise.streaming.replay import inventory_step, late_inventory, stream_inventory

ROW = "game string, team long, pitch_order long, inning int, outcome string"
BIG = 2**53 + 1


def plays():
    made = []
    for number in range(300):
        for game, team in ((f"g{number}", BIG + number), (None, number), (f"g{number}", None)):
            # Orders beside a null of another key stay whole; outcomes differ by key.
            made += [(game, team, BIG + i, 8 + i, [None, "upheld", "overturned"][(number + i * (team or 1)) % 3]) for i in range(5)]
    return [*made, (None, None, None, 1, "upheld"), (None, None, 2, 1, "upheld"), (None, None, 1, 1, None)]


def wanted(rows):
    keyed = {}
    for row in sorted(rows, key=lambda r: (r[2] is not None, r[2])):
        keyed.setdefault(row[:2], []).append(row[2:])
    return {(*key, r[0], *m) for key, mine in keyed.items() for r, m in zip(mine, inventory_step((2, None), {"inning": [r[1] for r in mine], "outcome": [r[2] for r in mine]})[1], strict=True)}


def run(spark, batches, replay):
    source, state, out = (scratch(spark, n) for n in ("source", "state", "out"))
    kept = []
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = replay(spark.readStream.schema(batch.schema).parquet(source))
        going = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        going.awaitTermination()
        kept.append(going.lastProgress["stateOperators"][0]["numRowsTotal"])
    return kept, [tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()]


@pytest.mark.parametrize("buckets", [3, 700])
def test_keys_share_states_and_stay_apart(spark, buckets):
    rows = plays()
    parts = [spark.createDataFrame(list(p), ROW) for p in ([r for r in rows if r[2] is None or r[2] < BIG + 2], [r for r in rows if r[2] is not None and r[2] >= BIG + 2])]
    kept, got = run(spark, parts, lambda s: stream_inventory(s, ["game", "team"], ["pitch_order"], buckets=buckets))
    assert max(kept) <= buckets
    assert len(got) == len(rows) and set(got) == wanted(rows)


def test_late_keys_share_states_and_stay_apart(spark):
    schema = ROW + ", ts timestamp"
    start = datetime(2024, 1, 1)
    rows = [(*r, start + timedelta(minutes=0 if r[2] is None else r[2] - BIG if r[2] >= BIG else r[2])) for r in plays()]
    # The later half arrives first, and one row in two comes again.
    parts = [rows[1::2] + rows[::4], rows[::2], [("end", 0, 1, 1, None, start + timedelta(days=30))]]
    kept, got = run(spark, [spark.createDataFrame(p, schema) for p in parts], lambda s: late_inventory(s, ["game", "team"], "ts", ["pitch_order"], "2 hours", buckets=3))
    assert max(kept) <= 3
    assert len(got) == len(rows) and set(got) == wanted([r[:5] for r in rows])


def test_queries_deal_keys_by_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert [streams.bucketed(spark, n) for n in (0, 10**6, 10**9)] == [4 * cores, 200, 200_000]
    rows = spark.createDataFrame([r for r in plays() if r[2] is not None], ROW)
    seen = []

    def replay(s, keys, order, **kw):
        seen.append(kw)
        return stream_inventory(s, keys, order, **kw)

    assert streams.streamed(spark, rows, replay).count() == rows.count()
    assert seen == [{"buckets": 4 * cores}] * 2


def test_keys_that_no_dictionary_can_tell_apart_are_refused(spark):
    with pytest.raises(TypeError, match="key k is a double"):
        stream_inventory(spark.createDataFrame([], "k double, i int, inning int, outcome string"), ["k"], ["i"])
