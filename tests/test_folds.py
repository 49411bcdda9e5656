"""Folds cut into segments give what one array gives, and what a plain loop gives."""

import random

import pytest
from pyspark.sql import functions as F

from stakewise.operators import sequential

KEYS, ORDER = ["g"], ["i"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = []
    for g, n in (("a", 37), ("b", 1), ("c", 16), ("d", 5)):
        for i in range(n):
            made.append((g, i, 1 + i * 13 // n, rng.choice(("upheld", "overturned", None)), rng.random(), rng.random() * 0.5, rng.random() < 0.6, rng.random() < 0.5, rng.random() < 0.4, rng.random() * 3, rng.random()))
    return spark.createDataFrame(made, "g string, i int, inning int, outcome string, p1 double, p2 double, act1 boolean, act2 boolean, success boolean, stake double, p double").cache()


def replays(rows):
    yield "inventory", sequential.inventory_replay(rows.select("g", "i", "inning", "outcome"), KEYS, ORDER)
    yield "mass", sequential.mass_replay(rows.select("g", "i", "inning", "p1", "p2", "success", "stake"), KEYS, ORDER)
    yield "policy", sequential.policy_replay(rows.select("g", "i", "inning", "act1", "act2", "success", "stake"), KEYS, ORDER)
    back = rows.select("g", "i", "inning", "p", F.col("act1").alias("adverse"), F.col("success").alias("correct"), F.col("stake").alias("x"), F.col("p2").alias("y"))
    yield "backward", sequential.reachable_value(back, KEYS, ORDER, ["x", "y"])


def flat(df):
    return {(r.g, r.i): [float(x) for x in r.state] for r in df.collect()}


def test_segments_change_nothing(rows, monkeypatch):
    want = {name: flat(df) for name, df in replays(rows)}
    for size in (1, 4, 16):
        monkeypatch.setattr(sequential, "SEGMENT", size)
        for name, df in replays(rows):
            got = flat(df)
            assert got.keys() == want[name].keys()
            for k, v in got.items():
                assert v == pytest.approx(want[name][k], abs=1e-9), (size, name, k)


def test_inventory_equals_a_plain_loop(rows, monkeypatch):
    monkeypatch.setattr(sequential, "SEGMENT", 5)
    got = flat(next(replays(rows))[1])
    k, last, key = 2, None, None
    for r in rows.orderBy("g", "i").collect():
        if r.g != key:
            k, last, key = 2, None, r.g
        if last is not None and r.inning != last and r.inning > 9 and k == 0:
            k = 1
        before, bad = k, r.outcome is not None and k == 0
        k -= r.outcome == "upheld" and not bad
        assert got[r.g, r.i] == [before, k, bad]
        last = r.inning


def test_mass_stream_equals_batch(spark, rows):
    from stakewise.plans.streams import streamed
    from stakewise.streaming.replay import stream_mass

    part = rows.select("g", "i", "inning", "p1", "p2", "success", "stake")
    named = part.withColumnsRenamed({"g": "game", "i": "pitch_order"}).withColumn("team", F.lit(0).cast("long"))
    got = {(r.game, r.pitch_order): [r.m0, r.m1, r.m2, r.challenges, r.captured] for r in streamed(spark, named, stream_mass).collect()}
    want = {(r.g, r.i): [r.state.m0, r.state.m1, r.state.m2, r.state.challenges, r.state.captured] for r in sequential.mass_replay(part, KEYS, ORDER).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
