"""Replicates that are kept: a run that is stopped or lost is filled up, and nothing is computed twice."""

import pytest
from pyspark.sql import functions as F

from stakewise.operators.resample import resumed
from stakewise.sources.readers import scratch


def test_stopped_and_lost_runs_are_filled_up(spark):
    folder, asked = scratch(spark, "resumed"), []
    keys = spark.range(30).select(F.col("id").alias("replicate"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("cell"))

    def compute(own):
        asked.append(own)
        return own.withColumn("twice", F.col("replicate") * 2)

    def broken(own):
        return own.withColumn("twice", F.raise_error(F.lit("lost")).cast("long"))

    first = resumed(folder, keys, compute, parts=3, most_parts=1)
    n = first.count()
    assert 0 < n < 30
    with pytest.raises(Exception, match="lost"):
        resumed(folder, keys, broken, parts=3)
    asked.clear()
    whole = resumed(folder, keys, compute, parts=5)
    assert sorted((r.replicate, r.cell, r.twice) for r in whole.collect()) == [(i, "ab"[i % 2], 2 * i) for i in range(30)]
    assert sum(a.count() for a in asked) == 30 - n
    asked.clear()
    assert resumed(folder, keys, compute).count() == 30 and sum(a.count() for a in asked) == 0
    assert resumed(folder, keys.union(keys.limit(0)), compute).count() == 30


def test_no_keys(spark):
    assert resumed(scratch(spark, "resumed"), spark.range(0), lambda k: k.withColumn("x", F.lit(1))).count() == 0
