"""Audits, model checks, design columns and bundles: what must pass, and what must not."""

import pytest
from pyspark.sql import functions as F

from stakewise.operators import prior, selection
from stakewise.operators.governance import CheckFailed
from stakewise.sources import readers

LEDGER = "k int, outcome string, call string, zone_call string, remaining_before int, remaining_after int, status string, linkage string, inning int"
ROWS = [(1, "upheld", "ball", "ball", 2, 1, "challenged", None, 3), (2, "overturned", "ball", "called_strike", 1, 1, "challenged", "plate_appearance_terminal", 10), (3, None, "ball", "called_strike", 0, 0, "out_of_challenges", None, 4), (4, None, "ball", "called_strike", 1, 1, "missed_available", None, 4)]
AUDIT = [("a", "upheld_challenge", 1, "pass"), ("b", "overturned_challenge", 2, "pass"), ("c", "zero_inventory_correctable", 3, "pass"), ("d", "missed_available", 4, "pass"), ("e", "pa_terminal_linkage", 2, "pass"), ("f", "extra_inning_challenge", 2, "pass")]


def test_audit(spark):
    ledger = spark.createDataFrame(ROWS, LEDGER)
    audit = spark.createDataFrame(AUDIT, "audit_id string, audit_category string, k int, status string")
    selection.require_audit(audit, ledger, ["k"], {"upheld_challenge": 1})
    for bad, rows, rule in (
        (audit.withColumn("status", F.lit("fail")), ledger, "pass"), (audit.union(audit.limit(1)), ledger, "repeats"), (audit, ledger.filter("k <> 3"), "once"),
        (audit, ledger.withColumn("remaining_after", F.lit(2)), "rule"), (audit.withColumn("audit_category", F.lit("other")), ledger, "lacks|rule"),
    ):
        with pytest.raises(CheckFailed, match=rule):
            selection.require_audit(bad, rows, ["k"], {})


def test_model_checks(spark):
    p = prior.binned_prior(spark.createDataFrame([("a", -0.2), ("a", 0.3), ("b", 1.1)], "c string, m double"), "c", "m", 0.5)
    selection.require_prior(p, "c")
    with pytest.raises(CheckFailed, match="close"):
        selection.require_prior(p.withColumn("weight", F.col("weight") * 1.01), "c")
    states = spark.range(288).select((F.col("id") % 3).alias("outs"), (F.floor(F.col("id") / 3) % 8).alias("base_state"), (F.floor(F.col("id") / 24) % 4).alias("balls"), F.floor(F.col("id") / 96).alias("strikes"), F.lit(0.5).alias("re"))
    selection.require_states(states)
    with pytest.raises(CheckFailed, match="287"):
        selection.require_states(states.filter("NOT (outs = 0 AND base_state = 0 AND balls = 0 AND strikes = 0)"))
    masses = spark.createDataFrame([(1, 0.5)], "k int, v double")
    selection.require_masses_agree(masses, masses.withColumn("v", F.col("v") + 0.001), ["k"], "v")
    with pytest.raises(CheckFailed, match="differ"):
        selection.require_masses_agree(masses, masses.withColumn("v", F.col("v") + 0.01), ["k"], "v")


def test_design_uses_what_training_saw(spark):
    train = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 3.0), (None, None)], "f string, v double")
    levels, scales = selection.learnt_levels(train, ["f"]), selection.learnt_scales(train, ["v"])
    assert levels == {"f": ["y", "x"]} and scales["v"] == (2.0, 1.0)
    out, names = selection.design(spark.createDataFrame([("new", 4.0), ("x", 2.0), (None, 2.0)], "f string, v double").coalesce(1), levels, scales)
    assert [tuple(r) for r in out.select(*names).collect()] == [(0.0, 2.0), (1.0, 0.0), (0.0, 0.0)]


def test_bundle_and_stale_feeds(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1)
    files = readers.export_bundle({"one": (df, ["k"]), "two": (df, ["v"])}, str(tmp_path / "bundle"))
    assert files.count() == 2 and spark.read.parquet(str(tmp_path / "bundle/one")).columns == ["k"]
    feeds = spark.createDataFrame([('{"abstractGameState" : "Final"}',), ('{"abstractGameState":"Live"}',), (None,)], "value string")
    assert readers.stale(feeds).count() == 2
