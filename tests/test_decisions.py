"""Kernels, signal-based decisions, searches and fits on known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stakewise import plans
from stakewise.functions import kernels as K
from stakewise.operators import decision, models, policy, prior

SF = "/root/testdata/sf0.001"


def look(sigma=0.8):
    bins = np.arange(-30, 30)
    weights = np.exp(-(((bins + 0.5) * 0.1 + 0.5) ** 2))
    return bins, weights / weights.sum(), prior.signal_lookup(bins, weights / weights.sum(), 0.1, sigma, 0.02)


def test_quadrature_and_splines():
    assert K.orthant(0, 0, 0.5) == pytest.approx(1 / 3, abs=1e-9)
    assert K.orthant(0.3, -0.2, 0) == pytest.approx((1 - K.phi(0.3)) * (1 - K.phi(-0.2)))
    assert K.orthant(0.3, -0.2, 1) == pytest.approx(1 - K.phi(0.3))
    x = np.random.default_rng(1).multivariate_normal([0, 0], [[1, -0.6], [-0.6, 1]], 400_000)
    assert K.orthant(0.2, -0.5, -0.6) == pytest.approx(((x[:, 0] > 0.2) & (x[:, 1] > -0.5)).mean(), abs=3e-3)
    assert K.mean_above(lambda s: s, 0.0, 0.0, 1.0) == pytest.approx(math.sqrt(2 / math.pi), abs=1e-6)
    assert math.isnan(K.mean_above(lambda s: s, math.inf, 0, 1)) and K.mean_above(lambda s: s, -1, 0.5, 0) == 0.5
    assert K.positive_area([-1, 1], [0, 2]) == pytest.approx(1.5) and K.positive_area([-2, -1], [1, 1]) == 0
    assert abs(K.b_spline(np.linspace(0, 53, 40), np.linspace(0, 53, 5)).sum(1) - 1).max() < 1e-12
    assert K.stage_design(np.arange(60)).shape[0] == 60
    y = np.sin(np.linspace(0, 3, 50))
    assert K.smoothed(y, np.ones(50), 1e-9) == pytest.approx(y, abs=1e-6) and np.diff(K.smoothed(y, np.ones(50), 1e9), 2) == pytest.approx(0, abs=1e-6)


def test_payoff_picks_the_best_threshold():
    _, _, table = look()
    gain, loss = np.array([1.0, 2.0, 0.0, 1.0, 0.5]), np.array([0.5, 0.3, 0.4, 0.0, 50.0])
    out = K.payoff(gain, loss, table)
    assert out["threshold"][2] == np.inf and out["threshold"][3] == -np.inf and out["advantage"][2] == 0
    for i in (0, 1):
        tries = table["success_tail"] * gain[i] - (table["action_tail"] - table["success_tail"]) * loss[i]
        assert out["advantage"][i] == pytest.approx(tries.max(), abs=2e-3)
    assert (out["advantage"] >= 0).all() and (out["success"] <= out["action"] + 1e-12).all()


def test_signal_values_agree_with_known_chances_without_noise(spark):
    bins, weights, table = look(0.001)
    t = pd.DataFrame({"stage": [0, 1], "role": "offense", "p_hat": 0.0, "stake": [0.2, 0.7], "next_stage": [1, None], "next_role": ["offense", None], "delta": [1, 0], "terminal": [False, True], "extra_grant": False, "weight": 10, "context": "league"})
    values = decision.SignalValues(t, {"league": table}, prior=0)
    rate = weights[bins >= 0].sum()
    assert values.arrival[1, 1] == pytest.approx(0.7 * rate, rel=1e-2) and values.arrival[0, 1] == pytest.approx(0.9 * rate, rel=2e-2)
    assert values.arrival[0, 0] == 0 and (np.diff(values.arrival, axis=1) >= -1e-12).all()
    passive = decision.SignalValues(t.assign(passive=True), {"league": table}, prior=0)
    assert (passive.arrival == 0).all()


CLOCK = "game_pk string, team_id string, pitch_order int, inning int, role string, stake double, r1 double, r2 double"


def test_frozen_evaluation_needs_the_whole_truth_and_bias_averages(spark):
    clock = spark.createDataFrame([("g", "t", i, 1 + i // 4, "offense", 1.0, 0.0, -0.5) for i in range(1, 13)], CLOCK)
    truth = spark.createDataFrame([("g", "t", i, (-1.0) ** i * i / 5) for i in range(1, 13)], "game_pk string, team_id string, pitch_order int, margin double")
    value = policy.frozen_evaluation(clock, truth, {"offense": 1.0}).agg(F.sum("state.captured")).first()[0]
    with pytest.raises(ValueError, match="cover"):
        policy.frozen_evaluation(clock, truth.filter("pitch_order > 1"), {"offense": 1.0})
    still = policy.bias_sensitivity(clock, truth, {"offense": 1.0}, 0.0, 3).first().captured
    assert still == pytest.approx(value) and policy.bias_sensitivity(clock, truth, {"offense": 1.0}, 1.0, 3).first().captured != pytest.approx(value)


def test_search_gates_and_cross_fitting(spark):
    rows = [(g, "t", i, i, 0.9 if i == 3 else 0.3, 1.0, i == 3, s) for g in ("a", "b", "c") for i in range(1, 4) for s in ("x", "y")]
    t = spark.createDataFrame(rows, "game string, team string, pitch_order int, inning int, p double, stake double, success boolean, scenario string").withColumn("team", F.concat("team", "scenario"))
    found = policy.search(t, ["game", "team"], "scenario", start=(0.0, 0.0), radius=0.5, rounds=3)
    assert found["worst"] == pytest.approx(3.0) and found["l1"] >= found["l2"] >= 0
    scored = spark.createDataFrame([(f"g{i % 5}", 0.1 + i * 0.001, 0.5, k) for i in range(40) for k in (1, 2)], "g string, a double, b double, k int")
    assert policy.promotion_gate(scored, "g", "a", "b").first().promoted and not policy.promotion_gate(scored, "g", "b", "a").first().promoted
    assert policy.smallest_within_one_error(scored, "k", "a", "g").first().selected == 1
    folded = scored.withColumn("fold", F.substring("g", 2, 1).cast("int") % 2)
    out = policy.cross_fit(folded, "g", "fold", lambda train: train.agg(F.avg("a")).first()[0], lambda m, test: test.withColumn("fit", F.lit(m)))
    assert out.count() == 80 and out.select("fit").distinct().count() == 2
    with pytest.raises(ValueError, match="trained"):
        policy.cross_fit(scored.withColumn("fold", F.col("k")), "g", "fold", lambda train: 0, lambda m, test: test)


def test_families_recover_their_coefficients(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, 8000)
    frame = pd.DataFrame({"x": x, "y": rng.random(8000) < 1 / (1 + np.exp(-(0.3 + 1.2 * x))), "n": rng.poisson(np.exp(0.2 + 0.5 * x)), "g": rng.integers(0, 12, 8000)})
    df = spark.createDataFrame(frame)
    for outcome, family, want in (("y", "logit", (0.3, 1.2)), ("n", "poisson", (0.2, 0.5))):
        fit = models.glm(df, outcome, ["x"], family)
        assert tuple(fit["coefficients"].values()) == pytest.approx(want, abs=0.12)
    out = models.cross_fitted(df.withColumn("y", F.col("y").cast("int")), "g", 3, "y", ["x"])
    assert out.count() == 8000 and out.agg(F.corr("prediction", "y")).first()[0] > 0.5
    few = models.cross_fitted(df.limit(60).withColumn("y", F.col("y").cast("int")), "g", 3, "y", ["x"])
    assert few.select("prediction").distinct().count() <= 3


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_policy_iteration_on_rows_equals_iteration_over_a_table(spark):
    rng = np.random.default_rng(6)
    rows = []
    for game in range(40):
        stages = sorted(rng.integers(0, 70, 12).tolist())
        roles = rng.choice(["offense", "defense"], 12).tolist()
        for i, (raw, role) in enumerate(zip(stages, roles, strict=True)):
            after = stages[i + 1] if i < 11 else None
            fold = lambda x: x if x < 54 else 54 + (x - 54) % 6
            rows.append((fold(raw), role, float(rng.integers(0, 101)) / 100, float(rng.normal(0.3, 1)), None if after is None else fold(after), roles[i + 1] if i < 11 else None, 0 if after is None else after - raw, i == 11, after is not None and after // 6 > max(8, raw // 6), "league"))
    names = ["stage", "role", "p_hat", "stake", "next_stage", "next_role", "delta", "terminal", "extra_grant", "context"]
    frame = pd.DataFrame(rows, columns=names)
    df = spark.createDataFrame(rows, "stage int, role string, p_hat double, stake double, next_stage int, next_role string, delta int, terminal boolean, extra_grant boolean, context string")
    want, got = decision.StateValues(frame.assign(weight=1)), decision.PolicyValues(df)
    assert got.rounds < 30 and (got.states.to_numpy() == want.states.to_numpy()).all()
    assert got.arrival == pytest.approx(want.arrival, abs=1e-7) and got.continuation == pytest.approx(want.continuation, abs=1e-7)
    _, _, table = look()
    want, got = decision.SignalValues(frame.assign(weight=1), {"league": table}), decision.PolicyValues(df, decision.by_signal({"league": table}))
    assert got.arrival == pytest.approx(want.arrival, abs=1e-4)


def test_too_many_distinct_transitions_do_not_come_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(decision, "MOST_ROWS", 3)
    df = spark.range(9).selectExpr("cast(id AS int) AS stage", "'offense' AS role", "cast(NULL AS int) AS next_stage", "cast(NULL AS string) AS next_role", "0 AS delta", "true AS terminal", "false AS extra_grant")
    with pytest.raises(ValueError, match="distinct transitions"):
        decision.compressed_transitions(df, ())


def test_search_ends_below_its_tolerance(spark):
    rows = [(g, "t", i, i, 0.9 if i == 3 else 0.3, 1.0, i == 3, "x") for g in ("a", "b") for i in range(1, 4)]
    t = spark.createDataFrame(rows, "game string, team string, pitch_order int, inning int, p double, stake double, success boolean, scenario string")
    assert policy.search(t, ["game", "team"], "scenario", start=(0.0, 0.0), radius=0.5, tolerance=0.2)["worst"] == pytest.approx(2.0)


def test_mixture_on_counts_equals_mixture_on_rows(spark):
    rng = np.random.default_rng(8)
    values = np.round(np.concatenate([rng.normal(-1, 0.4, 900), rng.normal(2, 0.6, 600)]), 1)
    bins, counts = np.unique(values, return_counts=True)
    one, two = models.mixture(values, 2), models.mixture(bins, 2, counts=counts)
    for name in ("mean", "sd", "weight"):
        assert two[name] == pytest.approx(one[name], abs=5e-3)
    frame = spark.createDataFrame([(float(v), f"g{i % 12}", i % 12 % 3 + 1) for i, v in enumerate(values)], "margin double, game string, fold int")
    scored = models.nested_mixtures(frame, "game", "fold", "margin", 3)
    assert policy.smallest_within_one_error(scored, "k", "loss", "game").first().selected == 2


def test_choice_probability_averages_over_draws(spark):
    draws = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 1.0, 0.0), (None, 1, 0.5, 0.0)], "player string, draw int, threshold double, log_sigma double")
    rows = spark.createDataFrame([("a", 1.0), ("z", 0.5)], "player string, margin double")
    got = {r.player: r.probability for r in models.choice_probability(rows, draws, "margin", "player").collect()}
    assert got["a"] == pytest.approx((K.phi(1.0) + 0.5) / 2, abs=1e-6) and got["z"] == pytest.approx(0.5, abs=1e-6)


def test_reverse_sweeps_equal_policy_iteration(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(60):
        raws = sorted((6 * rng.integers(0, 12, 6)).tolist())
        roles = rng.choice(["offense", "defense"], 6).tolist()
        for i, (raw, role) in enumerate(zip(raws, roles, strict=True)):
            after = raws[i + 1] if i < 5 else None
            fold = lambda x: x if x < 54 else 54 + (x - 54) % 6
            rows.append((fold(raw), role, float(rng.integers(0, 101)) / 100, float(rng.normal(0.3, 1)), None if after is None else fold(after), roles[i + 1] if i < 5 else None, 0 if after is None else after - raw, i == 5, after is not None and after // 6 > max(8, raw // 6)))
    df = spark.createDataFrame(rows, "stage int, role string, p_hat double, stake double, next_stage int, next_role string, delta int, terminal boolean, extra_grant boolean").repartition(2).cache()
    want, got = decision.PolicyValues(df, tolerance=1e-10), decision.SweptValues(df, tolerance=1e-10)
    assert got.arrival == pytest.approx(want.arrival, abs=1e-8) and got.marginal == pytest.approx(want.marginal, abs=1e-8)
    assert (got.arrival[:, 2] >= got.arrival[:, 1]).all() and got.rounds <= 3 and got.evaluations < 120


@pytest.mark.parametrize("segment", [256, 3])
def test_candidates_on_segments_equal_the_replay(spark, monkeypatch, segment):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        for i in range(1, 2 + 2 * g):
            rows.append((f"g{g}", "ab"[g % 2], i, 7 + i // 2, float(rng.integers(0, 100)) / 100, float(rng.normal(1, 2)), bool(rng.random() < 0.4)))
    t = spark.createDataFrame(rows, "game string, scenario string, pitch_order int, inning int, p double, stake double, success boolean")
    monkeypatch.setattr(policy, "SEGMENT", segment)
    points = [(0.0, 0.0), (0.6, 0.2), (3.0, 1.0)]
    got = {(r.candidate, r.scenario): r.value for r in policy.candidate_values(policy.segments(t, ["game"], "scenario"), points, ["game"], "scenario").collect()}
    assert len(got) == 6
    for i, (l1, l2) in enumerate(points):
        acts = policy.public_thresholds(t, "p", "stake", {1: F.lit(l1), 2: F.lit(l2)})
        for r in policy.mass_replay(acts, ["scenario", "game"], ["pitch_order"]).groupBy("scenario").agg(F.sum("state.captured").alias("value")).collect():
            assert got[i, r.scenario] == pytest.approx(r.value, abs=1e-8)


def test_equal_stakes_are_evaluated_once(spark):
    df = spark.range(900).selectExpr("cast(id % 2 AS int) AS stage", "'offense' AS role", "'league' AS context", "cast(id % 3 AS double) AS stake")
    evaluate = decision.by_signal({"league": look()[2]})
    held = evaluate.reduced(df)
    assert sorted((r.stage, r.stake, r.weight) for r in held.collect()) == [(s, float(k), 150) for s in (0, 1) for k in (0, 1, 2)]
    cuts = {(s, "offense"): np.array([0.1, 0.5]) for s in (0, 1)}
    found = K.payoff(np.array([0.0, 1.0, 2.0]), np.full(3, 0.5), look()[2])
    sums = evaluate(held, cuts)
    assert sums[1, "offense"][0, 1] == pytest.approx(150 * (np.arange(3) * found["success"]).sum())
    assert sums[0, "offense"][1, 1] == pytest.approx(150 * (found["action"] - found["success"]).sum())
