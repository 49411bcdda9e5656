"""Operators on small inputs with known answers, brute force, identities and rules that fail closed."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stakewise.functions import scalar as S
from stakewise.operators import decision, governance, ledger, models, prior, resample, sequential, stats, tables, transitions
from stakewise.sources import readers


def column(df, name):
    return [r[name] for r in df.select(name).collect()]


def test_stage_index_and_fold(spark):
    df = spark.createDataFrame([(1, False, 0), (9, True, 2), (10, False, 0), (11, True, 2)], "inning int, bottom boolean, outs int").coalesce(1)
    raw = S.out_index(F.col("inning"), F.col("bottom"), F.col("outs"))
    assert column(df.select(raw.alias("x")), "x") == [0, 53, 54, 65]
    assert column(df.select(S.stage(raw).alias("x")), "x") == [0, 53, 54, 59]


def test_corner_distance_and_zone(spark):
    df = spark.createDataFrame([(17 / 24 + 0.1, 3.6), (0.0, 2.5), (None, 2.0)], "x double, z double").coalesce(1)
    edge = column(df.select(S.edge_distance_inches(F.col("x"), F.col("z"), F.lit(1.5), F.lit(3.5)).alias("e")), "e")
    assert edge[0] == pytest.approx(12 * math.sqrt(0.02) - 1.45) and edge[1] < -1.45 and edge[2] is None
    calls = spark.createDataFrame([(-0.01,), (0.0,), (0.01,), (None,)], "e double").coalesce(1)
    assert column(calls.select(S.zone_call(F.col("e")).alias("c")), "c") == ["called_strike", "called_strike", "ball", None]


def test_null_rules(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "t boolean").coalesce(1)
    assert column(df.select(S.if_else(F.col("t"), 1, 0).alias("x")), "x") == [1, 0, None]
    assert column(df.select(S.is_true(F.col("t")).alias("x")), "x") == [True, False, False]


PLATE = "balls_before int, strikes_before int, outs_before int, on_1b int, on_2b int, on_3b int, concurrent_remove_1b int, concurrent_add_2b int, concurrent_runs int, concurrent_outs int, call string"


def scalar_branch(b, s, o, on, removed, added, runs, outs, call):
    """The same rules, one row at a time, in plain Python."""
    on = [int(bool(x)) for x in on]
    if removed:
        on[0] = 0
    if added:
        on[1] = 1
    o, runs = o + outs, runs
    if call == "ball":
        if b < 3:
            return (b + 1, s, o, *on, runs)
        if all(on):
            runs += 1
        first_free = on.index(0) if 0 in on else 2
        return (0, 0, o, *[1 if i <= first_free else x for i, x in enumerate(on)], runs)
    return (b, s + 1, o, *on, runs) if s < 2 else (0, 0, o + 1, *on, runs)


def test_call_branches_match_the_scalar_rules(spark):
    rows = [(b, s, o, x & 1, x >> 1 & 1 or None, x >> 2 & 1, m & 1, m >> 1, m, o % 2, c) for b in range(4) for s in range(3) for o in range(3) for x in range(8) for m in range(4) for c in ("ball", "called_strike")]
    out = transitions.call_branch(spark.createDataFrame(rows, PLATE), F.col("call")).collect()
    for r in out:
        want = scalar_branch(r.balls_before, r.strikes_before, r.outs_before, (r.on_1b, r.on_2b, r.on_3b), r.concurrent_remove_1b, r.concurrent_add_2b, r.concurrent_runs, r.concurrent_outs, r.call)
        assert tuple(r.branch) == want, r
    with pytest.raises(Exception, match="unsupported call"):
        transitions.call_branch(spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0, 0, 0, 0, "swing")], PLATE), F.col("call")).collect()


def test_inventory_path(spark):
    rows = [(1, i, inning, outcome) for i, (inning, outcome) in enumerate([(1, "upheld"), (2, "upheld"), (9, None), (10, None), (11, None)])]
    df = spark.createDataFrame(rows, "g int, i int, inning int, outcome string")
    out = sequential.inventory_replay(df, ["g"], ["i"]).orderBy("i").select("state.*").collect()
    assert [r.before for r in out] == [2, 1, 0, 1, 1] and [r.after for r in out] == [1, 0, 0, 1, 1] and not any(r.invalid for r in out)
    bad = spark.createDataFrame([(1, 0, 1, "unresolved")], "g int, i int, inning int, outcome string")
    assert sequential.inventory_replay(bad, ["g"], ["i"]).first().state.invalid
    with pytest.raises(Exception, match="without inventory"):
        sequential.require_valid(sequential.inventory_replay(bad, ["g"], ["i"])).collect()


def test_mass_replay_loses_on_failure_and_replenishes_extras(spark):
    rows = [("g", i, inning, float(i), success) for i, (inning, success) in enumerate([(9, False), (9, True), (10, False), (10, True), (11, True)], 1)]
    df = spark.createDataFrame(rows, "g string, i int, inning int, stake double, success boolean").withColumns({"p1": F.lit(1.0), "p2": F.lit(1.0)})
    out = [r.state for r in sequential.mass_replay(df, ["g"], ["i"]).orderBy("i").collect()]
    assert [s.m2 for s in out] == [1, 0, 0, 0, 0] and [s.m1 for s in out] == [0, 1, 1, 0, 1] and [s.m0 for s in out] == [0, 0, 0, 1, 0]
    assert sum(s.captured for s in out) == 7 and [s.granted for s in out] == [False, False, True, False, True]
    assert all(s.challenges == s.successes + s.failures for s in out)


def moves(spark, games, rows):
    """rows: (stage, inning, p, stake, correct) of each game, one team and role."""
    data = [(g, i, s, inning, "offense", p, x, ok) for g in range(games) for i, (s, inning, p, x, ok) in enumerate(rows)]
    df = spark.createDataFrame(data, "g int, i int, stage int, inning int, role string, p_hat double, stake double, success boolean").withColumn("raw", F.col("stage"))
    out = sequential.transitions(df, ["g"], ["i"], ["stage", "role", "raw"])
    return df, out.withColumn("delta", F.coalesce(F.col("next_raw") - F.col("raw"), F.lit(0)))


def test_last_challenge_is_saved_for_a_better_chance(spark):
    df, t = moves(spark, 20, [(0, 1, 0.2, 0.1, False), (1, 1, 0.9, 0.5, True)])
    values = decision.StateValues(decision.compressed_transitions(t))
    assert values.residual < 1e-10
    acts = decision.with_actions(df.filter("g = 0"), spark.createDataFrame(values.frame()))
    out = sequential.policy_replay(acts, ["g"], ["i"], initial=1).orderBy("i").collect()
    assert [r.state.challenged for r in out] == [False, True] and sum(r.state.captured for r in out) == 0.5


def test_extra_inning_grant_makes_none_and_one_equal(spark):
    _, t = moves(spark, 20, [(53, 9, 0.0, 0.1, False), (54, 10, 0.9, 0.5, True)])
    f = decision.StateValues(decision.compressed_transitions(t)).frame().set_index("stage").loc[53]
    assert f.continuation_k0 == pytest.approx(f.continuation_k1) and f.marginal_1 == pytest.approx(0)


def test_terminal_rows_cost_nothing_and_shrinkage(spark):
    _, t = moves(spark, 7, [(53, 9, 0.5, 0.2, True)])
    f = decision.StateValues(decision.compressed_transitions(t)).frame().iloc[0]
    assert f.marginal_1 == 0 and f.shrink == pytest.approx(7 / 37)


def test_backward_values_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [("g", i, 8 + i // 4, float(rng.random()), bool(rng.random() < 0.7), bool(rng.random() < 0.5), float(rng.random())) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, i int, inning int, p double, adverse boolean, correct boolean, re double")
    got = {r.i: tuple(r.state) for r in sequential.reachable_value(df, ["g"], ["i"], ["re"]).collect()}
    c, last = [0.0, 0.0, 0.0], None
    for _, i, inning, p, adverse, correct, gain in reversed(rows):
        if last is not None and last > 9 and last != inning:
            c[0] = c[1]
        if adverse:
            c = [c[0], *[c[k] + p * gain if correct else (1 - p) * c[k] + p * c[k - 1] for k in (1, 2)]]
        last = inning
        assert got[i] == pytest.approx(tuple(c))


def test_bins_and_wrong_rate(spark):
    df = spark.createDataFrame([("a", x) for x in (-0.004, 0.0, 0.004, -0.02, 0.03)], "c string, m double").coalesce(1)
    assert column(df.select(S.margin_bin(F.col("m"), 0.01).alias("b")), "b")[:3] == [-1, -1, 0]
    assert prior.wrong_rate(prior.binned_prior(df, "c", "m", 0.01), "c").first().wrong_rate == pytest.approx(2 / 5)


def test_crps_of_two_points(spark):
    p = spark.createDataFrame([("a", -3, 0.5), ("a", 1, 0.5)], "c string, bin int, weight double")
    obs = spark.createDataFrame([(1, "a", 0.0)], "id int, c string, y double")
    assert prior.crps(obs, p, "c", "y", 1.0, ["id"]).first().crps == pytest.approx((2.5 + 1.5) / 2 - 1.0)


def test_signal_lookup_closes_and_matches_bayes(spark):
    bins, weights = np.arange(-40, 40), np.random.default_rng(3).random(80)
    weights /= weights.sum()
    look = prior.signal_lookup(bins, weights, 0.1, 0.5, 0.02)
    assert look["action_tail"][0] == pytest.approx(1, abs=1e-5) and (np.diff(look["q"]) >= 0).all()
    assert look["success_tail"][0] == pytest.approx(weights[bins >= 0].sum(), abs=1e-5)
    for i in (200, 300, 380):
        phi = weights * np.exp(-(((look["signal"][i] - (bins + 0.5) * 0.1) / 0.5) ** 2) / 2)
        assert look["q"][i] == pytest.approx(phi[bins >= 0].sum() / phi.sum(), abs=2e-3)
    frame = spark.createDataFrame(pd.DataFrame({"c": "x", "bin": bins, "weight": weights}))
    assert prior.lookup_table(frame, "c", 0.1, 0.5).agg(F.max("action_tail")).first()[0] == pytest.approx(1, abs=1e-5)


def test_tails_posterior_limits_and_normal(spark):
    p = spark.createDataFrame([("a", -1, 0.25), ("a", 0, 0.75)], "c string, bin int, weight double")
    rows = spark.createDataFrame([(1, "a", 0.2), (2, "a", -9.0)], "id int, c string, r double")
    assert {r.id: (r.action, r.success) for r in prior.upper_tail(rows, p, "c", "r", 1.0, 0.0, ["id"]).collect()} == {1: (0.75, 0.75), 2: (1.0, 0.75)}
    assert sorted(column(prior.posterior(rows, p, "c", "r", 1.0, math.inf, ["id"]), "q")) == [0.75, 0.75]
    assert sorted(column(prior.posterior(rows, p, "c", "r", 1.0, 0, ["id"]), "q")) == [0.0, 1.0]
    z = spark.createDataFrame([(x / 4,) for x in range(-20, 21)], "z double").select("z", S.normal_cdf(F.col("z")).alias("n"), models.exact_normal_cdf("z").alias("e")).collect()
    assert all(abs(r.n - r.e) < 8e-8 and abs(r.e - 0.5 * math.erfc(-r.z / 2**0.5)) < 1e-15 for r in z)
    inf = spark.createDataFrame([(0.5, -math.inf, 1.0), (0.5, math.inf, 1.0), (0.5, 0.4, 0.0)], "m double, r double, s double").coalesce(1)
    assert column(inf.select(S.signal_probability(F.col("m"), F.col("r"), F.col("s")).alias("p")), "p") == [1.0, 0.0, 1.0]


def test_mixture_and_its_posterior(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(-2, 0.5, 3000), rng.normal(3, 1, 6000)])
    parts = models.mixture(values, 2)
    assert parts["mean"] == pytest.approx([-2, 3], abs=0.1) and parts["weight"] == pytest.approx([1 / 3, 2 / 3], abs=0.02)
    q = spark.range(1).select(models.mixture_posterior(F.lit(0.4), parts, 0.7).alias("q")).first().q
    grid = np.linspace(-8, 10, 40001)
    density = sum(w / s * np.exp(-(((grid - m) / s) ** 2) / 2) for w, m, s in zip(parts["weight"], parts["mean"], parts["sd"], strict=True)) * np.exp(-(((0.4 - grid) / 0.7) ** 2) / 2)
    assert q == pytest.approx(density[grid > 0].sum() / density.sum(), abs=1e-3)


def test_weighted_expectation_table(spark):
    obs = spark.createDataFrame([("a", 0, 0.0, 2.0, 0.0), ("b", 0, 2.0, 0.0, 2.0)], "g string, s int, y double, w1 double, w2 double")
    grid = spark.createDataFrame([(0, 0), (0, 1)], "s int, t int")
    for w, want in (("w1", 0.0), ("w2", 2.0)):
        out = tables.shrunken_cells(obs.withColumn("t", F.lit(0)), grid, ["s"], ["t"], "y", weight=w).collect()
        assert len(out) == 2 and all(r.estimate == pytest.approx(want) for r in out)


def test_quantiles_envelope_and_errors(spark):
    df = spark.createDataFrame([("g1", 1.0), ("g1", 2.0), ("g2", 6.0)], "g string, v double")
    r = stats.sandwich_error(df, "g", "v").first()
    assert r.se == pytest.approx(math.sqrt(2 * (9 + 9) / 9)) and r["mean"] == 3
    assert stats.cluster_mean_error(df, "g", "v").first().se == pytest.approx(np.std([1.5, 6], ddof=1) / math.sqrt(2))
    q = df.agg(F.collect_list("v").alias("v")).select(stats.quantile_type8(F.col("v"), 0.5).alias("q"), stats.quantile_type8(F.col("v"), 0.99).alias("t")).first()
    assert (q.q, q.t) == (pytest.approx(2), 6)
    e = stats.envelope(spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 3.0)], "n string, v double").withColumn("k", F.lit(1)), ["k"], "v", "n").first()
    assert (e.least, e.min_at, e.greatest, e.max_at) == (1.0, "x", 3.0, "z")


def test_folds_weights_and_seeds(spark):
    games = spark.createDataFrame([(f"g{i}",) for i in range(23)], "g string")
    sizes = resample.balanced_folds(games, "g", 5, 3).groupBy("fold").count().toPandas()["count"]
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == 23
    w = resample.bootstrap_weights(games, "g", 4, 9).groupBy("replicate").agg(F.sum("weight").alias("n")).toPandas()
    assert (w["n"] == 23).all() and len(w) == 4
    source = "ab"
    assert resample.bootstrap_seed(5, 7, source) == 1 + (5 + 7 * 1000003 + 9176 * (97 + 2 * 98)) % 2147483646
    calls = []
    folder = "/tmp/stakewise-checkpoint-" + governance.fingerprint(games)[:8] + str(np.random.default_rng().integers(10**9))
    for _ in range(2):
        out = resample.checkpointed(spark, folder, "x", lambda: calls.append(1) or games)
    assert len(calls) == 1 and out.count() == 23


def test_probit_recovers_the_width_and_bias(spark):
    rng = np.random.default_rng(8)
    m = rng.uniform(-6, 6, 6000)
    y = rng.random(6000) < [0.5 * math.erfc(-(x - 0.8) / 2.5 / 2**0.5) for x in m]
    df = spark.createDataFrame(pd.DataFrame({"m": m, "y": y, "t": 0.0}))
    fit = models.width_and_threshold(models.probit(df, "y", ["m"]), "m")
    assert fit["width"] == pytest.approx(2.5, abs=4 * fit["width_se"]) and fit["threshold"] == pytest.approx(0.8, abs=4 * fit["threshold_se"])
    assert models.threshold_bias(df, "y", "m", "t", 2.5, tolerance=0.05) == pytest.approx(fit["threshold"], abs=0.15)
    draws = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 1.0, 0.0), (None, 1, 5.0, 0.0)], "who string, draw int, threshold double, log_sigma double")
    rows = spark.createDataFrame([("a", 0.5), ("new", 5.0)], "who string, m double")
    got = {r.who: r.probability for r in models.choice_probability(rows, draws, "m", "who").collect()}
    assert got == {"a": pytest.approx(0.5, abs=1e-6), "new": pytest.approx(0.5, abs=1e-6)}


def test_search_roots_and_nodes():
    x, value = decision.minimise(lambda v: (v[0] - 1) ** 2 + 5 * (v[1] + v[0]) ** 2, np.zeros(2))
    assert x == pytest.approx([1, -1], abs=1e-4) and value < 1e-8
    assert decision.bisected(lambda v: v**3 - 50, 0, 1) == pytest.approx(50 ** (1 / 3))
    nodes, weights = decision.gauss_hermite(12)
    assert weights.sum() == pytest.approx(1) and (weights * nodes**4).sum() == pytest.approx(3)
    assert len(decision.scenario_grid([0, 0.25, 0.5, 0.75, 1], [0, 0.25, 0.5, 0.75, 1])) == 25


def test_checks_fail_closed(spark):
    df = spark.createDataFrame([(1, 0.5, 2), (2, None, 2)], "k int, margin double, n int")
    with pytest.raises(governance.CheckFailed, match="margin"):
        governance.guard_columns(df, "clock", denied=["margin"])
    with pytest.raises(governance.CheckFailed, match="lacks"):
        governance.require_columns(df, ["nope"], "table")
    with pytest.raises(governance.CheckFailed, match="repeats"):
        governance.require_unique(df, ["n"], "table")
    with pytest.raises(governance.CheckFailed, match="low"):
        governance.require_coverage(governance.coverage(df, F.col("margin").isNotNull(), "n"), "n")
    record = governance.frozen({"threshold": [1.5, 2.0]})
    assert governance.require_frozen(record) == {"threshold": [1.5, 2.0]}
    with pytest.raises(governance.CheckFailed, match="changed"):
        governance.require_frozen(record | {"policy": {"threshold": [1.5, 2.1]}})
    assert governance.fingerprint(df) == governance.fingerprint(df.orderBy(F.desc("k")).repartition(3)) != governance.fingerprint(df.withColumn("n", F.lit(3)))
    with pytest.raises(governance.CheckFailed, match="trained"):
        governance.held_out_apart(df, df, "k")


def test_provenance_rules(spark):
    clock = spark.createDataFrame([("g", "t", 1), ("g", "t", 2)], "game_pk string, team_id string, pitch_order int")
    table = ledger.policy_table(clock, {"oracle": (F.lit(1), F.lit(1)), "half": (F.lit(0.5), F.lit(0.5))})
    governance.require_provenance(table, clock, ledger.CLOCK)
    for bad, rule in ((table.withColumn("truth_used", F.lit(True)), "truth"), (table.withColumn("p1", F.lit(1.5)), "chance"), (table.filter("NOT (policy = 'half' AND pitch_order = 2)"), "cover"), (table.union(table), "repeats")):
        with pytest.raises(governance.CheckFailed, match=rule):
            governance.require_provenance(bad, clock, ledger.CLOCK)
    with pytest.raises(governance.CheckFailed):
        ledger.decision_clock(clock.withColumn("margin", F.lit(1.0)), [*ledger.CLOCK, "margin"])


FEED = {
    "gamePk": 7,
    "gameData": {"players": {"ID20": {"primaryPosition": {"code": "3"}}}, "teams": {"away": {"id": 1}, "home": {"id": 2}}, "absChallenges": {"hasChallenges": True, "away": {"usedSuccessful": 1, "usedFailed": 1, "remaining": 1}, "home": {"usedSuccessful": 0, "usedFailed": 0, "remaining": 2}}},
    "liveData": {
        "boxscore": {"officials": [{"officialType": "First Base", "official": {"id": 5}}, {"officialType": "Home Plate", "official": {"id": 6, "fullName": "U"}}]},
        "plays": {
            "allPlays": [
                {
                    "atBatIndex": 0, "about": {"isTopInning": True, "inning": 1}, "matchup": {"batter": {"id": 10}, "pitcher": {"id": 20}},
                    "reviewDetails": {"reviewType": "MJ", "isOverturned": False, "challengeTeamId": 1, "player": {"id": 10}},
                    "playEvents": [
                        {"isPitch": True, "index": 0, "pitchNumber": 1, "playId": "a", "details": {"call": {"code": "B"}}, "reviewDetails": {"reviewType": "XX", "isOverturned": True, "additionalReviews": [{"reviewType": "MJ", "isOverturned": True, "challengeTeamId": 2}]}},
                        {"isPitch": False, "index": 1},
                        {"isPitch": True, "index": 2, "pitchNumber": 2, "playId": "b", "details": {"call": {"code": "X", "description": "Called Strike"}}},
                    ],
                },
                {"atBatIndex": 1, "about": {"isTopInning": True, "inning": 1}, "matchup": {"pitcher": {"id": 21}}, "playEvents": [{"isPitch": True, "index": 0, "pitchNumber": 1, "details": {"call": {"code": "S"}}}, {"isPitch": True, "index": 1, "pitchNumber": 2, "details": {"call": {"code": "C"}}, "reviewDetails": {"reviewType": "NH", "isOverturned": True}}]},
            ]
        },
    },
}


def test_nested_feed(spark):
    feeds = readers.feed(spark.createDataFrame([(json.dumps(FEED),)], "value string"))
    rows = {(r.at_bat_number, r.pitch_number): r for r in readers.called_pitches(feeds).collect()}
    assert set(rows) == {(1, 1), (1, 2), (2, 2)}
    assert (rows[1, 1].call, rows[1, 1].outcome, rows[1, 1].challenger_team_id, rows[1, 1].pitcher_position) == ("ball", "overturned", 2, "3")
    assert (rows[1, 2].call, rows[1, 2].outcome, rows[1, 2].challenger_team_id) == ("called_strike", "upheld", 1)
    assert rows[2, 2].outcome is None and rows[2, 2].other_review and not rows[1, 1].other_review
    assert readers.plate_umpire(feeds).first().umpire_id == 6
    assert {(r.team_id, r.used_failed, r.remaining) for r in readers.feed_totals(feeds).collect()} == {(1, 1, 1), (2, 0, 2)}


def test_schedule_csv_and_sinks(spark, tmp_path):
    doc = {"dates": [{"date": "2024-05-01", "games": [{"gamePk": 1, "gameType": "R", "status": {"abstractGameState": "Final", "detailedState": "Final"}, "teams": {"away": {"team": {"id": 3}}, "home": {"team": {"id": 4}}}}, {"gamePk": 2, "gameType": "S"}, {"gamePk": 3, "gameType": "R", "officialDate": "2024-06-03", "status": {"detailedState": "Postponed", "abstractGameState": "Final"}}]}]}
    games = readers.schedule(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    assert sorted((r.game_pk, str(r.game_date)) for r in games.collect()) == [(1, "2024-05-01"), (3, "2024-06-03")]
    assert column(readers.completed(games), "game_pk") == [1] and readers.monthly_periods(games).first().month == "2024-05"
    (tmp_path / "a.csv").write_text(" k , v,w\n1, 2.5,x\n2,NA,null\n3,bad,\n")
    (tmp_path / "b.csv").write_text("k,z\n4,5\n9,9\n")
    keep = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    rows = readers.read_parts(spark, [([str(tmp_path / "a.csv")], "k int, v double, w string"), ([str(tmp_path / "b.csv")], "k int, z int")], keep, "k").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5, "x", None), (2, None, None, None), (3, None, None, None), (4, None, None, 5)]
    assert readers.read_or_empty(spark, str(tmp_path / "no.csv"), "a int").count() == 0
    out = str(tmp_path / "t")
    readers.write_table(keep.coalesce(1), out)
    assert readers.read_period(spark, out, ["k"], "k", "2", "3").count() == 2
    m = readers.manifest(spark, out).filter("path LIKE '%.parquet'").first()
    assert len(m.sha256) == 64 and m.bytes > 0
    readers.write_table(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), str(tmp_path / "c"), "csv")
    assert next((tmp_path / "c").glob("*.csv")).read_text() == "a,b\n1,\n"
    first = readers.latest_first(spark.createDataFrame([("x", 2), ("x", 1)], "k string, v int"), "k", [F.col("v")]).first()
    assert first.v == 1


def test_ledger_rows(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0.0, 2.5, 1.5, 3.5, "ball", 10, 20, True, True, "1", False, None), (1, 1, 2, 3.0, 2.5, 1.5, 3.5, "called_strike", 10, 20, True, False, "1", None, 10)], "game_pk int, at_bat_number int, pitch_number int, plate_x double, plate_z double, sz_bot double, sz_top double, call string, bat_team_id int, fld_team_id int, identity_matched boolean, tracking_available boolean, pitcher_position string, other_review boolean, challenger_team_id int")
    none = spark.createDataFrame([], "game_pk int, reason string")
    manual = spark.createDataFrame([(1, 1, 2, "manual")], "game_pk int, at_bat_number int, pitch_number int, reason string")
    out = ledger.with_eligibility(ledger.with_geometry(rows), none, manual)
    got = {r.pitch_number: (r.adverse_team_id, r.correctable_opportunity, r.exclusion_reason) for r in out.collect()}
    assert got == {1: (20, True, None), 2: (10, False, "manual")}
    line = {(r.pitch_number, r.team_id): (r.adverse, r.correct, r.attempted) for r in ledger.team_timeline(out).collect()}
    assert line == {(1, 10): (False, False, False), (1, 20): (True, True, False), (2, 10): (True, False, True), (2, 20): (False, False, False)}


def test_win_state_rolls_over(spark):
    rows = spark.createDataFrame([(3, 2, 2, 0, 0, 0, 0, 0, 0, 0, "called_strike", 12, "bottom", 3, 25)], PLATE + ", inning int, half string, bat_score int, fld_score int")
    s = transitions.win_state(transitions.call_branch(rows, F.col("call"))).first().win_state
    assert (s.inning, s.is_bottom, s.score_diff, s.outs, s.base_state, s.count_state) == (13, 0, -10, 0, "000", "0-0") or s.inning == 12


def test_stream_equals_batch(spark, tmp_path):
    from stakewise.streaming.replay import stream_inventory

    rng = np.random.default_rng(2)
    rows = [(f"g{k}", i, 8 + i // 6, [None, "upheld", "overturned"][rng.integers(3)]) for k in range(4) for i in range(30)]
    schema = "g string, i int, inning int, outcome string"
    folder = str(tmp_path / "in")
    for part in (range(0, 12), range(12, 30)):
        spark.createDataFrame([r for r in rows if r[1] in part], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = stream_inventory(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), ["g"], ["i"])
    q = stream.writeStream.format("memory").queryName("replayed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.g, r.i): (r.before, r.after, r.invalid) for r in spark.sql("SELECT * FROM replayed").collect()}
    batch = {(r.g, r.i): tuple(r.state) for r in sequential.inventory_replay(spark.createDataFrame(rows, schema), ["g"], ["i"]).collect()}
    assert got == batch and len(got) == 120
