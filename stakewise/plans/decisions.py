"""Priors met by signals, frozen policies, searches and model fits over the stand-in timeline.

Fixed points, searches and fits have no SQL; their queries give rows only and are tested on known answers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stakewise.functions.scalar import orthant, orthant_nodes
from stakewise.operators import decision, governance, models, policy, prior, quadrature, resample, selection, sequential
from stakewise.operators.ledger import CLOCK
from stakewise.plans.base import KEYS, ORDER, T, query, rounded, table, timeline
from stakewise.plans.builders import _PHI, _RUN
from stakewise.plans.statistics import HASH, PRIOR, margin_prior

SIGMA = {"offense": 1.2, "defense": 0.8}


def frozen_sql(team: str = "team", bias: str = "0", source: str = "t") -> str:
    """The common tables y and r: a frozen policy's chances against the truth, and its replay."""
    z = {k: _PHI.replace("z", f"z{k}") for k in (1, 2)}
    return f"""v AS (SELECT *, (margin - inning / 10.0::DOUBLE + {bias}) / sg AS z1, (margin - inning / 20.0::DOUBLE + {bias}) / sg AS z2 FROM (SELECT *, CASE role WHEN 'offense' THEN 1.2::DOUBLE ELSE 0.8 END AS sg FROM {source})),
    y AS (SELECT game, {team} AS team, pitch_order, inning, role, stake, 'structural' AS mode, a1, a2, a1 * (margin > 0)::INT AS s1, a2 * (margin > 0)::INT AS s2 FROM (SELECT *, CASE WHEN stake > 0 THEN {z[1]} ELSE 0 END AS a1, CASE WHEN stake > 0 THEN {z[2]} ELSE 0 END AS a2 FROM v)), {_RUN}"""


def public_clock(t):
    """Decision rows with thresholds that depend on the inning, keyed as a clock; and the truth, apart."""
    named = t.select(F.col("game").alias("game_pk"), F.col("team").cast("string").alias("team_id"), "pitch_order", "inning", "role", "stake", "margin")
    clock = named.withColumns({"r1": F.col("inning") / 10.0, "r2": F.col("inning") / 20.0})
    return clock.drop("margin"), named.select(*CLOCK, "margin")


@query(
    "n19_selected_density",
    f"WITH {T}, {PRIOR}, c AS (SELECT *, 1 / (1 + exp(-(bin + 0.5::DOUBLE) * 0.5::DOUBLE)) AS pi FROM prior), r AS (SELECT inning, sum(weight * pi) AS rate FROM c GROUP BY inning) SELECT inning, bin::BIGINT AS bin, round(rate, 8) AS rate, round(weight * pi / rate, 8) AS selected FROM c JOIN r USING (inning)",
)
def selected_density(spark, sf):
    """The margins of chosen rows."""
    grid = margin_prior(timeline(spark, sf)).withColumn("pi", 1 / (1 + F.exp(-(F.col("bin") + 0.5) * 0.5)))
    return rounded(policy.selected_density(grid, ["inning"], "weight", "pi").select("inning", "bin", "rate", "selected"), 8)


_Z = "((bin + 0.5::DOUBLE) * 0.5::DOUBLE - thr) / 1.2::DOUBLE"
_TAIL = "exp(-z * z / 2) / 2.5066282746310002 * (1 / (1 + 0.2316419 * abs(z))) * (0.319381530 + (1 / (1 + 0.2316419 * abs(z))) * (-0.356563782 + (1 / (1 + 0.2316419 * abs(z))) * (1.781477937 + (1 / (1 + 0.2316419 * abs(z))) * (-1.821255978 + (1 / (1 + 0.2316419 * abs(z))) * 1.330274429))))"


@query(
    "n24_upper_tail",
    f"WITH {T}, {PRIOR}, g AS (SELECT DISTINCT inning, inning / 10.0::DOUBLE AS thr FROM t), z AS (SELECT g.inning, thr, bin, weight, {_Z} AS z FROM g JOIN prior USING (inning)), p AS (SELECT *, weight * CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END AS m FROM z) SELECT inning, round(sum(m), 6) AS action, round(sum(CASE WHEN bin >= 0 THEN m ELSE 0 END), 6) AS success FROM p GROUP BY inning",
)
def upper_tail(spark, sf):
    """Chance that the signal passes a threshold, also on a wrong call."""
    t = timeline(spark, sf)
    thresholds = t.select("inning").distinct().withColumn("thr", F.col("inning") / 10.0)
    return rounded(prior.upper_tail(thresholds, margin_prior(t), "inning", "thr", 0.5, 1.2, []).drop("thr"))


@query(
    "c4_promotion_gate",
    f"WITH {T}, s AS (SELECT game, (success::INT - p) ^ 2 - (success::INT - 0.2::DOUBLE) ^ 2 AS d FROM t), m AS (SELECT avg(d) AS mean, count(*) AS n FROM s), c AS (SELECT game, sum(d - mean) AS r FROM s CROSS JOIN m GROUP BY game), e AS (SELECT any_value(mean) AS mean, sqrt(count(*)::DOUBLE / (count(*) - 1) * sum(r * r)) / any_value(n) AS se FROM c CROSS JOIN m) SELECT round(mean, 6) AS difference, round(se, 6) AS se, mean + se < 0 AS promoted FROM e",
)
def promotion_gate(spark, sf):
    """C4: is a challenger better than the incumbent by more than one clustered error."""
    y = F.col("success").cast("int")
    rows = timeline(spark, sf).withColumns({"one": F.pow(y - F.col("p"), 2), "two": F.pow(y - 0.2, 2)})
    return rounded(policy.promotion_gate(rows, "game", "one", "two"))


@query(
    "m7_public_policy",
    f"""WITH RECURSIVE {T}, pol AS (SELECT game, team, pitch_order, inning, success, stake, (p * stake > (1 - p) * 0.6::DOUBLE AND stake > 0)::INT AS p1, (p * stake > (1 - p) * 0.3::DOUBLE AND stake > 0)::INT AS p2 FROM t), r AS (
        SELECT game, team, 0::BIGINT AS pitch_order, 0::BIGINT AS inning, 2 AS k, 0::DOUBLE AS cap, 0 AS ch FROM pol WHERE pitch_order = 1
        UNION ALL
        SELECT game, team, pitch_order, inning, CASE WHEN act = 1 AND NOT success THEN k - 1 ELSE k END, CASE WHEN act = 1 AND success THEN stake ELSE 0 END, act FROM (SELECT *, CASE k WHEN 2 THEN p2 WHEN 1 THEN p1 ELSE 0 END AS act FROM (
            SELECT x.*, CASE WHEN x.inning > r.inning AND x.inning > 9 AND r.k = 0 THEN 1 ELSE r.k END AS k FROM r JOIN pol x ON x.game = r.game AND x.team = r.team AND x.pitch_order = r.pitch_order + 1)))
    SELECT game, sum(ch)::DOUBLE AS challenges, round(sum(cap), 4) AS captured FROM r WHERE pitch_order > 0 GROUP BY game""",
)
def public_policy(spark, sf):
    """A policy without signals, replayed."""
    t = timeline(spark, sf).select(*KEYS, *ORDER, "inning", "p", "stake", "success")
    rows = policy.public_thresholds(t, "p", "stake", {1: F.lit(0.6), 2: F.lit(0.3)}).drop("p")
    out = sequential.mass_replay(rows, KEYS, ORDER)
    return out.groupBy("game").agg(F.round(F.sum("state.challenges"), 6).alias("challenges"), F.round(F.sum("state.captured"), 4).alias("captured"))


@query("n10_signal_lookup")
def signal_lookup(spark, sf):
    """Grids of posterior and tails by context, by fast convolution. No SQL: a transform."""
    return rounded(prior.lookup_table(margin_prior(timeline(spark, sf)), "inning", 0.5, 1.2, 0.1))


def lookups(t, contexts: list[int]) -> dict:
    """One lookup per inning and for the league, from a prior whose rows are counted before they are fetched."""
    table = governance.fetched(margin_prior(t), 100_000, "rows of a prior")
    out = {str(c): prior.signal_lookup(*table[table["inning"] == c].sort_values("bin")[["bin", "weight"]].to_numpy().T, 0.5, 1.2) for c in contexts}
    league = table.groupby("bin")["weight"].mean().reset_index()
    return out | {"league": prior.signal_lookup(*league.to_numpy().T, 0.5, 1.2)}


@query("n11_payoffs")
def payoffs(spark, sf):
    """Best thresholds and masses at given stakes, solved in Arrow batches against broadcast lookups."""
    t = timeline(spark, sf)
    rows = t.select("event_id", F.when(F.col("inning") <= 6, F.col("inning").cast("string")).otherwise("late").alias("context"), "stake", (F.col("inning") / 10.0).alias("loss"))
    return rounded(policy.with_payoffs(rows, lookups(t, list(range(1, 7))), "context", "stake", "loss"))


@query("m5_joint_signal_values")
def joint_signal_values(spark, sf):
    """M4, M5: state values when both roles share one inventory and decide by signals. No SQL: a fixed point."""
    t = timeline(spark, sf)
    rows = t.select(*KEYS, *ORDER, "inning", "role", "stake", ((F.col("inning") - 1) * 6).alias("raw")).withColumn("context", F.lit("league"))
    rows = rows.withColumn("stage", F.when(F.col("raw") < 54, F.col("raw")).otherwise(54))
    moves = sequential.transitions(rows, KEYS, ORDER, ["stage", "role", "raw"]).withColumn("delta", F.coalesce(F.col("next_raw") - F.col("raw"), F.lit(0)))
    values = decision.PolicyValues(moves.cache(), decision.by_signal({"league": lookups(t, [])["league"]}), tolerance=1e-8)
    return rounded(spark.createDataFrame(values.frame()))


@query("m4_signal_values")
def m4_signal_values(spark, sf):
    """M4: state values of one role that decides by signals, by reverse sweeps over fronts of states, with updated values. No
    SQL: a fixed point; it agrees with policy iteration."""
    t = timeline(spark, sf).filter("role = 'offense'")
    rows = t.select(*KEYS, *ORDER, "inning", "role", "stake", ((F.col("inning") - 1) * 6).alias("raw")).withColumn("context", F.lit("league"))
    rows = rows.withColumn("stage", F.when(F.col("raw") < 54, F.col("raw")).otherwise(54))
    moves = sequential.transitions(rows, KEYS, ORDER, ["stage", "role", "raw"]).withColumn("delta", F.coalesce(F.col("next_raw") - F.col("raw"), F.lit(0)))
    values = decision.SweptValues(moves.cache(), decision.by_signal({"league": lookups(t, [])["league"]}), tolerance=1e-8)
    return rounded(spark.createDataFrame(values.frame()))


@query("m10_frozen_evaluation", f"WITH RECURSIVE {T}, {frozen_sql()} SELECT role, round(sum(ch), 5) AS challenges, round(sum(won), 5) AS successes, round(sum(ch) - sum(won), 5) AS failures, round(sum(cap), 3) AS captured FROM r WHERE pitch_order > 0 GROUP BY role")
def frozen_evaluation(spark, sf):
    """Thresholds fixed before the truth is joined; replayed and summed by role."""
    clock, truth = public_clock(timeline(spark, sf))
    out = policy.frozen_evaluation(clock, truth, SIGMA)
    return out.groupBy("role").agg(*[F.round(F.sum(f"state.{c}"), n).alias(c) for c, n in (("challenges", 5), ("successes", 5), ("failures", 5), ("captured", 3))])


@query("m12_bias_sensitivity", f"WITH RECURSIVE {T}, n AS (SELECT * FROM (VALUES (0, -sqrt(3.0::DOUBLE), 1 / 6.0::DOUBLE), (1, 0::DOUBLE, 2 / 3.0::DOUBLE), (2, sqrt(3.0::DOUBLE), 1 / 6.0::DOUBLE)) x(node, z0, w)), nb AS (SELECT t.*, node, z0 FROM t CROSS JOIN n), {frozen_sql('team * 10 + node', 'z0 * 0.5::DOUBLE', 'nb')} SELECT role, round(sum(cap * w), 3) AS captured FROM r JOIN n ON n.node = team % 10 WHERE pitch_order > 0 GROUP BY role")
def bias_sensitivity(spark, sf):
    """Captured value under a normal bias of all signals, by quadrature nodes side by side."""
    clock, truth = public_clock(timeline(spark, sf))
    return rounded(policy.bias_sensitivity(clock, truth, SIGMA, 0.5, 3), 3)


@query("m6_policy_search")
def policy_search(spark, sf):
    """M6: maximin pattern search over losses, until the pattern is narrower than its tolerance; a round is one job over arrays that are laid out once."""
    t = timeline(spark, sf).select(*KEYS, *ORDER, "inning", "p", "stake", "success", "role")
    found = policy.search(t, KEYS, "role", tolerance=0.02)
    return rounded(spark.createDataFrame([(found["l1"], found["l2"], found["worst"], found["binding"])], "l1 double, l2 double, worst double, binding string"))


@query("g4_probit_width")
def probit_width(spark, sf):
    """Common width and threshold of simulated choices, by Newton steps on sums. No SQL: a fit."""
    t = timeline(spark, sf).select("event_id", "margin", F.lit("all").alias("player"))
    players = spark.createDataFrame([("all", 0.4, 1.6)], "player string, threshold double, sigma double")
    drawn = models.simulated_choices(t, players, "margin", "player", 3)
    fit = models.width_and_threshold(models.probit(drawn, "challenged", ["margin"]), "margin")
    return rounded(spark.createDataFrame([tuple(float(x) for x in fit.values())], ", ".join(f"{n} double" for n in fit)))


@query("g2_propensity")
def propensity(spark, sf):
    """Cross-fitted probability by whole-game folds."""
    t = timeline(spark, sf).select("event_id", "game", "inning", "margin", F.col("outcome").isNotNull().cast("int").alias("hit"))
    out = models.cross_fitted(t, "game", 3, "hit", ["inning", "margin"])
    return out.select("event_id", "fold", F.round("prediction", 4).alias("prediction"))


@query("c2_nested_components")
def nested_components(spark, sf):
    """Components of a margin mixture by held-out loss over whole-game folds, the fewest within one clustered
    error of the best, of those whose fits all converged. No SQL: an iterative fit."""
    t = resample.dense_folds(timeline(spark, sf), "game", 3)
    scored = models.nested_mixtures(t, "game", "fold", "margin", 4).cache()
    usable = scored.groupBy("k").agg(F.bool_and("converged").alias("all")).filter("all").select("k")
    rows = scored.join(F.broadcast(usable), "k")
    best = policy.smallest_within_one_error(rows, "k", "loss", "game")
    means = rows.groupBy("k").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
    return rounded(means.crossJoin(F.broadcast(best)).select("k", "loss", "best", "selected"), 5)


@query("g5_count_rate")
def count_rate(spark, sf):
    """A Poisson rate in context; a proxy for the over-dispersed fit with random effects."""
    t = timeline(spark, sf).groupBy("game", "team", "inning").agg(F.count("outcome").alias("n"))
    t, terms = models.spline_columns(t, "inning", [4.0, 8.0], "s")
    fit = models.glm(t.withColumns({c: F.col(c) / 1000 for c in terms[1:]}), "n", terms, "poisson")
    return rounded(spark.createDataFrame([(n, float(b)) for n, b in fit["coefficients"].items()], "term string, coefficient double"), 3)


@query("c16_thinned_draws", f"WITH d AS (SELECT o_custkey % 400 AS source_draw, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT * FROM d ORDER BY {HASH.format('4, source_draw')}, source_draw LIMIT 50) SELECT row_number() OVER (ORDER BY source_draw) AS draw, source_draw, n FROM k")
def thinned_draws(spark, sf):
    """A thinned sample of draws, with their source ids."""
    draws = table(spark, sf, "orders").select((F.col("o_custkey") % 400).alias("draw"), F.col("o_orderkey").alias("parameter"))
    return rounded(policy.thinned(draws, "draw", 50, 4).groupBy("draw").agg(F.min("source_draw").alias("source_draw"), F.count("*").alias("n")))


FROZEN_DRAWS = f"""gm AS (SELECT game, row_number() OVER (ORDER BY game) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT game FROM t)), w AS (SELECT r.replicate, h.game, count(*) AS weight FROM gm CROSS JOIN (SELECT unnest(range(1, 5001)) AS replicate) r JOIN gm h ON h.place = {HASH.format("6, r.replicate, gm.place")} % gm.n GROUP BY ALL),
    sums AS (SELECT game, role, sum(cap) AS s, count(*) AS c FROM r WHERE pitch_order > 0 GROUP BY ALL), draws AS (SELECT replicate, role, sum(s * weight) / sum(c * weight) AS m FROM sums JOIN w USING (game) GROUP BY ALL), pt AS (SELECT role, sum(s) / sum(c) AS e FROM sums GROUP BY role)"""


@query("q6_bootstrap_of_frozen_policy", f"WITH RECURSIVE {T}, {frozen_sql()}, {FROZEN_DRAWS} SELECT role, round(any_value(e), 5) AS estimate, round(quantile_cont(m, 0.025), 5) AS lower, round(median(m), 5) AS median, round(quantile_cont(m, 0.975), 5) AS upper FROM draws JOIN pt USING (role) GROUP BY role")
def bootstrap_of_frozen_policy(spark, sf):
    """Interval of a frozen policy's captured value, by whole games."""
    clock, truth = public_clock(timeline(spark, sf))
    out = policy.frozen_evaluation(clock, truth, SIGMA).select("game_pk", "role", F.col("state.captured").alias("captured"))
    return rounded(resample.bootstrap_interval(out, "game_pk", ["role"], "captured", 5000, 6), 5)


def logistic_quality(x: np.ndarray) -> np.ndarray:
    """A posterior in closed form, which both engines can evaluate."""
    return 1 / (1 + np.exp(-1.5 * x))


@query(
    "n15_mean_above_threshold",
    f"""WITH {T}, c AS (SELECT DISTINCT margin, inning FROM t), n AS (SELECT unnest(range(0, 4001)) AS i), w AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM n),
    z AS (SELECT margin, inning, w, greatest((inning / 5.0::DOUBLE - margin) / 1.2::DOUBLE, -9) AS z0, i FROM c CROSS JOIN w), y AS (SELECT margin, inning, w, z0, z0 + (greatest(z0, 0) + 9 - z0) * i / 4000 AS z FROM z),
    m AS (SELECT margin, inning, sum(w * exp(-(z * z - greatest(z0, 0) ^ 2) / 2) / (1 + exp(-1.5 * (margin + 1.2::DOUBLE * z)))) / sum(w * exp(-(z * z - greatest(z0, 0) ^ 2) / 2)) AS q FROM y GROUP BY ALL)
    SELECT event_id, round(q, 6) AS q_chosen, true AS exact FROM t JOIN m USING (margin, inning)""",
)
def mean_above_threshold(spark, sf):
    """The mean posterior over signals beyond each row's threshold, by adaptive quadrature with an estimate of its error."""
    t = timeline(spark, sf)
    out = quadrature.with_tail_means(t, logistic_quality, F.col("inning") / 5.0, F.col("margin"), F.lit(1.2), "q_chosen")
    return out.select("event_id", F.round("q_chosen", 6).alias("q_chosen"), (F.col("q_chosen_error") < 1e-6).alias("exact"))


_NODES = "[" + ", ".join(f"{{'t': {t!r}::DOUBLE, 'w': {w!r}::DOUBLE}}" for t, w in orthant_nodes()) + "]"


def _phi_of(x: str) -> str:
    return "(" + _PHI.replace("z", f"({x})") + ")"


@query(
    "n17_orthant_mass",
    f"""WITH {T}, c AS (SELECT DISTINCT margin, inning FROM t), x AS (SELECT margin, inning, -margin / 0.9::DOUBLE AS h, (inning / 5.0::DOUBLE - margin) / 1.5::DOUBLE AS k, (inning - 6.5::DOUBLE) / 5.5::DOUBLE AS r FROM c), a AS (SELECT *, asin(r) AS arc FROM x),
    m AS (SELECT margin, inning, CASE WHEN r >= 1 THEN {_phi_of("-greatest(h, k)")} WHEN r <= -1 THEN greatest({_phi_of("-h")} - {_phi_of("k")}, 0)
        ELSE {_phi_of("-h")} * {_phi_of("-k")} + arc * list_sum(list_transform({_NODES}, lambda n: n.w * exp(-(h * h + k * k - 2 * h * k * sin(arc * n.t)) / (2 * (1 - sin(arc * n.t) ^ 2))))) / (2 * pi()) END AS mass FROM a)
    SELECT event_id, round(mass, 6) AS mass FROM t JOIN m USING (margin, inning)""".replace("exp(", "exp("),
)
def orthant_mass(spark, sf):
    """The chance that a margin is wrong and its signal passes, two correlated normals, at correlations from -1 to 1."""
    h, k = -F.col("margin") / 0.9, (F.col("inning") / 5.0 - F.col("margin")) / 1.5
    return timeline(spark, sf).select("event_id", F.round(orthant(h, k, (F.col("inning") - 6.5) / 5.5), 6).alias("mass"))


CONTEXT = """x AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_linenumber - 1 AS b, l_suppkey % 4 AS s, l_partkey % 4 AS o, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS st, CASE WHEN l_linestatus = 'O' THEN l_linestatus END AS th, CASE WHEN l_partkey % 50 = 0 THEN 'EP' END AS kind, CASE WHEN l_partkey % 9 > 0 THEN 60 + l_quantity END AS speed, l_tax * 100 - 4 AS margin FROM lineitem),
    k AS (SELECT *, CASE WHEN kind = 'EP' THEN 'eephus' WHEN speed < 75 THEN 'slow_non_eephus' WHEN speed IS NULL THEN 'speed_missing' ELSE 'regular_speed' END AS speed_stratum, CASE WHEN abs(margin) <= 3 THEN 'local_abs_margin_le_3' ELSE 'tail_abs_margin_gt_3' END AS margin_stratum FROM x)"""


@query(
    "p19_selection_context",
    f"WITH {CONTEXT} SELECT l_orderkey, l_linenumber, CASE WHEN b BETWEEN 0 AND 3 AND s BETWEEN 0 AND 2 THEN concat_ws('-', b, s) ELSE 'unknown' END AS count_state, concat_ws('-', coalesce(st, 'U'), coalesce(th, 'U')) AS matchup, CASE WHEN o BETWEEN 0 AND 2 THEN o::VARCHAR ELSE 'unknown' END AS outs_state, concat_ws('__', speed_stratum, margin_stratum) AS selection_stratum FROM k",
)
def selection_context(spark, sf):
    """Count, matchup, speed and margin strata."""
    p = F.col("l_partkey")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_linenumber") - 1).alias("balls_before"), (F.col("l_suppkey") % 4).alias("strikes_before"), (p % 4).alias("outs_before"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("stand"), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("p_throws"),
        F.when(p % 50 == 0, "EP").alias("pitch_type"), F.when(p % 9 > 0, F.col("l_quantity") + 60).alias("release_speed"), (F.col("l_tax") * 100 - 4).alias("margin"),
    )
    return selection.with_context(rows).select("l_orderkey", "l_linenumber", "count_state", "matchup", "outs_state", "selection_stratum")


@query(
    "a24_selection_evaluation",
    f"""WITH {T}, y AS (SELECT *, (outcome IS NOT NULL)::INT::DOUBLE AS y, success::INT::DOUBLE AS s FROM t), g AS (SELECT role, margin, sum(y) AS a, sum(p) AS b FROM y GROUP BY ALL), c AS (SELECT role, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY role) - sum(b) OVER w / sum(b) OVER (PARTITION BY role)) AS gap FROM g WINDOW w AS (PARTITION BY role ORDER BY margin)), k AS (SELECT role, max(gap) AS ks FROM c GROUP BY role)
    SELECT role, round(sum(y), 6) AS attempts, round(sum(p), 4) AS predicted_attempts, round(sum(p * s), 4) AS predicted_successes, round(sum(y * margin) / nullif(sum(y), 0), 6) AS mean_margin, round(any_value(ks), 6) AS ks FROM y JOIN k USING (role) GROUP BY role""",
)
def selection_evaluation(spark, sf):
    """Observed against predicted choices, with distances of their margins."""
    rows = timeline(spark, sf).withColumn("chosen", F.col("outcome").isNotNull())
    out = selection.evaluated(rows, ["role"], "chosen", "p", "success", "margin")
    return out.select("role", F.round("attempts", 6).alias("attempts"), F.round("predicted_attempts", 4).alias("predicted_attempts"), F.round("predicted_successes", 4).alias("predicted_successes"), F.round("mean_margin", 6).alias("mean_margin"), F.round("ks", 6).alias("ks"))


@query("p31_design_columns", f"WITH {T}, m AS (SELECT avg(stake) AS mu, stddev_samp(stake) AS sd FROM t) SELECT event_id, (event_type = 'click')::INT::DOUBLE AS click, round((stake - mu) / sd, 6) AS z FROM t CROSS JOIN m")
def design_columns(spark, sf):
    """Indicators by stored levels and z-scores by stored moments."""
    t = timeline(spark, sf)
    made, _ = selection.design(t, {"event_type": ["view", "click"]}, selection.learnt_scales(t, ["stake"]))
    return made.select("event_id", F.col("event_type__click").alias("click"), F.round("z__stake", 6).alias("z"))
