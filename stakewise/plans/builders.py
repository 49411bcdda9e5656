"""Model rows, threshold tables, replays under beliefs, coordinated refits, and sources and checks met by queries."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from stakewise.functions import scalar as S
from stakewise.operators import builders, governance, resample, selection, transitions
from stakewise.plans.base import KEYS, ORDER, T, query, rounded, table, timeline
from stakewise.plans.sequential import AFTER, BRANCH, PLATE, plate
from stakewise.plans.statistics import HASH, PRIOR, margin_prior
from stakewise.sources.readers import scratch


@query("p1_renamed_columns", "SELECT p_partkey AS item_id, p_name AS label, p_brand AS family FROM part")
def renamed_columns(spark, sf):
    """A required projection under new names."""
    return builders.renamed(table(spark, sf, "part"), {"p_partkey": "item_id", "p_name": "label", "p_brand": "family"}, "items")


@query("p27_rounded_limits", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(coalesce(CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice / 16 END, l_quantity / 16)::DECIMAL(20, 9), 3)::DOUBLE AS v FROM lineitem")
def rounded_limits(spark, sf):
    """One source's limit, else the other's, at three places; sixteenths have ties."""
    r = table(spark, sf, "lineitem")
    v = builders.limits(F.when(F.col("l_linenumber") % 3 > 0, F.col("l_extendedprice") / 16), F.col("l_quantity") / 16)
    return r.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), v.alias("v"))


@query("p16_pattern_fields", r"SELECT o_orderkey, regexp_matches(o_orderpriority, '^[12]-') AS urgent, regexp_replace(o_orderpriority, '^[0-9]-', '') AS label, regexp_replace(lower(o_orderpriority), '[^a-z]+', '_', 'g') AS slug, year(o_orderdate) AS year, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def pattern_fields(spark, sf):
    """Patterns and dates of text fields."""
    o = table(spark, sf, "orders")
    return rounded(o.select("o_orderkey", F.rlike("o_orderpriority", F.lit("^[12]-")).alias("urgent"), F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("label"), F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]+", "_").alias("slug"), F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM").alias("month")))


@query(
    "t5_win_state",
    f"""WITH {PLATE}, a AS (SELECT *, 1 + l_orderkey % 13 AS inn, l_orderkey % 2 = 0 AS bottom, l_orderkey % 17 AS bat, l_orderkey % 5 AS fld FROM ({AFTER.format(BRANCH.format('plate'))})), s AS (SELECT *, no >= 3 AS over FROM a)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, least(inn + (over AND bottom)::INT, 12)::BIGINT AS inning, (CASE WHEN over THEN NOT bottom ELSE bottom END)::BIGINT AS is_bottom, greatest(-10, least(10, CASE WHEN bottom THEN bat + nr - fld ELSE fld - bat - nr END))::BIGINT AS score_diff,
        (CASE WHEN over THEN 0 ELSE no END)::BIGINT AS outs, CASE WHEN over THEN '000' ELSE concat(n1, n2, n3) END AS base_state, CASE WHEN over THEN '0-0' ELSE concat_ws('-', nb, ns) END AS count_state FROM s""",
)
def win_state(spark, sf):
    """T5: state after rollover of the half, with inning and score limited."""
    p = plate(spark, sf).withColumns({"inning": (1 + F.col("l_orderkey") % 13), "half": F.when(F.col("l_orderkey") % 2 == 0, "bottom").otherwise("top"), "bat_score": F.col("l_orderkey") % 17, "fld_score": F.col("l_orderkey") % 5})
    return rounded(transitions.win_state(transitions.call_branch(p, F.col("call"))).select("l_orderkey", "l_linenumber", "win_state.*"))


@query("o14_last_eligible", "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS last_priority FROM orders GROUP BY o_custkey")
def last_eligible(spark, sf):
    """The last element of a nested array that meets a condition."""
    nested = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("events"))
    fits = F.filter("events", lambda e: e["o_orderstatus"] == "F")
    return nested.select("o_custkey", F.get(fits, F.size(fits) - 1)["o_orderpriority"].alias("last_priority"))


@query("o10_split_and_map", "SELECT l_suppkey, count(*) AS n, round(sum(w * l_quantity) / sum(w), 6) AS smooth FROM (SELECT *, 0.5::DOUBLE ^ ((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) - 1) / 50.0::DOUBLE) AS w FROM lineitem) GROUP BY l_suppkey")
def split_and_map(spark, sf):
    """A table split into groups, each summarised by a function of its own; here as a window and an aggregate."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber")
    rows = table(spark, sf, "lineitem").withColumn("w", F.pow(F.lit(0.5), (F.row_number().over(w) - 1) / F.lit(50.0)))
    return rounded(rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("l_quantity")) / F.sum("w")).alias("smooth")))


@query("b6_official_challenges", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'overturned' ELSE 'upheld' END AS savant_outcome, CASE WHEN l_linestatus = 'O' THEN 'called_strike' ELSE 'ball' END AS savant_initial_call, CASE WHEN l_linestatus = 'O' THEN l_suppkey % 30 ELSE l_partkey % 30 END::BIGINT AS savant_challenger_team_id FROM lineitem")
def official_challenges(spark, sf):
    """Outcome, call and challenger of official rows."""
    r = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_returnflag") == "R").cast("int").alias("is_challengeABS_overturned"), (F.col("l_linestatus") == "O").cast("int").alias("original_isStrike_ump"), (F.col("l_suppkey") % 30).alias("bat_team_id"), (F.col("l_partkey") % 30).alias("fld_team_id"))
    return builders.official_challenges(r).select("l_orderkey", "l_linenumber", "savant_outcome", "savant_initial_call", "savant_challenger_team_id")


def model_rows(t):
    """The timeline under the names of model rows."""
    e = F.col("event_id")
    return t.select(
        F.col("game").alias("game_pk"), "team", "pitch_order", "inning", "event_id", "role", F.when(F.col("role") == "offense", "called_strike").otherwise("ball").alias("initial_call"), (e % 9 > 0).alias("tracking_available"),
        F.when(e % 11 > 0, F.col("margin")).alias("edge_distance_inches"), F.when(e % 3 == 0, F.col("margin")).alias("exact_margin"), (e % 5).alias("balls_before"), (e % 4).alias("strikes_before"),
        F.element_at(F.array(*map(F.lit, ("FF", "SL", "CH", "XX"))), (e % 4 + 1).cast("int")).alias("pitch_type"), F.when(e % 13 > 0, F.col("user_id")).alias("unit_id"), F.col("team").cast("string").alias("team_id"),
        F.col("stake").alias("stake_G"), (F.col("inning") / 10.0).alias("inventory_loss"), F.col("outcome").isNotNull().cast("int").alias("challenged"), (e % 3).alias("inventory"),
    )


_COUNT = "CASE WHEN event_id % 5 <= 3 AND event_id % 4 <= 2 THEN concat_ws('-', event_id % 5, event_id % 4) ELSE 'unknown' END"


@query(
    "b8_discrimination_rows",
    f"""WITH {T}, r AS (SELECT *, inning / 10.0::DOUBLE AS loss, CASE WHEN event_id % 3 = 0 OR event_id % 11 > 0 THEN margin END AS m FROM t WHERE role = 'offense' AND event_id % 13 > 0 AND event_id % 3 >= 1), q AS (SELECT *, loss / (stake + loss) AS q, greatest(1e-6, least(1 - 1e-6, loss / (stake + loss))) AS c FROM r WHERE m IS NOT NULL AND stake >= 0 AND stake + loss > 0)
    SELECT event_id, m AS margin_inches, CASE WHEN event_id % 3 = 0 THEN 'exact_rounded_geometry' ELSE 'precomputed_exact_edge' END AS margin_source, {_COUNT} AS count_state, round(stake + loss, 6) AS total_stake, round(q, 8) AS q_star, c <> q AS q_star_clipped, round(ln(c / (1 - c)), 6) AS cost FROM q""",
)
def discrimination_rows(spark, sf):
    """Eligible rows with reconciled margins, break-even chances and their log-odds."""
    out = builders.discrimination_rows(model_rows(timeline(spark, sf)))
    return out.select("event_id", "margin_inches", "margin_source", "count_state", F.round("total_stake", 6).alias("total_stake"), F.round("q_star", 8).alias("q_star"), "q_star_clipped", F.round("challenge_cost_log_odds", 6).alias("cost"))


@query("b9_margin_prior_rows", f"WITH {T} SELECT game AS game_pk, pitch_order, {_COUNT} AS count_state, margin AS edge_distance_inches FROM t WHERE role = 'offense' AND event_id % 9 > 0 AND event_id % 11 > 0")
def margin_prior_rows(spark, sf):
    """Rows of the margin prior."""
    return rounded(builders.margin_prior_rows(model_rows(timeline(spark, sf))))


@query("b11_role_prior_rows", f"WITH {T} SELECT event_id, role, margin AS physical_margin, CASE WHEN role = 'defense' THEN 0 - margin ELSE margin END AS role_margin, concat_ws('__', {_COUNT}, CASE event_id % 4 WHEN 0 THEN 'fastball' WHEN 1 THEN 'breaking' WHEN 2 THEN 'offspeed' ELSE 'other' END) AS context FROM t WHERE event_id % 9 > 0 AND event_id % 11 > 0".replace("SELECT event_id, role", "SELECT game AS game_pk, pitch_order, role"))
def role_prior_rows(spark, sf):
    """Prior rows of both roles, margins signed for each, by count and pitch family."""
    return rounded(builders.role_prior_rows(model_rows(timeline(spark, sf))))


@query("b15_decision_units", f"WITH {T} SELECT event_id, CASE WHEN role = 'offense' THEN user_id ELSE team END::VARCHAR AS decision_unit_id, CASE WHEN role = 'offense' THEN team ELSE user_id % 7 END::VARCHAR AS team_context_id, CASE WHEN role = 'defense' THEN 0 - margin ELSE margin END AS role_margin_inches FROM t")
def decision_units(spark, sf):
    """Both roles' width rows under the same names."""
    t = timeline(spark, sf).select("event_id", "role", F.col("user_id").alias("batter_id"), F.col("team").alias("defensive_team_id"), F.col("team").alias("bat_team_id"), (F.col("user_id") % 7).alias("opponent_team_id"), F.col("margin").alias("margin_inches"))
    return builders.decision_units(t).select("event_id", "decision_unit_id", "team_context_id", "role_margin_inches")


WIDTHS = "widths AS (SELECT * FROM (VALUES (1, 'offense', 1.2::DOUBLE), (1, 'defense', 0.8), (2, 'offense', 1.4), (2, 'defense', 0.9)) w(fold, role, width)), scen AS (SELECT * FROM (VALUES (1, 1.0::DOUBLE, 1.0::DOUBLE), (2, 0.5, 0.8)) s(scenario_id, ko, kd))"


def threshold_rows(spark, sf):
    t = timeline(spark, sf)
    e = F.col("event_id")
    replays = t.select("event_id", "role", "margin", F.col("inning").alias("stage"), (e % 2 + 1).cast("int").alias("fold"), F.when(e % 10 == 0, "passive").otherwise("structural").alias("decision_mode"), F.col("stake").alias("stake_G"), (F.col("inning") / 10.0).alias("loss_k1"), (F.col("inning") / 20.0).alias("loss_k2"), (F.col("inning") / 8.0).alias("r_k1"), (F.col("inning") / 16.0).alias("r_k2"))
    widths = spark.createDataFrame([(1, "offense", 1.2), (1, "defense", 0.8), (2, "offense", 1.4), (2, "defense", 0.9)], "fold int, role string, width double")
    scenarios = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.8)], "scenario_id int, offense_kappa double, defense_kappa double")
    return builders.threshold_table(replays, widths, scenarios, ["event_id", "margin"])


_THRESHOLDS = f"""{T}, {WIDTHS}, x AS (SELECT t.event_id, t.role, t.margin, t.inning AS stage, w.width, s.scenario_id, k.v AS inventory, stake AS G, inning / (10.0::DOUBLE * k.v) AS L, inning / (8.0::DOUBLE * k.v) AS r_star, CASE WHEN t.role = 'offense' THEN ko ELSE kd END AS kappa
    FROM t JOIN widths w ON w.role = t.role AND w.fold = t.event_id % 2 + 1 CROSS JOIN scen s CROSS JOIN (SELECT unnest([1, 2]) AS v) k WHERE t.event_id % 10 <> 0)"""


@query("r14_threshold_table", f"WITH {_THRESHOLDS} SELECT event_id, scenario_id::BIGINT AS scenario_id, inventory::BIGINT AS inventory, stage, round(width * kappa, 6) AS sensory_sigma, round(width * sqrt(1 - kappa * kappa), 6) AS action_sigma, round(r_star, 6) AS r_star, round(CASE WHEN G + L > 0 THEN L / (G + L) END, 6) AS q_star FROM x")
def threshold_table(spark, sf):
    """Thresholds by scenario and inventory with widths and break-even chances."""
    return rounded(threshold_rows(spark, sf).select("event_id", "scenario_id", "inventory", "stage", "sensory_sigma", "action_sigma", "r_star", "q_star"))


_TAILS = "exp(-z * z / 2) / 2.5066282746310002 * (1 / (1 + 0.2316419 * abs(z))) * (0.319381530 + (1 / (1 + 0.2316419 * abs(z))) * (-0.356563782 + (1 / (1 + 0.2316419 * abs(z))) * (1.781477937 + (1 / (1 + 0.2316419 * abs(z))) * (-1.821255978 + (1 / (1 + 0.2316419 * abs(z))) * 1.330274429))))"
_PHI = f"CASE WHEN z >= 0 THEN 1 - {_TAILS} ELSE {_TAILS} END"


@query("r14_profile_table", f"WITH {_THRESHOLDS}, z AS (SELECT *, (margin - r_star) / (width * kappa) AS z FROM x), p AS (SELECT *, {_PHI} AS p FROM z) SELECT role, scenario_id::BIGINT AS scenario_id, inventory::BIGINT AS inventory, (CASE WHEN margin = 0 THEN -1 ELSE floor(margin / 0.5 + 1e-9) END)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS probability FROM p GROUP BY ALL")
def profile_table(spark, sf):
    """Mean normative chance to challenge by margin bin, scenario and inventory."""
    rows = threshold_rows(spark, sf)
    chance = builders.normative_probability(F.col("margin"), F.col("r_star"), F.col("sensory_sigma"))
    return rounded(builders.profile(rows, ["role", "scenario_id", "inventory"], "margin", 0.5, chance))


_BELIEFS = f"""{T}, {PRIOR}, th AS (SELECT DISTINCT inning, k.v AS k, inning / (10.0::DOUBLE * k.v) AS thr FROM t CROSS JOIN (SELECT unnest([1, 2]) AS v) k), zz AS (SELECT th.inning, k, weight, bin, ((bin + 0.5::DOUBLE) * 0.5::DOUBLE - thr) / 1.2::DOUBLE AS z FROM th JOIN prior USING (inning)), m AS (SELECT *, weight * {_PHI} AS m FROM zz),
    ms AS (SELECT inning, sum(m) FILTER (k = 1) AS a1, sum(m) FILTER (k = 2) AS a2, sum(m) FILTER (k = 1 AND bin >= 0) AS s1, sum(m) FILTER (k = 2 AND bin >= 0) AS s2 FROM m GROUP BY inning),
    y AS (SELECT game, team, pitch_order, t.inning, role, stake, CASE WHEN event_id % 10 = 0 THEN 'passive' WHEN event_id % 10 = 1 THEN 'exogenous' ELSE 'structural' END AS mode, a1, a2, s1, s2 FROM t JOIN ms ON ms.inning = t.inning)"""
_RUN = """r AS (SELECT game, team, 0::BIGINT AS pitch_order, 0::BIGINT AS inning, '' AS role, 0::DOUBLE AS x0, 0::DOUBLE AS x1, 1::DOUBLE AS x2, 0::DOUBLE AS ch, 0::DOUBLE AS won, 0::DOUBLE AS cap FROM y WHERE pitch_order = 1
    UNION ALL SELECT game, team, pitch_order, inning, role, m0 + m1 * live * (a1 - s1), m1 - m1 * live * (a1 - s1) + m2 * live * (a2 - s2), m2 - m2 * live * (a2 - s2), live * (m1 * a1 + m2 * a2), live * (m1 * s1 + m2 * s2), own * live * (m1 * s1 + m2 * s2) * stake FROM (
        SELECT y.*, CASE WHEN mode = 'passive' THEN 0::DOUBLE ELSE 1 END AS live, CASE WHEN mode = 'structural' THEN 1::DOUBLE ELSE 0 END AS own, CASE WHEN y.inning > 9 AND y.inning > r.inning THEN 0 ELSE x0 END AS m0, x1 + CASE WHEN y.inning > 9 AND y.inning > r.inning THEN x0 ELSE 0 END AS m1, x2 AS m2
        FROM r JOIN y ON y.game = r.game AND y.team = r.team AND y.pitch_order = r.pitch_order + 1))"""


def believed(spark, sf):
    """The timeline with the masses of acting and of success at given thresholds, from the margin prior alone."""
    from stakewise.operators import prior

    t = timeline(spark, sf)
    rows = t.select(*KEYS, *ORDER, "inning", "role", "stake", F.when(F.col("event_id") % 10 == 0, "passive").when(F.col("event_id") % 10 == 1, "exogenous").otherwise("structural").alias("decision_mode"))
    held = margin_prior(t)
    for k in (1, 2):
        thresholds = t.select("inning").distinct().withColumn("thr", F.col("inning") / (10.0 * k))
        masses = prior.upper_tail(thresholds, held, "inning", "thr", 0.5, 1.2, []).select("inning", F.col("action").alias(f"a{k}"), F.col("success").alias(f"s{k}"))
        rows = rows.join(F.broadcast(masses), "inning")
    return builders.prior_replay(rows, KEYS, ORDER)


@query("q6_signal_replay", f"WITH RECURSIVE {_BELIEFS}, {_RUN} SELECT game, team, pitch_order, round(ch, 7) AS challenges, round(won, 7) AS successes, round(cap, 5) AS captured FROM r WHERE pitch_order > 0")
def signal_replay(spark, sf):
    """Q6: both roles share one inventory and act by signals; structural, passive and exogenous rows."""
    out = believed(spark, sf)
    return out.select(*KEYS, F.col("pitch_order").cast("long").alias("pitch_order"), F.round("state.challenges", 7).alias("challenges"), F.round("state.successes", 7).alias("successes"), F.round("state.captured", 5).alias("captured"))


@query("r16_prior_only_score", f"WITH RECURSIVE {_BELIEFS}, {_RUN} SELECT CASE WHEN grouping(role) = 1 THEN 'combined' ELSE role END AS role, round(sum(cap), 3) AS expected, round(sum(cap) / (SELECT count(*) FROM (SELECT DISTINCT game, team FROM t)), 5) AS per_team_game FROM r WHERE pitch_order > 0 GROUP BY GROUPING SETS ((role), ())")
def prior_only_score(spark, sf):
    """Value of a policy under its prior alone, by role and combined."""
    from stakewise.operators.stats import with_total

    out = believed(spark, sf).select(*KEYS, "role", F.col("state.captured").alias("captured"))
    games = out.select(*KEYS).distinct().agg(F.count("*").alias("games"))
    summed = with_total(out, "role", [F.sum("captured").alias("expected")])
    return summed.crossJoin(F.broadcast(games)).select("role", F.round("expected", 3).alias("expected"), F.round(F.col("expected") / F.col("games"), 5).alias("per_team_game"))


_DRAWS = ((1, 0.6), (2, 0.9), (3, 1.3), (4, 2.0))


@query(
    "n14_draw_thresholds",
    f"""WITH RECURSIVE {T}, c AS (SELECT DISTINCT inning, floor(stake)::DOUBLE AS g FROM t), d AS (SELECT * FROM (VALUES {", ".join(f"({d}, {s}::DOUBLE)" for d, s in _DRAWS)}) v(draw, sigma)), x AS (SELECT inning, g, draw, 2.25::DOUBLE / (2.25 + sigma * sigma) AS w, (inning / 10.0::DOUBLE) / (g + inning / 10.0::DOUBLE) AS q FROM c CROSS JOIN d WHERE g > 0),
    bi AS (SELECT inning, g, draw, w, q, 0 AS i, -40::DOUBLE AS lo, 40::DOUBLE AS hi FROM x UNION ALL SELECT inning, g, draw, w, q, i + 1, CASE WHEN {_PHI} < q THEN mid ELSE lo END, CASE WHEN {_PHI} < q THEN hi ELSE mid END FROM (SELECT *, (lo + hi) / 2 AS mid, (w * (lo + hi) / 2 + (1 - w) * -0.4) / (sqrt(1 - w) * 1.5) AS z FROM bi WHERE i < 60)),
    s AS (SELECT inning, g, (lo + hi) / 2 AS r FROM bi WHERE i = 60) SELECT inning, g AS gain, round(avg(r), 5) AS mean, round(min(r), 5) AS least, round(max(r), 5) AS greatest FROM s GROUP BY inning, g""",
)
def draw_thresholds(spark, sf):
    """Thresholds by row and draw, as roots of a belief, summed up over draws."""
    t = timeline(spark, sf)
    rows = t.select("inning", F.floor("stake").cast("double").alias("gain")).distinct().filter("gain > 0").withColumn("loss", F.col("inning") / 10.0)
    draws = spark.createDataFrame(list(_DRAWS), "draw int, sigma double")
    out = builders.draw_thresholds(rows, draws, -0.4, 1.5, "gain", "loss")
    return rounded(out.groupBy("inning", "gain").agg(F.avg("r_star").alias("mean"), F.min("r_star").alias("least"), F.max("r_star").alias("greatest")), 5)


REPLICATES, SEED = 300, 17
_OFFSET = {name: 9176 * sum(ord(c) * i for i, c in enumerate(name, 1)) for name in ("clock", "history", "width")}


def _weights(name: str, groups: str) -> str:
    seed = f"1 + ({SEED} + r.replicate * 1000003 + {_OFFSET[name]}) % 2147483646"
    return f"""g_{name} AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM ({groups})), w_{name} AS (SELECT r.replicate, h.g, count(*) AS weight FROM g_{name} a CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate) r JOIN g_{name} h ON h.place = {HASH.format(seed + ", a.place")} % a.n GROUP BY ALL)"""


SOURCES = f"""{_weights("clock", "SELECT DISTINCT game AS g FROM t")}, {_weights("history", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS g FROM orders")}, {_weights("width", "SELECT DISTINCT game AS g FROM t")}"""


@query(
    "c8_coordinated_refits",
    f"""WITH {T}, {SOURCES}, ms AS (SELECT strftime(o_orderdate, '%Y-%m') AS g, o_orderstatus AS parent, o_orderpriority AS cell, sum(o_totalprice / 1e5) AS s, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
    tot AS (SELECT replicate, parent, cell, sum(s * weight) AS s, sum(n * weight) AS n FROM ms JOIN w_history USING (g) GROUP BY ALL), par AS (SELECT replicate, parent, sum(s) / sum(n) AS m FROM tot GROUP BY ALL), re AS (SELECT replicate, avg((s + 20 * m) / (n + 20)) AS re FROM tot JOIN par USING (replicate, parent) GROUP BY replicate),
    wd AS (SELECT replicate, sqrt(greatest(0, sum(ss * weight) / sum(n * weight) - (sum(s * weight) / sum(n * weight)) ^ 2)) AS width, sum(w * weight) / sum(n * weight) AS wrong FROM (SELECT game AS g, count(*)::DOUBLE AS n, sum(margin) AS s, sum(margin * margin) AS ss, sum((margin > 0)::INT)::DOUBLE AS w FROM t GROUP BY game) JOIN w_width USING (g) GROUP BY replicate),
    ck AS (SELECT replicate, sum(s * weight) / sum(n * weight) AS stake FROM (SELECT game AS g, sum(p * stake) AS s, count(*)::DOUBLE AS n FROM t GROUP BY game) JOIN w_clock USING (g) GROUP BY replicate)
    SELECT replicate::BIGINT AS replicate, round(re, 6) AS re, round(width, 6) AS width, round(wrong, 6) AS wrong, round(stake, 5) AS stake, round(re * width * wrong * stake, 4) AS value FROM re JOIN wd USING (replicate) JOIN ck USING (replicate)""",
)
def coordinated_refits(spark, sf):
    """Three sources resampled with seeds of their own; an expectation table, a width and a prior's rate
    refitted by weighted group sums in every replicate, and the evaluation scored with all three. Finished replicates are
    kept: the query stops halfway, starts again, and computes those that are missing."""
    t = timeline(spark, sf)
    orders = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("g"), F.col("o_orderstatus").alias("parent"), F.col("o_orderpriority").alias("cell"), (F.col("o_totalprice") / 1e5).alias("v"))
    named = t.select(F.col("game").alias("g"), "p", "stake", "margin")
    weights = builders.coordinated_weights({"clock": named, "history": orders, "width": named}, "g", REPLICATES, SEED)
    n, margin = F.count("*").cast("double").alias("n"), F.col("margin")
    sums = orders.groupBy("g", "parent", "cell").agg(F.sum("v").alias("s"), n).cache()
    moments = named.groupBy("g").agg(n, F.sum("margin").alias("s"), F.sum(margin * margin).alias("ss"), F.sum((margin > 0).cast("double")).alias("w"), F.sum(F.col("p") * F.col("stake")).alias("c")).cache()

    def refitted(replicates):
        of = lambda name: weights.filter(F.col("source") == name).drop("source").join(replicates, "replicate")
        re = builders.refitted_cells(sums, of("history"), "g", ["cell"], ["parent"]).groupBy("replicate").agg(F.avg("estimate").alias("re"))
        widths = builders.refitted_widths(moments, of("width"), "g", [])
        prior = resample.bootstrap_totals(moments, of("width"), "g", [], ["w", "n"]).select("replicate", (F.col("w") / F.col("n")).alias("wrong"))
        clock = resample.bootstrap_totals(moments, of("clock"), "g", [], ["c", "n"]).select("replicate", (F.col("c") / F.col("n")).alias("stake"))
        return re.join(widths, "replicate").join(prior, "replicate").join(clock, "replicate").select("replicate", "re", "width", "wrong", "stake")

    folder = scratch(spark, "replicates")
    replicates = spark.range(1, REPLICATES + 1).select(F.col("id").cast("int").alias("replicate"))
    resample.resumed(folder, replicates, refitted, parts=2, most_parts=1)
    out = resample.resumed(folder, replicates, refitted, parts=2)
    value = F.col("re") * F.col("width") * F.col("wrong") * F.col("stake")
    return out.select(F.col("replicate").cast("long").alias("replicate"), *[F.round(c, 6).alias(c) for c in ("re", "width", "wrong")], F.round("stake", 5).alias("stake"), F.round(value, 4).alias("value"))


@query(
    "c15_cross_fitted_parts",
    f"""WITH {T}, f AS (SELECT *, (dense_rank() OVER (ORDER BY game) - 1) % 3 + 1 AS fold, floor(margin / 0.5 + 1e-9) AS bin FROM t), k AS (SELECT unnest([1, 2, 3]) AS fold), tr AS (SELECT k.fold, f.role, margin, CASE WHEN margin = 0 THEN -1 ELSE bin END AS bin FROM f JOIN k ON k.fold <> f.fold)
    SELECT fold::BIGINT AS fold, role, count(*) AS n, round(stddev_pop(margin), 6) AS width, round(avg((bin >= 0)::INT), 6) AS wrong_rate FROM tr GROUP BY ALL""",
)
def cross_fitted_parts(spark, sf):
    """Widths and priors of every fold and role from the other folds' games, by subtracting a fold's sums from all."""
    t = resample.dense_folds(timeline(spark, sf), "game", 3)
    wrong = (S.margin_bin(F.col("margin"), 0.5) >= 0).cast("double")
    cells = t.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("margin").alias("s"), F.sum(F.col("margin") * F.col("margin")).alias("ss"), F.sum(wrong).alias("w"))
    names = ["n", "s", "ss", "w"]
    whole = cells.groupBy("role").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    rest = cells.join(F.broadcast(whole), "role").select("fold", "role", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in names])
    mean = F.col("s") / F.col("n")
    return rounded(rest.select("fold", "role", "n", F.sqrt(F.col("ss") / F.col("n") - mean * mean).alias("width"), (F.col("w") / F.col("n")).alias("wrong_rate")))


@query("g12_belief_envelope", f"WITH {T}, {PRIOR}, g AS (SELECT x::DOUBLE / 4 AS signal FROM (SELECT unnest(range(-16, 17)) AS x)), s AS (SELECT 1 AS scenario, 0.6::DOUBLE AS sigma UNION ALL SELECT 2, 1.2 UNION ALL SELECT 3, 2.0), m AS (SELECT scenario, inning, signal, sum(CASE WHEN bin >= 0 THEN weight * exp(-(((signal - (bin + 0.5::DOUBLE) * 0.5) / sigma) ^ 2) / 2) ELSE 0 END) / sum(weight * exp(-(((signal - (bin + 0.5::DOUBLE) * 0.5) / sigma) ^ 2) / 2)) AS q FROM prior CROSS JOIN g CROSS JOIN s GROUP BY ALL) SELECT inning, signal, round(min(q), 6) AS least, round(max(q), 6) AS greatest FROM m GROUP BY inning, signal")
def belief_envelope(spark, sf):
    """Least and greatest belief at each signal over scenarios of noise."""
    from stakewise.operators import prior

    t = timeline(spark, sf)
    held = margin_prior(t).cache()
    signals = spark.range(-16, 17).select((F.col("id") / 4).alias("signal"))
    grid = held.select("inning").distinct().crossJoin(F.broadcast(signals))
    parts = [prior.posterior(grid, held, "inning", "signal", 0.5, sigma, []).withColumn("scenario", F.lit(i)) for i, sigma in enumerate((0.6, 1.2, 2.0), 1)]
    return rounded(functools.reduce(lambda a, b: a.union(b), parts).groupBy("inning", "signal").agg(F.min("q").alias("least"), F.max("q").alias("greatest")))


@query("v2_resolved_and_unique", "SELECT count(*) AS rows, count(*) - count(DISTINCT event_id) AS repeated, count(*) FILTER (event_type IS NULL) AS unresolved FROM events")
def resolved_and_unique(spark, sf):
    """V1, V2: an allowed projection, its keys unique and its values resolved; a broken rule raises before rows come out."""
    rows = governance.guard_columns(table(spark, sf, "events").select("event_id", "event_type"), "resolution", ["event_id", "event_type"], ["value"])
    governance.require_unique(rows, ["event_id"], "resolution")
    governance.require_none(rows.filter("event_type IS NULL"), "an event is not resolved")
    keys = rows.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isNull()).alias("bad"))
    return keys.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("bad").alias("unresolved"))


@query("v6_geometry_agrees", f"WITH {T} SELECT role, count(*) AS challenges, count(*) FILTER ((outcome = 'overturned') = (margin > 0)) AS agreeing, round(count(*) FILTER ((outcome = 'overturned') = (margin > 0)) / count(*), 6) AS share FROM t WHERE outcome IS NOT NULL GROUP BY role")
def geometry_agrees(spark, sf):
    """V6: rulings that geometry confirms, by role: a call was overturned where the margin is above zero. Over real tracking all
    must agree; the stand-in's margins and rulings have nothing to do with each other."""
    t = timeline(spark, sf).filter("outcome IS NOT NULL")
    agreeing = F.count_if((F.col("outcome") == "overturned") == (F.col("margin") > 0))
    return rounded(t.groupBy("role").agg(F.count("*").alias("challenges"), agreeing.alias("agreeing"), (agreeing / F.count("*")).alias("share")))


@query("v17_masses_agree", f"WITH {T}, {PRIOR}, z AS (SELECT inning, weight, (bin + 0.5::DOUBLE) * 0.5::DOUBLE / 1.2::DOUBLE AS z FROM prior) SELECT inning, round(sum(weight * {_PHI}), 6) AS analytic, round(sum(weight), 6) AS total FROM z GROUP BY inning")
def masses_agree(spark, sf):
    """Prior weights close, and the mass of noisy signals beyond zero is the same by normal tails of the bins and
    by fast convolution, within 0.002; both are checked before rows come out."""
    from stakewise.operators import prior

    held = margin_prior(timeline(spark, sf)).cache()
    selection.require_prior(held, "inning")
    analytic = prior.upper_tail(held.select("inning").distinct().withColumn("thr", F.lit(0.0)), held, "inning", "thr", 0.5, 1.2, []).select("inning", F.col("action").alias("mass"))
    # the first signal above zero has all of them in its tail
    numeric = prior.lookup_table(held, "inning", 0.5, 1.2, 0.01).filter("signal > 0").groupBy("inning").agg(F.min_by("action_tail", "signal").alias("mass"))
    selection.require_masses_agree(analytic, numeric, ["inning"], "mass")
    return rounded(analytic.withColumnRenamed("mass", "analytic").join(held.groupBy("inning").agg(F.sum("weight").alias("total")), "inning"))


@query("v8_audit_sample", f"WITH {T}, c AS (SELECT *, CASE WHEN outcome = 'upheld' THEN 'upheld_challenge' WHEN outcome = 'overturned' THEN 'overturned_challenge' WHEN inning > 9 THEN 'extra_inning' ELSE 'other' END AS category FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {HASH.format('3, event_id')}, event_id) AS k FROM c) SELECT category, k AS audit_id, event_id FROM r WHERE k <= 10")
def audit_sample(spark, sf):
    """V8: a stratified audit sample, ten rows of each category in hash order."""
    from pyspark.sql import Window

    t = timeline(spark, sf)
    category = F.when(F.col("outcome") == "upheld", "upheld_challenge").when(F.col("outcome") == "overturned", "overturned_challenge").when(F.col("inning") > 9, "extra_inning").otherwise("other")
    w = Window.partitionBy("category").orderBy("h", "event_id")
    ranked = t.select("event_id", category.alias("category"), resample.hashed(F.lit(3), F.col("event_id")).alias("h")).withColumn("audit_id", F.row_number().over(w))
    return rounded(ranked.filter("audit_id <= 10").select("category", "audit_id", "event_id"))
