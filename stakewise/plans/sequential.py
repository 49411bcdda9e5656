"""State transitions, folds over timelines, spend-or-wait rules, checks and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stakewise.operators import decision, governance, ledger, resample, sequential, stats, tables, transitions
from stakewise.plans.base import KEYS, ORDER, T, nearest, query, rounded, table, timeline

PLATE = """plate AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS balls, cast(l_quantity AS BIGINT) % 3 AS strikes, l_suppkey % 3 AS outs, l_partkey % 2 AS b1, (l_partkey // 2) % 2 AS b2, (l_partkey // 4) % 2 AS b3, (l_orderkey % 5 = 0)::INT AS ro, l_returnflag = 'R' AS ball, l_extendedprice / 1e5 AS runs, l_linestatus = 'O' AS batting FROM lineitem)"""
BRANCH = """SELECT *, ball AND balls >= 3 AS walk, NOT ball AND strikes >= 2 AS so, outs + ro AS o0 FROM {0}"""
AFTER = """SELECT *, CASE WHEN walk OR so THEN 0 ELSE balls + ball::INT END AS nb, CASE WHEN walk OR so THEN 0 ELSE strikes + (NOT ball)::INT END AS ns, o0 + so::INT AS no, CASE WHEN walk THEN 1 ELSE b1 END AS n1,
    CASE WHEN walk AND b1 = 1 THEN 1 ELSE b2 END AS n2, CASE WHEN walk AND b1 = 1 AND b2 = 1 THEN 1 ELSE b3 END AS n3, (walk AND b1 = 1 AND b2 = 1 AND b3 = 1)::INT AS nr FROM ({0})"""


def plate(spark, sf):
    p = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") % 4).alias("balls_before"), (F.col("l_quantity").cast("int") % 3).alias("strikes_before"), (F.col("l_suppkey") % 3).cast("int").alias("outs_before"),
        (p % 2).alias("on_1b"), (F.floor(p / 2) % 2).alias("on_2b"), (F.floor(p / 4) % 2).alias("on_3b"), (F.col("l_orderkey") % 5 == 0).cast("int").alias("concurrent_outs"),
        F.when(F.col("l_returnflag") == "R", "ball").otherwise("called_strike").alias("call"), (F.col("l_extendedprice") / 1e5).alias("runs_to_end"), (F.col("l_linestatus") == "O").alias("batting"),
    )


@query("t3_call_branch", f"WITH {PLATE} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, nb::BIGINT AS balls, ns::BIGINT AS strikes, no::BIGINT AS outs, n1::BIGINT AS on_1b, n2::BIGINT AS on_2b, n3::BIGINT AS on_3b, nr::BIGINT AS runs FROM ({AFTER.format(BRANCH.format('plate'))})")
def call_branch(spark, sf):
    """Movement, forced walks, and the state after a call."""
    p = plate(spark, sf)
    return rounded(transitions.call_branch(p, F.col("call")).select("l_orderkey", "l_linenumber", "branch.*"))


RE = """cells AS (SELECT outs, concat(b1, b2, b3) AS base, balls, strikes, sum(runs) AS s, count(*)::DOUBLE AS n FROM plate GROUP BY ALL), par AS (SELECT outs, base, sum(s) / sum(n) AS m FROM cells GROUP BY ALL), ov AS (SELECT sum(s) / sum(n) AS m FROM cells),
    grid AS (SELECT o.v AS outs, concat(a.v, b.v, c.v) AS base, u.v AS balls, s.v AS strikes FROM (SELECT unnest([0, 1, 2]) v) o, (SELECT unnest([0, 1]) v) a, (SELECT unnest([0, 1]) v) b, (SELECT unnest([0, 1]) v) c, (SELECT unnest([0, 1, 2, 3]) v) u, (SELECT unnest([0, 1, 2]) v) s),
    re AS (SELECT g.outs, g.base, g.balls, g.strikes, (coalesce(s, 0) + 20 * coalesce(par.m, ov.m)) / (coalesce(n, 0) + 20) AS re FROM grid g CROSS JOIN ov LEFT JOIN par USING (outs, base) LEFT JOIN cells USING (outs, base, balls, strikes))"""


def run_expectation(spark, rows):
    """288 states; the grid is a constant table."""
    grid = spark.range(288).select((F.col("id") % 3).cast("int").alias("outs"), F.lpad(F.bin(F.floor(F.col("id") / 3) % 8), 3, "0").alias("base_state"), (F.floor(F.col("id") / 24) % 4).cast("int").alias("balls"), (F.floor(F.col("id") / 96) % 3).cast("int").alias("strikes"))
    named = rows.select(F.col("outs_before").alias("outs"), F.concat("on_1b", "on_2b", "on_3b").alias("base_state"), F.col("balls_before").alias("balls"), F.col("strikes_before").alias("strikes"), "runs_to_end")
    return tables.shrunken_cells(named, grid, ["outs", "base_state"], ["balls", "strikes"], "runs_to_end").withColumnRenamed("estimate", "re")


@query("a7_re288", f"WITH {PLATE}, {RE} SELECT outs::BIGINT AS outs, base AS base_state, balls::BIGINT AS balls, strikes::BIGINT AS strikes, round(re, 6) AS re FROM re")
def re288(spark, sf):
    """The full run-expectation table."""
    return rounded(run_expectation(spark, plate(spark, sf)).select("outs", "base_state", "balls", "strikes", "re"))


@query(
    "t7_hypothetical_gain",
    f"""WITH {PLATE}, {RE}, st AS (SELECT *, nb AS sb, ns AS ss, no AS sn, n1 AS s1, n2 AS s2, n3 AS s3, nr AS sr FROM ({AFTER.format(BRANCH.format('plate'))})),
    fl AS ({AFTER.format(BRANCH.format('(SELECT * EXCLUDE (walk, so, o0, nb, ns, no, n1, n2, n3, nr) REPLACE (NOT ball AS ball) FROM st)'))}),
    v AS (SELECT fl.*, sr + CASE WHEN sn >= 3 THEN 0 ELSE a.re END AS stands, nr + CASE WHEN no >= 3 THEN 0 ELSE b.re END AS flipped FROM fl LEFT JOIN re a ON a.outs = sn AND a.base = concat(s1, s2, s3) AND a.balls = sb AND a.strikes = ss LEFT JOIN re b ON b.outs = no AND b.base = concat(n1, n2, n3) AND b.balls = nb AND b.strikes = ns)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN batting THEN flipped - stands ELSE stands - flipped END, 6) AS gain FROM v""",
)
def hypothetical_gain(spark, sf):
    """Value of the opposite call over the one that stands, with a broadcast state table."""
    p = plate(spark, sf)
    out = transitions.correction_gain(p, run_expectation(spark, p), F.col("call"), F.col("batting"))
    return rounded(out.select("l_orderkey", "l_linenumber", "gain"))


@query(
    "q1_inventory_replay",
    f"""WITH RECURSIVE {T}, r AS (
        SELECT game, team, pitch_order, inning, outcome, 2 AS before, CASE WHEN outcome = 'upheld' THEN 1 ELSE 2 END AS after FROM t WHERE pitch_order = 1
        UNION ALL
        SELECT game, team, pitch_order, inning, outcome, k, CASE WHEN outcome = 'upheld' AND k > 0 THEN k - 1 ELSE k END FROM (
            SELECT t.game, t.team, t.pitch_order, t.inning, t.outcome, CASE WHEN t.inning <> r.inning AND t.inning > 9 AND r.after = 0 THEN 1 ELSE r.after END AS k
            FROM r JOIN t ON t.game = r.game AND t.team = r.team AND t.pitch_order = r.pitch_order + 1))
    SELECT game, team, pitch_order, before::BIGINT AS before, after::BIGINT AS after, outcome IS NOT NULL AND before = 0 AS invalid FROM r""",
)
def inventory_replay(spark, sf):
    """Q1: challenges left before and after each row."""
    rows = timeline(spark, sf).select(*KEYS, *ORDER, "inning", "outcome")
    return rounded(sequential.inventory_replay(rows, KEYS, ORDER).select(*KEYS, *ORDER, "state.*"))


@query(
    "q4_expected_mass_replay",
    f"""WITH RECURSIVE {T}, r AS (
        SELECT game, team, 0::BIGINT AS pitch_order, 0::BIGINT AS inning, 0::DOUBLE AS x0, 0::DOUBLE AS x1, 1::DOUBLE AS x2, 0::DOUBLE AS m0, 0::DOUBLE AS m1, 0::DOUBLE AS m2, 0::DOUBLE AS ch, 0::DOUBLE AS cap FROM t WHERE pitch_order = 1
        UNION ALL
        SELECT game, team, pitch_order, inning, (m0 + m1 * p1 * f) / s, (m1 - m1 * p1 * f + m2 * p2 * f) / s, (m2 - m2 * p2 * f) / s, m0, m1, m2, m1 * p1 + m2 * p2, (m1 * p1 + m2 * p2) * (1 - f) * stake FROM (
            SELECT *, m0 + m1 + m2 AS s FROM (
                SELECT t.game, t.team, t.pitch_order, t.inning, t.stake, t.p * 0.5 AS p1, t.p AS p2, CASE WHEN t.success THEN 0::DOUBLE ELSE 1 END AS f,
                    CASE WHEN t.inning > 9 AND t.inning > r.inning THEN 0 ELSE x0 END AS m0, x1 + CASE WHEN t.inning > 9 AND t.inning > r.inning THEN x0 ELSE 0 END AS m1, x2 AS m2
                FROM r JOIN t ON t.game = r.game AND t.team = r.team AND t.pitch_order = r.pitch_order + 1)))
    SELECT game, team, pitch_order, round(m0, 8) AS m0, round(m1, 8) AS m1, round(m2, 8) AS m2, round(ch, 8) AS challenges, round(cap, 6) AS captured FROM r WHERE pitch_order > 0""",
)
def expected_mass_replay(spark, sf):
    """Q4, Q5: probability mass over inventories, with what is expected to happen."""
    rows = timeline(spark, sf).select(*KEYS, *ORDER, "inning", (F.col("p") * 0.5).alias("p1"), F.col("p").alias("p2"), "success", "stake")
    out = sequential.mass_replay(rows, KEYS, ORDER).select(*KEYS, *ORDER, *[nearest(F.col(f"state.{m}"), 8).alias(m) for m in ("m0", "m1", "m2", "challenges")], nearest(F.col("state.captured"), 6).alias("captured"))
    return out.withColumn("pitch_order", F.col("pitch_order").cast("long"))


@query(
    "q3_policy_replay",
    f"""WITH RECURSIVE {T}, pol AS (SELECT policy, game, team, pitch_order, inning, success, stake, CASE policy WHEN 'oracle' THEN success WHEN 'positive_ev' THEN p > 0 WHEN 'static_ev' THEN p * stake > 0.05 ELSE false END AND (policy = 'static_ev' OR stake > 0) AS act FROM t CROSS JOIN (VALUES ('never'), ('positive_ev'), ('static_ev'), ('oracle')) v(policy)), r AS (
        SELECT policy, game, team, 0::BIGINT AS pitch_order, 0::BIGINT AS inning, 2 AS after, false AS ch, 0::DOUBLE AS cap FROM pol WHERE pitch_order = 1
        UNION ALL
        SELECT policy, game, team, pitch_order, inning, CASE WHEN act AND k > 0 AND NOT success THEN k - 1 ELSE k END, act AND k > 0, CASE WHEN act AND k > 0 AND success THEN stake ELSE 0 END FROM (
            SELECT x.*, CASE WHEN r.pitch_order > 0 AND x.inning > r.inning AND x.inning > 9 AND r.after = 0 THEN 1 ELSE r.after END AS k FROM r JOIN pol x ON x.policy = r.policy AND x.game = r.game AND x.team = r.team AND x.pitch_order = r.pitch_order + 1))
    SELECT policy, game, sum(ch::INT)::BIGINT AS challenges, round(sum(cap), 4) AS captured FROM r WHERE pitch_order > 0 GROUP BY policy, game""",
)
def policy_replay(spark, sf):
    """Deterministic replays of several policies, reduced to games."""
    t = timeline(spark, sf)
    made = decision.fixed_policies(F.col("p"), F.col("stake"), F.col("success"))
    rows = t.select(*KEYS, *ORDER, "inning", "success", "stake", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), a.alias("act1"), a.alias("act2")) for n, a in made.items()])).alias("x")).select("*", "x.*").drop("x")
    out = sequential.policy_replay(rows, ["policy", *KEYS], ORDER)
    return out.groupBy("policy", "game").agg(F.sum(F.col("state.challenged").cast("long")).alias("challenges"), F.round(F.sum("state.captured"), 4).alias("captured"))


@query(
    "q2_backward_recursion",
    f"""WITH RECURSIVE {T}, z AS (SELECT *, max(pitch_order) OVER (PARTITION BY game, team) AS last FROM t), r AS (
        SELECT game, team, last + 1 AS pitch_order, 0::BIGINT AS inning, 0::DOUBLE AS c0, 0::DOUBLE AS c1, 0::DOUBLE AS c2 FROM z WHERE pitch_order = 1
        UNION ALL
        SELECT game, team, pitch_order, inning, o0, CASE WHEN NOT adv THEN c1 WHEN success THEN c1 + p * stake ELSE (1 - p) * c1 + p * o0 END, CASE WHEN NOT adv THEN c2 WHEN success THEN c2 + p * stake ELSE (1 - p) * c2 + p * c1 END FROM (
            SELECT z.game, z.team, z.pitch_order, z.inning, z.p, z.stake, z.success, z.margin > -2 AS adv, r.c1, r.c2, CASE WHEN r.inning > 9 AND r.inning <> z.inning THEN r.c1 ELSE r.c0 END AS o0
            FROM r JOIN z ON z.game = r.game AND z.team = r.team AND z.pitch_order = r.pitch_order - 1))
    SELECT game, team, pitch_order, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM r WHERE inning > 0""",
)
def backward_recursion(spark, sf):
    """Q2: what is reachable with none, one or two left, from the end of the game backwards."""
    rows = timeline(spark, sf).select(*KEYS, *ORDER, "inning", "p", (F.col("margin") > -2).alias("adverse"), F.col("success").alias("correct"), F.col("stake").alias("re"))
    out = sequential.reachable_value(rows, KEYS, ORDER, ["re"])
    return rounded(out.select(*KEYS, *ORDER, *[F.col(f"state.re_c{k}").alias(f"c{k}") for k in range(3)]))


@query(
    "w3_lead_transitions",
    f"WITH {T} SELECT event_id, lead(role) OVER w AS next_role, lead(inning) OVER w AS next_inning, lead(inning) OVER w IS NULL AS terminal, coalesce(lead(inning) OVER w > 9 AND lead(inning) OVER w > inning, false) AS extra_grant FROM t WINDOW w AS (PARTITION BY game, team ORDER BY pitch_order)".replace("lead(inning) OVER w AS next_inning", "coalesce(lead(inning) OVER w, -1)::BIGINT AS next_inning"),
)
def lead_transitions(spark, sf):
    """Next states, terminal rows, and the grant on entering an extra inning."""
    out = sequential.transitions(timeline(spark, sf), KEYS, ORDER, ["role", "inning"])
    return rounded(out.select("event_id", "next_role", F.coalesce("next_inning", F.lit(-1)).alias("next_inning"), "terminal", "extra_grant"))


@query("w4_future_totals", f"WITH {T} SELECT event_id, round(coalesce(sum(stake) OVER w, 0), 6) AS future_stake, coalesce(sum(hit) OVER w, 0)::BIGINT AS future_hit, round(coalesce(sum(stake) OVER s, 0), 6) AS segment_stake FROM (SELECT *, success::INT AS hit, CASE WHEN inning <= 9 THEN 0 ELSE inning END AS seg FROM t) WINDOW w AS (PARTITION BY game, team ORDER BY pitch_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), s AS (PARTITION BY game, team, seg ORDER BY pitch_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
def future_totals(spark, sf):
    """Totals still to come, in the game and in the segment between replenishments."""
    t = timeline(spark, sf).withColumns({"hit": F.col("success").cast("long"), "segment": F.when(F.col("inning") <= 9, 0).otherwise(F.col("inning"))})
    out = sequential.future_totals(t, KEYS, ORDER, ["stake", "hit"])
    out = sequential.future_totals(out.withColumn("in_segment", F.col("stake")), [*KEYS, "segment"], ORDER, ["in_segment"])
    return rounded(out.select("event_id", "future_stake", "future_hit", F.col("future_in_segment").alias("segment_stake")))


@query("m2_bellman_values")
def bellman_values(spark, sf):
    """Policy iteration over the rows with their own stakes; a linear system over the states. No SQL: a fixed point."""
    t = timeline(spark, sf).select(*KEYS, *ORDER, "inning", "role", F.col("p").alias("p_hat"), "stake")
    t = t.withColumn("raw", (F.col("inning") - 1) * 6 + F.col("pitch_order") % 2 * 3).withColumn("stage", F.when(F.col("raw") < 54, F.col("raw")).otherwise(54 + (F.col("raw") - 54) % 6))
    moves = sequential.transitions(t, KEYS, ORDER, ["stage", "role", "raw"]).withColumn("delta", F.coalesce(F.col("next_raw") - F.col("raw"), F.lit(0)))
    return rounded(spark.createDataFrame(decision.PolicyValues(moves.cache()).frame()))


@query("m3_actions", f"WITH {T} SELECT event_id, round(p * stake - (1 - p) * inning / 10.0::DOUBLE, 6) AS advantage, round(CASE WHEN stake > 0 THEN (inning / 10.0::DOUBLE) / (stake + inning / 10.0::DOUBLE) END, 6) AS threshold, p * stake - (1 - p) * inning / 10.0::DOUBLE > 0 AND stake > 0 AS act FROM t")
def actions(spark, sf):
    """Advantage of a challenge and the least probability worth one."""
    gain = decision.advantage(F.col("p"), F.col("stake"), F.col("inning"), 10.0)
    least = decision.threshold(F.col("stake"), F.col("inning") / 10.0)
    return timeline(spark, sf).select("event_id", nearest(gain, 6).alias("advantage"), nearest(least, 6).alias("threshold"), ((gain > 0) & (F.col("stake") > 0)).alias("act"))


@query(
    "m6_policy_maximin",
    f"""WITH {T}, v AS (SELECT c AS candidate, inning AS scenario, sum(CASE WHEN p > c THEN CASE WHEN success THEN stake ELSE -0.3 * stake END ELSE 0 END) AS value FROM t CROSS JOIN (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)) x(c) GROUP BY ALL)
    SELECT candidate, arg_min(scenario, value) AS binding, round(min(value), 4) AS worst, round(avg(value), 4) AS mean FROM v GROUP BY candidate ORDER BY min(value) DESC, avg(value) DESC, candidate LIMIT 1""",
)
def policy_maximin(spark, sf):
    """Candidates across scenarios, the best worst case."""
    t = timeline(spark, sf).select("inning", "p", "success", "stake", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7, 0.9)))).alias("candidate"))
    value = F.when(F.col("p") > F.col("candidate"), F.when(F.col("success"), F.col("stake")).otherwise(-0.3 * F.col("stake"))).otherwise(0.0)
    return rounded(decision.maximin(t.groupBy("candidate", F.col("inning").alias("scenario")).agg(F.sum(value).alias("value")), "candidate", "scenario", "value"), 4)


@query("n22_loss_surface", f"WITH {T} SELECT event_id, round(s2 + greatest(a, 0) + ln(1 + exp(-abs(a))), 6) AS l1, round(s2, 6) AS l2 FROM (SELECT event_id, margin AS a, greatest(b, 0) + ln(1 + exp(-abs(b))) AS s2 FROM (SELECT *, p * 4 - 2 AS b FROM t))")
def loss_surface(spark, sf):
    """Surfaces with L1 >= L2 >= 0 by construction."""
    one, two = decision.loss_surface(F.col("margin"), F.col("p") * 4 - 2)
    return rounded(timeline(spark, sf).select("event_id", one.alias("l1"), two.alias("l2")))


@query("v3_totals_reconciled", f"WITH {T}, d AS (SELECT game, team, count(*) FILTER (outcome = 'upheld') AS failed FROM t GROUP BY game, team), s AS (SELECT game, team, count(*) FILTER (outcome = 'upheld') + (team = 2 AND game LIKE '%5')::INT AS failed FROM t GROUP BY game, team) SELECT game, team, s.failed AS stated_failed, d.failed FROM s LEFT JOIN d USING (game, team) WHERE s.failed <> coalesce(d.failed, 0)")
def totals_reconciled(spark, sf):
    """V3, V4: keys whose counted detail differs from stated totals."""
    t = timeline(spark, sf)
    detail = t.groupBy(*KEYS).agg(F.count_if(F.col("outcome") == "upheld").alias("failed"))
    stated = detail.withColumn("failed", F.col("failed") + ((F.col("team") == 2) & F.endswith("game", F.lit("5"))).cast("int"))
    return rounded(governance.reconciled(detail, stated, KEYS, ["failed"]))


@query("v5_key_differences", "SELECT k, CASE WHEN bool_or(side = 'a') THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT o_custkey AS k, 'a' AS side FROM orders UNION ALL SELECT DISTINCT c_custkey, 'b' FROM customer WHERE c_custkey % 7 <> 0) GROUP BY k HAVING count(*) = 1")
def key_differences(spark, sf):
    """Keys on one side only."""
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("k"))
    return governance.same_keys(a, b, ["k"])


@query("v10_row_hashes", "SELECT n_nationkey::BIGINT AS n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS sha256 FROM nation")
def row_hashes(spark, sf):
    """Hashes of canonical rows."""
    n = table(spark, sf, "nation")
    return rounded(n.select("n_nationkey", governance.row_hash(n.columns).alias("sha256")))


@query(
    "r6_policy_summary",
    f"""WITH RECURSIVE {T}, pol AS (SELECT policy, game, team, pitch_order, inning, role, success, stake, CASE policy WHEN 'observed' THEN (outcome IS NOT NULL)::INT::DOUBLE WHEN 'oracle' THEN (success AND stake > 0)::INT::DOUBLE ELSE p END AS q FROM t CROSS JOIN (VALUES ('observed'), ('oracle'), ('signal')) v(policy)), r AS (
        SELECT policy, game, team, 0::BIGINT AS pitch_order, 0::BIGINT AS inning, '' AS role, 0::DOUBLE AS x0, 0::DOUBLE AS x1, 1::DOUBLE AS x2, 0::DOUBLE AS ch, 0::DOUBLE AS won, 0::DOUBLE AS cap FROM pol WHERE pitch_order = 1
        UNION ALL
        SELECT policy, game, team, pitch_order, inning, role, m0 + m1 * q * f, m1 - m1 * q * f + m2 * q * f, m2 - m2 * q * f, (m1 + m2) * q, (m1 + m2) * q * (1 - f), (m1 + m2) * q * (1 - f) * stake FROM (
            SELECT x.*, CASE WHEN x.success THEN 0::DOUBLE ELSE 1 END AS f, CASE WHEN x.inning > 9 AND x.inning > r.inning THEN 0 ELSE x0 END AS m0, x1 + CASE WHEN x.inning > 9 AND x.inning > r.inning THEN x0 ELSE 0 END AS m1, x2 AS m2
            FROM r JOIN pol x ON x.policy = r.policy AND x.game = r.game AND x.team = r.team AND x.pitch_order = r.pitch_order + 1)),
    s AS (SELECT policy, CASE WHEN grouping(role) = 1 THEN 'combined' ELSE role END AS role, sum(ch) AS ch, sum(won) AS won, sum(cap) AS cap FROM r WHERE pitch_order > 0 GROUP BY GROUPING SETS ((policy, role), (policy)))
    SELECT s.policy, s.role, round(s.ch, 4) AS challenges, round(s.cap, 3) AS captured, round(s.won / nullif(s.ch, 0), 6) AS success_rate, round(s.cap - o.cap, 3) AS gain, round(s.cap / b.cap, 6) AS share_of_best FROM s JOIN s o ON o.role = s.role AND o.policy = 'observed' JOIN s b ON b.role = s.role AND b.policy = 'oracle'""",
)
def policy_summary(spark, sf):
    """Replay every policy, sum by role and combined, compare with the observed one and the oracle."""
    t = timeline(spark, sf)
    chance = {"observed": F.col("outcome").isNotNull().cast("double"), "oracle": (F.col("success") & (F.col("stake") > 0)).cast("double"), "signal": F.col("p")}
    made = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("p1"), c.alias("p2")) for n, c in chance.items()])
    rows = t.select(*KEYS, *ORDER, "inning", "role", "success", "stake", F.explode(made).alias("x")).select("*", "x.*").drop("x")
    out = ledger.policy_summary(sequential.mass_replay(rows, ["policy", *KEYS], ORDER), [])
    return out.select("policy", "role", F.round("challenges", 4).alias("challenges"), F.round("captured", 3).alias("captured"), F.round("success_rate", 6).alias("success_rate"), F.round("gain", 3).alias("gain"), F.round("share_of_best", 6).alias("share_of_best"))


@query("r5_opportunity_adjusted", f"WITH {T} SELECT team, count(*) AS chances, count(outcome) AS attempts, round(sum(p), 4) AS expected, round(count(outcome) - sum(p), 4) AS above_expected FROM t GROUP BY team")
def opportunity_adjusted(spark, sf):
    """Observed less expected."""
    return rounded(ledger.opportunity_adjusted(timeline(spark, sf), ["team"], F.col("outcome").isNotNull(), F.col("p")), 4)


@query("r7_inning_summary", f"WITH {T} SELECT role, CASE WHEN inning >= 10 THEN '10+' ELSE inning::VARCHAR END AS inning, count(*) AS chances, count(outcome) AS challenges, round(avg(success::INT), 6) AS rate FROM t GROUP BY ALL")
def inning_summary(spark, sf):
    """By role and inning, later ones pooled."""
    values = [F.count("*").alias("chances"), F.count("outcome").alias("challenges"), F.round(F.avg(F.col("success").cast("int")), 6).alias("rate")]
    return ledger.inning_summary(timeline(spark, sf), values)


@query("r11_sample_summary", f"WITH {T}, s AS (SELECT count(*)::DOUBLE AS rows, count(DISTINCT game)::DOUBLE AS games, count(outcome)::DOUBLE AS challenges, round(avg(success::INT), 6) AS rate FROM t) SELECT metric, value FROM (UNPIVOT s ON rows, games, challenges, rate INTO NAME metric VALUE value)")
def sample_summary(spark, sf):
    """Headline figures in long form."""
    s = timeline(spark, sf).agg(F.count("*").cast("double").alias("rows"), F.countDistinct("game").cast("double").alias("games"), F.count("outcome").cast("double").alias("challenges"), F.round(F.avg(F.col("success").cast("int")), 6).alias("rate"))
    return s.unpivot([], ["rows", "games", "challenges", "rate"], "metric", "value")


@query("r1_failed_cost", f"WITH {T}, k AS (SELECT *, pitch_order % 3 AS left_over FROM t WHERE outcome IS NOT NULL) SELECT event_id, outcome, round(CASE WHEN outcome = 'upheld' THEN CASE WHEN left_over = 1 THEN stake ELSE stake / 2 END ELSE 0 END, 6) AS cost, round(CASE WHEN success THEN stake END, 6) AS gross FROM k")
def failed_cost(spark, sf):
    """What a failed challenge cost, by the units that were left."""
    k = timeline(spark, sf).filter("outcome IS NOT NULL")
    cost = F.when(F.col("outcome") == "upheld", F.when(F.col("pitch_order") % 3 == 1, F.col("stake")).otherwise(F.col("stake") / 2)).otherwise(0.0)
    return rounded(k.select("event_id", "outcome", cost.alias("cost"), F.when(F.col("success"), F.col("stake")).alias("gross")))


@query("o11_temporal_split", "SELECT CASE WHEN cast(ts AS date) < (SELECT min(cast(ts AS date)) + INTERVAL 20 DAY FROM events) THEN 'development' ELSE 'confirmation' END AS part, count(*) AS rows, count(DISTINCT cast(ts AS date)) AS games FROM events GROUP BY 1")
def temporal_split(spark, sf):
    """Development before a date, confirmation from it on."""
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    first = e.agg(F.min("day").alias("first"))
    part = F.when(F.col("day") < F.date_add("first", 20), "development").otherwise("confirmation")
    return e.crossJoin(F.broadcast(first)).groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.countDistinct("day").alias("games"))


@query("c9_replicate_summary", f"WITH {T}, gm AS (SELECT game, row_number() OVER (ORDER BY game) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT game FROM t)), w AS (SELECT r.replicate, h.game, count(*) AS weight FROM gm CROSS JOIN (SELECT unnest(range(1, 501)) AS replicate) r JOIN gm h ON h.place = ('0x' || substr(md5(concat_ws('|', 5, r.replicate, gm.place)), 1, 12))::BIGINT % gm.n GROUP BY ALL), s AS (SELECT game, role, sum(p * stake) AS e, sum(success::INT * stake) AS o FROM t GROUP BY ALL) SELECT replicate, role, round(sum(e * weight), 4) AS e, round(sum(o * weight), 4) AS o FROM s JOIN w USING (game) GROUP BY ALL")
def replicate_summary(spark, sf):
    """Weighted replicates of group sums."""
    t = timeline(spark, sf)
    sums = t.groupBy("game", "role").agg(F.sum(F.col("p") * F.col("stake")).alias("e"), F.sum(F.col("success").cast("int") * F.col("stake")).alias("o"))
    return rounded(resample.bootstrap_totals(sums, resample.bootstrap_weights(t, "game", 500, 5), "game", ["role"], ["e", "o"]), 4)


@query("j13_first_differences", f"WITH {T} SELECT a.event_id, round(b.stake - a.stake, 6) AS change FROM t a JOIN t b ON b.game = a.game AND b.team = a.team AND b.pitch_order = a.pitch_order + 1")
def first_differences(spark, sf):
    """Rows aligned by key; a window instead of the self join."""
    w = Window.partitionBy(*KEYS).orderBy("pitch_order")
    return rounded(timeline(spark, sf).select("event_id", (F.lead("stake").over(w) - F.col("stake")).alias("change")).filter("change IS NOT NULL"))


@query("r8_margin_support", f"WITH {T} SELECT role, count(*) AS n, round(avg((abs(margin) <= 1)::INT), 6) AS near, round(quantile_cont(margin, 0.1), 6) AS low, round(quantile_cont(margin, 0.9), 6) AS high FROM t GROUP BY role")
def margin_support(spark, sf):
    """Support of a margin by role."""
    return rounded(timeline(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.avg((F.abs("margin") <= 1).cast("int")).alias("near"), F.percentile("margin", 0.1).alias("low"), F.percentile("margin", 0.9).alias("high")))


@query("a12_weighted_means", f"WITH {T} SELECT game, round(sum(stake * p) / nullif(sum(p), 0), 6) AS mean FROM t GROUP BY game")
def weighted_means(spark, sf):
    """Weighted means with a guarded denominator."""
    return rounded(timeline(spark, sf).groupBy("game").agg(stats.weighted_mean(F.col("stake"), F.col("p")).alias("mean")))
