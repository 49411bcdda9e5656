"""Additive models and counts over orders.

An order stands for a chance to challenge: its summed quantity is the margin, its number of lines the speed, and one with a
large line was challenged. Fits have no SQL; the sums that they rest on do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stakewise.operators import gam, hierarchy, models, profiles, resample
from stakewise.plans.base import T, query, rounded, table, timeline

LARGE = 40


def choices(spark, sf):
    """Orders as choices, from one aggregation of their lines."""
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        (F.max("l_quantity") > LARGE).cast("int").alias("challenged"), F.sum("l_quantity").cast("double").alias("margin"), F.count("*").cast("double").alias("speed"), F.avg("l_tax").alias("stake"),
        F.min("l_returnflag").alias("flag"), F.floor(4 * F.log2(1 + F.min("l_partkey"))).cast("string").alias("unit"), (F.max("l_suppkey") % 40).cast("string").alias("team"),
    )
    return p.withColumn("fold", (F.col("l_orderkey") % 3 + 1).cast("int"))


def _basis(x: str, low: str, high: str, k: int, first: str) -> str:
    """SQL for the four bases of a spline that aren't zero: a list of (place, value)."""
    t = f"(({x} - {low}) / (({high} - {low}) / {k - 3}))"
    cell = f"least(floor({t}), {k - 4})"
    u = f"({t} - {cell})"
    parts = f"(1 - {u}) ^ 3 / 6", f"(3 * {u} ^ 3 - 6 * {u} ^ 2 + 4) / 6", f"(-3 * {u} ^ 3 + 3 * {u} ^ 2 + 3 * {u} + 1) / 6", f"{u} ^ 3 / 6"
    return "[" + ", ".join(f"{{'i': {first} + {cell}::INT + {m}, 'v': {part}}}" for m, part in enumerate(parts)) + "]"


@query(
    "g3_design_sums",
    f"""WITH x AS (SELECT (max(l_quantity) > {LARGE})::INT::DOUBLE AS y, sum(l_quantity)::DOUBLE AS q, count(*)::DOUBLE AS d, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT min(q) AS qa, max(q) AS qb, min(d) AS da, max(d) AS db FROM x), f AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS place FROM (SELECT DISTINCT f FROM x)),
    b AS (SELECT y, place, {_basis('q', 'qa', 'qb', 8, '1')} AS s, {_basis('q', 'qa', 'qb', 6, '0')} AS one, {_basis('d', 'da', 'db', 5, '0')} AS two FROM x CROSS JOIN r JOIN f USING (f)),
    e AS (SELECT y, [{{'i': 0, 'v': 1.0::DOUBLE}}] || s || flatten(list_transform(one, lambda a: list_transform(two, lambda c: {{'i': 9 + a.i * 5 + c.i, 'v': a.v * c.v}}))) || [{{'i': 39 + place::INT, 'v': 1.0::DOUBLE}}] AS e FROM b),
    g AS (SELECT y, e, unnest(e) AS a FROM e), p AS (SELECT a, unnest(e) AS c FROM g)
    SELECT i::BIGINT AS i, j::BIGINT AS j, round(value, 4) AS value FROM (
        SELECT a.i AS i, c.i AS j, sum(a.v * c.v) AS value FROM p WHERE a.i <= c.i GROUP BY ALL HAVING sum(a.v * c.v) <> 0
        UNION ALL SELECT a.i, -1, sum(a.v * y) FROM g GROUP BY ALL HAVING sum(a.v * y) <> 0
        UNION ALL SELECT -1, unnest([0, 1, 2]), unnest([sum(y * y), sum(y * y), count(*)::DOUBLE]) FROM x)""",
)
def g3_design_sums(spark, sf):
    """The sums that an additive model rests on, for a smooth, an interaction and levels."""
    rows = choices(spark, sf)
    model = gam.learnt_terms(rows, smooth={"margin": 8}, tensor={("margin", "speed"): (6, 5)}, fixed=["flag"])
    return rounded(gam.design_sums(rows, "challenged", model), 4)


@query("g3_selection_gam")
def g3_selection_gam(spark, sf):
    """Choices by an additive probit with smooths, an interaction, levels and random effects, against a local
    baseline that is linear in the margin; log losses of held-out orders near the middle and in the tails, and the
    baseline's width. No SQL: a fit with smoothing strengths."""
    rows = choices(spark, sf).withColumn("stratum", F.when(F.col("margin").between(60, 120), "local").otherwise("tail")).cache()
    train, test = rows.filter("fold > 1"), rows.filter("fold = 1")
    full = gam.fitted(train, "challenged", gam.learnt_terms(train, smooth={"margin": 12, "speed": 8, "stake": 7}, tensor={("margin", "speed"): (8, 6)}, fixed=["flag"], random=["unit", "team"]), tolerance=1e-6)
    near = train.filter("stratum = 'local'")
    local = gam.fitted(near, "challenged", gam.learnt_terms(near, linear=["margin"], smooth={"stake": 7}, random=["unit", "team"]), tolerance=1e-6)
    losses = gam.log_loss(gam.scored(gam.scored(test, full, "full"), local, "local"), "challenged", ["full", "local"], ["stratum"])
    slope = float(local.coefficients[1])
    width = F.lit(1 / slope if slope > 0 else None).cast("double")
    return rounded(losses.select("*", width.alias("width"), F.lit(float(sum(full.freedom))).alias("freedom"), F.lit(full.converged and local.converged).alias("converged")), 4)


@query("g5_negative_binomial")
def g5_negative_binomial(spark, sf):
    """Counts in context with a learnt dispersion and crossed random effects: what an order's first lines are is the
    state, its year the season. Effects of levels and the dispersion. No SQL: a fit."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.floor(F.sum("l_quantity") / 20).alias("runs"), F.concat_ws("|", F.min("l_returnflag"), F.min("l_linestatus")).alias("state"), (F.year(F.min("l_shipdate")) - 1998).cast("double").alias("season"),
        (F.max("l_suppkey") % 30).cast("string").alias("park"), F.floor(4 * F.log2(1 + F.min("l_partkey"))).cast("string").alias("batter"), (F.min("l_suppkey") % 50).cast("string").alias("pitcher"),
    )
    rows = rows.cache()
    model = gam.fitted(rows, "runs", gam.learnt_terms(rows, linear=["season"], fixed=["state"], random=["park", "batter", "pitcher"]), "negative_binomial", dispersion=5.0, learn_dispersion=True, tolerance=1e-8)
    found = [*gam.effects(model), ("dispersion", "", model.dispersion)]
    return rounded(spark.createDataFrame(found, "term string, level string, effect double"), 3)


@query("g6_hierarchical_probit")
def g6_hierarchical_probit(spark, sf):
    """players' thresholds and widths from a Gibbs sampler over two chains, how far the chains agree, and held-out
    choices scored by the draws, players without draws as the mean player. No SQL: a sampler."""
    rows = choices(spark, sf).select("l_orderkey", "fold", F.col("challenged"), (F.col("margin") / 50).alias("margin"), F.col("unit").alias("player"), "team").cache()
    draws = hierarchy.sampled(rows.filter("fold > 1"), "challenged", "margin", "player", "team", "l_orderkey", burn=20, keep=40)
    agreement = float(hierarchy.split_scale_reduction(draws.population()).max())
    scored = models.choice_probability(rows.filter("fold = 1"), hierarchy.player_draws(spark, draws), "margin", "player")
    held = scored.groupBy("player").agg(F.count("*").alias("n"), F.avg("challenged").alias("observed"), F.avg("probability").alias("expected"))
    players = spark.createDataFrame(hierarchy.player_summary(draws))
    return rounded(held.join(players, "player", "left").withColumn("agreement", F.lit(agreement)), 3)


@query(
    "g11_accepted_profiles",
    f"""WITH {T}, f AS (SELECT role, inning, game, (dense_rank() OVER (ORDER BY game) - 1) % 3 + 1 AS fold, (outcome IS NOT NULL)::INT::DOUBLE AS y FROM t), c AS (SELECT role, inning, fold, game, count(*)::DOUBLE AS n, sum(y) AS s FROM f GROUP BY ALL),
    o AS (SELECT role, inning, fold, sum(n) AS fn, sum(s) AS fs, sum(sum(n)) OVER (PARTITION BY role, inning) AS an, sum(sum(s)) OVER (PARTITION BY role, inning) AS s_all FROM c GROUP BY role, inning, fold), p AS (SELECT role, fold, sum(n) AS fn, sum(s) AS fs, sum(sum(n)) OVER (PARTITION BY role) AS an, sum(sum(s)) OVER (PARTITION BY role) AS s_all FROM c GROUP BY role, fold),
    m AS (SELECT c.role, c.inning, c.n, c.s, (o.s_all - o.fs + 0.5::DOUBLE) / (o.an - o.fn + 1) AS own, (p.s_all - p.fs + 0.5::DOUBLE) / (p.an - p.fn + 1) AS pooled, (o.s_all + 0.5::DOUBLE) / (o.an + 1) AS all_own, (p.s_all + 0.5::DOUBLE) / (p.an + 1) AS all_pooled FROM c JOIN o USING (role, inning, fold) JOIN p USING (role, fold)),
    d AS (SELECT *, (-(s * ln(own) + (n - s) * ln(1 - own)) + s * ln(pooled) + (n - s) * ln(1 - pooled)) / n AS d FROM m),
    g AS (SELECT role, inning, sum(n) AS n, count(*) AS games, avg(d) AS difference, stddev_samp(d) / sqrt(count(*)) AS se, any_value(all_own) AS own, any_value(all_pooled) AS pooled FROM d GROUP BY role, inning)
    SELECT role, inning, n, games, round(difference, 6) AS difference, round(se, 6) AS se, coalesce(difference + se < 0, false) AS accepted, round(CASE WHEN coalesce(difference + se < 0, false) THEN own ELSE pooled END, 6) AS rate FROM g""",
)
def g11_accepted_profiles(spark, sf):
    """Profiles by role and inning that beat their role's out of fold by more than one paired error; the others fall back."""
    rows = resample.dense_folds(timeline(spark, sf), "game", 3).withColumn("hit", F.col("outcome").isNotNull())
    return rounded(profiles.accepted_profiles(rows, ["role", "inning"], ["role"], "fold", "game", "hit"))


@query("n20_probit_curves")
def n20_probit_curves(spark, sf):
    """Smoothing splines of choice rates on the probit scale, one for each flag. No SQL: a fit with a chosen penalty."""
    return rounded(profiles.probit_curves(choices(spark, sf), ["flag"], "speed", "challenged"), 4)
