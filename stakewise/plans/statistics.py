"""Tables of expectation, clustered errors, distances, bootstraps and empirical priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from stakewise.operators import prior, resample, stats, tables
from stakewise.operators.mixtures import mixtures, training_counts
from stakewise.plans.base import KEYS, T, query, rounded, table, timeline

CELLS = """cell AS (SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY ALL),
    parent AS (SELECT l_returnflag, l_linestatus, sum(s) / sum(n) AS m FROM cell GROUP BY ALL), overall AS (SELECT sum(s) / sum(n) AS m FROM cell),
    grid AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) a(l_returnflag) CROSS JOIN (VALUES ('F'), ('O')) b(l_linestatus) CROSS JOIN (SELECT unnest(range(1, 9)) AS l_linenumber))"""


@query(
    "a7_shrunken_cell_means",
    f"""WITH {CELLS} SELECT g.l_returnflag, g.l_linestatus, g.l_linenumber, round(coalesce(c.n, 0)::DOUBLE, 6) AS n, round(coalesce(p.m, o.m), 6) AS parent_mean,
        round((coalesce(c.s, 0) + 20 * coalesce(p.m, o.m)) / (coalesce(c.n, 0) + 20), 6) AS estimate
    FROM grid g CROSS JOIN overall o LEFT JOIN parent p USING (l_returnflag, l_linestatus) LEFT JOIN cell c USING (l_returnflag, l_linestatus, l_linenumber)""",
)
def shrunken_cell_means(spark, sf):
    """Cell means shrunk to their parents on the full grid, which has a line number that does not occur."""
    rows = table(spark, sf, "lineitem")
    grid = tables.literal_grid(spark, {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"], "l_linenumber": list(range(1, 9))})
    return rounded(tables.shrunken_cells(rows, grid, ["l_returnflag", "l_linestatus"], ["l_linenumber"], "l_quantity"))


@query(
    "a27_holdout_fit",
    """WITH tr AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), m AS (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS f FROM tr GROUP BY ALL), o AS (SELECT avg(l_extendedprice) AS a FROM tr),
    e AS (SELECT coalesce(f, a) AS f, l_extendedprice AS y FROM lineitem LEFT JOIN m USING (l_returnflag, l_linenumber) CROSS JOIN o WHERE l_shipdate >= TIMESTAMP '1996-01-01')
    SELECT count(*) AS n, round(sqrt(avg((f - y) ^ 2)), 4) AS rmse, round(avg(abs(f - y)), 4) AS mae, round(avg(f - y), 4) AS bias, round(corr(f, y), 6) AS correlation FROM e""",
)
def holdout_fit(spark, sf):
    """Errors of cell means on later rows."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice", "l_shipdate")
    out = tables.holdout_fit(rows, F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"), ["l_returnflag", "l_linenumber"], "l_extendedprice")
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "bias")], F.round("correlation", 6).alias("correlation"))


@query(
    "a9_leave_one_group_out",
    f"WITH {T}, a AS (SELECT inning, role, sum(stake) AS s, count(*) AS c FROM t GROUP BY ALL), o AS (SELECT inning, role, game, sum(stake) AS s, count(*) AS c FROM t GROUP BY ALL) SELECT event_id, round((a.s - o.s) / greatest(a.c - o.c, 1), 6) AS expected_stake FROM t JOIN a USING (inning, role) JOIN o USING (inning, role, game)",
)
def leave_one_group_out(spark, sf):
    """The bucket's mean without the row's own group."""
    return rounded(tables.leave_one_group_out(timeline(spark, sf), ["inning", "role"], "game", ["stake"]).select("event_id", "expected_stake"))


@query(
    "a10_rate_without_own",
    f"""WITH {T}, e AS (SELECT *, margin > -1 AS ok, CASE WHEN margin > -1 THEN (outcome IS NOT NULL)::INT END AS hit FROM t), a AS (SELECT inning, sum(coalesce(hit, 0)) AS h, sum(ok::INT) AS n FROM e GROUP BY ALL), o AS (SELECT inning, game, sum(coalesce(hit, 0)) AS h, sum(ok::INT) AS n FROM e GROUP BY ALL),
    l AS (SELECT sum(h) / sum(n) AS p FROM o) SELECT event_id, round((a.h - o.h + 30 * l.p) / (a.n - o.n + 30), 6) AS rate FROM e JOIN a USING (inning) JOIN o USING (inning, game) CROSS JOIN l""",
)
def rate_without_own(spark, sf):
    """A10: leave-one-group-out rate with a prior of 30 rows at the overall rate."""
    t = timeline(spark, sf)
    return rounded(tables.shrunken_rate_without_own(t, ["inning"], "game", F.col("outcome").isNotNull(), F.col("margin") > -1).select("event_id", "rate"))


@query(
    "a13_quantiles",
    "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.025), 6) AS lower, round(median(l_quantity), 6) AS median, round(quantile_cont(l_quantity, 0.975), 6) AS upper, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag",
)
def quantiles(spark, sf):
    """Exact quantiles by linear interpolation."""
    q = F.percentile("l_quantity", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(q.alias("q"), F.stddev_samp("l_quantity").alias("sd"))
    return rounded(out.select("l_returnflag", *[F.col("q")[i].alias(n) for i, n in enumerate(("lower", "median", "upper"))], "sd"))


@query(
    "a13_quantile_type8",
    """WITH s AS (SELECT n_regionkey AS region, c_acctbal AS v, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
    h AS (SELECT DISTINCT region, n, (n + 1.0::DOUBLE / 3) * 0.9::DOUBLE + 1.0::DOUBLE / 3 AS h FROM s)
    SELECT h.region::BIGINT AS region, round(a.v + (h - floor(h)) * (b.v - a.v), 6) AS q FROM h JOIN s a ON a.region = h.region AND a.i = greatest(1, least(h.n, floor(h))) JOIN s b ON b.region = h.region AND b.i = greatest(1, least(h.n, floor(h) + 1))""",
)
def quantile_type8(spark, sf):
    """The median-unbiased quantile, from the sorted values of a bounded group."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(c.groupBy(F.col("n_regionkey").alias("region")).agg(stats.quantile_type8(F.collect_list("c_acctbal"), 0.9).alias("q")))


@query("a15_two_stage", f"WITH {T}, g AS (SELECT game, team, role, sum(stake) AS s, count(*) FILTER (outcome IS NOT NULL) AS c FROM t GROUP BY ALL) SELECT role, count(*) AS team_games, round(avg(s), 6) AS mean_stake, round(avg(c), 6) AS mean_challenges FROM g GROUP BY role")
def two_stage(spark, sf):
    """Sums within, means over."""
    g = timeline(spark, sf).groupBy(*KEYS, "role").agg(F.sum("stake").alias("s"), F.count("outcome").alias("c"))
    return rounded(g.groupBy("role").agg(F.count("*").alias("team_games"), F.avg("s").alias("mean_stake"), F.avg("c").alias("mean_challenges")))


@query(
    "a16_sandwich_error",
    f"WITH {T}, m AS (SELECT role, avg(stake) AS mean, count(*) AS n FROM t GROUP BY role), c AS (SELECT role, game, sum(stake - mean) AS r FROM t JOIN m USING (role) GROUP BY role, game) SELECT role, round(any_value(mean), 6) AS mean, any_value(n) AS n, count(*) AS clusters, round(sqrt(count(*)::DOUBLE / (count(*) - 1) * sum(r * r)) / any_value(n), 6) AS se FROM c JOIN m USING (role) GROUP BY role",
)
def sandwich(spark, sf):
    """Cluster-robust error of a mean."""
    return rounded(stats.sandwich_error(timeline(spark, sf), "game", "stake", ["role"]))


@query("a17_cluster_mean_error", f"WITH {T}, m AS (SELECT role, game, avg(stake) AS m FROM t GROUP BY ALL) SELECT role, round(avg(m), 6) AS mean, count(*) AS clusters, round(stddev_samp(m) / sqrt(count(*)), 6) AS se FROM m GROUP BY role")
def cluster_mean(spark, sf):
    """Error of the mean of cluster means."""
    return rounded(stats.cluster_mean_error(timeline(spark, sf), "game", "stake", ["role"]))


@query(
    "a19_concentration",
    f"""WITH {T}, g AS (SELECT game, team, sum(stake * CASE WHEN success THEN 1 ELSE -0.2 END) AS gain FROM t GROUP BY ALL), r AS (SELECT team, gain, row_number() OVER (PARTITION BY team ORDER BY gain DESC, game) AS i, count(*) OVER (PARTITION BY team) AS n FROM g WHERE gain > 0)
    SELECT team, round(sum(gain) FILTER (i <= greatest(1, ceil(n * 0.01::DOUBLE))) / sum(gain), 6) AS top1, round(sum(gain) FILTER (i <= greatest(1, ceil(n * 0.1::DOUBLE))) / sum(gain), 6) AS top10 FROM r GROUP BY team""",
)
def concentration(spark, sf):
    """Share of the gains in the top rows."""
    g = timeline(spark, sf).groupBy("game", "team").agg(F.sum(F.col("stake") * F.when(F.col("success"), 1.0).otherwise(-0.2)).alias("gain"))
    return rounded(stats.concentration(g, ["team"], "gain", {"top1": 0.01, "top10": 0.1}, ["game"]))


@query("a20_coverage", f"WITH {T} SELECT CASE WHEN grouping(team) = 1 THEN 'league' ELSE team::VARCHAR END AS team, count(*) AS rows, round(avg((margin >= -2.5)::INT), 6) AS coverage FROM t GROUP BY GROUPING SETS ((team), ())")
def coverage(spark, sf):
    """Coverage by group and overall."""
    from stakewise.operators.governance import coverage as covered

    return rounded(covered(timeline(spark, sf), F.col("margin") >= -2.5, "team"))


@query(
    "a21_ks_wasserstein",
    f"""WITH {T}, g AS (SELECT role, margin, sum(p) AS a, sum((outcome IS NOT NULL)::INT) AS b FROM t GROUP BY ALL), c AS (SELECT role, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY role) - sum(b) OVER w / sum(b) OVER (PARTITION BY role)) AS gap, lead(margin) OVER w - margin AS width FROM g WINDOW w AS (PARTITION BY role ORDER BY margin))
    SELECT role, round(max(gap), 6) AS ks, round(coalesce(sum(gap * width), 0), 6) AS wasserstein FROM c GROUP BY role""",
)
def ks_wasserstein(spark, sf):
    """Distances of two weighted samples."""
    return rounded(stats.cdf_distances(timeline(spark, sf), ["role"], "margin", F.col("p"), F.col("outcome").isNotNull().cast("int")))


@query("a14_probability_scores", f"WITH {T}, s AS (SELECT role, success::INT AS y, p, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM t) SELECT role, round(avg((y - p) ^ 2), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg(p - y), 6) AS calibration FROM s GROUP BY role")
def probability_scores(spark, sf):
    """Judged probabilities."""
    scores = stats.scores(F.col("success"), F.col("p"))
    return rounded(timeline(spark, sf).groupBy("role").agg(*[c.alias(n) for n, c in scores.items()]))


@query(
    "a22_envelope",
    f"WITH {T}, s AS (SELECT role, inning AS scenario, sum(stake * p) AS v FROM t GROUP BY ALL) SELECT role, round(min(v), 4) AS least, arg_min(scenario, v) AS min_at, round(max(v), 4) AS greatest, arg_max(scenario, v) AS max_at FROM s GROUP BY role",
)
def envelope(spark, sf):
    """Least and greatest scenario and which they are."""
    s = timeline(spark, sf).groupBy("role", F.col("inning").alias("scenario")).agg(F.sum(F.col("stake") * F.col("p")).alias("v"))
    return rounded(stats.envelope(s, ["role"], "v", "scenario"), 4)


@query("a25_local_and_tails", f"WITH {T} SELECT role, CASE WHEN abs(margin) <= 2 THEN 'local' WHEN margin > 2 THEN 'high' ELSE 'low' END AS part, count(*) AS n, round(avg((outcome IS NOT NULL)::INT), 6) AS rate, round(avg(margin), 6) AS mean_margin FROM t GROUP BY ALL")
def local_and_tails(spark, sf):
    """Rows near the edge and those in the tails."""
    part = F.when(F.abs("margin") <= 2, "local").when(F.col("margin") > 2, "high").otherwise("low")
    return rounded(timeline(spark, sf).groupBy("role", part.alias("part")).agg(F.count("*").alias("n"), F.avg(F.col("outcome").isNotNull().cast("int")).alias("rate"), F.avg("margin").alias("mean_margin")))


PRIOR = """bins AS (SELECT inning, cast(CASE WHEN margin = 0 THEN -1 ELSE floor(CASE WHEN abs(margin / 0.5 - round_even(margin / 0.5, 0)) < 1e-10 THEN round_even(margin / 0.5, 0) ELSE margin / 0.5 END) END AS INT) AS bin, count(*) AS n FROM t GROUP BY ALL),
    pb AS (SELECT bin, sum(n) AS nb FROM bins GROUP BY bin), pc AS (SELECT inning, sum(n) AS nc FROM bins GROUP BY inning), tot AS (SELECT sum(n) AS total FROM bins),
    prior AS (SELECT pc.inning, pb.bin, (coalesce(n, 0) + 100 * nb / total) / (nc + 100) AS weight FROM pc CROSS JOIN pb CROSS JOIN tot LEFT JOIN bins ON bins.inning = pc.inning AND bins.bin = pb.bin)"""


def margin_prior(t):
    return prior.binned_prior(t, "inning", "margin", 0.5)


@query("n4_binned_prior", f"WITH {T}, {PRIOR} SELECT inning, bin::BIGINT AS bin, round(weight, 8) AS weight FROM prior")
def binned_prior(spark, sf):
    """Histograms by context, shrunk to all contexts."""
    return rounded(margin_prior(timeline(spark, sf)), 8)


@query("n6_prior_wrong_rate", f"WITH {T}, {PRIOR} SELECT inning, round(sum(CASE WHEN bin >= 0 THEN weight ELSE 0 END), 8) AS wrong_rate FROM prior GROUP BY inning")
def prior_wrong_rate(spark, sf):
    """Chance of a wrong call before any signal."""
    return rounded(prior.wrong_rate(margin_prior(timeline(spark, sf)), "inning"), 8)


@query(
    "n5_posterior_q",
    f"WITH {T}, {PRIOR}, m AS (SELECT event_id, bin, weight * exp(-0.5::DOUBLE * (((margin + p - 0.5) - (bin + 0.5) * 0.5) / 1.2::DOUBLE) ^ 2) AS w FROM t JOIN prior USING (inning)) SELECT event_id, round(sum(CASE WHEN bin >= 0 THEN w ELSE 0 END) / sum(w), 8) AS q FROM m GROUP BY event_id",
)
def posterior_q(spark, sf):
    """Discrete Bayes over the bins."""
    t = timeline(spark, sf)
    signals = t.select("event_id", "inning", (F.col("margin") + F.col("p") - 0.5).alias("signal"))
    return rounded(prior.posterior(signals, margin_prior(t), "inning", "signal", 0.5, 1.2, ["event_id"]).select("event_id", "q"), 8)


@query("n7_log_density", f"WITH {T}, {PRIOR}, k AS (SELECT event_id, inning, cast(CASE WHEN margin = 0 THEN -1 ELSE floor(CASE WHEN abs(margin / 0.5 - round_even(margin / 0.5, 0)) < 1e-10 THEN round_even(margin / 0.5, 0) ELSE margin / 0.5 END) END AS INT) AS bin FROM t) SELECT event_id, round(ln(weight / 0.5::DOUBLE), 8) AS log_density FROM k LEFT JOIN prior USING (inning, bin)")
def log_density(spark, sf):
    """Log density of the histogram."""
    t = timeline(spark, sf)
    return rounded(prior.log_density(t.select("event_id", "inning", "margin"), margin_prior(t), "inning", "margin", 0.5).select("event_id", "log_density"), 8)


@query(
    "n8_crps",
    f"""WITH {T}, {PRIOR}, f AS (SELECT inning, sum(weight) OVER w AS f, (lead(bin) OVER w - bin) * 0.5 AS gap FROM prior WINDOW w AS (PARTITION BY inning ORDER BY bin)), s AS (SELECT inning, sum(f * (1 - f) * coalesce(gap, 0)) AS spread FROM f GROUP BY inning),
    d AS (SELECT event_id, inning, sum(weight * abs((bin + 0.5) * 0.5 - margin)) AS d FROM t JOIN prior USING (inning) GROUP BY ALL) SELECT event_id, round(d - spread, 8) AS crps FROM d JOIN s USING (inning)""",
)
def crps(spark, sf):
    """Exact score of a finite distribution, by prefix sums."""
    t = timeline(spark, sf)
    return rounded(prior.crps(t.select("event_id", "inning", "margin"), margin_prior(t), "inning", "margin", 0.5, ["event_id"]).select("event_id", "crps"), 8)


@query("n3_context_weights", f"WITH {T}, s AS (SELECT game, p AS a, 1 - p AS b FROM t), o AS (SELECT avg(a) AS oa, avg(b) AS ob FROM s) SELECT game, round((sum(a) + 100 * any_value(oa)) / (count(*) + 100), 8) AS a, round((sum(b) + 100 * any_value(ob)) / (count(*) + 100), 8) AS b FROM s CROSS JOIN o GROUP BY game")
def context_weights(spark, sf):
    """Mixture weights by context from soft counts."""
    rows = timeline(spark, sf).select("game", F.col("p").alias("a"), (1 - F.col("p")).alias("b"))
    return rounded(prior.context_weights(rows, "game", ["a", "b"]), 8)


HASH = "('0x' || substr(md5(concat_ws('|', {0})), 1, 12))::BIGINT"
WEIGHTS = f"""gm AS (SELECT game, row_number() OVER (ORDER BY game) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT game FROM t)),
    w AS (SELECT r.replicate, h.game, count(*) AS weight FROM gm CROSS JOIN (SELECT unnest(range(1, 5001)) AS replicate) r JOIN gm h ON h.place = {HASH.format("7, r.replicate, gm.place")} % gm.n GROUP BY ALL),
    sums AS (SELECT game, role, sum(stake) AS s, count(*) AS c FROM t GROUP BY ALL), draws AS (SELECT replicate, role, sum(s * weight) / sum(c * weight) AS m FROM sums JOIN w USING (game) GROUP BY ALL)"""


@query("c6_bootstrap_interval", f"WITH {T}, {WEIGHTS}, pt AS (SELECT role, sum(s) / sum(c) AS e FROM sums GROUP BY role) SELECT role, round(any_value(e), 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS lower, round(median(m), 6) AS median, round(quantile_cont(m, 0.975), 6) AS upper FROM draws JOIN pt USING (role) GROUP BY role")
def bootstrap_interval(spark, sf):
    """Whole-group bootstrap over group sums."""
    return rounded(resample.bootstrap_interval(timeline(spark, sf), "game", ["role"], "stake", 5000, 7))


@query("c10_simultaneous_band", f"WITH {T}, {WEIGHTS}, pt AS (SELECT role, sum(s) / sum(c) AS e FROM sums GROUP BY role), d AS (SELECT replicate, max(abs(m - e)) AS d FROM draws JOIN pt USING (role) GROUP BY replicate), q AS (SELECT quantile_cont(d, 0.95) AS h FROM d) SELECT role, round(e, 6) AS estimate, round(e - h, 6) AS lower, round(e + h, 6) AS upper FROM pt CROSS JOIN q")
def simultaneous_band(spark, sf):
    """One half-width for all scenarios at once."""
    t = timeline(spark, sf)
    sums = t.groupBy("game", "role").agg(F.sum("stake").alias("s"), F.count("stake").alias("c"))
    draws = resample.bootstrap_totals(sums, resample.bootstrap_weights(t, "game", 5000, 7), "game", ["role"], ["s", "c"]).select("replicate", "role", (F.col("s") / F.col("c")).alias("m"))
    points = sums.groupBy("role").agg((F.sum("s") / F.sum("c")).alias("m"))
    return rounded(resample.simultaneous_band(points, draws, "role", "m"))


@query("c11_worst_bound", f"WITH {T}, {WEIGHTS}, d AS (SELECT replicate, min(m) AS w FROM draws GROUP BY replicate) SELECT round(quantile_cont(w, 0.05), 6) AS bound FROM d")
def worst_bound(spark, sf):
    """One-sided bound of the worst scenario."""
    t = timeline(spark, sf)
    sums = t.groupBy("game", "role").agg(F.sum("stake").alias("s"), F.count("stake").alias("c"))
    draws = resample.bootstrap_totals(sums, resample.bootstrap_weights(t, "game", 5000, 7), "game", ["role"], ["s", "c"]).withColumn("m", F.col("s") / F.col("c"))
    return rounded(resample.worst_bound(draws, "m"))


@query("c1_balanced_folds", f"WITH {T} SELECT game, (row_number() OVER (ORDER BY {HASH.format('11, game')}, game) - 1) % 5 + 1 AS fold FROM (SELECT DISTINCT game FROM t)")
def balanced_folds(spark, sf):
    """Balanced folds of whole groups in hash order."""
    return rounded(resample.balanced_folds(timeline(spark, sf), "game", 5, 11))


@query(
    "c3_one_error_rule",
    f"""WITH {T}, s AS (SELECT a AS alpha, game, abs(margin - 0.1) / (1 + abs(a - 100) / 400.0) + p * 0 AS score FROM t CROSS JOIN (VALUES (0), (50), (100), (200), (400)) v(a)), m AS (SELECT alpha, avg(score) AS mean, count(*) AS n FROM s GROUP BY alpha), c AS (SELECT alpha, game, sum(score - mean) AS r FROM s JOIN m USING (alpha) GROUP BY ALL),
    e AS (SELECT alpha, any_value(mean) AS mean, sqrt(count(*)::DOUBLE / (count(*) - 1) * sum(r * r)) / any_value(n) AS se FROM c JOIN m USING (alpha) GROUP BY alpha), best AS (SELECT alpha AS best, mean + se AS lim FROM e ORDER BY mean, alpha LIMIT 1) SELECT best::BIGINT AS best, max(alpha)::BIGINT AS selected FROM e CROSS JOIN best WHERE mean <= lim GROUP BY 1""".replace(" + p * 0", ""),
)
def one_error_rule(spark, sf):
    """The largest candidate within one clustered error of the best."""
    t = timeline(spark, sf).select("game", "margin", F.explode(F.array(*map(F.lit, (0, 50, 100, 200, 400)))).alias("alpha"))
    scored = t.withColumn("score", F.abs(F.col("margin") - 0.1) / (1 + F.abs(F.col("alpha") - 100) / 400.0))
    return rounded(prior.largest_within_one_error(scored, "alpha", "score", "game"))


ROUNDS = 12
MIXTURES = f"""
WITH RECURSIVE cells AS (
    SELECT user_id % 4 AS fold, floor(value / 2.0) * 2.0 AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL
), counts AS MATERIALIZED (
    SELECT f, v, sum(n)::DOUBLE AS n FROM cells JOIN (SELECT DISTINCT fold AS f FROM cells) ON f != fold GROUP BY ALL
), b AS (
    SELECT *, (sum(n) OVER (PARTITION BY f ORDER BY v) - n / 2) / sum(n) OVER (PARTITION BY f) AS below FROM counts
), placed AS (
    SELECT *, lag(v) OVER (PARTITION BY f ORDER BY v) AS v0, lag(below) OVER (PARTITION BY f ORDER BY v) AS below0 FROM b
), wanted AS (
    SELECT k, i, (i + 0.5::DOUBLE) / k AS q FROM range(1, 4) a(k), range(0, 3) c(i) WHERE i < k
), centres AS (
    SELECT f, sum(n) AS n, sum(v * n) / sum(n) AS centre FROM counts GROUP BY f
), spreads AS (
    SELECT f, sqrt(sum((v - centre) ** 2 * c.n) / max(m.n)) AS spread FROM counts c JOIN centres m USING (f) GROUP BY f
), starts AS (
    SELECT f, k, i, coalesce(max(CASE WHEN coalesce(below0, -1) < q AND below >= q THEN
        CASE WHEN below0 IS NULL THEN v ELSE v0 + (q - below0) / (below - below0) * (v - v0) END END), max(v)) AS mean
    FROM placed, wanted GROUP BY f, k, i
), r AS (
    SELECT 0 AS step, f, k, i, 1.0::DOUBLE / k AS weight, mean, greatest(spread / k, 0.05::DOUBLE) AS sd, NULL::DOUBLE AS value
    FROM starts JOIN spreads USING (f)
    UNION ALL
    SELECT step + 1, f, k, i, s / sum(s) OVER (PARTITION BY f, k), (s1 + mean * s0) / s,
        greatest(sqrt(greatest(s2 - 2 * ((s1 + mean * s0) / s - mean) * s1 + ((s1 + mean * s0) / s - mean) ** 2 * s0, 0) / s), 0.05), value
    FROM (
        SELECT step, f, k, i, mean, sum(share) AS s0, sum(share) + 0.001::DOUBLE AS s, sum(share * (v - mean)) AS s1,
            sum(share * (v - mean) ** 2) AS s2, sum(total * n) AS value
        FROM (
            SELECT *, exp(log_part - total) * n AS share FROM (
                SELECT *, top + ln(sum(exp(log_part - top)) OVER (PARTITION BY f, k, v)) AS total FROM (
                    SELECT *, max(log_part) OVER (PARTITION BY f, k, v) AS top FROM (
                        SELECT r.*, v, n, -(((v - mean) / sd) ** 2) / 2 - ln(sd) + ln(weight) - 0.9189385332046727 AS log_part
                        FROM r JOIN counts USING (f) WHERE step < {ROUNDS}))))
        GROUP BY step, f, k, i, mean)
)
SELECT f, k, row_number() OVER (PARTITION BY f, k ORDER BY mean) - 1 AS component, round(weight, 6) AS weight, round(mean, 6) AS mean, round(sd, 6) AS sd,
    round(value / (SELECT sum(n) FROM counts c WHERE c.f = r.f), 6) AS log_likelihood
FROM r WHERE step = {ROUNDS}
"""


@query("n2_fold_mixtures", MIXTURES)
def fold_mixtures(spark, sf):
    """Mixtures of 1 to 3 components of the stakes, for every fold of users at once, after a fixed number of rounds; the
    log likelihood is a row's mean."""
    rows = table(spark, sf, "events").select((F.col("user_id") % 4).alias("fold"), "value").cache()
    parts = mixtures(rows, "fold", "value", 3, width=2.0, rounds=ROUNDS, tolerance=-1.0)
    sizes = training_counts(rows, "fold", "value", 2.0).groupBy("f").agg(F.sum("n").alias("n"))
    return rounded(parts.join(sizes, "f").select("f", "k", "component", "weight", "mean", "sd", (F.col("log_likelihood") / F.col("n")).alias("log_likelihood")))
