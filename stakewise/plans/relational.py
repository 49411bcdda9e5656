"""Scalar, join, aggregate, window and reshape queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stakewise.functions import scalar as S
from stakewise.operators import ledger, stats, tables
from stakewise.plans.base import KEYS, T, query, rounded, table, timeline

MONEY = "l_extendedprice * (1 - l_discount)"


@query(
    "revenue_by_nation",
    """SELECT n_name, r_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
        round(avg(l_quantity), 6) AS mean_quantity, round(max(o_totalprice), 2) AS largest_order
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY n_name, r_name""",
)
def revenue_by_nation(spark, sf):
    """Facts to dimensions; the small ones are left to Catalyst, which broadcasts them by size."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.expr(MONEY).alias("money"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    names = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name", "r_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("money"), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.max("o_totalprice"), 2).alias("largest_order"))


@query("j8_customers_without_orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf):
    """Anti join."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("j8_customers_with_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice BETWEEN 100000 AND 300000)")
def customers_with_orders(spark, sf):
    """Semi join with a range pushed to the scan."""
    orders = table(spark, sf, "orders").filter(F.col("o_totalprice").between(100000, 300000)).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query(
    "j5_full_outer_summary",
    """WITH c AS (SELECT c_nationkey AS k, count(*) AS customers, sum(c_acctbal) AS balance FROM customer GROUP BY 1),
    s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1),
    o AS (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1),
    n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 3)
    SELECT k, coalesce(customers, 0) AS customers, round(coalesce(balance, 0), 2) AS balance, coalesce(suppliers, 0) AS suppliers, coalesce(orders, 0) AS orders
    FROM n FULL JOIN c USING (k) FULL JOIN s USING (k) FULL JOIN o USING (k)""",
)
def full_outer_summary(spark, sf):
    """Summaries folded over full joins, zero where one has no row."""
    customer = table(spark, sf, "customer")
    parts = [
        table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("k")),
        customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance")),
        table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")),
        table(spark, sf, "orders").filter("o_orderstatus = 'F'").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("orders")),
    ]
    return ledger.full_joined(parts, ["k"], ["customers", "balance", "suppliers", "orders"]).withColumns({"balance": F.round("balance", 2), "k": F.col("k").cast("long")})


@query(
    "j4_right_weights",
    """SELECT p_brand, round(sum(coalesce(l_quantity, 0) * w), 2) AS weighted, count(l_orderkey) AS lines
    FROM (SELECT l_partkey, l_quantity, l_orderkey FROM lineitem WHERE l_discount > 0.08) RIGHT JOIN (SELECT p_partkey, p_brand, p_size % 3 AS w FROM part) ON l_partkey = p_partkey GROUP BY p_brand""",
)
def right_weights(spark, sf):
    """Weights drive the join; parts without lines stay."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_size") % 3).alias("w"))
    lines = table(spark, sf, "lineitem").filter("l_discount > 0.08").select("l_partkey", "l_quantity", "l_orderkey")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "right")
    return joined.groupBy("p_brand").agg(F.round(F.sum(F.coalesce("l_quantity", F.lit(0.0)) * F.col("w")), 2).alias("weighted"), F.count("l_orderkey").alias("lines"))


@query(
    "j6_update_join",
    "SELECT s_suppkey, coalesce(CASE WHEN n_regionkey = 1 THEN n_name END, 'elsewhere') AS place, round(coalesce(b, s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, max(c_acctbal) AS b FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) ON s_nationkey = c_nationkey",
)
def update_join(spark, sf):
    """J6, P4-like defaults: values replaced where the other side has one."""
    best = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("b"))
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(best, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    place = F.coalesce(F.when(F.col("n_regionkey") == 1, F.col("n_name")), F.lit("elsewhere"))
    return joined.select("s_suppkey", place.alias("place"), F.round(F.coalesce("b", "s_acctbal"), 2).alias("balance"))


@query(
    "j9_policies_by_clock",
    f"""WITH {T} SELECT policy, role, count(*) AS n, round(sum(CASE policy WHEN 'never' THEN 0 WHEN 'half' THEN 0.5 ELSE p END * stake), 2) AS expected
    FROM t CROSS JOIN (VALUES ('never'), ('half'), ('signal')) v(policy) GROUP BY policy, role""",
)
def policies_by_clock(spark, sf):
    """Rows fan out to policies without a join, by one array per row."""
    t = timeline(spark, sf)
    made = F.array(*[F.struct(F.lit(n).alias("policy"), p.alias("q")) for n, p in (("never", F.lit(0.0)), ("half", F.lit(0.5)), ("signal", F.col("p")))])
    rows = t.select("role", "stake", F.explode(made).alias("x")).select("role", "stake", "x.*")
    return rows.groupBy("policy", "role").agg(F.count("*").alias("n"), F.round(F.sum(F.col("q") * F.col("stake")), 2).alias("expected"))


@query(
    "j11_nearest_state",
    """WITH known AS (SELECT DISTINCT p_size AS s, p_partkey % 3 AS g FROM part WHERE p_size % 7 = 0), wanted AS (SELECT DISTINCT p_size AS s, p_partkey % 3 AS g FROM part)
    SELECT g, s, arg_min(k, abs(k - s) * 1000 + k) AS resolved FROM (SELECT w.g, w.s, known.s AS k FROM wanted w JOIN known ON known.g = w.g) GROUP BY g, s""",
)
def nearest_state(spark, sf):
    """A missing state takes its parent's nearest one, the lower in a tie."""
    part = table(spark, sf, "part").select(F.col("p_size").alias("s"), (F.col("p_partkey") % 3).alias("g")).distinct()
    return rounded(ledger.nearest_state(part, part.filter("s % 7 = 0"), ["g"], "s"))


@query(
    "j12_grid_interpolation",
    """WITH g AS (SELECT i, i * 1000.0::DOUBLE AS x, sqrt(i * 1000.0::DOUBLE) AS y FROM range(0, 601) r(i))
    SELECT o_orderkey, round(a.y + least(1, greatest(0, (o_totalprice - a.x) / (b.x - a.x))) * (b.y - a.y), 6) AS root
    FROM orders JOIN g a ON a.i = least(599, cast(floor(o_totalprice / 1000) AS BIGINT)) JOIN g b ON b.i = a.i + 1""",
)
def grid_interpolation(spark, sf):
    """The grid is even, so the last point below is arithmetic and the lookup an equi join."""
    from stakewise.operators.prior import interpolated

    grid = spark.range(601).select(F.col("id").alias("i"), (F.col("id") * 1000.0).alias("x")).withColumn("y", F.sqrt("x"))
    pairs = grid.alias("a").join(grid.alias("b"), F.expr("b.i = a.i + 1")).select("a.i", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.least(F.lit(599), F.floor(F.col("o_totalprice") / 1000)).alias("i"))
    y = interpolated(F.col("o_totalprice"), *[F.col(c) for c in ("x0", "x1", "y0", "y1")])
    return orders.join(F.broadcast(pairs), "i").select("o_orderkey", F.round(y, 6).alias("root"))


@query(
    "p6_score_bucket",
    """SELECT p_partkey, p_size % 13 - 6 AS d, CASE WHEN p_size % 13 - 6 <= -5 THEN '<=-5' WHEN p_size % 13 - 6 <= -3 THEN '-4:-3' WHEN p_size % 13 - 6 = -2 THEN '-2' WHEN p_size % 13 - 6 = -1 THEN '-1' WHEN p_size % 13 - 6 = 0 THEN '0'
        WHEN p_size % 13 - 6 = 1 THEN '1' WHEN p_size % 13 - 6 = 2 THEN '2' WHEN p_size % 13 - 6 <= 4 THEN '3:4' ELSE '>=5' END AS bucket FROM part""",
)
def score_bucket(spark, sf):
    """Right-closed buckets."""
    return rounded(table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 13 - 6).alias("d")).withColumn("bucket", S.score_bucket(F.col("d"))))


@query(
    "p7_p20_state_keys",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_linenumber * 2 AS inning, l_returnflag = 'R' AS bottom, cast(l_quantity AS BIGINT) % 3 AS outs, l_partkey % 2 AS a, l_suppkey % 2 AS b, CASE WHEN l_linestatus = 'O' THEN 1 END AS c FROM lineitem),
    i AS (SELECT *, (inning - 1) * 6 + CASE WHEN bottom THEN 3 ELSE 0 END + outs AS idx FROM s)
    SELECT l_orderkey, l_linenumber, idx, CASE WHEN idx < 54 THEN idx ELSE 54 + (idx - 54) % 6 END AS stage,
        concat(a, b, coalesce(c, 0)) AS bases, concat_ws('|', CASE WHEN idx < 54 THEN idx ELSE 54 + (idx - 54) % 6 END, CASE WHEN bottom THEN 'x' ELSE 'y' END) AS key FROM i""",
)
def state_keys(spark, sf):
    """Base states, stage indices and composite keys."""
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 2).alias("inning"), (F.col("l_returnflag") == "R").alias("bottom"), (F.col("l_quantity").cast("long") % 3).alias("outs"), (F.col("l_partkey") % 2).alias("a"), (F.col("l_suppkey") % 2).alias("b"), F.when(F.col("l_linestatus") == "O", 1).alias("c"))
    r = r.withColumn("idx", S.out_index(F.col("inning"), F.col("bottom"), F.col("outs"))).withColumn("stage", S.stage(F.col("idx")))
    key = S.composite_key(F.col("stage"), F.when(F.col("bottom"), "x").otherwise("y"))
    return rounded(r.select("l_orderkey", "l_linenumber", "idx", "stage", S.base_state(F.col("a"), F.col("b"), F.col("c")).alias("bases"), key.alias("key")))


GEOMETRY = """g AS (SELECT l_orderkey, l_linenumber, l_discount * 20 - 1 AS x, l_tax * 30 + 1 AS z, l_returnflag, 1.5 AS lo, 3.4 AS hi FROM lineitem),
    q AS (SELECT *, abs(x) - 17.0::DOUBLE / 24 AS qx, greatest(lo - z, z - hi) AS qz FROM g),
    e AS (SELECT *, 12 * (sqrt(greatest(qx, 0) ^ 2 + greatest(qz, 0) ^ 2) + least(greatest(qx, qz), 0)) - 1.45 AS edge FROM q)"""


@query(
    "p8_rectangle_distance",
    f"""WITH {GEOMETRY} SELECT l_orderkey, l_linenumber, round(edge, 6) AS edge, CASE WHEN edge <= 0 THEN 'called_strike' ELSE 'ball' END AS zone,
        CASE WHEN l_returnflag = 'A' THEN 'offense' WHEN l_returnflag = 'N' THEN 'defense' END AS role,
        coalesce(CASE WHEN l_returnflag IN ('A', 'N') THEN (CASE WHEN edge <= 0 THEN 'called_strike' ELSE 'ball' END) <> (CASE WHEN l_returnflag = 'A' THEN 'called_strike' ELSE 'ball' END) END, false) AS correctable, abs(edge) <= 0.25 AS near_edge FROM e""",
)
def rectangle(spark, sf):
    """Signed distance, zone call, adverse role and correctable flag."""
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 20 - 1).alias("x"), (F.col("l_tax") * 30 + 1).alias("z"), F.translate("l_returnflag", "AN", "CB").alias("code"))
    r = r.withColumn("edge", S.edge_distance_inches(F.col("x"), F.col("z"), F.lit(1.5), F.lit(3.4))).withColumn("call", S.normal_call(F.col("code"), F.lit(None).cast("string"))).withColumn("zone", S.zone_call(F.col("edge")))
    return rounded(r.select("l_orderkey", "l_linenumber", "edge", "zone", S.adverse_role(F.col("call")).alias("role"), S.correctable(F.col("zone"), F.col("call")).alias("correctable"), S.near_edge(F.col("edge")).alias("near_edge")))


@query(
    "p11_eligibility",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 50 = 0 THEN 'manual' END, CASE WHEN o_custkey % 40 = 0 THEN 'game' END, CASE WHEN o_orderkey % 11 = 0 THEN 'same_pitch_non_abs_review' END,
        CASE WHEN o_orderpriority NOT LIKE '1%' AND o_orderkey % 9 = 0 THEN 'position_player_pitching' END, CASE WHEN o_orderstatus = 'P' THEN 'statcast_identity_mismatch' WHEN o_orderkey % 7 = 0 THEN 'missing_tracking' END) AS reason FROM orders""",
)
def eligibility(spark, sf):
    """A cascade whose later rules win, as a coalesce in reverse order."""
    k = F.col("o_orderkey")
    position = F.when(k % 9 == 0, F.substring("o_orderpriority", 1, 1))
    reason = S.exclusion_reason(F.col("o_orderstatus") != "P", k % 7 != 0, position, k % 11 == 0, F.when(F.col("o_custkey") % 40 == 0, "game"), F.when(k % 50 == 0, "manual"))
    return table(spark, sf, "orders").select("o_orderkey", reason.alias("reason"))


@query(
    "p13_status_case",
    f"""WITH {T} SELECT event_id, CASE WHEN margin <= 0 THEN 'not_correctable' WHEN outcome IS NOT NULL THEN 'challenged' WHEN pitch_order % 3 > 0 THEN 'missed_available' ELSE 'out_of_challenges' END AS status,
        CASE WHEN user_id = event_id % 150 THEN 'batter' WHEN user_id = event_id % 149 THEN 'pitcher' ELSE 'catcher' END AS player,
        CASE WHEN event_type IN ('view') THEN 'fastball' WHEN event_type IN ('click') THEN 'breaking' WHEN event_type IN ('error') THEN 'offspeed' ELSE 'other' END AS family,
        CASE WHEN event_id % 400 >= 250 AND event_id % 17 >= 10 THEN 'high' WHEN event_id % 400 >= 100 AND event_id % 17 >= 3 THEN 'moderate' ELSE 'limited' END AS tier FROM t""",
)
def status_case(spark, sf):
    """Status, roles, families and tiers."""
    t, e = timeline(spark, sf), F.col("event_id")
    family = S.pitch_family(F.when(F.col("event_type") == "view", "SI").when(F.col("event_type") == "click", "CU").when(F.col("event_type") == "error", "FS"))
    return t.select("event_id", S.opportunity_status(F.col("margin") > 0, F.col("outcome").isNotNull(), F.col("pitch_order") % 3).alias("status"), S.challenger_role(F.col("user_id"), e % 150, e % 149).alias("player"), family.alias("family"), S.reliability_tier(e % 400, e % 17).alias("tier"))


@query(
    "p21_p26_probability_functions",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS p, l_quantity / 10 - 2.5 AS x, l_tax * 50 AS lam, l_linenumber % 3 AS k FROM lineitem), c AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM s)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 8) AS softplus, round(ln(q / (1 - q)), 8) AS logit, round(1 / (1 + exp(-x)), 8) AS expit,
        round(-CASE WHEN k = 1 THEN ln(q) ELSE ln(1 - q) END, 8) AS loss, round(CASE WHEN p + lam > 0 THEN lam / (p + lam) END, 8) AS break_even,
        round(CASE WHEN lam > 1e-10 THEN p / lam ELSE 0 END * CASE WHEN k <= 1 THEN 1 - exp(-lam) ELSE 1 - exp(-lam) * (1 + lam) END, 8) AS inventory_loss,
        round(q * x, 8) AS sensory, round(x * sqrt(1 - q * q), 8) AS action FROM c""",
)
def probability_functions(spark, sf):
    """Stable transforms, losses and widths, all in one code-generated projection."""
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("p"), (F.col("l_quantity") / 10 - 2.5).alias("x"), (F.col("l_tax") * 50).alias("lam"), (F.col("l_linenumber") % 3).alias("k"))
    p, x, lam = F.col("p"), F.col("x"), F.col("lam")
    sensory, action = S.width_parts(S.clipped(p), x)
    return rounded(r.select("l_orderkey", "l_linenumber", S.softplus(x).alias("softplus"), S.logit(p).alias("logit"), S.expit(x).alias("expit"), S.log_loss(F.col("k") == 1, p).alias("loss"), S.break_even(p, lam).alias("break_even"), S.expected_inventory_loss(lam, p, F.col("k")).alias("inventory_loss"), sensory.alias("sensory"), action.alias("action")), 8)


_PHI = "exp(-z * z / 2) / 2.5066282746310002 * (1 / (1 + 0.2316419 * abs(z))) * (0.319381530 + (1 / (1 + 0.2316419 * abs(z))) * (-0.356563782 + (1 / (1 + 0.2316419 * abs(z))) * (1.781477937 + (1 / (1 + 0.2316419 * abs(z))) * (-1.821255978 + (1 / (1 + 0.2316419 * abs(z))) * 1.330274429))))"


@query(
    "n1_normal_cdf",
    f"WITH s AS (SELECT event_id, (event_id % 121 - 60)::DOUBLE / 15 AS z FROM events) SELECT event_id, round(CASE WHEN z >= 0 THEN 1 - {_PHI} ELSE {_PHI} END, 6) AS phi, round(exp(-z * z / 2) / 2.5066282746310002, 6) AS density FROM s",
)
def normal_cdf(spark, sf):
    """The normal distribution as a column expression."""
    z = (F.col("event_id") % 121 - 60) / 15
    return rounded(table(spark, sf, "events").select("event_id", S.normal_cdf(z).alias("phi"), S.normal_density(z).alias("density")))


@query("p30_median_imputation", "WITH s AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS v FROM part) SELECT p_partkey, v IS NULL AS missing, round(coalesce(v, median(v) OVER (PARTITION BY p_brand), median(v) OVER ()), 6) AS v FROM s")
def median_imputation(spark, sf):
    """Family median, then the overall one."""
    r = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("v"))
    return rounded(tables.median_imputed(r, "v", "p_brand").select("p_partkey", "missing", "v"))


@query("p33_margin_bin", f"WITH {T} SELECT event_id, CASE WHEN margin = 0 THEN -1 ELSE cast(floor(CASE WHEN abs(margin / 0.25 - round_even(margin / 0.25, 0)) < 1e-10 THEN round_even(margin / 0.25, 0) ELSE margin / 0.25 END) AS BIGINT) END AS bin, CASE WHEN role = 'offense' THEN margin > 0 ELSE margin >= 0 END AS success FROM t")
def margin_bin(spark, sf):
    """Bins with snapped edges, and who a margin of zero belongs to."""
    m = F.col("margin")
    return rounded(timeline(spark, sf).select("event_id", S.margin_bin(m, 0.25).alias("bin"), S.margin_success(F.col("role"), m).alias("success")))


@query(
    "a5_first_last_per_group",
    f"WITH {T} SELECT game, team, arg_min(event_type, pitch_order) AS first_type, arg_max(event_type, pitch_order) AS last_type, arg_max(event_id, stake * 1e6 - event_id * 1e-6) AS largest, count(*) AS n, bool_or(success) AS any_success, bool_and(stake > 0) AS all_positive FROM t GROUP BY game, team",
)
def first_last(spark, sf):
    """First, last and extreme rows by key, without a sort."""
    t = timeline(spark, sf)
    return t.groupBy(*KEYS).agg(F.min_by("event_type", "pitch_order").alias("first_type"), F.max_by("event_type", "pitch_order").alias("last_type"), F.max_by("event_id", F.col("stake") * 1e6 - F.col("event_id") * 1e-6).alias("largest"), F.count("*").alias("n"), F.bool_or("success").alias("any_success"), F.bool_and(F.col("stake") > 0).alias("all_positive"))


@query("a11_role_plus_combined", f"WITH {T} SELECT CASE WHEN grouping(role) = 1 THEN 'combined' ELSE role END AS role, game, count(*) AS n, round(sum(stake), 4) AS total, round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS rate FROM t GROUP BY GROUPING SETS ((game, role), (game))")
def role_plus_combined(spark, sf):
    """Groups and their total in one pass."""
    aggregates = [F.count("*").alias("n"), F.round(F.sum("stake"), 4).alias("total"), F.round(F.avg(F.col("success").cast("double")), 6).alias("rate")]
    return stats.with_total(timeline(spark, sf), "role", aggregates, keys=["game"])


@query("a23_compressed_rows", f"WITH {T} SELECT inning, role, round(p, 1) AS p, success, count(*) AS weight FROM t GROUP BY ALL")
def compressed_rows(spark, sf):
    """Equal rows once, with their weight."""
    return rounded(stats.compressed(timeline(spark, sf).withColumn("p", F.round("p", 1)), ["inning", "role", "p", "success"]))


@query("w1_pitch_order", f"WITH {T} SELECT event_id, game, team, pitch_order, inning, row_number() OVER (PARTITION BY game, team, inning ORDER BY pitch_order) AS place, row_number() OVER (PARTITION BY game, team ORDER BY pitch_order) = 1 AS first_row FROM t")
def pitch_order(spark, sf):
    """Numbering in groups and once-per-group flags."""
    t, w = timeline(spark, sf), Window.partitionBy(*KEYS).orderBy("pitch_order")
    return rounded(t.select("event_id", *KEYS, "pitch_order", "inning", F.row_number().over(Window.partitionBy(*KEYS, "inning").orderBy("pitch_order")).alias("place"), (F.row_number().over(w) == 1).alias("first_row")))


@query("w2_renumbered", f"WITH {T}, r AS (SELECT event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY game, team ORDER BY pitch_order) AS pitch FROM t) SELECT event_id, cast(pitch AS BIGINT) AS pitch FROM r WHERE event_type <> 'error'")
def renumbered(spark, sf):
    """Running count of kept rows, then the filter."""
    return ledger.physical_pitches(timeline(spark, sf), KEYS, "pitch_order", F.col("event_type") == "error").select("event_id", F.col("pitch_order").alias("pitch"))


@query("w6_runs_to_end", f"WITH {T} SELECT event_id, round(greatest(0, max(stake) OVER (PARTITION BY game, team, inning) - stake), 6) AS runs_to_end FROM t")
def runs_to_end(spark, sf):
    """The group's maximum less the row's own value."""
    return rounded(tables.runs_to_end(timeline(spark, sf), [*KEYS, "inning"], ["stake"]).select("event_id", "runs_to_end"))


@query(
    "w7_running_max",
    f"WITH {T} SELECT event_id, round(max(p) OVER w, 6) AS monotone, round(coalesce(sum(half) OVER (PARTITION BY game, team ORDER BY pitch_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 6) AS right_tail, coalesce(stake < last, false) AS falls FROM (SELECT *, (stake + lag(stake) OVER w) / 2 AS half, lag(stake) OVER w AS last FROM t WINDOW w AS (PARTITION BY game, team ORDER BY pitch_order)) WINDOW w AS (PARTITION BY game, team ORDER BY pitch_order)",
)
def running_max(spark, sf):
    """Monotone repair, trapezoid tails and order checks."""
    w = Window.partitionBy(*KEYS).orderBy("pitch_order")
    t = timeline(spark, sf).withColumns({"last": F.lag("stake").over(w), "half": (F.col("stake") + F.lag("stake").over(w)) / 2})
    tail = F.coalesce(F.sum("half").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return rounded(t.select("event_id", F.max("p").over(w).alias("monotone"), tail.alias("right_tail"), F.coalesce(F.col("stake") < F.col("last"), F.lit(False)).alias("falls")))


@query("w11_dense_fold", f"WITH {T} SELECT event_id, (dense_rank() OVER (ORDER BY game) - 1) % 5 + 1 AS fold FROM t")
def dense_fold(spark, sf):
    """Folds by the group's rank; only distinct groups are ranked."""
    from stakewise.operators.resample import dense_folds

    return rounded(dense_folds(timeline(spark, sf), "game", 5).select("event_id", "fold"))


@query("o1_mixed_sort_top", "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS price FROM orders ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 100")
def mixed_sort_top(spark, sf):
    """O1, O2, O3: a top-100 report; each task keeps 100 rows."""
    return table(spark, sf, "orders").orderBy(F.desc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price"))


@query("o4_union_by_name", "SELECT c_nationkey AS nation, 'customer' AS kind, c_mktsegment AS segment, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, 'supplier', NULL, s_acctbal FROM supplier")
def union_by_name(spark, sf):
    """Union with columns that one side lacks."""
    from stakewise.sources.readers import union_by_name as union

    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    return union([c, s])


@query("o6_set_operations", "SELECT 'both' AS part, k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_discount = 0.1 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10) UNION ALL SELECT 'left', k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_discount = 0.1 EXCEPT SELECT p_partkey FROM part WHERE p_size < 10)")
def set_operations(spark, sf):
    """Intersection, difference and distinct of keys."""
    a = table(spark, sf, "lineitem").filter("l_discount = 0.1").select(F.col("l_partkey").alias("k"))
    b = table(spark, sf, "part").filter("p_size < 10").select(F.col("p_partkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("part"), "k").union(a.subtract(b).select(F.lit("left"), "k"))


@query("o7_unpivot_measures", "SELECT l_returnflag, measure, round(sum(v), 2) AS total FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_tax INTO NAME measure VALUE v) GROUP BY ALL")
def unpivot_measures(spark, sf):
    """Sums first, then the long form: three rows a group instead of three rows a line."""
    sums = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.sum(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_tax")])
    return sums.unpivot("l_returnflag", ["l_quantity", "l_extendedprice", "l_tax"], "measure", "total").withColumn("total", F.round("total", 2))


@query("o9_pivot_roles", f"WITH {T} SELECT game, team, coalesce(sum(stake) FILTER (role = 'offense'), 0) AS offense_raw, round(sum(stake) FILTER (role = 'offense'), 4) AS offense, round(sum(stake) FILTER (role = 'defense'), 4) AS defense FROM t GROUP BY game, team".replace("coalesce(sum(stake) FILTER (role = 'offense'), 0) AS offense_raw, ", ""))
def pivot_roles(spark, sf):
    """Roles as columns; naming them spares the pass that finds them."""
    return timeline(spark, sf).groupBy(*KEYS).pivot("role", ["offense", "defense"]).agg(F.round(F.sum("stake"), 4))


@query("o12_group_replication", f"WITH {T}, w AS (SELECT DISTINCT game, cast(dense_rank() OVER (ORDER BY game) % 3 AS BIGINT) AS weight FROM t) SELECT printf('%s__bootstrap_%03d', game, i) AS game, count(*) AS n, round(sum(stake), 4) AS total FROM t JOIN w USING (game) CROSS JOIN LATERAL (SELECT unnest(range(1, weight + 1)) AS i) GROUP BY 1")
def group_replication(spark, sf):
    """Whole groups repeated by weight."""
    from stakewise.operators.resample import replicated

    t = timeline(spark, sf)
    games = t.select("game").distinct().select("game", (F.row_number().over(Window.orderBy("game")) % 3).alias("weight"))
    return replicated(t, F.broadcast(games.filter("weight > 0")), "game").groupBy("game").agg(F.count("*").alias("n"), F.round(F.sum("stake"), 4).alias("total"))


@query("o13_json_fields", "SELECT event_id, json_extract_string(props, '$.' || k) AS v FROM events CROSS JOIN (SELECT DISTINCT k FROM (SELECT unnest(json_keys(props)) AS k FROM events) ORDER BY k LIMIT 1)")
def json_fields(spark, sf):
    """A field of a JSON column; the name of the first key is one value."""
    e = table(spark, sf, "events").select("event_id", "props")
    first = e.select(F.explode(F.json_object_keys("props")).alias("k")).agg(F.min("k").alias("k"))
    return e.crossJoin(F.broadcast(first)).select("event_id", F.from_json("props", "map<string,string>")[F.col("k")].alias("v"))
