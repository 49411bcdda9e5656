"""Builders of model rows: official challenges, discrimination and prior rows, decision units, thresholds, prior-only replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakewise.functions import scalar as S
from stakewise.operators.governance import guard_columns, require_columns
from stakewise.operators.resample import bootstrap_seed, hashed
from stakewise.operators.sequential import REGULATION, folded, vectors

UNKNOWN = "__UNKNOWN__"
#: Columns that say how a challenge ended; model rows may not have them.
OUTCOME_COLUMNS = ("outcome", "overturned", "success", "is_challengeABS_overturned", "zone_call")


def renamed(rows: DataFrame, names: dict[str, str], label: str) -> DataFrame:
    """The columns in ``names`` (old to new) and no others; a missing one raises."""
    require_columns(rows, list(names), label)
    return rows.select(*[F.col(old).alias(new) for old, new in names.items()])


def limits(feed: Column, other: Column, places: int = 3) -> Column:
    """A zone limit: the feed's, else the other source's, rounded half away from zero as a decimal, not as a binary double."""
    return F.round(F.coalesce(feed, other).cast("decimal(20,9)"), places).cast("double")


def official_challenges(rows: DataFrame) -> DataFrame:
    """Outcome, initial call and challenging team of official challenge rows: the side that the call went against."""
    require_columns(rows, ["is_challengeABS_overturned", "original_isStrike_ump", "bat_team_id", "fld_team_id"], "official challenges")
    strike = F.col("original_isStrike_ump") == 1
    return rows.withColumns({
        "savant_outcome": F.when(F.col("is_challengeABS_overturned") == 1, "overturned").otherwise("upheld"),
        "savant_initial_call": F.when(strike, "called_strike").otherwise("ball"),
        "savant_challenger_team_id": F.when(strike, F.col("bat_team_id")).otherwise(F.col("fld_team_id")).cast("long"),
    })


def exact_margin(supplied: Column, exact: Column, tolerance: float = 1e-8) -> Column:
    """The margin by geometry where there is one, else the supplied one; the two may not differ by more than ``tolerance``."""
    differ = F.abs(exact - supplied) > tolerance
    return F.when(F.coalesce(differ, F.lit(False)), F.raise_error(F.lit("precomputed edge distances disagree with the geometry")).cast("double")).otherwise(F.coalesce(exact, supplied))


def count_state(balls: Column, strikes: Column) -> Column:
    valid = F.coalesce(balls.between(0, 3) & strikes.between(0, 2), F.lit(False))
    return F.when(valid, F.concat_ws("-", balls.cast("int"), strikes.cast("int"))).otherwise("unknown")


def discrimination_rows(rows: DataFrame, adverse: str = "called_strike", epsilon: float = 1e-6) -> DataFrame:
    """Eligible rows of (game_pk, pitch_order, unit_id, team_id, initial_call, stake_G, inventory_loss, challenged,
    inventory, supplied and exact margins, balls_before, strikes_before) with stakes, break-even chance and its log-odds.

    A row is eligible if its call is ``adverse``, keys are there, stakes are finite, not negative and not both zero,
    a challenge is left and the action is 0 or 1.
    """
    guard_columns(rows, "discrimination rows", denied=list(OUTCOME_COLUMNS))
    margin = exact_margin(F.col("edge_distance_inches"), F.col("exact_margin"))
    total = F.col("stake_G") + F.col("inventory_loss")
    q = F.when(total > 0, F.col("inventory_loss") / total)
    made = rows.withColumns({
        "margin_inches": margin, "margin_source": F.when(F.col("exact_margin").isNotNull(), "exact_rounded_geometry").otherwise("precomputed_exact_edge"),
        "count_state": count_state(F.col("balls_before"), F.col("strikes_before")), "team_id": F.coalesce(F.nullif(F.col("team_id").cast("string"), F.lit("")), F.lit(UNKNOWN)),
        "total_stake": total, "q_star": q, "q_star_clipped": S.clipped(q, epsilon) != q, "challenge_cost_log_odds": S.logit(q, epsilon),
    })
    fine = (F.col("initial_call") == adverse) & F.col("game_pk").isNotNull() & F.col("unit_id").isNotNull() & F.col("margin_inches").isNotNull()
    fine = fine & (F.col("stake_G") >= 0) & (F.col("inventory_loss") >= 0) & (F.col("total_stake") > 0) & (F.col("inventory") >= 1) & F.col("challenged").isin(0, 1)
    return made.filter(fine).drop("exact_margin", "edge_distance_inches")


def margin_prior_rows(rows: DataFrame) -> DataFrame:
    """Tracked called strikes with a margin, by count: what a margin prior is fitted on."""
    kept = F.col("game_pk").isNotNull() & F.coalesce(F.col("tracking_available"), F.lit(False)) & (F.col("initial_call") == "called_strike") & F.col("edge_distance_inches").isNotNull()
    return rows.filter(kept).select("game_pk", "pitch_order", count_state(F.col("balls_before"), F.col("strikes_before")).alias("count_state"), "edge_distance_inches")


def role_prior_rows(rows: DataFrame) -> DataFrame:
    """Prior rows of both roles in one pass: each tracked call is adverse to one role, whose margin is signed its way, with
    the context of count and pitch family."""
    role = F.when(F.col("initial_call") == "called_strike", "offense").when(F.col("initial_call") == "ball", "defense")
    kept = F.col("game_pk").isNotNull() & F.coalesce(F.col("tracking_available"), F.lit(False)) & role.isNotNull() & F.col("edge_distance_inches").isNotNull()
    context = F.concat_ws("__", count_state(F.col("balls_before"), F.col("strikes_before")), S.pitch_family(F.col("pitch_type")))
    return rows.filter(kept).select("game_pk", "pitch_order", role.alias("role"), F.col("edge_distance_inches").alias("physical_margin"), role_margin(role, F.col("edge_distance_inches")).alias("role_margin"), context.alias("context"))


def role_margin(role: Column, margin: Column) -> Column:
    """A margin as the role sees it: beyond zero the call was wrong for it."""
    return F.when(role == "defense", F.lit(0.0) - margin).otherwise(margin)


def decision_units(rows: DataFrame) -> DataFrame:
    """Width rows of both roles under the same names: a batter decides on offense, a team on defense."""
    offense = F.col("role") == "offense"
    return rows.withColumns({
        "decision_unit_id": F.when(offense, F.col("batter_id")).otherwise(F.col("defensive_team_id")).cast("string"),
        "team_context_id": F.when(offense, F.col("bat_team_id")).otherwise(F.col("opponent_team_id")).cast("string"),
        "role_margin_inches": role_margin(F.col("role"), F.col("margin_inches")),
    })


def threshold_table(replays: DataFrame, widths: DataFrame, scenarios: DataFrame, keys: list[str]) -> DataFrame:
    """Structural rows of ``replays`` (keys, fold, role, stage, decision_mode, stake_G, loss_k1, loss_k2, r_k1, r_k2), one per
    scenario (scenario_id, offense_kappa, defense_kappa) and inventory, with widths, break-even chance and stakes.

    ``widths`` (fold, role, width) and the scenarios are tables of a few rows a fold.
    """
    kappa = F.when(F.col("role") == "offense", F.col("offense_kappa")).otherwise(F.col("defense_kappa"))
    joined = replays.filter("decision_mode = 'structural'").join(widths, ["fold", "role"], "left").crossJoin(F.broadcast(scenarios))
    sensory, action = S.width_parts(kappa, F.col("width"))
    each = F.array(*[F.struct(F.lit(k).alias("inventory"), F.col(f"loss_k{k}").alias("L"), F.col(f"r_k{k}").alias("r_star")) for k in (1, 2)])
    rows = joined.select(*keys, "fold", "role", "stage", "scenario_id", F.col("stake_G").alias("G"), F.col("width"), sensory.alias("sensory_sigma"), action.alias("action_sigma"), F.explode(each).alias("x")).select("*", "x.*").drop("x")
    return rows.withColumn("q_star", S.break_even(F.col("G"), F.col("L")))


def normative_probability(margin: Column, r_star: Column, sensory: Column) -> Column:
    return S.signal_probability(margin, r_star, sensory)


def profile(rows: DataFrame, by: list[str], margin: str, width: float, chance: Column) -> DataFrame:
    """Mean chance to challenge, and the number of rows, by margin bin: rows are reduced to bins in one pass."""
    return rows.groupBy(*by, S.margin_bin(F.col(margin), width).alias("bin")).agg(F.count("*").alias("n"), F.avg(chance).alias("probability"))


def prior_replay(rows: DataFrame, keys: list[str], order: list[str], initial: int = 2) -> DataFrame:
    """Expected replay under beliefs alone: rows have inning, stake, decision_mode, and for one or two units left the mass of
    acting (a1, a2) and of acting with success (s1, s2).

    A "passive" row never acts. An "exogenous" one acts as given but captures nothing for the policy. No truth is read.
    """

    def step(m: Column, row: Column) -> tuple[Column, Column]:
        enters = (row["inning"] > REGULATION) & (row["inning_before"].isNull() | (row["inning"] > row["inning_before"]))
        live = F.when(row["decision_mode"] == "passive", 0.0).otherwise(1.0)
        own = F.when(row["decision_mode"] == "structural", 1.0).otherwise(0.0)
        m0, m1 = F.when(enters, 0.0).otherwise(m["m0"]), m["m1"] + F.when(enters, m["m0"]).otherwise(0.0)
        f1, f2 = (mass * live * (row[f"a{k}"] - row[f"s{k}"]) for k, mass in ((1, m1), (2, m["m2"])))
        won = live * (m1 * row["s1"] + m["m2"] * row["s2"])
        acts = live * (m1 * row["a1"] + m["m2"] * row["a2"])
        after = F.struct((m0 + f1).alias("m0"), (m1 - f1 + f2).alias("m1"), (m["m2"] - f2).alias("m2"))
        return after, F.struct(m0.alias("m0"), m1.alias("m1"), m["m2"].alias("m2"), acts.alias("challenges"), won.alias("successes"), (own * won * row["stake"]).alias("captured"))

    return folded(rows, keys, order, step=step, **vectors(["m0", "m1", "m2"], [float(k == initial) for k in range(3)]))


def root_between(f, low: Column, high: Column, rounds: int = 60) -> Column:
    """Root of a function that increases between two points, by bisection inside the expression; the ends if it has none there."""

    def half(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        below = f(middle) < 0
        return F.struct(F.when(below, middle).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high"))

    start = F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, half, lambda s: (s["low"] + s["high"]) / 2)


def draw_thresholds(rows: DataFrame, draws: DataFrame, mean: float, sd: float, gain: str, loss: str) -> DataFrame:
    """``rows`` by every draw (draw, sigma) of the signal's noise, with the signal at which a normal margin is beyond zero
    with the break-even chance: no gain is +Inf, no loss is -Inf. ``draws`` is a table of some hundred rows."""
    weight = sd * sd / (sd * sd + F.col("sigma") * F.col("sigma"))
    behind = F.sqrt(1 - weight) * sd

    def belief(signal: Column) -> Column:
        return S.normal_cdf((weight * signal + (1 - weight) * mean) / behind) - S.break_even(F.col(gain), F.col(loss))

    solved = root_between(belief, F.lit(-40.0), F.lit(40.0))
    limit = F.when(F.col(gain) <= 0, float("inf")).when(F.col(loss) <= 0, float("-inf"))
    return rows.crossJoin(F.broadcast(draws)).withColumn("r_star", F.coalesce(limit, solved))


def coordinated_weights(sources: dict[str, DataFrame], group: str, replicates: int, seed: int) -> DataFrame:
    """(source, replicate, group, weight): whole-group bootstraps of several sources with replicate seeds of their own.

    Seeds come by arithmetic, so any replicate can be made again alone. A source has one row per group here; groups are
    numbered in their order.
    """
    from pyspark.sql import Window

    parts = None
    for name, groups in sources.items():
        numbered = groups.select(group).distinct().withColumns({"place": F.row_number().over(Window.orderBy(group)) - 1})
        n = numbered.agg(F.count("*").alias("n"))
        seeds = groups.sparkSession.createDataFrame([(r, bootstrap_seed(seed, r, name)) for r in range(1, replicates + 1)], "replicate int, seed long")
        draws = numbered.select(F.col("place").alias("draw")).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(seeds))
        drawn = draws.select("replicate", (hashed(F.col("seed"), F.col("draw")) % F.col("n")).alias("place")).groupBy("replicate", "place").agg(F.count("*").alias("weight"))
        part = drawn.join(numbered, "place").select(F.lit(name).alias("source"), "replicate", group, "weight")
        parts = part if parts is None else parts.union(part)
    return parts


def refitted_cells(sums: DataFrame, weights: DataFrame, group: str, cell: list[str], parent: list[str], strength: float = 20.0) -> DataFrame:
    """Cell means shrunk to their parents under each replicate's weights, from sums by group and cell (s, n)."""
    totals = sums.join(weights, group).groupBy("replicate", *parent, *cell).agg(F.sum(F.col("s") * F.col("weight")).alias("s"), F.sum(F.col("n") * F.col("weight")).alias("n"))
    parents = totals.groupBy("replicate", *parent).agg((F.sum("s") / F.sum("n")).alias("mean"))
    joined = totals.join(parents, ["replicate", *parent])
    return joined.withColumn("estimate", (F.col("s") + strength * F.col("mean")) / (F.col("n") + strength))


def refitted_widths(sums: DataFrame, weights: DataFrame, group: str, by: list[str]) -> DataFrame:
    """Width of a role's margins under each replicate's weights: the standard deviation by weighted moments (n, s, ss)."""
    t = sums.join(weights, group).groupBy("replicate", *by).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("n", "s", "ss")])
    mean = F.col("s") / F.col("n")
    return t.select("replicate", *by, F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)).alias("width"))
