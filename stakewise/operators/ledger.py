"""The tables of the analysis: event ledger, team timeline, clock, truth, comparators and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakewise.functions import scalar as S
from stakewise.operators.governance import guard_columns, require_unique
from stakewise.operators.stats import ratio, with_total

PITCH = ["game_pk", "at_bat_number", "pitch_number"]
CLOCK = ["game_pk", "team_id", "pitch_order"]
#: Columns that may not appear on a decision clock.
TRUTH = ("margin", "success", "outcome", "edge_distance_inches", "zone_call", "correctable_opportunity")


def numbered(rows: DataFrame, key: str, order: list[str], out: str = "pitch_order") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def physical_pitches(rows: DataFrame, keys: list[str], order: str, automatic: Column) -> DataFrame:
    """Rows without automatic ones, renumbered by those before them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(order, F.sum(F.when(automatic, 0).otherwise(1)).over(w)).filter(~automatic)


def with_geometry(rows: DataFrame) -> DataFrame:
    edge = S.edge_distance_inches(*[F.col(c) for c in ("plate_x", "plate_z", "sz_bot", "sz_top")])
    rows = rows.withColumn("edge_distance_inches", edge).withColumn("zone_call", S.zone_call(F.col("edge_distance_inches")))
    bat, fld = (F.when(F.col("call") == c, F.col(t)) for c, t in (("called_strike", "bat_team_id"), ("ball", "fld_team_id")))
    return rows.withColumns({"adverse_team_id": F.coalesce(bat, fld), "adverse_role": S.adverse_role(F.col("call")), "correctable_opportunity": S.correctable(F.col("zone_call"), F.col("call")), "near_edge": S.near_edge(F.col("edge_distance_inches"))})


def with_eligibility(rows: DataFrame, games: DataFrame, pitches: DataFrame) -> DataFrame:
    """Reasons of games (game_pk, reason) and of pitches (PITCH, reason) override those of the row."""
    joined = rows.join(games.select("game_pk", F.col("reason").alias("__g")), "game_pk", "left")
    joined = joined.join(pitches.select(*PITCH, F.col("reason").alias("__m")), PITCH, "left")
    reason = S.exclusion_reason(F.col("identity_matched"), F.col("tracking_available"), F.col("pitcher_position"), F.col("other_review"), F.col("__g"), F.col("__m"))
    out = joined.withColumn("exclusion_reason", reason).drop("__g", "__m")
    eligible = F.col("exclusion_reason").isNull()
    return out.withColumns({"eligible": eligible, "correctable_opportunity": F.col("correctable_opportunity") & eligible})


def team_timeline(ledger: DataFrame) -> DataFrame:
    """Two rows per pitch, one per team, in one pass: side, whether the pitch was adverse to the team, and whether
    its correction was open to it."""
    sides = [F.struct(F.col(f"{s}_team_id").alias("team_id"), F.lit(role).alias("side")) for s, role in (("bat", "offense"), ("fld", "defense"))]
    rows = ledger.withColumn("__s", F.explode(F.array(*sides))).select("*", "__s.*").drop("__s")
    mine = S.is_true(F.col("adverse_team_id") == F.col("team_id"))
    return rows.withColumns({"adverse": mine, "correct": mine & F.col("correctable_opportunity"), "attempted": S.is_true(F.col("challenger_team_id") == F.col("team_id"))})


def decision_clock(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Public decision rows: string keys, unique, and none of the columns that hold the truth."""
    clock = guard_columns(rows.select(*columns), "the decision clock", denied=list(TRUTH))
    clock = clock.withColumns({k: F.col(k).cast("string") for k in ("game_pk", "team_id")})
    return require_unique(clock, CLOCK, "the decision clock")


def policy_table(clock: DataFrame, policies: dict[str, tuple[Column, Column]], uses_truth: set[str] = frozenset({"oracle"})) -> DataFrame:
    """(policy, keys, p1, p2, truth_used) for every policy and row of the clock, from one pass over it."""
    made = [F.struct(F.lit(n).alias("policy"), p1.cast("double").alias("p1"), p2.cast("double").alias("p2"), F.lit(n in uses_truth).alias("truth_used")) for n, (p1, p2) in policies.items()]
    return clock.select(*CLOCK, F.explode(F.array(*made)).alias("p")).select(*CLOCK, "p.*")


def policy_summary(replayed: DataFrame, by: list[str], reference: str = "observed", best: str = "oracle") -> DataFrame:
    """Per policy and role (and combined): totals of the replay, gain over the observed policy, share of the oracle."""
    totals = [F.sum(F.col(f"state.{c}")).alias(c) for c in ("challenges", "successes", "failures", "captured")]
    sums = with_total(replayed, "role", totals, keys=["policy", *by])
    refs = {n: sums.filter(F.col("policy") == p).select(*by, "role", F.col("captured").alias(n)) for n, p in (("__o", reference), ("__b", best))}
    joined = sums.join(refs["__o"], [*by, "role"], "left").join(refs["__b"], [*by, "role"], "left")
    return joined.withColumns({"success_rate": ratio(F.col("successes"), F.col("challenges")), "gain": F.col("captured") - F.col("__o"), "share_of_best": ratio(F.col("captured"), F.col("__b"))}).drop("__o", "__b")


def full_joined(parts: list[DataFrame], keys: list[str], fill: list[str]) -> DataFrame:
    """Full outer join of summaries on their keys; ``fill`` columns are zero where a part has no row."""
    joined = reduce(lambda a, b: a.join(b, keys, "full"), parts)
    return joined.fillna(0, fill)


def opportunity_adjusted(rows: DataFrame, by: list[str], happened: Column, expected: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("chances"), F.sum(happened.cast("int")).alias("attempts"), F.sum(expected).alias("expected")).withColumn("above_expected", F.col("attempts") - F.col("expected"))


def inning_summary(rows: DataFrame, values: list[Column], pooled_from: int = 10) -> DataFrame:
    """By role and inning, later innings pooled."""
    label = F.when(F.col("inning") >= pooled_from, f"{pooled_from}+").otherwise(F.col("inning").cast("string"))
    return rows.groupBy("role", label.alias("inning")).agg(*values)


def nearest_state(wanted: DataFrame, states: DataFrame, parent: list[str], stage: str) -> DataFrame:
    """``wanted`` with ``resolved``: the stage itself where it exists, else the nearest one of the same parent (ties: the lower).

    States are a small dimension, so candidates of a parent are few.
    """
    known = states.select(*parent, F.col(stage).alias("__s")).distinct()
    near = wanted.select(*parent, stage).distinct().join(known, parent)
    best = near.groupBy(*parent, stage).agg(F.min_by("__s", F.struct(F.abs(F.col("__s") - F.col(stage)), "__s")).alias("resolved"))
    return wanted.join(best, [*parent, stage], "left")
