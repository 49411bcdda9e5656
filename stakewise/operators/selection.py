"""Context of choices, their evaluation against predictions, design columns, audits and model checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakewise.operators.governance import CheckFailed, require_none
from stakewise.operators.stats import cdf_distances

SLOW_MPH, LOCAL_INCHES = 75.0, 3.0


def among(value: Column, first: int, last: int) -> Column:
    return F.coalesce(value.between(first, last), F.lit(False))


def matchup(stand: Column, throws: Column) -> Column:
    return F.concat_ws("-", F.coalesce(stand, F.lit("U")), F.coalesce(throws, F.lit("U")))


def with_context(rows: DataFrame, slow_mph: float = SLOW_MPH) -> DataFrame:
    """Count, matchup, outs, speed and margin strata of (balls_before, strikes_before, outs_before, stand, p_throws,
    pitch_type, release_speed, margin); what is missing or impossible is "unknown"."""
    b, s, o, speed = (F.col(c) for c in ("balls_before", "strikes_before", "outs_before", "release_speed"))
    eephus = F.coalesce(F.col("pitch_type") == "EP", F.lit(False))
    known = speed.isNotNull() & ~F.isnan(speed)
    strata = F.when(eephus, "eephus").when(known & (speed < slow_mph), "slow_non_eephus").when(~known, "speed_missing").otherwise("regular_speed")
    near = F.when(F.abs("margin") <= LOCAL_INCHES, "local_abs_margin_le_3").otherwise("tail_abs_margin_gt_3")
    made = {
        "count_state": F.when(among(b, 0, 3) & among(s, 0, 2), F.concat_ws("-", b, s)).otherwise("unknown"), "matchup": matchup(F.col("stand"), F.col("p_throws")),
        "outs_state": F.when(among(o, 0, 2), o.cast("string")).otherwise("unknown"), "speed_stratum": strata, "margin_stratum": near, "selection_stratum": F.concat_ws("__", strata, near),
    }
    return rows.withColumns(made)


def design(rows: DataFrame, factors: dict[str, list[str]], scaled: dict[str, tuple[float, float]]) -> tuple[DataFrame, list[str]]:
    """Indicator columns of factors, whose first level is the reference, and z-scores by stored means and deviations.

    Levels come from training; others, and nulls, count as the reference.
    """
    out = {f"{f}__{level}": F.coalesce(F.col(f).cast("string") == level, F.lit(False)).cast("double") for f, levels in factors.items() for level in levels[1:]}
    out |= {f"z__{c}": (F.col(c) - mean) / (sd or 1.0) for c, (mean, sd) in scaled.items()}
    return rows.withColumns(out), list(out)


def learnt_levels(rows: DataFrame, factors: list[str]) -> dict[str, list[str]]:
    """Levels of each factor by falling frequency, ties by name: the mode is the reference. Factors are of few levels."""
    out = {}
    for f in factors:
        counts = rows.filter(F.col(f).isNotNull()).groupBy(F.col(f).cast("string").alias("l")).count().orderBy(F.desc("count"), "l")
        out[f] = [r["l"] for r in counts.collect()]
    return out


def learnt_scales(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    r = rows.agg(*[x for c in columns for x in (F.avg(c), F.stddev_samp(c))]).first()
    return {c: (float(r[2 * i] or 0), float(r[2 * i + 1] or 0)) for i, c in enumerate(columns)}


def evaluated(rows: DataFrame, by: list[str], chosen: str, chance: str, success: str, margin: str) -> DataFrame:
    """Observed against predicted choices: attempts, successes, mean margins, and distances of the margins' distributions."""
    y, p, s, m = F.col(chosen).cast("double"), F.col(chance), F.col(success).cast("double"), F.col(margin)
    totals = rows.groupBy(*by).agg(
        F.sum(y).alias("attempts"), F.sum(p).alias("predicted_attempts"), F.sum(y * s).alias("successes"), F.sum(p * s).alias("predicted_successes"),
        F.try_divide(F.sum(y * m), F.sum(y)).alias("mean_margin"), F.try_divide(F.sum(p * m), F.sum(p)).alias("predicted_mean_margin"),
    )
    return totals.join(cdf_distances(rows, by, margin, y, p), by)


#: What must hold for an audited row of each category, over the ledger's columns.
AUDIT_RULES = {
    "upheld_challenge": "outcome = 'upheld' AND call = zone_call AND remaining_after = remaining_before - 1",
    "overturned_challenge": "outcome = 'overturned' AND call <> zone_call AND remaining_after = remaining_before",
    "zero_inventory_correctable": "status = 'out_of_challenges' AND remaining_before = 0 AND call <> zone_call",
    "missed_available": "status = 'missed_available' AND remaining_before > 0 AND call <> zone_call",
    "pa_terminal_linkage": "outcome IS NOT NULL AND linkage = 'plate_appearance_terminal'",
    "extra_inning_challenge": "outcome IN ('overturned', 'upheld') AND inning > 9",
}


def require_audit(audit: DataFrame, ledger: DataFrame, keys: list[str], least: dict[str, int]) -> None:
    """Audited rows are unique, passed, found once in the ledger, and still satisfy their category's rule."""
    require_none(audit.groupBy("audit_id").count().filter("count > 1"), "an audit id repeats")
    require_none(audit.filter("status <> 'pass' OR status IS NULL"), "an audited row did not pass")
    counts = {r["audit_category"]: r["count"] for r in audit.groupBy("audit_category").count().collect()}
    if short := [c for c, n in least.items() if counts.get(c, 0) < n]:
        raise CheckFailed(f"the audit lacks {', '.join(short)}")
    joined = audit.withColumnRenamed("status", "audit_status").join(ledger.withColumn("__found", F.lit(True)), keys, "left")
    require_none(joined.groupBy("audit_id").agg(F.count("__found").alias("n")).filter("n <> 1"), "an audited row is not in the ledger once")
    rule = reduce(lambda c, r: c.when(F.col("audit_category") == r, F.expr(AUDIT_RULES[r])), AUDIT_RULES, F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False))
    require_none(joined.filter(~F.coalesce(rule, F.lit(False))), "an audited row no longer satisfies its rule")


def require_masses_agree(analytic: DataFrame, numeric: DataFrame, keys: list[str], value: str, within: float = 0.002) -> None:
    joined = analytic.select(*keys, F.col(value).alias("a")).join(numeric.select(*keys, F.col(value).alias("n")), keys, "full")
    require_none(joined.filter(F.col("a").isNull() | F.col("n").isNull() | (F.abs(F.col("a") - F.col("n")) > within)), "analytic and numeric masses differ")


def require_prior(prior: DataFrame, context: str) -> None:
    """Weights of every context are non-negative and sum to one."""
    require_none(prior.groupBy(context).agg(F.sum("weight").alias("w"), F.min("weight").alias("least")).filter("abs(w - 1) > 1e-8 OR least < 0"), "prior weights do not close")


def require_states(table: DataFrame, states: int = 288) -> None:
    """A complete state table: so many distinct states, each with a finite value."""
    r = table.agg(F.countDistinct("outs", "base_state", "balls", "strikes").alias("n"), F.count("*").alias("rows"), F.count_if(F.col("re").isNull() | F.isnan("re") | (F.abs("re") == float("inf"))).alias("bad")).first()
    if r["n"] != states or r["rows"] != states or r["bad"]:
        raise CheckFailed(f"the state table has {r['rows']} rows, {r['n']} states and {r['bad']} without a value")
