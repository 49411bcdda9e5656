"""What a called pitch does to the state of a half-inning, and what it is worth: all row-local CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakewise.functions.scalar import base_state, occupied, opposite_call

BASES = ("1b", "2b", "3b")


def number(name: str, columns: list[str]) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("int") if name in columns else F.lit(0)


def moved(df: DataFrame) -> dict[str, Column]:
    """The state after concurrent movement: runners are removed first, then added; runs and outs add up."""
    state = {"balls": F.col("balls_before"), "strikes": F.col("strikes_before")}
    state["outs"] = F.col("outs_before") + number("concurrent_outs", df.columns)
    state["runs"] = number("concurrent_runs", df.columns)
    for b in BASES:
        removed, added = (number(f"concurrent_{x}_{b}", df.columns) > 0 for x in ("remove", "add"))
        state[f"on_{b}"] = F.when(added, 1).when(removed, 0).otherwise(occupied(F.col(f"on_{b}")))
    return state


def call_branch(df: DataFrame, call: Column, out: str = "branch") -> DataFrame:
    """``df`` with the struct ``out``: balls, strikes, outs, on_1b, on_2b, on_3b and runs after the call.

    The fourth ball walks the batter and forces runners ahead; the third strike is an out. Other calls raise.
    """
    s = moved(df)
    known = F.when(call.isin("ball", "called_strike"), call).otherwise(F.raise_error(F.concat(F.lit("unsupported call: "), F.coalesce(call, F.lit("null")))))
    df = df.withColumn("__s", F.struct(known.alias("call"), *[c.alias(n) for n, c in s.items()]))
    c = {n: F.col(f"__s.{n}") for n in (*s, "call")}
    ball, strike = c["call"] == "ball", c["call"] == "called_strike"
    walk, strikeout = ball & (c["balls"] >= 3), strike & (c["strikes"] >= 2)
    first, second = walk & (c["on_1b"] == 1), walk & (c["on_1b"] == 1) & (c["on_2b"] == 1)
    over = walk | strikeout
    after = {
        "balls": F.when(over, 0).otherwise(c["balls"] + ball.cast("int")),
        "strikes": F.when(over, 0).otherwise(c["strikes"] + strike.cast("int")),
        "outs": c["outs"] + strikeout.cast("int"),
        "on_1b": F.when(walk, 1).otherwise(c["on_1b"]),
        "on_2b": F.when(first, 1).otherwise(c["on_2b"]),
        "on_3b": F.when(second, 1).otherwise(c["on_3b"]),
        "runs": c["runs"] + (second & (c["on_3b"] == 1)).cast("int"),
    }
    return df.withColumn(out, F.struct(*[x.cast("int").alias(n) for n, x in after.items()])).drop("__s")


def branch_value(df: DataFrame, table: DataFrame, branch: str = "branch", out: str = "branch_re") -> DataFrame:
    """Runs of the branch plus the expectation of its state; nothing remains at three outs, unknown states give null.

    ``table`` (outs, base_state, balls, strikes, re) has 288 rows at most, so it is broadcast.
    """
    keyed = F.broadcast(table.select(F.col("outs").alias("__o"), F.col("base_state").alias("__b"), F.col("balls").alias("__u"), F.col("strikes").alias("__t"), F.col("re").alias("__re")))
    b = F.col(branch)
    state = base_state(b["on_1b"], b["on_2b"], b["on_3b"])
    joined = df.join(keyed, (b["outs"] == F.col("__o")) & (state == F.col("__b")) & (b["balls"] == F.col("__u")) & (b["strikes"] == F.col("__t")), "left")
    value = b["runs"] + F.when(b["outs"] >= 3, 0.0).otherwise(F.col("__re"))
    return joined.withColumn(out, value).drop("__o", "__b", "__u", "__t", "__re")


def correction_gain(df: DataFrame, table: DataFrame, call: Column, for_batting: Column, out: str = "gain") -> DataFrame:
    """Value of the opposite call over the call that stands, for the batting side, or negated for the other.

    Neither location nor outcome of a challenge is read.
    """
    df = branch_value(call_branch(df, call, "__stands"), table, "__stands", "__stands_re")
    df = branch_value(call_branch(df, opposite_call(call), "__flipped"), table, "__flipped", "__flipped_re")
    gain = F.col("__flipped_re") - F.col("__stands_re")
    return df.withColumn(out, F.when(for_batting, gain).otherwise(-gain)).drop("__stands", "__flipped", "__stands_re", "__flipped_re")


def win_state(df: DataFrame, branch: str = "branch") -> DataFrame:
    """State after half-inning rollover for win probability: inning capped at 12, score difference at 10 either way."""
    b, bottom = F.col(branch), F.col("half") == "bottom"
    over = b["outs"] >= 3
    home = F.when(bottom, F.col("bat_score") + b["runs"]).otherwise(F.col("fld_score"))
    away = F.when(bottom, F.col("fld_score")).otherwise(F.col("bat_score") + b["runs"])
    inning = F.col("inning") + (over & bottom).cast("int")
    return df.withColumn(
        "win_state",
        F.struct(
            F.least(inning, F.lit(12)).alias("inning"), F.when(over, ~bottom).otherwise(bottom).cast("int").alias("is_bottom"),
            F.greatest(F.lit(-10), F.least(F.lit(10), home - away)).alias("score_diff"), F.when(over, 0).otherwise(b["outs"]).alias("outs"),
            F.when(over, "000").otherwise(base_state(b["on_1b"], b["on_2b"], b["on_3b"])).alias("base_state"),
            F.when(over, "0-0").otherwise(F.concat_ws("-", b["balls"], b["strikes"])).alias("count_state"),
        ),
    )
