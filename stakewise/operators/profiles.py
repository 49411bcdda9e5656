"""Profiles of groups: which of them hold up out of fold, and smooth curves of their rates on the probit scale."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakewise.functions.kernels import inverse_phi, natural_spline
from stakewise.operators.governance import CheckFailed

#: Different values of a group's x that one curve may have.
MOST_POINTS = 5000


def _log_loss(s: Column, n: Column, p: Column) -> Column:
    return -(s * F.log(p) + (n - s) * F.log(1 - p))


def accepted_profiles(rows: DataFrame, group: list[str], pool: list[str], fold: str, game: str, outcome: str) -> DataFrame:
    """(group, n, games, difference, se, accepted, rate): a group keeps its own rate only if, out of fold, it beats that of its
    ``pool`` (a part of the group's columns) by more than one error of the paired differences.

    Rates come from the other folds, with half a success and half a failure added. Differences are mean log losses of a
    game's rows; their error is that of games. A group of one game has no error and falls back to its pool, as does one
    whose differences can't tell. Rows are reduced to group, fold and game once; a game lies in one fold.
    """
    y = F.col(outcome).cast("double")
    cells = rows.filter(y.isNotNull()).groupBy(*group, fold, game).agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("s"))

    def elsewhere(by: list[str], name: str) -> DataFrame:
        part = cells.groupBy(*by, fold).agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
        whole = part.groupBy(*by).agg(F.sum("fn").alias("an"), F.sum("fs").alias("as"))
        rate = (F.col("as") - F.col("fs") + 0.5) / (F.col("an") - F.col("fn") + 1)
        return part.join(whole, by).select(*by, fold, rate.alias(name), ((F.col("as") + 0.5) / (F.col("an") + 1)).alias(f"all_{name}"))

    met = cells.join(elsewhere(group, "own"), [*group, fold]).join(elsewhere(pool, "pooled"), [*pool, fold])
    difference = (_log_loss(F.col("s"), F.col("n"), F.col("own")) - _log_loss(F.col("s"), F.col("n"), F.col("pooled"))) / F.col("n")
    found = met.withColumn("d", difference).groupBy(*group).agg(
        F.sum("n").alias("n"), F.count("*").alias("games"), F.avg("d").alias("difference"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"), F.first("all_own").alias("own"), F.first("all_pooled").alias("pooled")
    )
    better = F.coalesce(F.col("difference") + F.col("se") < 0, F.lit(False))
    return found.select(*group, "n", "games", "difference", "se", better.alias("accepted"), F.when(better, F.col("own")).otherwise(F.col("pooled")).alias("rate"))


def probit_curves(rows: DataFrame, group: list[str], x: str, outcome: str) -> DataFrame:
    """(group, x, n, observed, smooth): each group's natural cubic smoothing spline through the probits of its rates, weighted
    by counts, with the penalty that generalised cross-validation prefers. Rows are reduced to group and x first; the
    different x of a group are counted, and more than ``MOST_POINTS`` are an error. Null x or outcomes are left out."""
    y = F.col(outcome).cast("double")
    cells = rows.filter(F.col(x).isNotNull() & y.isNotNull()).groupBy(*group, x).agg(F.count("*").alias("n"), F.sum(y).alias("s")).cache()
    most = cells.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most > MOST_POINTS:
        raise CheckFailed(f"{most} points of a curve are more than {MOST_POINTS}")
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*group, x]) + ", n long, observed double, smooth double"

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(x)
        n, s = frame["n"].to_numpy(float), frame["s"].to_numpy(float)
        z = inverse_phi((s + 0.5) / (n + 1))
        frame["observed"], frame["smooth"] = z, natural_spline(frame[x].to_numpy(float), z, n)[0]
        return frame[[*group, x, "n", "observed", "smooth"]]

    return cells.groupBy(*group).applyInPandas(smooth, schema)
