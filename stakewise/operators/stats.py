"""Statistics over groups: quantiles, clustered errors, distances of distributions, concentration, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is zero or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return ratio(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def sandwich_error(rows: DataFrame, cluster: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean with the cluster-robust error sqrt(G / (G - 1) * sum(cluster residual sums ^ 2) / n ^ 2)."""
    by = by or []
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    total = sums.groupBy(*by).agg((F.sum("s") / F.sum("c")).alias("mean"), F.sum("c").alias("n"), F.count("*").alias("clusters"))
    joined = sums.join(total, by) if by else sums.crossJoin(F.broadcast(total))
    residual = F.col("s") - F.col("c") * F.col("mean")
    g = F.col("clusters")
    squares = joined.groupBy(*by, "mean", "n", "clusters").agg(F.sum(residual * residual).alias("q"))
    return squares.select(*by, "mean", "n", "clusters", F.when(g > 1, F.sqrt(g / (g - 1) * F.col("q")) / F.col("n")).alias("se"))


def cluster_mean_error(rows: DataFrame, cluster: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean of cluster means with the error sd / sqrt(G). Not the same quantity as ``sandwich_error``."""
    by = by or []
    means = rows.groupBy(*by, cluster).agg(F.avg(value).alias("m"))
    return means.groupBy(*by).agg(F.avg("m").alias("mean"), F.count("*").alias("clusters"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"))


def quantile_type8(values: Column, p: float) -> Column:
    """Median-unbiased quantile of an array: place (n + 1/3) p + 1/3 in the sorted values."""
    ordered = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(ordered)
    place = (n + 1 / 3) * p + 1 / 3
    low = F.floor(place).cast("int")
    at = lambda i: F.get(ordered, F.greatest(F.lit(0), F.least(n - 1, i - 1)))
    return at(low) + (place - low) * (at(low + 1) - at(low))


def cdf_distances(rows: DataFrame, by: list[str], value: str, weight_a: Column, weight_b: Column) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein-1 distances of two weighted samples of the same values, by group.

    Rows are reduced to distinct values first; running sums go over those.
    """
    points = rows.groupBy(*by, value).agg(F.sum(weight_a).alias("a"), F.sum(weight_b).alias("b"))
    whole, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(value)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.abs(F.sum("a").over(running) / F.sum("a").over(whole) - F.sum("b").over(running) / F.sum("b").over(whole))
    steps = points.select(*by, gap.alias("gap"), (F.lead(value).over(w) - F.col(value)).alias("width"))
    return steps.groupBy(*by).agg(F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * F.col("width")), F.lit(0.0)).alias("wasserstein"))


def concentration(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], order: list[str]) -> DataFrame:
    """Share of the positive values that the top ceil(n * p) rows hold, one column per entry of ``shares``; at least one row counts."""
    ranked = rows.filter(F.col(value) > 0)
    n = Window.partitionBy(*by)
    w = Window.partitionBy(*by).orderBy(F.desc(value), *order)
    ranked = ranked.withColumns({"__n": F.count("*").over(n), "__r": F.row_number().over(w)})
    top = [F.sum(F.when(F.col("__r") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * p)), F.col(value))) for p in shares.values()]
    return ranked.groupBy(*by).agg(*[ratio(t, F.sum(value)).alias(name) for name, t in zip(shares, top, strict=True)])


def scores(outcome: Column, p: Column) -> dict[str, Column]:
    """Aggregates that judge probabilities: Brier score, log loss, calibration gap."""
    y = outcome.cast("double")
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return {"brier": F.avg((y - p) * (y - p)), "log_loss": F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))), "calibration": F.avg(p - y)}


def envelope(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Least and greatest value of each group and which row has it; ties go to the smaller name."""
    out = rows.groupBy(*by).agg(F.min(F.struct(value, name)).alias("low"), F.min_by(name, F.struct((-F.col(value)).alias("v"), name)).alias("max_at"), F.max(value).alias("most"))
    return out.select(*by, F.col(f"low.{value}").alias("least"), F.col(f"low.{name}").alias("min_at"), F.col("most").alias("greatest"), "max_at")


def compressed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows with their ``weight``: what an iteration should read instead of the rows."""
    return rows.groupBy(*columns).agg(F.count("*").alias("weight"))


def with_total(rows: DataFrame, by: str, aggregates: list[Column], label: str = "combined", keys: list[str] | None = None) -> DataFrame:
    """Groups by ``by`` and their total, in one pass of grouping sets."""
    keys = keys or []
    out = rows.groupingSets([[*map(F.col, keys), F.col(by)], [*map(F.col, keys)]], *keys, by).agg(F.grouping(by).alias("__g"), *aggregates)
    return out.withColumn(by, F.when(F.col("__g") == 1, label).otherwise(F.col(by))).drop("__g")
