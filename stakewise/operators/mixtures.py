"""Gaussian mixtures of all folds and sizes at once: Spark sums, the driver holds the components only.

Rows are counted once by bins. A round of expectation-maximisation is one aggregation over (fold, bin) counts: the
densities of all models are column expressions, their sums by component are the only rows that leave the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LOG_TAU = 0.9189385332046727
#: Most components over all folds and sizes: the models travel with the tasks, their sums come back.
MOST_COMPONENTS = 10_000
MODEL = "f int, k int, component int, weight double, mean double, sd double"
PARTS = "f int, k int, parts array<struct<weight: double, mean: double, sd: double>>"


def training_counts(rows: DataFrame, fold: str, value: str, width: float) -> DataFrame:
    """(f, v, n): for each fold ``f`` the rows of the other folds, counted by the lower ends ``v`` of bins of ``width``.

    Rows without a fold, or whose value is null or not finite, take no part.
    """
    x = F.col(value).cast("double")
    known = rows.filter(F.col(fold).isNotNull() & x.isNotNull() & (F.abs(x) < math.inf))
    cells = known.groupBy(F.col(fold).cast("int").alias("fold"), (F.floor(x / width) * width).alias("v")).agg(F.count("*").alias("n"))
    folds = sorted(r[0] for r in cells.select("fold").distinct().limit(MOST_COMPONENTS + 1).collect())
    if len(folds) > MOST_COMPONENTS:
        raise ValueError(f"more than {MOST_COMPONENTS} folds")
    others = F.explode(F.filter(F.lit(folds) if folds else F.array().cast("array<int>"), lambda f: f != F.col("fold")))
    return cells.select(others.alias("f"), "v", "n").groupBy("f", "v").agg(F.sum("n").alias("n"))


def starts(counts: DataFrame, most: int, floor: float) -> DataFrame:
    """``MODEL`` rows to start from: components at even quantiles of each fold's bins, with even weights."""
    bins = Window.partitionBy("f").orderBy("v")
    whole = Window.partitionBy("f")
    below = (F.sum("n").over(bins) - F.col("n") / 2) / F.sum("n").over(whole)
    placed = counts.select("f", "v", "n", below.alias("below")).withColumns({"v0": F.lag("v").over(bins), "below0": F.lag("below").over(bins)})
    wanted = [(k, i, (i + 0.5) / k) for k in range(1, most + 1) for i in range(k)]

    def quantile(q: float) -> Column:
        share = (F.lit(q) - F.col("below0")) / (F.col("below") - F.col("below0"))
        inside = F.when(F.col("below0").isNull(), F.col("v")).otherwise(F.col("v0") + share * (F.col("v") - F.col("v0")))
        return F.coalesce(F.max(F.when((F.coalesce("below0", F.lit(-1.0)) < q) & (F.col("below") >= q), inside)), F.max("v"))

    n, centre = F.sum("n"), F.sum(F.col("v") * F.col("n")) / F.sum("n")
    moments = counts.groupBy("f").agg(n.alias("rows"), centre.alias("centre"))
    spread = counts.join(moments, "f").groupBy("f").agg(F.sqrt(F.sum((F.col("v") - F.col("centre")) ** 2 * F.col("n")) / F.max("rows")).alias("spread"))
    means = placed.groupBy("f").agg(F.array(*[quantile(q) for _, _, q in wanted]).alias("means")).join(spread, "f")
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("component"), F.lit(1 / k).alias("weight"), F.col("means")[j].alias("mean")) for j, (k, i, _) in enumerate(wanted)])
    return means.select("f", "spread", F.explode(parts).alias("p")).select("f", "p.k", "p.component", "p.weight", "p.mean", F.greatest(F.col("spread") / F.col("p.k"), F.lit(floor)).alias("sd"))


def densities(counts: DataFrame, models: DataFrame) -> DataFrame:
    """(f, v, n, k, parts, logs, total) of ``counts`` under every one of ``models`` (f, k, parts) of their fold: the logs of
    the parts' weighted densities at ``v``, and the log of the densities' sum."""
    joined = counts.join(F.broadcast(models), "f")
    log = F.transform("parts", lambda p: -(((F.col("v") - p["mean"]) / p["sd"]) ** 2) / 2 - F.log(p["sd"]) + F.log(p["weight"]) - HALF_LOG_TAU)
    logs = joined.select("*", log.alias("logs")).withColumn("top", F.array_max("logs"))
    return logs.withColumn("total", F.col("top") + F.log(F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))).drop("top")


def mixtures(rows: DataFrame, fold: str, value: str, most: int, width: float = 0.1, rounds: int = 500, floor: float = 0.05, ridge: float = 1e-3, tolerance: float = 1e-9) -> DataFrame:
    """Mixtures of 1 to ``most`` components for each fold, fitted to the other folds: (f, k, component, weight, mean,
    sd, log_likelihood, converged), components by mean.

    A model whose log likelihood moves by less than ``tolerance`` of itself is left as it is; the others go on, at most
    ``rounds`` times. The log likelihood is that before the last step. Equal rows, and bins of one value, are no special
    case: no width falls below ``floor``. Without rows there are no models.
    """
    from stakewise.operators.governance import fetched

    spark = rows.sparkSession
    counts = training_counts(rows, fold, value, width).cache()
    found = {}
    for r in fetched(starts(counts, most, floor), MOST_COMPONENTS, "components").itertuples(index=False):
        found[r.f, r.k, r.component] = (r.weight, r.mean, r.sd)
    value_of, done = {}, set()
    for _ in range(rounds):
        open_ = [(int(f), int(k), [tuple(map(float, found[f, k, i])) for i in range(k)]) for f, k in sorted({m[:2] for m in found} - done)]
        if not open_:
            break
        scored = densities(counts, spark.createDataFrame(open_, PARTS))
        each = scored.select("f", "k", "v", "n", "total", F.posexplode(F.arrays_zip("parts", "logs"))).select("f", "k", "n", "total", F.col("pos").alias("component"), (F.exp(F.col("col.logs") - F.col("total")) * F.col("n")).alias("share"), (F.col("v") - F.col("col.parts.mean")).alias("off"))
        sums = each.groupBy("f", "k", "component").agg(F.sum("share").alias("s0"), F.sum(F.col("share") * F.col("off")).alias("s1"), F.sum(F.col("share") * F.col("off") ** 2).alias("s2"), F.sum(F.col("total") * F.col("n")).alias("value"))
        stepped: dict[tuple, list] = {}
        for r in sums.collect():
            stepped.setdefault((r.f, r.k), []).append(r)
        for (f, k), parts in stepped.items():
            mass = sum(r.s0 + ridge for r in parts)
            for r in parts:
                n, old = r.s0 + ridge, found[f, k, r.component][1]
                mean = (r.s1 + old * r.s0) / n
                around = max(0.0, r.s2 - 2 * (mean - old) * r.s1 + (mean - old) ** 2 * r.s0)
                found[f, k, r.component] = (n / mass, mean, max(math.sqrt(around / n), floor))
            now, last = parts[0].value, value_of.get((f, k), -math.inf)
            value_of[f, k] = now
            if abs(now - last) <= tolerance * (1 + abs(now)):
                done.add((f, k))
    counts.unpersist()
    out = []
    for f, k in sorted({m[:2] for m in found}):
        parts = sorted((found[f, k, i] for i in range(k)), key=lambda p: p[1])
        out += [(int(f), int(k), i, *map(float, p), value_of.get((f, k)), (f, k) in done) for i, p in enumerate(parts)]
    return spark.createDataFrame(out, MODEL + ", log_likelihood double, converged boolean")
