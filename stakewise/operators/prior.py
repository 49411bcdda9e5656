"""Empirical priors of a margin: binned histograms by context shrunk to all contexts, posteriors and scores.

Bins of a prior are few (a range over a width), so priors are small tables; rows of data meet them by equi-joins on
context, and cross only with bins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakewise.functions.scalar import margin_bin, normal_cdf


def binned_prior(rows: DataFrame, context: str, margin: str, width: float, strength: float = 100.0) -> DataFrame:
    """(context, bin, weight): (n in context and bin + strength * overall share) / (n in context + strength).

    Every context has every bin that occurs anywhere, so weights sum to one.
    """
    cells = rows.groupBy(context, margin_bin(F.col(margin), width).alias("bin")).agg(F.count("*").alias("n"))
    bins = cells.groupBy("bin").agg(F.sum("n").alias("n_bin"))
    contexts = cells.groupBy(context).agg(F.sum("n").alias("n_context"))
    total = bins.agg(F.sum("n_bin").alias("total"))
    grid = contexts.crossJoin(bins).crossJoin(F.broadcast(total)).join(cells, [context, "bin"], "left")
    share = F.col("n_bin") / F.col("total")
    return grid.select(context, "bin", ((F.coalesce("n", F.lit(0)) + strength * share) / (F.col("n_context") + strength)).alias("weight"))


def context_weights(rows: DataFrame, context: str, components: list[str], strength: float = 100.0) -> DataFrame:
    """Mixture weights by context from soft counts: (sum + strength * overall share) / (n + strength)."""
    total = rows.agg(*[F.avg(c).alias(f"all_{c}") for c in components])
    sums = rows.groupBy(context).agg(*[F.sum(c).alias(c) for c in components], F.count("*").alias("n"))
    joined = sums.crossJoin(F.broadcast(total))
    return joined.select(context, *[((F.col(c) + strength * F.col(f"all_{c}")) / (F.col("n") + strength)).alias(c) for c in components])


def wrong_rate(prior: DataFrame, context: str) -> DataFrame:
    """Weight of the bins beyond zero: the chance of a wrong call before any signal."""
    return prior.groupBy(context).agg(F.sum(F.when(F.col("bin") >= 0, F.col("weight")).otherwise(0.0)).alias("wrong_rate"))


def posterior(signals: DataFrame, prior: DataFrame, context: str, signal: str, width: float, sigma: float, keys: list[str]) -> DataFrame:
    """q = P(margin > 0 | signal) for each row of ``signals``, by Bayes over the context's bins at their centres.

    Without noise the signal decides; with infinite noise the prior does.
    """
    if sigma == 0:
        return signals.withColumn("q", (F.col(signal) > 0).cast("double"))
    if sigma == float("inf"):
        return signals.join(wrong_rate(prior, context).withColumnRenamed("wrong_rate", "q"), context, "left")
    z = (F.col(signal) - (F.col("bin") + 0.5) * width) / sigma
    mass = F.col("weight") * F.exp(-z * z / 2)
    joined = signals.join(prior, context)
    return joined.groupBy(*keys, context, signal).agg((F.sum(F.when(F.col("bin") >= 0, mass).otherwise(0.0)) / F.sum(mass)).alias("q"))


def upper_tail(thresholds: DataFrame, prior: DataFrame, context: str, threshold: str, width: float, sigma: float, keys: list[str]) -> DataFrame:
    """Chance that the signal passes each threshold (``action``), and that it does so on a wrong call (``success``)."""
    centre = (F.col("bin") + 0.5) * width
    over = (centre > F.col(threshold)).cast("double") if sigma == 0 else normal_cdf((centre - F.col(threshold)) / sigma)
    mass = F.col("weight") * over
    joined = thresholds.join(prior, context)
    return joined.groupBy(*keys, context, threshold).agg(F.sum(mass).alias("action"), F.sum(F.when(F.col("bin") >= 0, mass).otherwise(0.0)).alias("success"))


def crps(observations: DataFrame, prior: DataFrame, context: str, value: str, width: float, keys: list[str]) -> DataFrame:
    """Continuous ranked probability score of the binned distribution: E|X - y| - E|X - X'| / 2.

    The second term is one number a context, from prefix sums over its bins.
    """
    w = Window.partitionBy(context).orderBy("bin")
    below = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = (F.lead("bin").over(w) - F.col("bin")) * width
    cumulative = prior.select(context, F.sum("weight").over(below).alias("f"), gap.alias("gap"))
    spread = cumulative.groupBy(context).agg(F.sum(F.col("f") * (1 - F.col("f")) * F.coalesce("gap", F.lit(0.0))).alias("spread"))
    joined = observations.join(prior, context)
    first = joined.groupBy(*keys, context, value).agg(F.sum(F.col("weight") * F.abs((F.col("bin") + 0.5) * width - F.col(value))).alias("d"))
    return first.join(spread, context).select(*keys, context, value, (F.col("d") - F.col("spread")).alias("crps"))


def log_density(observations: DataFrame, prior: DataFrame, context: str, value: str, width: float) -> DataFrame:
    """Log of the histogram's density at each value; null outside its bins."""
    keyed = observations.withColumn("bin", margin_bin(F.col(value), width))
    return keyed.join(prior, [context, "bin"], "left").withColumn("log_density", F.log(F.col("weight") / width)).drop("weight")


def largest_within_one_error(rows: DataFrame, candidate: str, score: str, cluster: str) -> DataFrame:
    """The largest candidate whose mean score is within one clustered error (of the best one) of the best, least, mean."""
    from stakewise.operators.stats import sandwich_error

    by = sandwich_error(rows, cluster, score, [candidate])
    best = by.agg(F.min(F.struct("mean", F.col(candidate).alias("c"), "se")).alias("b")).select((F.col("b.mean") + F.col("b.se")).alias("limit"), F.col("b.c").alias("best"))
    return by.crossJoin(F.broadcast(best)).filter(F.col("mean") <= F.col("limit")).groupBy("best").agg(F.max(candidate).alias("selected"))


# Numeric kernels on one small table each: plain numpy, called per (role, sigma, context) in a grouped map.


def signal_lookup(bins: np.ndarray, weights: np.ndarray, width: float, sigma: float, step: float = 0.05, reach: float = 6.0) -> dict[str, np.ndarray]:
    """Grid of signals with q (monotone), and the tails P(signal beyond) and P(signal beyond, wrong call).

    Densities come from a fast convolution of the bin masses with a Gaussian on a grid that divides the bins evenly.
    """
    per_bin = max(1, int(np.ceil(width / step)))
    step = width / per_bin
    pad = int(np.ceil(reach * sigma / step)) + 1
    first, last = int(bins.min()), int(bins.max()) + 1
    mass, wrong = np.zeros((last - first) * per_bin + 2 * pad), np.zeros((last - first) * per_bin + 2 * pad)
    for b, w in zip(bins, weights, strict=True):
        at = pad + (int(b) - first) * per_bin
        mass[at : at + per_bin] += w / per_bin
        if b >= 0:
            wrong[at : at + per_bin] += w / per_bin
    signal = (np.arange(len(mass)) - pad + 0.5) * step + first * width
    size = len(mass) + 2 * pad  # room enough that nothing comes round from the other end
    offsets = np.minimum(np.arange(size), size - np.arange(size)) * step
    kernel = np.exp(-((offsets / sigma) ** 2) / 2)
    kernel /= kernel.sum()
    parts = np.fft.rfft(np.array([mass, wrong]), size, axis=1) * np.fft.rfft(kernel)
    density, joint = np.maximum(np.fft.irfft(parts, size, axis=1)[:, : len(mass)], 0)
    q = np.maximum.accumulate(np.divide(joint, density, out=np.zeros_like(joint), where=density > 1e-9 * density.max()))
    tails = [np.concatenate([[x.sum()], x.sum() - np.cumsum(x)])[:-1] for x in (density, joint)]
    return {"signal": signal, "q": q, "action_tail": tails[0], "success_tail": tails[1]}


def lookup_table(prior: DataFrame, context: str, width: float, sigma: float, step: float = 0.05) -> DataFrame:
    """``signal_lookup`` of every context: one small group each."""
    import pandas as pd

    kind = prior.schema[context].dataType.simpleString()

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({context: key[0]} | signal_lookup(frame["bin"].to_numpy(), frame["weight"].to_numpy(), width, sigma, step))

    return prior.groupBy(context).applyInPandas(build, f"{context} {kind}, signal double, q double, action_tail double, success_tail double")


def interpolated(x: Column, low: Column, high: Column, at_low: Column, at_high: Column) -> Column:
    """Linear between two grid points; the ends hold outside."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return at_low + share * (at_high - at_low)
