"""Models of choice: probit widths by Newton steps on aggregates, threshold bias, choice curves.

``probit`` is the plain likelihood with a ridge on chosen columns, and ``choice_probability`` scores given posterior draws;
``gam`` has smooths and random effects, ``hierarchy`` the sampler.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stakewise.functions.scalar import normal_cdf, normal_density


def _probit(eta: Column) -> tuple[Column, Column, Column]:
    p = F.greatest(F.least(normal_cdf(eta), F.lit(1 - 1e-10)), F.lit(1e-10))
    return p, normal_density(eta), p * (1 - p)


def _logit(eta: Column) -> tuple[Column, Column, Column]:
    p = F.greatest(F.least(1 / (1 + F.exp(-eta)), F.lit(1 - 1e-10)), F.lit(1e-10))
    return p, p * (1 - p), p * (1 - p)


def _log(eta: Column) -> tuple[Column, Column, Column]:
    mean = F.exp(F.least(eta, F.lit(30.0)))
    return mean, mean, mean


#: Mean, slope of the mean, and variance as functions of the linear part.
FAMILIES = {"probit": _probit, "logit": _logit, "poisson": _log}


def glm(rows: DataFrame, outcome: str, features: list[str], family: str = "probit", ridge: float = 1e-6, rounds: int = 30, weight: str | None = None) -> dict:
    """Maximum-likelihood coefficients (with "intercept"), covariance, log-likelihood (less constants) and rounds.

    A scoring round is one aggregation: the sums that make up slope and curvature come to the driver, rows never do.
    The ridge holds back all but the intercept; a large one on indicator columns stands for random effects.
    """
    names = ["intercept", *features]
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    w, y = F.col(weight) if weight else F.lit(1.0), F.col(outcome).cast("double")
    beta, value, size = np.zeros(len(names)), -np.inf, len(names)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    penalty = ridge * np.diag([0.0] + [1.0] * len(features)) + 1e-12 * np.eye(size)
    for done in range(1, rounds + 1):
        eta = sum((c * float(b) for c, b in zip(columns, beta, strict=True)), F.lit(0.0))
        mean, slope, variance = FAMILIES[family](eta)
        likelihood = y * F.log(mean) - mean if family == "poisson" else F.when(y > 0, F.log(mean)).otherwise(F.log(1 - mean))
        marked = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)], (w * slope * (y - mean) / variance).alias("s"), (w * slope * slope / variance).alias("h"), (w * likelihood).alias("l"))
        sums = marked.agg(*[F.sum(F.col("s") * F.col(f"x{i}")) for i in range(size)], *[F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs], F.sum("l")).first()
        if sums[-1] is None:
            raise ValueError("no rows to fit")
        information = np.zeros((size, size))
        for (i, j), x in zip(pairs, sums[size:-1], strict=True):
            information[i, j] = information[j, i] = x
        step = np.linalg.solve(information + penalty, np.array(sums[:size], float) - penalty @ beta)
        beta, last, value = beta + np.clip(step, -5, 5), value, float(sums[-1])
        if np.abs(step).max() < 1e-8 or abs(value - last) < 1e-9 * (1 + abs(value)):
            break
    return {"coefficients": dict(zip(names, beta.tolist(), strict=True)), "covariance": np.linalg.inv(information + penalty), "log_likelihood": value, "rounds": done, "family": family}


def predicted(rows: DataFrame, fit: dict, out: str = "prediction") -> DataFrame:
    """``rows`` with the mean that a ``glm`` gives; features that a row lacks (unseen levels) count as zero."""
    eta = F.lit(float(fit["coefficients"]["intercept"]))
    for name, b in fit["coefficients"].items():
        if name != "intercept" and name in rows.columns:
            eta = eta + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * float(b)
    return rows.withColumn(out, FAMILIES[fit["family"]](eta)[0])


def probit(rows: DataFrame, outcome: str, features: list[str], **options) -> dict:
    return glm(rows, outcome, features, "probit", **options)


def spline_columns(rows: DataFrame, column: str, knots: list[float], prefix: str) -> tuple[DataFrame, list[str]]:
    """Truncated-power cubic columns of a feature, as expressions; for smooth terms of a ``glm``."""
    x = F.col(column).cast("double")
    terms = {f"{prefix}1": x, f"{prefix}2": x * x, f"{prefix}3": x * x * x} | {f"{prefix}k{i}": F.pow(F.greatest(x - k, F.lit(0.0)), 3) for i, k in enumerate(knots)}
    return rows.withColumns(terms), list(terms)


def cross_fitted(rows: DataFrame, group: str, folds: int, outcome: str, features: list[str], family: str = "logit", least_rows: int = 200) -> DataFrame:
    """Held-out predictions by whole-group folds; too few rows or groups give the training mean."""
    from stakewise.operators.resample import dense_folds

    folded = dense_folds(rows, group, folds)
    sizes = {r["fold"]: (r["n"], r["g"]) for r in folded.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct(group).alias("g")).collect()}
    out = None
    for fold in range(1, folds + 1):
        train, test = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        n, g = (sum(x[i] for f, x in sizes.items() if f != fold) for i in (0, 1))
        if n < least_rows or g < folds:
            part = test.crossJoin(F.broadcast(train.agg(F.avg(F.col(outcome).cast("double")).alias("prediction"))))
        else:
            part = predicted(test, glm(train, outcome, features, family))
        out = part if out is None else out.unionByName(part)
    return out


def simulated_choices(rows: DataFrame, players: DataFrame, margin: str, player: str, seed: int) -> DataFrame:
    """Choices drawn from players' (threshold, sigma): a uniform hash of the row against Phi((margin - threshold) / sigma)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    joined = rows.join(players, player)
    return joined.withColumn("challenged", u < normal_cdf((F.col(margin) - F.col("threshold")) / F.col("sigma"))).drop("threshold", "sigma")


def width_and_threshold(fit: dict, margin: str) -> dict:
    """Width 1 / slope and threshold -intercept / slope of a probit in ``margin``, with delta-method errors."""
    names = list(fit["coefficients"])
    a, b = fit["coefficients"]["intercept"], fit["coefficients"][margin]
    i, j = names.index("intercept"), names.index(margin)
    v = fit["covariance"]
    slope_error = np.sqrt(v[j, j])
    g = np.array([-1 / b, a / b**2])
    return {"width": 1 / b, "width_se": slope_error / b**2, "threshold": -a / b, "threshold_se": float(np.sqrt(g @ v[np.ix_([i, j], [i, j])] @ g))}


def threshold_bias(rows: DataFrame, outcome: str, margin: str, threshold: str, width: float, bounds: tuple[float, float] = (-20.0, 20.0), tolerance: float = 1e-4) -> float:
    """Shift of all thresholds that makes the outcomes most likely, by golden section; a look is one aggregation."""

    def loss(bias: float) -> float:
        p = normal_cdf((F.col(margin) - F.col(threshold) - bias) / width)
        q = F.greatest(F.least(p, F.lit(1 - 1e-10)), F.lit(1e-10))
        return rows.agg(F.sum(-F.when(F.col(outcome), F.log(q)).otherwise(F.log(1 - q)))).first()[0] or 0.0

    share = (5**0.5 - 1) / 2
    low, high = bounds
    a, b = high - share * (high - low), low + share * (high - low)
    fa, fb = loss(a), loss(b)
    while high - low > tolerance:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - share * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + share * (high - low)
            fb = loss(b)
    return (low + high) / 2


def choice_probability(rows: DataFrame, draws: DataFrame, margin: str, player: str) -> DataFrame:
    """Mean over posterior draws (player, draw, threshold, log_sigma) of Phi((margin - threshold) / sigma); players
    without draws take the population's, kept under a null player.

    A player's draws travel as one array, some hundred pairs, so rows are never multiplied by draws.
    """
    arrays = draws.groupBy(player).agg(F.collect_list(F.struct("threshold", "log_sigma")).alias("__draws"))
    population = arrays.filter(F.col(player).isNull()).select(F.col("__draws").alias("__all"))
    joined = rows.join(arrays.filter(F.col(player).isNotNull()), player, "left").crossJoin(F.broadcast(population))

    def add(total: Column, d: Column) -> Column:
        return total + normal_cdf((F.col(margin) - d["threshold"]) / F.exp(d["log_sigma"]))

    held = F.coalesce("__draws", "__all")
    return joined.withColumn("probability", F.aggregate(held, F.lit(0.0), add) / F.size(held)).drop("__draws", "__all")


@F.pandas_udf(T.DoubleType())
def exact_normal_cdf(x: pd.Series) -> pd.Series:
    """Phi to full precision, in Arrow batches."""
    from math import erfc

    return pd.Series([0.5 * erfc(-v / 2**0.5) if v == v else None for v in x.to_numpy(float)], dtype="float64")


def mixture(values: np.ndarray, k: int, rounds: int = 500, floor: float = 0.05, ridge: float = 1e-3, tolerance: float = 1e-9, counts: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gaussian mixture by deterministic expectation-maximisation: starts on a grid of quantiles, ends sorted by mean.

    With ``counts``, each value stands for so many rows: Spark counts rows by fine bins, and only the bins come here.
    """
    order = np.argsort(values)
    values, counts = values[order], (np.ones(len(values)) if counts is None else counts.astype(float)[order])
    below = (np.cumsum(counts) - counts / 2) / counts.sum()
    mean = np.quantile(values, (np.arange(k) + 0.5) / k) if (counts == 1).all() else np.interp((np.arange(k) + 0.5) / k, below, values)
    centre = np.average(values, weights=counts)
    sd, weight = np.full(k, max(np.sqrt(np.average((values - centre) ** 2, weights=counts)) / k, floor)), np.full(k, 1 / k)
    last, converged = -np.inf, False
    for _ in range(rounds):
        log = -(((values[:, None] - mean) / sd) ** 2) / 2 - np.log(sd) + np.log(weight) - 0.9189385332046727
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        share = np.exp(log - total[:, None]) * counts[:, None]
        n = share.sum(0) + ridge
        weight, mean = n / n.sum(), (share * values[:, None]).sum(0) / n
        sd = np.maximum(np.sqrt((share * (values[:, None] - mean) ** 2).sum(0) / n), floor)
        value = (total * counts).sum()
        if converged := abs(value - last) <= tolerance * (1 + abs(value)):
            break
        last = value
    order = np.argsort(mean)
    return {"weight": weight[order], "mean": mean[order], "sd": sd[order], "log_likelihood": np.array(value), "converged": np.array(converged)}


def mixture_log_density(values: np.ndarray, parts: dict[str, np.ndarray]) -> np.ndarray:
    log = -(((values[:, None] - parts["mean"]) / parts["sd"]) ** 2) / 2 - np.log(parts["sd"]) + np.log(parts["weight"]) - 0.9189385332046727
    top = log.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(log - top).sum(1))


def nested_mixtures(rows: DataFrame, group: str, fold: str, value: str, most: int, width: float = 0.1) -> DataFrame:
    """Held-out log loss of mixtures of 1 to ``most`` components by group: (k, group, n, loss, converged).

    Rows are counted once by fold, group and bins of ``width``; each fold's mixture is fitted to the other folds' bins.
    What comes to the driver are the bins of each fold, whose number is measured first.
    """
    from stakewise.operators.governance import fetched

    cells = rows.groupBy(fold, group, F.round(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n")).cache()
    bins = fetched(cells.groupBy(fold, "bin").agg(F.sum("n").alias("n")), 1_000_000, "bins of folds")
    out = []
    for f in sorted(bins[fold].unique()):
        train = bins[bins[fold] != f].groupby("bin")["n"].sum()
        at = np.sort(bins["bin"].unique())
        for k in range(1, most + 1):
            parts = mixture(train.index.to_numpy() * width, k, counts=train.to_numpy())
            loss = -mixture_log_density(at * width, parts)
            out += [(int(f), int(b), k, float(x), bool(parts["converged"])) for b, x in zip(at, loss, strict=True)]
    table = rows.sparkSession.createDataFrame(out, f"{fold} int, bin long, k int, loss double, converged boolean")
    scored = cells.join(F.broadcast(table), [fold, "bin"])
    return scored.groupBy("k", group).agg(F.sum("n").alias("n"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"), F.bool_and("converged").alias("converged"))


def mixture_posterior(signal: Column, parts: dict[str, np.ndarray], sigma: float) -> Column:
    """P(margin > 0 | signal) for a Gaussian mixture prior and Gaussian noise, in closed form per component."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for w, m, s in zip(parts["weight"], parts["mean"], parts["sd"], strict=True):
        total = float(np.hypot(s, sigma))
        mass = float(w) / total * normal_density((signal - float(m)) / total)
        mean = (float(m) * sigma**2 + signal * float(s) ** 2) / total**2
        spread = float(s) * sigma / total
        top = top + mass * (normal_cdf(mean / spread) if spread else (mean > 0).cast("double"))
        bottom = bottom + mass
    return F.when(bottom > 0, top / bottom)
