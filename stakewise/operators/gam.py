"""Additive models with penalised smooths, interactions and random effects, fitted over rows that stay on Spark.

A smooth is a cubic B-spline on even knots with squared second differences as its penalty; an interaction is a tensor
product without its margins, with one penalty in each direction; a random effect has one coefficient a level and their
squares as its penalty. Each scoring round is one pass: tasks add up the cross products of their rows under the present
coefficients, few numbers for any number of rows, and Spark adds up the tasks' sums. On those the driver solves for the
coefficients and sets every penalty's strength by restricted maximum likelihood (generalised Fellner-Schall steps).

Sums are over the plain bases, of which a row has few that are not zero. That smooths add up to zero over the rows, and
that the margins of interactions do, is arranged afterwards: by a change of basis on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakewise.functions.kernels import density, phi
from stakewise.operators.governance import CheckFailed, fetched

#: Coefficients of a model at most; the driver holds a square matrix of them.
MOST = 4000
SUMS = "i int, j int, value double"
#: Sums beside the products: square of the working response, deviance, rows, and four for a dispersion.
REST = 7
LOOSEST, STRICTEST = 1e-8, 1e10


@dataclass
class Smooth:
    """``k`` cubic B-splines over [low, high]; values outside count as the nearer end."""

    column: str
    k: int
    low: float
    high: float

    @property
    def size(self) -> int:
        return self.k

    @property
    def columns(self) -> list[str]:
        return [self.column]

    def basis(self, x: dict[str, np.ndarray]) -> np.ndarray:
        step = (self.high - self.low) / (self.k - 3)
        t = (np.clip(x[self.column], self.low, self.high) - self.low) / step
        cell = np.minimum(np.floor(t), self.k - 4).astype(int)
        u = t - cell
        out = np.zeros((len(t), self.k))
        parts = (1 - u) ** 3 / 6, (3 * u**3 - 6 * u**2 + 4) / 6, (-3 * u**3 + 3 * u**2 + 3 * u + 1) / 6, u**3 / 6
        for m, part in enumerate(parts):
            out[np.arange(len(t)), cell + m] = part
        return out

    def change(self, sums: np.ndarray) -> np.ndarray:
        """Columns that span the coefficients under which the smooth adds up to zero, given the bases' ``sums``."""
        return np.linalg.qr(sums[:, None], mode="complete")[0][:, 1:]

    def penalties(self) -> list[np.ndarray]:
        d = np.diff(np.eye(self.k), 2, axis=0)
        return [d.T @ d]


@dataclass
class Tensor:
    """Products of the bases of two smooths, without what either does alone."""

    one: Smooth
    two: Smooth

    @property
    def size(self) -> int:
        return self.one.k * self.two.k

    @property
    def columns(self) -> list[str]:
        return [self.one.column, self.two.column]

    def basis(self, x: dict[str, np.ndarray]) -> np.ndarray:
        a, b = self.one.basis(x), self.two.basis(x)
        return (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)

    def change(self, sums: np.ndarray) -> np.ndarray:
        # bases of either margin add up to one, so these are the margins' own sums
        table = sums.reshape(self.one.k, self.two.k)
        return np.kron(self.one.change(table.sum(1)), self.two.change(table.sum(0)))

    def penalties(self) -> list[np.ndarray]:
        return [np.kron(self.one.penalties()[0], np.eye(self.two.k)), np.kron(np.eye(self.one.k), self.two.penalties()[0])]


@dataclass
class Linear:
    column: str
    size: int = 1

    @property
    def columns(self) -> list[str]:
        return [self.column]

    def basis(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.asarray(x[self.column], float)[:, None]

    def change(self, sums: np.ndarray) -> np.ndarray:
        return np.eye(1)

    def penalties(self) -> list[np.ndarray]:
        return []


@dataclass
class Levels:
    """One coefficient a level; fixed ones leave the first level out, random ones are penalised. Other values count nothing."""

    column: str
    levels: list[str]
    random: bool = False

    @property
    def size(self) -> int:
        return len(self.levels)

    @property
    def columns(self) -> list[str]:
        return [self.column]

    def places(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """The level of each row; -1 for other values. Levels are in sorted order."""
        if not self.levels:
            return np.full(len(x[self.column]), -1)
        # each different value is looked up once
        codes, found = pd.factorize(np.asarray(x[self.column], object))
        place = {level: at for at, level in enumerate(self.levels)}
        places = np.array([*(place.get(str(v), -1) for v in found), place.get("", -1)])
        return places[codes]

    def basis(self, x: dict[str, np.ndarray]) -> np.ndarray:
        at = self.places(x)
        out = np.zeros((len(at), self.size))
        out[np.flatnonzero(at >= 0), at[at >= 0]] = 1
        return out

    def change(self, sums: np.ndarray) -> np.ndarray:
        return np.eye(self.size) if self.random else np.eye(self.size)[:, 1:]

    def penalties(self) -> list[np.ndarray]:
        return [np.eye(self.size)] if self.random else []


Term = Smooth | Tensor | Linear | Levels


@dataclass
class Model:
    """Terms, and after the fit the coefficients of their plain bases (the intercept first), strengths and degrees of freedom."""

    terms: list[Term]
    coefficients: np.ndarray | None = None
    strengths: list[float] = field(default_factory=list)
    freedom: list[float] = field(default_factory=list)
    deviance: float = float("nan")
    dispersion: float = 1.0
    rounds: int = 0
    converged: bool = False

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for t in self.terms for c in t.columns))

    @property
    def dense(self) -> list[Term]:
        return [t for t in self.terms if not (isinstance(t, Levels) and t.random)]

    @property
    def effects(self) -> list[Levels]:
        return [t for t in self.terms if isinstance(t, Levels) and t.random]

    def spans(self) -> list[tuple[Term, int, int]]:
        """Each term with its first coefficient and the one behind its last; random effects come last."""
        at, out = 1, []
        for t in [*self.dense, *self.effects]:
            out.append((t, at, at + t.size))
            at += t.size
        return out

    @property
    def size(self) -> int:
        return 1 + sum(t.size for t in self.terms)

    def linear(self, x: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Linear predictor of rows, their dense design, and their places among the random levels."""
        design = np.concatenate([np.ones((n, 1)), *[t.basis(x) for t in self.dense]], 1)
        places = [t.places(x) for t in self.effects]
        beta = np.zeros(self.size) if self.coefficients is None else self.coefficients
        eta = design @ beta[: design.shape[1]]
        for (_, low, _), at in zip(self.spans()[len(self.dense) :], places, strict=True):
            eta = eta + np.where(at >= 0, beta[low + at], 0)
        return eta, design, places


def learnt_terms(rows: DataFrame, linear: list[str] = (), smooth: dict[str, int] | None = None, tensor: dict[tuple[str, str], tuple[int, int]] | None = None, fixed: list[str] = (), random: list[str] = ()) -> Model:
    """Ranges and levels of the columns. A smooth of fewer than four values, or of one without spread, is linear, and has
    fewer bases than values; an interaction needs eight values on both sides; levels that are alone are left out."""
    smooth, tensor = smooth or {}, tensor or {}
    numeric = list(dict.fromkeys([*smooth, *(c for pair in tensor for c in pair)]))
    most = max([*smooth.values(), 8], default=8) + 1
    values = {c: rows.select(c).filter(F.col(c).isNotNull()).distinct().limit(most).count() for c in numeric}
    range_of = {}
    if numeric:
        r = rows.agg(*[f(F.col(c).cast("double")) for c in numeric for f in (F.min, F.max, F.stddev_pop)]).first()
        range_of = {c: (r[3 * i], r[3 * i + 1], r[3 * i + 2]) for i, c in enumerate(numeric)}
    terms: list[Term] = [Linear(c) for c in linear]
    for c, k in smooth.items():
        low, high, spread = range_of[c]
        flat = values[c] < 4 or spread is None or spread < 1e-10
        terms.append(Linear(c) if flat or min(k, values[c] - 1) < 4 else Smooth(c, min(k, values[c] - 1), low, high))
    for (a, b), (i, j) in tensor.items():
        if values[a] >= 8 and values[b] >= 8:
            terms.append(Tensor(Smooth(a, i, *range_of[a][:2]), Smooth(b, j, *range_of[b][:2])))
    for c in [*fixed, *random]:
        found = fetched(rows.select(F.col(c).cast("string").alias(c)).filter(F.col(c).isNotNull()).distinct(), MOST, f"levels of {c}")[c]
        if len(found) > 1:
            # in the order in which numpy compares, by code points
            terms.append(Levels(c, sorted(found), c in random))
    model = Model(terms)
    if model.size > MOST:
        raise CheckFailed(f"{model.size} coefficients are more than {MOST}")
    return model


def working(eta: np.ndarray, y: np.ndarray, family: str, dispersion: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, working responses and deviances of rows at their linear predictors. Rare tails keep a little weight.
    ``negative_binomial`` has the variance mean + mean^2 / ``dispersion``."""
    if family == "unit":
        return np.ones(len(y)), y, (y - eta) ** 2
    if family == "probit":
        eta = np.clip(eta, -6, 6)
        p, slope = phi(eta), density(eta)
        p = np.clip(p, 1e-10, 1 - 1e-10)
        return slope**2 / (p * (1 - p)), eta + (y - p) / slope, -2 * (y * np.log(p) + (1 - y) * np.log1p(-p))
    if family == "logit":
        eta = np.clip(eta, -20, 20)
        p = 1 / (1 + np.exp(-eta))
        w = p * (1 - p)
        return w, eta + (y - p) / w, -2 * (y * np.log(p) + (1 - y) * np.log1p(-p))
    if family == "negative_binomial":
        eta = np.clip(eta, -20, 20)
        mean = np.exp(eta)
        part = np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mean), 0)
        return mean / (1 + mean / dispersion), eta + (y - mean) / mean, 2 * (part - (y + dispersion) * np.log((y + dispersion) / (mean + dispersion)))
    raise ValueError(f"no family {family}")


class Sums:
    """Cross products of the rows seen so far: of the dense design, of random levels with it, and of levels with levels."""

    def __init__(self, model: Model):
        self.model = model
        self.width = 1 + sum(t.size for t in model.dense)
        self.low = [low for _, low, _ in model.spans()[len(model.dense) :]]
        self.dense = np.zeros((self.width, self.width))
        self.response = np.zeros(model.size)
        self.mixed = [np.zeros((t.size, self.width)) for t in model.effects]
        # at most MOST ** 2 / 4 cells in a table
        self.crossed = {(e, f): np.zeros(t.size * u.size) for e, t in enumerate(model.effects) for f, u in enumerate(model.effects) if e < f}
        self.rest = np.zeros(REST)

    def add(self, x: dict[str, np.ndarray], y: np.ndarray, family: str, dispersion: float) -> None:
        eta, design, places = self.model.linear(x, len(y))
        w, z, deviance = working(eta, y, family, dispersion)
        weighted = design * w[:, None]
        self.dense += design.T @ weighted
        self.response[: self.width] += weighted.T @ z
        self.rest[:3] += (w * z * z).sum(), deviance.sum(), len(y)
        if family == "negative_binomial":
            above = np.exp(np.clip(eta, -20, 20)) + dispersion
            self.rest[3:] += np.log(above).sum(), ((y + dispersion) / above).sum(), (1 / above).sum(), ((y + dispersion) / above**2).sum()
        for e, at in enumerate(places):
            fine = at >= 0
            cells = (at[fine, None] * self.width + np.arange(self.width)).ravel()
            self.mixed[e] += np.bincount(cells, weighted[fine].ravel(), self.mixed[e].size).reshape(self.mixed[e].shape)
            self.response[self.low[e] : self.low[e] + self.model.effects[e].size] += np.bincount(at[fine], (w * z)[fine], self.model.effects[e].size)
            for f in range(e + 1, len(places)):
                both = fine & (places[f] >= 0)
                key, inverse = np.unique(at[both] * self.model.effects[f].size + places[f][both], return_inverse=True)
                self.crossed[e, f][key] += np.bincount(inverse, w[both], len(key))

    def rows(self) -> pa.RecordBatch:
        """(i, j, value) of all sums that are not zero; j = -1 marks the response, i = -1 the rest."""
        i, j = np.nonzero(np.triu(self.dense))
        parts = [(i, j, self.dense[i, j])]
        for e, table in enumerate(self.mixed):
            a, b = np.nonzero(table)
            parts.append((b, self.low[e] + a, table[a, b]))
            # a level meets itself only: its weights are its sums with the intercept
            own = np.flatnonzero(table[:, 0])
            parts.append((self.low[e] + own, self.low[e] + own, table[own, 0]))
        for (e, f), held in self.crossed.items():
            key, wide = np.flatnonzero(held), self.model.effects[f].size
            parts.append((self.low[e] + key // wide, self.low[f] + key % wide, held[key]))
        filled = np.flatnonzero(self.response)
        parts.append((filled, np.full(len(filled), -1), self.response[filled]))
        kept = np.flatnonzero((np.arange(REST) < 3) | (self.rest != 0))
        parts.append((np.full(len(kept), -1), kept, self.rest[kept]))
        i, j, value = (np.concatenate([np.asarray(p[c]) for p in parts]) for c in range(3))
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(value.astype(float))], names=["i", "j", "value"])


def design_sums(rows: DataFrame, outcome: str, model: Model, family: str = "unit", dispersion: float = 1.0) -> DataFrame:
    """(i, j, value): the weighted cross products of the plain bases under the model's coefficients, upper triangle, with
    (i, -1) for those with the working response and (-1, 0..2) for its square, the deviance and the number of rows, and more
    for a dispersion. Rows
    that lack a value or the outcome are left out; a missing level counts nothing."""
    numbers = [c for t in model.terms if not isinstance(t, Levels) for c in t.columns]
    taken = rows.select(*[(F.col(c).cast("double") if c in numbers else F.col(c).cast("string")).alias(c) for c in model.columns], F.col(outcome).cast("double").alias("__y"))

    def added(batches):
        sums = Sums(model)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = {c: part[c].to_numpy(zero_copy_only=False) for c in model.columns}
                sums.add(x, part["__y"].to_numpy(zero_copy_only=False).astype(float), family, dispersion)
        yield sums.rows()

    found = taken.dropna(subset=[*dict.fromkeys(numbers), "__y"]).mapInArrow(added, SUMS)
    return found.groupBy("i", "j").agg(F.sum("value").alias("value"))


def fetched_sums(rows: DataFrame, outcome: str, model: Model, family: str, dispersion: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross products, their responses and the rest as arrays."""
    got = fetched(design_sums(rows, outcome, model, family, dispersion), MOST * (MOST + 3), "sums")
    i, j, value = got["i"].to_numpy(), got["j"].to_numpy(), got["value"].to_numpy()
    gram, response, rest = np.zeros((model.size, model.size)), np.zeros(model.size), np.zeros(REST)
    upper = (i >= 0) & (j >= 0)
    gram[i[upper], j[upper]] = value[upper]
    gram[j[upper], i[upper]] = value[upper]
    response[i[j < 0]] = value[j < 0]
    rest[j[i < 0]] = value[i < 0]
    return gram, response, rest


def changed_basis(model: Model, sums: np.ndarray) -> np.ndarray:
    """From constrained to plain coefficients; ``sums`` are those of the plain bases over the rows."""
    blocks, out, at = [np.eye(1)], None, 0
    blocks += [t.change(sums[low:high]) for t, low, high in model.spans()]
    out = np.zeros((model.size, sum(b.shape[1] for b in blocks)))
    row = 0
    for b in blocks:
        out[row : row + b.shape[0], at : at + b.shape[1]] = b
        row, at = row + b.shape[0], at + b.shape[1]
    return out


def penalties_of(model: Model, change: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each penalty in constrained coefficients: where it stands, its matrix, scaled to a largest eigenvalue of 1, and its
    eigenvalues in a basis that the penalties of the term share (those of an interaction commute)."""
    out = []
    for t, low, high in model.spans():
        own = np.flatnonzero(np.abs(change[low:high]).sum(0) > 0)
        found = [change[low:high][:, own].T @ s @ change[low:high][:, own] for s in t.penalties()]
        found = [m / np.linalg.eigvalsh(m)[-1] for m in found]
        if found:
            basis = np.linalg.eigh(sum(m * 0.7**n for n, m in enumerate(found)))[1]
            for m in found:
                spectrum = np.einsum("ij,ik,kj->j", basis, m, basis, optimize=True)
                out.append((own, m, np.where(spectrum > 1e-9, spectrum, 0)))
    return out


def settled_strengths(gram: np.ndarray, response: np.ndarray, penalties: list, strengths: np.ndarray, rounds: int = 20, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients and penalties' strengths of a weighted linear fit of known scale, and the inverse of its curvature.

    A step multiplies a strength by (what its penalty frees a priori less what it leaves a posteriori) over the penalty's
    present size; strengths rest where the restricted likelihood has no slope.
    """
    size = len(gram)
    for _ in range(rounds):
        total = np.zeros((size, size))
        for (own, s, _), x in zip(penalties, strengths, strict=True):
            total[np.ix_(own, own)] += x * s
        inverse = np.linalg.inv(gram + total + 1e-10 * np.eye(size))
        beta = inverse @ response
        new = strengths.copy()
        shared = [sum(x * e for (o, _, e), x in zip(penalties, strengths, strict=True) if o[0] == own[0]) for own, *_ in penalties]
        for n, (own, s, spectrum) in enumerate(penalties):
            some = shared[n] > 0
            free = (spectrum[some] / shared[n][some]).sum() - (inverse[np.ix_(own, own)] * s).sum()
            large = beta[own] @ s @ beta[own]
            new[n] = np.clip(strengths[n] * np.clip(max(free, 1e-12) / max(large, 1e-12), 1e-3, 1e3), LOOSEST, STRICTEST)
        moved = np.abs(np.log(new / strengths)).max(initial=0)
        strengths = new
        if moved < tolerance:
            break
    return beta, strengths, inverse


def exceeding(rows: DataFrame, outcome: str) -> np.ndarray:
    """How many rows have a count above 0, 1, 2 and so on, from the counts of counts."""
    counts = fetched(rows.filter(F.col(outcome).isNotNull()).groupBy(F.col(outcome).cast("long").alias("y")).agg(F.count("*").alias("n")), 1_000_000, "different counts")
    if (counts["y"] < 0).any():
        raise CheckFailed("a count is negative")
    n = np.zeros(int(counts["y"].max() if len(counts) else 0) + 1)
    n[counts["y"].to_numpy()] = counts["n"]
    return n.sum() - np.cumsum(n)[:-1]


def dispersion_step(dispersion: float, above: np.ndarray, rest: np.ndarray) -> float:
    """One Newton step for the log of a negative-binomial dispersion, at the means that ``rest`` was summed at.

    A digamma at y + dispersion less that at the dispersion is the sum of 1 / (dispersion + k) over k below y, so the rows'
    digammas come from the counts of counts.
    """
    k = dispersion + np.arange(len(above))
    n, logs, ratios, inverses, squares = rest[2:]
    slope = (above / k).sum() + n * np.log(dispersion) + n - logs - ratios
    curve = -(above / k**2).sum() + n / dispersion - 2 * inverses + squares
    # in the log: d/dt = x d/dx, and a step against the slope where the curve isn't concave
    first, second = dispersion * slope, dispersion**2 * curve + dispersion * slope
    step = -first / second if second < 0 else np.sign(first)
    return float(np.clip(dispersion * np.exp(np.clip(step, -1.5, 1.5)), 1e-3, 1e7))


def fitted(rows: DataFrame, outcome: str, model: Model, family: str = "probit", rounds: int = 40, tolerance: float = 1e-8, dispersion: float = 1.0, learn_dispersion: bool = False) -> Model:
    """``model`` with coefficients, by scoring rounds of one pass each until they or the deviance rest. With
    ``learn_dispersion`` a round also takes a step for the dispersion of a negative binomial, from the same pass."""
    plain, *_ = fetched_sums(rows, outcome, Model(model.terms), "unit")
    if not plain[0, 0]:
        raise ValueError("no rows to fit")
    change = changed_basis(model, plain[0])
    penalties = penalties_of(model, change)
    above = exceeding(rows, outcome) if learn_dispersion else None
    strengths, last = np.ones(len(penalties)), np.inf
    model = Model(model.terms, dispersion=dispersion)
    for model.rounds in range(1, rounds + 1):
        gram, response, rest = fetched_sums(rows, outcome, model, family, model.dispersion)
        spread = dispersion_step(model.dispersion, above, rest) if learn_dispersion and model.rounds > 1 else model.dispersion
        still = abs(np.log(spread / model.dispersion)) < 1e-6 or spread in (1e-3, 1e7)
        beta, strengths, inverse = settled_strengths(change.T @ gram @ change, change.T @ response, penalties, strengths)
        moved = change @ beta - (0 if model.coefficients is None else model.coefficients)
        model.coefficients, model.dispersion = change @ beta, spread
        model.deviance = float(rest[1])
        model.converged = bool(model.rounds > 1 + learn_dispersion and still and (np.abs(moved).max() < tolerance or abs(model.deviance - last) < tolerance * (1 + abs(last))))
        if model.converged:
            break
        last = model.deviance
    model.strengths = strengths.tolist()
    share = np.diag(inverse @ (change.T @ gram @ change))
    model.freedom = [float(share[np.abs(change[low:high]).sum(0) > 0].sum()) for _, low, high in model.spans()]
    return model


def effects(model: Model) -> list[tuple[str, str, float]]:
    """(term, level, coefficient) of the intercept, linear terms and levels."""
    out = [("intercept", "", float(model.coefficients[0]))]
    for t, low, high in model.spans():
        if isinstance(t, Linear):
            out.append((t.column, "", float(model.coefficients[low])))
        elif isinstance(t, Levels):
            out += [(t.column, level, float(b)) for level, b in zip(t.levels, model.coefficients[low:high], strict=True)]
    return out


def scored(rows: DataFrame, model: Model, out: str = "linear") -> DataFrame:
    """``rows`` with the model's linear predictor; levels that it hasn't seen count nothing, nor do missing ones. Null where a
    number is missing."""
    numbers = [c for t in model.terms if not isinstance(t, Levels) for c in t.columns]
    inputs = [(F.col(c).cast("double") if c in numbers else F.col(c).cast("string")) for c in model.columns]

    @F.pandas_udf("double")
    def linear(*series: pd.Series) -> pd.Series:
        x = {c: s.to_numpy() for c, s in zip(model.columns, series, strict=True)}
        known = np.ones(len(series[0]), bool)
        for c in dict.fromkeys(numbers):
            known &= ~pd.isna(x[c])
        eta = model.linear({c: v[known].astype(float) if c in numbers else v[known] for c, v in x.items()}, int(known.sum()))[0]
        whole = np.full(len(known), np.nan)
        whole[known] = eta
        return pd.Series(whole).astype(object).where(known, None)

    return rows.withColumn(out, linear(*inputs) if inputs else F.lit(float(model.coefficients[0])))


def log_loss(rows: DataFrame, outcome: str, linear: list[str], by: list[str]) -> DataFrame:
    """By ``by``: the number of rows, and the mean log loss of each probit predictor."""
    from stakewise.functions.scalar import normal_cdf

    def loss(c: str):
        p = F.greatest(F.least(normal_cdf(F.col(c)), F.lit(1 - 1e-12)), F.lit(1e-12))
        return F.avg(-F.when(F.col(outcome) > 0, F.log(p)).otherwise(F.log(1 - p))).alias(f"{c}_log_loss")

    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *[loss(c) for c in linear])
