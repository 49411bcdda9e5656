"""Additive models against dense fits."""

import numpy as np
import pandas as pd
import pytest

from stakewise.functions.kernels import phi
from stakewise.operators import gam


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(2)
    n = 4000
    x, z, g, h = rng.uniform(-2, 3, n), rng.uniform(0, 1, n), rng.integers(0, 12, n), rng.integers(0, 8, n)
    effect = rng.normal(0, 0.4, 12)
    eta = np.sin(2 * x) + 0.8 * x * (z - 0.5) + effect[g] - 0.3 + 0.2 * (h % 3 == 0)
    y = (rng.random(n) < phi(eta)).astype(int)
    return pd.DataFrame({"x": x, "z": z, "g": g.astype(str), "h": h.astype(str), "f": np.where(h % 3 == 0, "a", "b"), "y": y, "eta": eta})


def terms():
    return [gam.Smooth("x", 10, -2.0, 3.0), gam.Smooth("z", 6, 0.0, 1.0), gam.Tensor(gam.Smooth("x", 6, -2.0, 3.0), gam.Smooth("z", 5, 0.0, 1.0)), gam.Levels("f", ["a", "b"]), gam.Levels("g", sorted(map(str, range(12))), True), gam.Levels("h", list("01234567"), True)]


def dense(model, frame):
    x = {c: frame[c].to_numpy() for c in model.columns}
    return np.concatenate([np.ones((len(frame), 1)), *[t.basis(x) for t, _, _ in model.spans()]], 1)


def test_sums_equal_dense_products(spark, frame):
    model = gam.Model(terms())
    model.coefficients = np.random.default_rng(0).normal(0, 0.2, model.size)
    design = dense(model, frame)
    y = frame["y"].to_numpy(float)
    w, z, deviance = gam.working(design @ model.coefficients, y, "probit")
    gram, response, rest = gam.fetched_sums(spark.createDataFrame(frame).repartition(3), "y", model, "probit")
    assert np.allclose(gram, design.T @ (design * w[:, None]), atol=1e-8)
    assert np.allclose(response, design.T @ (w * z), atol=1e-8)
    assert np.allclose(rest[:3], [(w * z * z).sum(), deviance.sum(), len(y)])


def restricted(gram, response, squares, penalties, strengths):
    """Minus twice the restricted log-likelihood of the working model, less constants, by determinants."""
    total = np.zeros_like(gram)
    for (own, s, _), x in zip(penalties, strengths, strict=True):
        total[np.ix_(own, own)] += x * s
    beta = np.linalg.solve(gram + total, response)
    values = np.linalg.eigvalsh(total)
    return squares - beta @ response - np.log(values[values > 1e-9 * min(strengths)]).sum() + np.linalg.slogdet(gram + total)[1], beta


def test_fit_equals_a_dense_one(spark, frame):
    model = gam.fitted(spark.createDataFrame(frame).repartition(3), "y", gam.Model(terms()), tolerance=1e-12, rounds=60)
    assert model.converged
    design, y = dense(model, frame), frame["y"].to_numpy(float)
    change = gam.changed_basis(model, design.sum(0))
    penalties = gam.penalties_of(model, change)
    x = design @ change
    # scoring with the same strengths from zero, on all rows at once
    total = np.zeros((x.shape[1], x.shape[1]))
    for (own, s, _), k in zip(penalties, model.strengths, strict=True):
        total[np.ix_(own, own)] += k * s
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        w, z, _ = gam.working(x @ beta, y, "probit")
        gram, response = x.T @ (x * w[:, None]), x.T @ (w * z)
        beta = np.linalg.solve(gram + total + 1e-10 * np.eye(len(gram)), response)
    assert np.abs(change @ beta - model.coefficients).max() < 1e-6
    # no strength can move without a loss of restricted likelihood
    held = gam.settled_strengths(gram, response, penalties, np.array(model.strengths), rounds=2000, tolerance=1e-9)[1]
    best, _ = restricted(gram, response, (w * z * z).sum(), penalties, held)
    for n in range(len(held)):
        for factor in (0.7, 1.4):
            moved = held.copy()
            moved[n] *= factor
            assert restricted(gram, response, (w * z * z).sum(), penalties, moved)[0] > best - 1e-4
    # and the curve is the one that made the choices
    assert np.corrcoef(design @ model.coefficients, frame["eta"])[0, 1] > 0.95
    assert 4 < model.freedom[0] < 9


def test_smooths_add_up_to_zero(spark, frame):
    model = gam.fitted(spark.createDataFrame(frame), "y", gam.Model(terms()[:3]), tolerance=1e-6)
    x = {c: frame[c].to_numpy() for c in model.columns}
    for term, low, high in model.spans()[:2]:
        assert abs((term.basis(x) @ model.coefficients[low:high]).sum()) < 1e-6


def test_scores_of_unseen_levels_and_missing_numbers(spark, frame):
    model = gam.Model([gam.Linear("x"), gam.Levels("g", ["1", "2"], True)], np.array([0.5, 2.0, 1.0, -1.0]))
    rows = spark.createDataFrame([(1.0, "1"), (1.0, "9"), (1.0, None), (None, "1")], "x double, g string")
    assert [r.linear for r in gam.scored(rows, model).collect()] == [3.5, 2.5, 2.5, None]


def test_terms_learnt_from_columns(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), 7.0, "a" if i % 2 else "b", "one", None if i else 1.0) for i in range(40)], "x double, three double, same double, f string, alone string, gone double")
    model = gam.learnt_terms(rows, smooth={"x": 12, "three": 6, "same": 5}, tensor={("x", "three"): (6, 5)}, fixed=["f", "alone"], random=["f"])
    kinds = [type(t).__name__ for t in model.terms]
    assert kinds == ["Smooth", "Linear", "Linear", "Levels", "Levels"]
    assert (model.terms[0].k, model.terms[0].low, model.terms[0].high) == (12, 0.0, 39.0)
    with pytest.raises(ValueError):
        gam.fitted(rows.limit(0).selectExpr("x", "1 AS y"), "y", gam.Model([gam.Linear("x")]))


def test_negative_binomial_with_crossed_effects(spark):
    from math import lgamma

    rng = np.random.default_rng(7)
    n = 6000
    a, b, x = rng.integers(0, 15, n), rng.integers(0, 10, n), rng.uniform(-1, 1, n)
    mean = np.exp(0.6 + 0.4 * x + rng.normal(0, 0.5, 15)[a] + rng.normal(0, 0.2, 10)[b])
    y = rng.poisson(mean * rng.gamma(2.5, 1 / 2.5, n))
    frame = pd.DataFrame({"x": x, "a": a.astype(str), "b": b.astype(str), "y": y})
    rows = spark.createDataFrame(frame).repartition(3)
    model = gam.learnt_terms(rows, linear=["x"], random=["a", "b"])
    fit = gam.fitted(rows, "y", model, "negative_binomial", dispersion=1.0, learn_dispersion=True, tolerance=1e-12, rounds=60)
    assert fit.converged
    assert abs(fit.dispersion - 2.5) < 0.4
    assert abs(fit.coefficients[1] - 0.4) < 0.08
    # the dispersion is the best one at these means
    eta = dense(fit, frame) @ fit.coefficients

    def likelihood(t):
        mu = np.exp(eta)
        return sum(lgamma(k + t) - lgamma(t) for k in y) + (t * np.log(t / (mu + t)) + y * np.log(mu / (mu + t))).sum()

    assert likelihood(fit.dispersion) > max(likelihood(fit.dispersion * f) for f in (0.999, 1.001))
    # and the coefficients solve the penalised equations
    mu = np.exp(eta)
    slope = dense(fit, frame).T @ ((y - mu) / (1 + mu / fit.dispersion))
    penalty = np.zeros(fit.size)
    for (t, low, high), k in zip(fit.spans()[1:], fit.strengths, strict=True):
        penalty[low:high] = k * fit.coefficients[low:high]
    assert np.abs(slope - penalty).max() < 1e-4
    # an unseen level counts nothing
    one, two = (r.linear for r in gam.scored(spark.createDataFrame([(0.0, "0", "99"), (0.0, "99", "99")], "x double, a string, b string"), fit).collect())
    assert two == pytest.approx(fit.coefficients[0])
    assert one == pytest.approx(fit.coefficients[0] + fit.coefficients[2])


def test_counts_above():
    from stakewise.operators.gam import dispersion_step

    rest = np.array([0, 0, 4.0, *[0] * 4])
    assert dispersion_step(1.0, np.array([3.0, 1.0]), rest) > 0


def test_each_different_level_is_looked_up_once():
    class Counted(str):
        looked = 0

        def __str__(self):
            Counted.looked += 1
            return str.__str__(self)

    values = np.array([Counted("b"), None, Counted("z")] * 500, object)
    assert gam.Levels("c", ["a", "b"]).places({"c": values}).tolist() == [1, -1, -1] * 500 and Counted.looked == 2
