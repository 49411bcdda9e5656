"""Adaptive quadrature and orthant masses against fine fixed rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stakewise.functions import kernels
from stakewise.functions.scalar import orthant
from stakewise.operators.quadrature import tail_means, with_tail_means


def fine(f, threshold, mean, sd, n=200_001):
    low = max((threshold - mean) / sd, -9.0)
    z = np.linspace(low, max(low, 0) + 12 if low < 3 else low + 12 / max(low, 1) * 3, n)
    w = np.exp(-(z * z - max(low, 0) ** 2) / 2)
    return np.trapezoid(w * f(mean + sd * z), z) / np.trapezoid(w, z)


KINKED = lambda x: np.interp(x, [-2, -0.3, 0.4, 0.41, 3], [0, 0.1, 0.2, 0.9, 1])


@pytest.mark.parametrize("f", [lambda x: 1 / (1 + np.exp(-3 * x)), KINKED, np.sin])
def test_means_equal_a_fine_rule(f):
    cases = [(t, m, s) for t in (-50.0, -1.0, 0.0, 0.4, 2.0, 9.0) for m in (-2.0, 0.0, 1.5) for s in (0.05, 0.7, 2.0) if (t - m) / s < 60]
    value, error = tail_means(f, *np.array(cases).T)
    want = np.array([fine(f, *c) for c in cases])
    assert np.abs(value - want).max() < 2e-6
    assert error.max() < 1e-5 and (error >= 0).all()


def test_errors_are_cautious():
    t, m, s = np.meshgrid(np.linspace(-3, 3, 7), np.linspace(-1, 1, 5), [0.3, 1.0])
    t, m, s = t.ravel(), m.ravel(), s.ravel()
    rough, bound = tail_means(KINKED, t, m, s, tolerance=1e-4)
    good, _ = tail_means(KINKED, t, m, s, tolerance=1e-12)
    assert (np.abs(rough - good) <= bound + 1e-12).mean() > 0.9
    assert np.abs(rough - good).max() < 1e-4


def test_limits(spark):
    inf = float("inf")
    rows = spark.createDataFrame([(inf, 0.0, 1.0), (-inf, 0.3, 1.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0), (None, 1.0, 1.0), (40.0, 0.0, 1.0)], "t double, m double, s double")
    got = [(r.q, r.q_error) for r in with_tail_means(rows, lambda x: x, F.col("t"), F.col("m"), F.col("s"), "q").collect()]
    assert got[0] == got[3] == got[4] == (None, None)
    assert got[1][0] == pytest.approx(0.3, abs=1e-9) and got[2] == (1.0, 0.0)
    # Mills' ratio: the mean beyond t is t + 1 / t - 2 / t^3 ...
    assert got[5][0] == pytest.approx(40 + 1 / 40 - 2 / 40**3, abs=1e-6)


def test_orthants_at_all_correlations(spark):
    rng = np.random.default_rng(3)
    cases = [(float(h), float(k), float(r)) for r in (-1, -0.99999, -0.97, -0.5, 0, 0.3, 0.9, 0.999, 0.999999, 1) for h, k in [*rng.normal(0, 1.2, (12, 2)), (0.7, 0.7), (0.7, -0.7), (0.0, 0.0), (1.0, 1.001)]]
    got = [r.p for r in spark.createDataFrame(cases, "h double, k double, r double").coalesce(1).select(orthant(F.col("h"), F.col("k"), F.col("r")).alias("p")).collect()]

    def want(h, k, r):
        if abs(r) == 1:
            return kernels.orthant(h, k, r)
        y = np.linspace(k, max(k, 0) + 9, 400_001)
        return np.trapezoid(kernels.density(y) * kernels.phi((r * y - h) / math.sqrt(1 - r * r)), y)

    assert np.abs(np.array(got)[::5] - [want(*c) for c in cases[::5]]).max() < 1e-6
    at_zero = [p for p, (h, k, r) in zip(got, cases, strict=True) if h == k == 0]
    assert at_zero == pytest.approx([0.25 + math.asin(r) / (2 * math.pi) for h, k, r in cases if h == k == 0], abs=1e-7)
