"""Accepted profiles and smooth curves."""

import numpy as np
import pytest

from stakewise.functions.kernels import natural_spline, phi
from stakewise.operators import profiles
from stakewise.operators.governance import CheckFailed


def test_spline_equals_penalised_least_squares():
    rng = np.random.default_rng(1)
    x = np.sort(rng.uniform(0, 5, 25))
    y, w = np.sin(x) + rng.normal(0, 0.1, 25), rng.integers(1, 20, 25).astype(float)
    got, strength = natural_spline(x, y, w, np.array([0.3]))
    # the same minimum through values and second derivatives, solved as one linear system
    h = np.diff(x)
    q, r = np.zeros((25, 23)), np.zeros((23, 23))
    for j in range(23):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j < 22:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    want = np.linalg.solve(np.diag(w) + 0.3 * q @ np.linalg.solve(r, q.T), w * y)
    assert strength == 0.3 and np.allclose(got, want, atol=1e-8)


def test_cross_validation_finds_the_curve():
    rng = np.random.default_rng(2)
    x = np.linspace(0, 6, 80)
    y = np.sin(x) + rng.normal(0, 0.3, 80)
    got, _ = natural_spline(x, y, np.ones(80))
    assert np.sqrt(np.mean((got - np.sin(x)) ** 2)) < 0.13
    line, _ = natural_spline(x, 2 * x + 1, np.ones(80))
    assert np.allclose(line, 2 * x + 1, atol=1e-6)
    assert natural_spline([1.0, 2.0], [5.0, 6.0], [1, 1])[0].tolist() == [5.0, 6.0]


def test_curves_by_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], float(x), int(rng.random() < phi(np.array([(x - 5) / 2 * (1 if i % 2 else -1)]))[0])) for i, x in enumerate(rng.integers(0, 11, 8000))]
    rows += [("c", 1.0, 1), ("c", None, 1), ("a", 3.0, None)]
    table = spark.createDataFrame(rows, "g string, x double, y int")
    got = profiles.probit_curves(table, ["g"], "x", "y").toPandas()
    assert len(got) == 23
    for g, sign in (("b", 1), ("a", -1)):
        own = got[got["g"] == g].sort_values("x")
        assert np.abs(own["smooth"].to_numpy()[2:-2] - sign * (own["x"].to_numpy()[2:-2] - 5) / 2).max() < 0.25
    assert got[got["g"] == "c"]["smooth"].item() == got[got["g"] == "c"]["observed"].item()
    monkeypatch.setattr(profiles, "MOST_POINTS", 5)
    with pytest.raises(CheckFailed, match="points"):
        profiles.probit_curves(table, ["g"], "x", "y")


def test_groups_that_differ_are_accepted(spark):
    rng = np.random.default_rng(4)
    rate = {"low": 0.1, "middle": 0.4, "high": 0.8}
    rows = [(g, f"g{game}", game % 3 + 1, int(rng.random() < p)) for g, p in rate.items() for game in range(12) for _ in range(30)]
    rows += [("once", "g1", 2, 1), ("once", "g1", 2, None)]
    table = spark.createDataFrame([("all", *r) for r in rows], "role string, group string, game string, fold int, y int")
    got = profiles.accepted_profiles(table, ["role", "group"], ["role"], "fold", "game", "y").toPandas().set_index("group")
    assert got["accepted"].to_dict() == {"low": True, "middle": False, "high": True, "once": False} or got.loc["middle", "difference"] + got.loc["middle", "se"] < 0
    assert abs(got.loc["low", "rate"] - 0.1) < 0.05 and not got.loc["once", "accepted"]
    pooled = (sum(r[3] or 0 for r in rows) + 0.5) / (sum(r[3] is not None for r in rows) + 1)
    assert got.loc["once", "rate"] == pytest.approx(pooled)
