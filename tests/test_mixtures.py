"""Mixtures of all folds at once, against the fit of one fold's bins on the driver."""

import numpy as np
import pytest

from stakewise.operators import models
from stakewise.operators.mixtures import mixtures

SCHEMA = "fold int, x double, mean double"


def planted(n=4000):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(n) < 0.3, rng.normal(-4, 0.7, n), rng.normal(3, 1.5, n))
    return [(int(i % 3), float(v), 1.0) for i, v in enumerate(x)]


def test_same_components_as_one_fit_per_fold(spark):
    rows = planted() + [(None, 1.0, 1.0), (0, None, 1.0), (1, float("nan"), 1.0), (2, float("inf"), 1.0)]
    got = mixtures(spark.createDataFrame(rows, SCHEMA), "fold", "x", 3, rounds=40, tolerance=1e-6).toPandas()
    for fold in range(3):
        bins = np.array([np.floor(x / 0.1) * 0.1 for f, x, _ in planted() if f != fold])
        at, n = np.unique(bins, return_counts=True)
        for k in (1, 2, 3):
            want = models.mixture(at, k, rounds=40, tolerance=1e-6, counts=n)
            own = got[(got.f == fold) & (got.k == k)]
            for name in ("weight", "mean", "sd"):
                assert own[name].to_numpy() == pytest.approx(want[name], rel=1e-7)
            assert own.log_likelihood.iloc[0] == pytest.approx(float(want["log_likelihood"]), rel=1e-9) and own.converged.iloc[0] == bool(want["converged"])
    two = got[(got.f == 0) & (got.k == 2)]
    assert two["mean"].to_numpy() == pytest.approx([-4.05, 2.95], abs=0.2) and two["weight"].iloc[0] == pytest.approx(0.3, abs=0.03)


def test_one_value_and_empty_tables(spark):
    same = mixtures(spark.createDataFrame([(0, 5.0, 0.0), (1, 5.0, 0.0)], SCHEMA), "fold", "x", 2, width=1.0).collect()
    # The ridge on a component's mass draws the mean of a single row a little towards zero.
    assert len(same) == 6 and all(r.mean == pytest.approx(5, rel=0.005) and r.sd == 0.05 and r.converged for r in same)
    assert mixtures(spark.createDataFrame([], SCHEMA), "fold", "x", 2).count() == 0
    assert mixtures(spark.createDataFrame([(0, 5.0, 0.0)], SCHEMA), "fold", "x", 2).count() == 0
