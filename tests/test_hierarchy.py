"""The hierarchical probit recovers what made its choices."""

import numpy as np
import pandas as pd
import pytest

from stakewise.functions.kernels import inverse_phi, phi, quick_phi
from stakewise.operators import hierarchy
from stakewise.operators.governance import CheckFailed


def planted(n=6000, players=25, teams=5):
    rng = np.random.default_rng(4)
    threshold, sigma, shift = rng.normal(1.0, 0.6, players), np.exp(rng.normal(0.2, 0.25, players)), rng.normal(0, 0.2, teams)
    p, t, m = rng.integers(0, players, n), rng.integers(0, teams, n), rng.uniform(-3, 5, n)
    y = rng.random(n) < phi((m - threshold[p]) / sigma[p] + shift[t])
    frame = pd.DataFrame({"key": np.arange(n), "player": [f"p{i:02}" for i in p], "team": t.astype(str), "margin": m, "y": y.astype(int)})
    return frame, threshold, sigma


def plain_sums(frame):
    """``_latent_sums`` without Spark, and the cells and levels that go with it."""
    players, teams = (sorted(set(frame[c])) for c in ("player", "team"))
    p, t = (frame[c].map({k: i for i, k in enumerate(v)}).to_numpy() for c, v in (("player", players), ("team", teams)))
    m, y, key = frame["margin"].to_numpy(), frame["y"].to_numpy().astype(bool), frame["key"].to_numpy()
    cells = pd.DataFrame({"p": p, "t": t, "n": 1.0, "s": m, "q": m * m}).groupby(["p", "t"], as_index=False).sum()

    def sums(held, pairs, shifts, step, seed):
        one, two = np.zeros(pairs.shape), np.zeros(shifts.shape)
        for c in range(len(pairs)):
            z = hierarchy.latent(pairs[c, p, 0] + pairs[c, p, 1] * m + shifts[c, t], y, hierarchy.uniforms(key, c, step, seed))
            np.add.at(one[c], p, np.stack([z, z * m], 1))
            np.add.at(two[c], t, z)
        return one, two

    return sums, cells, players, teams


def test_recovers_players_and_chains_agree(monkeypatch):
    frame, threshold, sigma = planted()
    sums, *levels = plain_sums(frame)
    monkeypatch.setattr(hierarchy, "_latent_sums", sums)
    draws = hierarchy._chains(None, *levels, 2, 60, 300, 1, np.array([-1, 0.5]), np.array([2.0, 1.0]))
    assert hierarchy.split_scale_reduction(draws.population()).max() < 1.05
    found = hierarchy.player_summary(draws)
    assert np.corrcoef(found["threshold"], threshold)[0, 1] > 0.95
    assert np.corrcoef(found["log_sigma"], np.log(sigma))[0, 1] > 0.8
    assert ((np.abs(found["threshold"] - threshold) / found["threshold_sd"]) < 3).mean() > 0.9
    assert abs(found["log_sigma"].mean() - np.log(sigma).mean()) < 0.1
    assert np.allclose(draws.shifts.sum(-1), 0, atol=1e-9)


def test_spark_draws_equal_plain_ones_whatever_the_partitions(spark, monkeypatch):
    frame, *_ = planted(800, 6, 3)
    one, two = (hierarchy.sampled(spark.createDataFrame(frame).repartition(k), "y", "margin", "player", "team", "key", burn=2, keep=3) for k in (1, 4))
    sums, *levels = plain_sums(frame)
    monkeypatch.setattr(hierarchy, "_latent_sums", sums)
    plain = hierarchy._chains(None, *levels, 2, 2, 3, 1, np.array([-1.0, 0.5]), np.array([2.0, 1.0]))
    assert one.players == sorted(set(frame["player"]))
    assert np.allclose(one.pairs, two.pairs, atol=1e-8) and np.allclose(one.pairs, plain.pairs, atol=1e-8)
    assert np.allclose(one.shifts, plain.shifts, atol=1e-8)


def test_missing_values_and_no_rows(spark):
    frame, *_ = planted(300, 4, 2)
    rows = spark.createDataFrame(frame)
    odd = rows.union(spark.createDataFrame([(1, None, "0", 1.0, 1), (2, "p00", None, 1.0, 1), (3, "p00", "0", None, 1)], rows.schema))
    draws = hierarchy.sampled(odd, "y", "margin", "player", "team", "key", burn=1, keep=1)
    assert len(draws.players) == 4
    with pytest.raises(CheckFailed):
        hierarchy.sampled(rows.limit(0), "y", "margin", "player", "team", "key")


def test_latent_scores_keep_their_side():
    eta = np.linspace(-12, 12, 4001)
    u = hierarchy.uniforms(np.arange(4001), 0, 3, 1)
    assert ((u > 0) & (u < 1)).all() and abs(u.mean() - 0.5) < 0.02
    assert (hierarchy.latent(eta, np.ones(4001, bool), u) >= 0).all()
    assert (hierarchy.latent(eta, np.zeros(4001, bool), u) <= 0).all()
    z = hierarchy.latent(np.full(200_000, 0.5), np.ones(200_000, bool), hierarchy.uniforms(np.arange(200_000), 1, 1, 1))
    expected = 0.5 + np.exp(-0.125) / np.sqrt(2 * np.pi) / phi(np.array([0.5]))[0]
    assert abs(z.mean() - expected) < 0.01


def test_quantiles_invert_the_normal():
    p = np.concatenate([np.geomspace(1e-280, 0.5, 2000), 1 - np.geomspace(1e-12, 0.5, 500)])
    assert np.abs(phi(inverse_phi(p)) / p - 1).max() < 2e-4
    x = np.linspace(-6, 6, 501)
    assert np.abs(inverse_phi(phi(x)) - x).max() < 1e-5


def test_rows_travel_in_blocks(spark):
    rows = spark.range(0, 40_000, 1, 2).selectExpr("id % 2 = 0 AS y", "id / 7.0D AS m", "id AS key", "cast(id % 5 AS int) AS p", "cast(id % 3 AS int) AS t")
    blocks = hierarchy.packed(rows).collect()
    assert len(blocks) < 10
    found = np.sort(np.concatenate([np.frombuffer(b.key, np.int64) for b in blocks]))
    assert np.array_equal(found, np.arange(40_000))
    for b in blocks:
        key = np.frombuffer(b.key, np.int64)
        assert np.array_equal(np.frombuffer(b.t, np.int32), key % 3) and np.array_equal(np.frombuffer(b.m, float), key / 7.0)


def test_quick_phi_is_phi():
    x = np.concatenate([np.linspace(-37, 9, 20_001), [0.0, np.inf, -np.inf]])
    assert np.abs(quick_phi(x) / np.maximum(phi(x), 1e-320) - 1)[x > -37].max() < 1e-12 and quick_phi(x)[-1] == 0
