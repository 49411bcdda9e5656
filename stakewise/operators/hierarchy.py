"""A hierarchical probit by Gibbs sampling: players' thresholds and widths, pooled, with shifts by team.

A row's latent score is a + b * margin + c + noise, with the player's a and b and the team's c, and it is a choice where
that is positive; so a player's threshold is -a / b and the width 1 / b. Players' pairs (a, b) come from one bivariate
normal, team shifts, which add up to zero, from a normal around 0; their moments have weak priors.

Rows stay on Spark, packed into blocks of ``BLOCK`` once, so that a round hands tasks a few arrays. In each round tasks draw their rows' latent scores, truncated to the side of the choice, and add them up
by player and by team; the counts and margins by player and team that go with them never change and are summed once. Given
these sums the driver draws players, teams and moments: arrays over levels, whose number is checked. A row's draw is a hash
of its key, the chain and the round, so a repeated task repeats it. All chains run in the same passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakewise.functions.kernels import inverse_phi, quick_phi
from stakewise.operators.governance import CheckFailed, fetched

#: Players and teams at most, and pairs of them that meet.
MOST_LEVELS = 200_000
MOST_CELLS = 2_000_000
#: Rows of a block, whose arrays stay in the processor's cache.
BLOCK = 16_384
#: Rows of a task of a round, and different sums of a task that adds them up.
ROWS_A_TASK, SUMS_A_TASK = 500_000, 20_000
#: A row's choice, margin, key, player and team as a block has them.
PACKED = {"y": np.int8, "m": np.float64, "key": np.int64, "p": np.int32, "t": np.int32}


@dataclass
class Draws:
    """Kept draws, chain by chain: of players' pairs (chain, draw, player, 2), teams' shifts, means and covariances."""

    players: list[str]
    teams: list[str]
    pairs: np.ndarray
    shifts: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def population(self) -> np.ndarray:
        """(chain, draw, 2): threshold and log width of the mean player."""
        a, b = self.means[..., 0], self.means[..., 1]
        return np.stack([-a / b, -np.log(np.maximum(b, 1e-12))], -1)


def uniforms(keys: np.ndarray, chain: int, step: int, seed: int) -> np.ndarray:
    """Numbers strictly between 0 and 1 that depend on row, chain, round and seed alone."""
    salt = np.uint64((seed * 1_000_003 + chain * 7919 + step * 104_729) * 0x9E3779B97F4A7C15 % 2**64)
    x = keys.astype(np.int64).view(np.uint64) + salt
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def latent(eta: np.ndarray, chosen: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Normal draws around ``eta``, above 0 for choices and below for the rest."""
    side = np.where(chosen, 1.0, -1.0)
    return eta - side * inverse_phi(np.maximum(u * quick_phi(side * eta), 1e-300))


def indexed(rows: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """``rows`` with ``column``_at, the place of its value among the sorted ones."""
    found = sorted(fetched(rows.select(F.col(column).cast("string").alias(column)).distinct(), MOST_LEVELS, f"values of {column}")[column])
    table = rows.sparkSession.createDataFrame(list(enumerate(found)), f"{column}_at int, {column} string")
    # MOST_LEVELS rows at most
    return rows.withColumn(column, F.col(column).cast("string")).join(F.broadcast(table), column), found


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows`` (y, m, key, p, t): a column's values as one array."""

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append({c: batch[c].to_numpy(zero_copy_only=False).astype(kind) for c, kind in PACKED.items()})
            size += batch.num_rows
            if size >= BLOCK:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    def block(held):
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate([x[c] for x in held]).tobytes()], pa.binary()) for c in PACKED], names=list(PACKED))

    return rows.select(*PACKED).mapInArrow(pack, ", ".join(f"{c} binary" for c in PACKED))


def moments(rng: np.random.Generator, pairs: np.ndarray, covariance: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A draw of the pairs' mean (normal prior with ``centre`` and standard deviations ``spread``), then of their covariance
    (inverse Wishart prior, four degrees of freedom and a tenth of the unit matrix)."""
    n, inverse = len(pairs), np.linalg.inv(covariance)
    precision = n * inverse + np.diag(spread**-2.0)
    mean = np.linalg.solve(precision, inverse @ pairs.sum(0) + centre / spread**2)
    mean = mean + np.linalg.solve(np.linalg.cholesky(precision).T, rng.normal(size=2))
    scale = 0.1 * np.eye(2) + (pairs - mean).T @ (pairs - mean)
    # Wishart with the inverse scale by its triangular factor
    degrees = n + 4
    factor = np.array([[np.sqrt(rng.chisquare(degrees)), 0], [rng.normal(), np.sqrt(rng.chisquare(degrees - 1))]])
    root = np.linalg.cholesky(np.linalg.inv(scale)) @ factor
    return mean, np.linalg.inv(root @ root.T)


def drawn_pairs(rng: np.random.Generator, gram: np.ndarray, response: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """One (a, b) for each player from its conditional normal."""
    inverse = np.linalg.inv(covariance)
    precision = gram + inverse
    centre = np.linalg.solve(precision, (response + inverse @ mean)[..., None])[..., 0]
    root = np.linalg.cholesky(precision)
    return centre + np.linalg.solve(np.swapaxes(root, 1, 2), rng.normal(size=centre.shape)[..., None])[..., 0]


def sampled(rows: DataFrame, chosen: str, margin: str, player: str, team: str, key: str, chains: int = 2, burn: int = 50, keep: int = 100, seed: int = 1, centre: tuple[float, float] = (-1.0, 0.5), spread: tuple[float, float] = (2.0, 1.0)) -> Draws:
    """Draws of the hierarchical probit. Rows that lack a value are left out; ``key`` is a whole number that tells rows apart
    (rows that share it share their noise)."""
    named = rows.select(F.col(chosen).cast("boolean").alias("y"), F.col(margin).cast("double").alias("m"), F.col(player).alias("player"), F.col(team).alias("team"), F.col(key).cast("long").alias("key")).dropna()
    named, players = indexed(named, "player")
    named, teams = indexed(named, "team")
    placed = named.select("y", "m", "key", F.col("player_at").alias("p"), F.col("team_at").alias("t"))
    cells = fetched(placed.groupBy("p", "t").agg(F.count("*").alias("n"), F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q")), MOST_CELLS, "pairs of player and team")
    if not len(cells):
        raise CheckFailed("no rows to sample from")
    # a round is short, so its tasks are as many as there are cores, or as the rows need
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(cells["n"].sum()) // ROWS_A_TASK))
    held = packed(placed.coalesce(tasks)).cache()
    try:
        return _chains(held, cells, players, teams, chains, burn, keep, seed, np.array(centre, float), np.array(spread, float))
    finally:
        held.unpersist()


def _chains(held: DataFrame, cells: pd.DataFrame, players: list[str], teams: list[str], chains: int, burn: int, keep: int, seed: int, centre: np.ndarray, spread: np.ndarray) -> Draws:
    p, t, n, s, q = (cells[c].to_numpy() for c in ("p", "t", "n", "s", "q"))
    total = lambda at, x, size: np.bincount(at, x, size)
    size, wide = len(players), len(teams)
    gram = np.empty((size, 2, 2))
    gram[:, 0, 0], gram[:, 1, 1] = total(p, n, size), total(p, q, size)
    gram[:, 0, 1] = gram[:, 1, 0] = total(p, s, size)
    rows_of_team = total(t, n, wide)
    rngs = [np.random.default_rng([seed, c]) for c in range(chains)]
    means = np.array([centre + spread * 0.5 * r.normal(size=2) for r in rngs])
    covariances = np.array([np.eye(2) * 0.25] * chains)
    pairs = np.repeat(means[:, None, :], size, 1)
    shifts, variance = np.zeros((chains, wide)), np.full(chains, 0.05)
    out = [np.empty((chains, keep, *x)) for x in ((size, 2), (wide,), (2,), (2, 2))]
    for step in range(burn + keep):
        by_player, by_team = _latent_sums(held, pairs, shifts, step, seed)
        for c, rng in enumerate(rngs):
            met = np.stack([total(p, n * shifts[c, t], size), total(p, s * shifts[c, t], size)], 1)
            pairs[c] = drawn_pairs(rng, gram, by_player[c] - met, means[c], covariances[c])
            left = by_team[c] - total(t, n * pairs[c, p, 0] + s * pairs[c, p, 1], wide)
            precision = rows_of_team + 1 / variance[c]
            shifts[c] = left / precision + rng.normal(size=wide) / np.sqrt(precision)
            # given that shifts add up to zero, so that they don't trade with the players' mean
            shifts[c] -= shifts[c].sum() / (1 / precision).sum() / precision
            variance[c] = (0.01 + (shifts[c] ** 2).sum() / 2) / rng.gamma(2 + wide / 2)
            means[c], covariances[c] = moments(rng, pairs[c], covariances[c], centre, spread)
        if step >= burn:
            for kept, now in zip(out, (pairs, shifts, means, covariances), strict=True):
                kept[:, step - burn] = now
    return Draws(players, teams, *out)


def _latent_sums(held: DataFrame, pairs: np.ndarray, shifts: np.ndarray, step: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of latent scores, and of them times margins, by chain and player; and of the scores by chain and team."""
    chains, size, wide = len(pairs), pairs.shape[1], shifts.shape[1]
    sent = held.sparkSession.sparkContext.broadcast((pairs, shifts))

    def added(batches):
        pairs, shifts = sent.value
        one, two = np.zeros((chains, size, 2)), np.zeros((chains, wide))
        for y, m, key, p, t in (row for batch in batches for row in zip(*[batch[c].to_pylist() for c in PACKED], strict=True)):
            y, m, key, p, t = (np.frombuffer(x, kind) for x, kind in zip((y, m, key, p, t), PACKED.values(), strict=True))
            for c in range(chains):
                z = latent(pairs[c, p, 0] + pairs[c, p, 1] * m + shifts[c, t], y.astype(bool), uniforms(key, c, step, seed))
                one[c, :, 0] += np.bincount(p, z, size)
                one[c, :, 1] += np.bincount(p, z * m, size)
                two[c] += np.bincount(t, z, wide)
        for kind, table in ((0, one.reshape(chains, -1)), (1, two)):
            c, at = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), pa.array(c.astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(table[c, at])], names=["kind", "chain", "at", "value"])

    # a task has one row a sum already; the session's number of shuffle partitions would be a round's tasks
    parts = -(-chains * (2 * size + wide) // SUMS_A_TASK)
    found = held.mapInArrow(added, "kind int, chain int, at long, value double").repartition(parts, "kind", "chain", "at").groupBy("kind", "chain", "at").agg(F.sum("value").alias("value"))
    got = fetched(found, chains * (2 * MOST_LEVELS + MOST_LEVELS), "sums")
    sent.unpersist()
    one, two = np.zeros((chains, 2 * size)), np.zeros((chains, wide))
    for kind, table in ((0, one), (1, two)):
        mine = got[got["kind"] == kind]
        table[mine["chain"].to_numpy(), mine["at"].to_numpy()] = mine["value"].to_numpy()
    return one.reshape(chains, size, 2), two


def split_scale_reduction(draws: np.ndarray) -> np.ndarray:
    """R-hat of (chain, draw, ...): how far halves of chains disagree about where a quantity lies; 1 where they agree."""
    half = draws.shape[1] // 2
    parts = np.concatenate([draws[:, :half], draws[:, half : 2 * half]])
    within = parts.var(1, ddof=1).mean(0)
    between = parts.mean(1).var(0, ddof=1)
    return np.sqrt((half - 1) / half + between / within)


def player_draws(spark, draws: Draws) -> DataFrame:
    """(player, draw, threshold, log_sigma) for ``models.choice_probability``, with the mean player as null; a draw in which a
    player's slope isn't positive has none of that player."""
    chains, keep = draws.pairs.shape[:2]
    flat = draws.pairs.reshape(chains * keep, len(draws.players), 2)
    mean = draws.means.reshape(chains * keep, 2)
    rows = [(None, d, float(-a / b), float(-np.log(b))) for d, (a, b) in enumerate(mean) if b > 0]
    rows += [(name, d, float(-a / b), float(-np.log(b))) for i, name in enumerate(draws.players) for d, (a, b) in enumerate(flat[:, i]) if b > 0]
    return spark.createDataFrame(rows, "player string, draw int, threshold double, log_sigma double")


def player_summary(draws: Draws) -> pd.DataFrame:
    """Posterior means and deviations of every player's threshold and log width, by draws with a positive slope."""
    flat = draws.pairs.reshape(-1, len(draws.players), 2)
    a, b = flat[..., 0], np.where(flat[..., 1] > 0, flat[..., 1], np.nan)
    threshold, width = -a / b, -np.log(b)
    return pd.DataFrame({"player": draws.players, "threshold": np.nanmean(threshold, 0), "threshold_sd": np.nanstd(threshold, 0), "log_sigma": np.nanmean(width, 0), "log_sigma_sd": np.nanstd(width, 0)})
