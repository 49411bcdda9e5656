"""Frozen evaluation, searches over candidates, sensitivities, cross-fitting and promotion gates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stakewise.functions.kernels import payoff
from stakewise.functions.scalar import signal_probability
from stakewise.operators.decision import gauss_hermite, maximin
from stakewise.operators.governance import held_out_apart, require_none, same_keys
from stakewise.operators.ledger import CLOCK
from stakewise.operators.sequential import REGULATION, SEGMENT, mass_replay
from stakewise.operators.stats import sandwich_error
from stakewise.sources.readers import scratch


def with_payoffs(rows: DataFrame, lookups: dict[str, dict[str, np.ndarray]], context: str, gain: str, loss: str) -> DataFrame:
    """``rows`` with threshold, action, success and advantage at given stakes; contexts without a lookup take that of
    "league". A lookup is a few hundred points, contexts are few, so they travel with the tasks."""
    names = ["threshold", "action", "success", "advantage"]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def solve(frames):
        for frame in frames:
            out = np.zeros((len(frame), 4))
            keys = frame[context].where(frame[context].isin(lookups.keys()), "league").to_numpy()
            for key in pd.unique(keys):
                mine = keys == key
                found = payoff(frame[gain].to_numpy(float)[mine], frame[loss].to_numpy(float)[mine], lookups[key])
                out[mine] = np.stack([found[n] for n in names], 1)
            yield frame.assign(**{n: out[:, i] for i, n in enumerate(names)})

    return rows.mapInPandas(solve, schema)


def frozen_evaluation(clock: DataFrame, truth: DataFrame, sigma: dict[str, float], margin: str = "margin") -> DataFrame:
    """Replay of fixed thresholds r1 and r2: the truth (CLOCK keys, margin) is joined only now and must cover the clock.

    The chance to act given the margin is Phi((margin - r) / sigma of the role); a correct call has a margin above zero.
    """
    require_none(same_keys(clock, truth, CLOCK), "the truth does not cover the clock")
    width = reduce(lambda c, r: c.when(F.col("role") == r, sigma[r]), sigma, F.when(F.lit(False), 0.0))
    rows = clock.join(truth.select(*CLOCK, margin), CLOCK)
    chances = {f"p{k}": F.when(F.col("stake") > 0, signal_probability(F.col(margin), F.col(f"r{k}"), width)).otherwise(0.0) for k in (1, 2)}
    rows = rows.withColumns(chances | {"success": F.col(margin) > 0})
    return mass_replay(rows.select(*CLOCK, "inning", "role", "p1", "p2", "success", "stake"), CLOCK[:2], CLOCK[2:])


def bias_sensitivity(clock: DataFrame, truth: DataFrame, sigma: dict[str, float], spread: float, nodes: int = 5) -> DataFrame:
    """Captured value when all signals of a team-game are off by a normal bias: nodes are replayed side by side and weighted."""
    at, weight = gauss_hermite(nodes)
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("node"), F.lit(float(x * spread)).alias("bias"), F.lit(float(w)).alias("node_weight")) for i, (x, w) in enumerate(zip(at, weight, strict=True))]))
    rows = clock.withColumn("__b", made).select("*", "__b.*").drop("__b")
    shifted = rows.withColumns({f"r{k}": F.col(f"r{k}") - F.col("bias") for k in (1, 2)}).withColumn("team_id", F.concat_ws("#", "team_id", "node"))
    spread_truth = truth.withColumn("__n", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1)))).withColumn("team_id", F.concat_ws("#", "team_id", "__n")).drop("__n")
    out = frozen_evaluation(shifted, spread_truth, sigma)
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in weight]), F.split("team_id", "#")[1].cast("int") + 1)
    return out.groupBy("role").agg(F.sum(F.col("state.captured") * weights).alias("captured"))


def public_thresholds(rows: DataFrame, p: str, gain: str, losses: dict[int, Column]) -> DataFrame:
    """Chances of a policy that sees no signal: act surely where the prior rate is worth it, per inventory."""
    return rows.withColumns({f"p{k}": ((F.col(p) * F.col(gain) > (1 - F.col(p)) * loss) & (F.col(gain) > 0)).cast("double") for k, loss in losses.items()})


def segments(clock: DataFrame, keys: list[str], scenario: str) -> DataFrame:
    """The timelines of rows with p, stake, success and inning as arrays of at most ``SEGMENT`` rows, laid out once for any
    number of rounds. A segment that isn't full and is a key's first is ``alone``."""
    along = Window.partitionBy(scenario, *keys).orderBy("pitch_order")
    before = F.lag("inning").over(along)
    enters = F.coalesce((F.col("inning") > REGULATION) & (before.isNull() | (F.col("inning") > before)), F.lit(False))
    row = F.struct("pitch_order", enters.alias("enters"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("p", "stake")], F.coalesce("success", F.lit(False)).alias("success"))
    placed = clock.select(scenario, *keys, F.floor((F.row_number().over(along) - 1) / SEGMENT).alias("segment"), row.alias("row"))
    rows = placed.groupBy(scenario, *keys, "segment").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    alone = (F.col("segment") == 0) & (F.size("rows") < SEGMENT)
    return rows.select(scenario, *keys, "segment", alone.alias("alone"), *[F.col(f"rows.{c}").alias(c) for c in ("enters", "p", "stake", "success")])


def images(points: list[tuple[float, float]], begun: np.ndarray):
    """What segments make of the masses ``begun`` (starts, 3) under each loss pair: the masses behind them and the value
    captured inside, (starts * 4) numbers a pair. Rows act that are surely worth it; rows that lack p or stake never do.

    All segments of a batch go forward row by row, the longest first, as arrays of (segments, pairs, starts).
    """
    losses = np.array(points, float)

    @F.pandas_udf("array<array<double>>")
    def made(enters: pd.Series, p: pd.Series, stake: pd.Series, success: pd.Series) -> pd.Series:
        if not len(p):
            return pd.Series([], dtype=object)
        length = p.map(len).to_numpy()
        order = np.argsort(-length, kind="stable")
        length = length[order]
        enters, p, stake, success = (np.concatenate([x.iloc[i] for i in order]) for x in (enters, p, stake, success))
        acts = ((p * stake)[:, None] > (1 - p)[:, None] * losses.T[:, None]) & (stake > 0)[:, None]
        first = np.cumsum(length) - length
        m = np.broadcast_to(begun.T[:, None, None], (3, len(length), len(losses), len(begun))).copy()
        captured = np.zeros(m.shape[1:])
        for step in range(length[0]):
            live = int(np.searchsorted(-length, -step, "left"))
            at = first[:live] + step
            m0, m1, m2 = m[:, :live]
            granted = np.where(enters[at, None, None], m0, 0)
            m0, m1 = m0 - granted, m1 + granted
            c1, c2 = m1 * acts[0, at][..., None], m2 * acts[1, at][..., None]
            won = success[at].astype(bool)[:, None, None]
            captured[:live] += np.where(won, (c1 + c2) * np.nan_to_num(stake[at])[:, None, None], 0)
            m[:, :live] = np.where(won, (m0, m1, m2), (m0 + c1, m1 - c1 + c2, m2 - c2))
        out = np.empty((len(length), len(losses), len(begun), 4))
        out[order] = np.stack([*m, captured], -1)
        return pd.Series(out.reshape(len(length), len(losses), -1).tolist())

    return made("enters", "p", "stake", "success")


def candidate_values(laid: DataFrame, points: list[tuple[float, float]], keys: list[str], scenario: str, initial: int = 2, longer: bool = True) -> DataFrame:
    """(candidate, scenario, value) of loss pairs, numbered by their places in ``points``, on ``segments``.

    Values are expected replays as in ``mass_replay``, all pairs in one job. Masses move linearly, so a timeline of more than one
    segment is put together from what each makes of either number of challenges. Timelines are added up as decimals, which no
    order of rows changes, so that pairs with equal decisions have equal values. Without ``longer``, all segments are alone.
    """
    start = np.eye(3)[[initial]]
    values = laid.filter("alone").select(scenario, F.posexplode(images(points, start)).alias("candidate", "image")).select("candidate", scenario, F.col("image")[3].alias("captured"))
    if longer:
        parts = laid.filter("NOT alone").select(scenario, *keys, "segment", F.posexplode(images(points, np.eye(3))).alias("candidate", "image"))
        parts = parts.groupBy("candidate", scenario, *keys).agg(F.sort_array(F.collect_list(F.struct("segment", "image"))).alias("__parts"))

        def onward(s: Column, part: Column) -> Column:
            behind = [sum((s[k] * part["image"][4 * k + j] for k in range(1, 3)), s[0] * part["image"][j]) for j in range(4)]
            return F.array(*behind[:3], s[3] + behind[3])

        joined = F.aggregate("__parts", F.array(*[F.lit(float(x)) for x in (*start[0], 0.0)]), onward)
        values = values.unionByName(parts.select("candidate", scenario, joined[3].alias("captured")))
    return values.groupBy("candidate", scenario).agg(F.sum(F.col("captured").cast("decimal(28,10)")).cast("double").alias("value"))


def search(clock: DataFrame, keys: list[str], scenario: str, start: tuple[float, float] = (0.5, 0.25), radius: float = 0.25, rounds: int | None = None, tolerance: float = 0.01) -> dict:
    """Maximin pattern search over losses l1 >= l2 >= 0: neighbours of the best point, one job a round.

    A round without a better point halves the radius; the search ends when it is below ``tolerance``, or after ``rounds``.
    Timelines are laid out as arrays once, in files of few partitions; a round reads only those.
    """
    spark, best, done = clock.sparkSession, tuple(start), 0
    path = scratch(spark, "segments")
    segments(clock, keys, scenario).write.parquet(path)
    laid = spark.read.parquet(path)
    longer = not laid.filter("NOT alone").isEmpty()
    while done != rounds and (rounds is not None or radius >= tolerance):
        done += 1
        around = {(round(max(0.0, best[0] + a * radius), 9), round(max(0.0, best[1] + b * radius), 9)) for a in (-1, 0, 1) for b in (-1, 0, 1)}
        points = sorted((a, b) for a, b in around if a >= b)
        won = maximin(candidate_values(laid, points, keys, scenario, longer=longer), "candidate", scenario, "value").first()
        moved, best = points[won["candidate"]] != best, points[won["candidate"]]
        radius = radius if moved else radius / 2
    return {"l1": best[0], "l2": best[1], "worst": won["worst"], "binding": won["binding"]}


def cross_fit(rows: DataFrame, group: str, fold: str, fit, score) -> DataFrame:
    """Union of ``score(fit(train), test)`` over folds; a group on both sides raises."""
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    parts = []
    for f in folds:
        train, test = rows.filter(F.col(fold) != f), rows.filter(F.col(fold) == f)
        held_out_apart(train, test, group)
        parts.append(score(fit(train), test))
    return reduce(DataFrame.unionByName, parts)


def promotion_gate(rows: DataFrame, group: str, challenger: str, incumbent: str) -> DataFrame:
    """Whether a challenger's loss is below the incumbent's by more than one clustered error of the paired difference."""
    paired = rows.withColumn("difference", F.col(challenger) - F.col(incumbent))
    r = sandwich_error(paired, group, "difference")
    return r.select(F.col("mean").alias("difference"), "se", (F.col("mean") + F.col("se") < 0).alias("promoted"))


def smallest_within_one_error(rows: DataFrame, candidate: str, score: str, cluster: str) -> DataFrame:
    """The smallest candidate whose mean loss is within one clustered error of the best one's."""
    by = sandwich_error(rows, cluster, score, [candidate])
    best = by.agg(F.min(F.struct("mean", F.col(candidate).alias("c"), "se")).alias("b")).select((F.col("b.mean") + F.col("b.se")).alias("limit"), F.col("b.c").alias("best"))
    return by.crossJoin(F.broadcast(best)).filter(F.col("mean") <= F.col("limit")).groupBy("best").agg(F.min(candidate).alias("selected"))


def thinned(draws: DataFrame, draw: str, keep: int, seed: int) -> DataFrame:
    """``keep`` draws by the order of their hashes, renumbered from 1; ``source_draw`` remembers which they were."""
    from pyspark.sql import Window

    from stakewise.operators.resample import hashed

    ids = draws.select(draw).distinct().orderBy(hashed(F.lit(seed), F.col(draw)), draw).limit(keep)
    numbered = ids.withColumn("__i", F.row_number().over(Window.orderBy(draw)))
    return draws.join(numbered, draw).withColumnRenamed(draw, "source_draw").withColumnRenamed("__i", draw)


def selected_density(grid: DataFrame, by: list[str], weight: str, chance: str) -> DataFrame:
    """Density of the margins of chosen rows: f * pi / E[pi], with E[pi] as ``rate``; sums to one in each group."""
    totals = grid.groupBy(*by).agg(F.sum(F.col(weight) * F.col(chance)).alias("rate"))
    return grid.join(totals, by).withColumn("selected", F.when(F.col("rate") > 0, F.col(weight) * F.col(chance) / F.col("rate")))
