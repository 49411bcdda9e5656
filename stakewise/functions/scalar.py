"""Row-local expressions: calls, counts, geometry, eligibility, stakes and probabilities.

Null rules: ``is_true`` reads null as false, ``if_else`` gives null for a null test, and a plain CASE falls through.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The zone, the ball, and the tolerance around the zone's edge.
HALF_WIDTH_FT = 17 / 24
BALL_RADIUS_IN = 1.45
SENSITIVITY_IN = 0.25
REGULATION_INNINGS = 9
OUTS_PER_INNING = 6
#: Right-closed score breaks and their labels.
SCORE_BREAKS = (-5, -3, -2, -1, 0, 1, 2, 4)
SCORE_LABELS = ("<=-5", "-4:-3", "-2", "-1", "0", "1", "2", "3:4", ">=5")
#: Families of pitch types; others are "other".
PITCH_FAMILIES = {"fastball": ["FF", "FA", "SI", "FC"], "breaking": ["SL", "ST", "SV", "CU", "KC", "CS"], "offspeed": ["CH", "FS", "FO", "SC"]}


#: Why a row is not eligible.
MISMATCH, UNTRACKED, POSITION_PLAYER, OTHER_REVIEW = "statcast_identity_mismatch", "missing_tracking", "position_player_pitching", "same_pitch_non_abs_review"


def is_true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def if_else(test: Column, yes, no) -> Column:
    return F.when(test.isNull(), None).when(test, yes).otherwise(no)


def normal_call(code: Column, description: Column) -> Column:
    words = F.lower(description)
    return F.when(code == "C", "called_strike").when(code == "B", "ball").when(words == "called strike", "called_strike").when(words == "ball", "ball")


def opposite_call(call: Column) -> Column:
    return F.when(call == "ball", "called_strike").when(call == "called_strike", "ball")


def right_closed(value: Column, breaks: tuple, labels: tuple) -> Column:
    """The label of the first break that is at least ``value``; the last label beyond all; null for null."""
    chain = reduce(lambda c, b: c.when(value <= b[0], b[1]), zip(breaks, labels, strict=False), F.when(value.isNull(), None))
    return chain.otherwise(labels[-1])


def score_bucket(difference: Column) -> Column:
    return right_closed(difference, SCORE_BREAKS, SCORE_LABELS)


def occupied(base: Column) -> Column:
    return F.coalesce(base != 0, F.lit(False)).cast("int")


def base_state(first: Column, second: Column, third: Column) -> Column:
    """Three bits, first base first."""
    return F.concat(*[occupied(b).cast("string") for b in (first, second, third)])


def rectangle_distance(x: Column, z: Column, low: Column, high: Column, half_width: float = HALF_WIDTH_FT) -> Column:
    """Signed distance to a rectangle: Euclidean at the corners, negative inside."""
    qx, qz = F.abs(x) - half_width, F.greatest(low - z, z - high)
    out = F.sqrt(F.pow(F.greatest(qx, F.lit(0.0)), 2) + F.pow(F.greatest(qz, F.lit(0.0)), 2)) + F.least(F.greatest(qx, qz), F.lit(0.0))
    return F.when(x.isNull() | z.isNull() | low.isNull() | high.isNull(), None).otherwise(out)


def edge_distance_inches(x: Column, z: Column, low: Column, high: Column) -> Column:
    return rectangle_distance(x, z, low, high) * 12 - BALL_RADIUS_IN


def zone_call(edge: Column) -> Column:
    """The edge itself is a strike."""
    return F.when(edge <= 0, "called_strike").when(edge > 0, "ball")


def adverse_role(call: Column) -> Column:
    return F.when(call == "called_strike", "offense").when(call == "ball", "defense")


def correctable(zone: Column, call: Column) -> Column:
    return is_true(zone != call)


def near_edge(edge: Column, within: float = SENSITIVITY_IN) -> Column:
    return is_true(F.abs(edge) <= within)


def exclusion_reason(identity: Column, tracking: Column, position_code: Column, other_review: Column, game_reason: Column, manual_reason: Column) -> Column:
    """Why a row is not eligible, or null; manual reasons override those of games, and so on down the list."""
    code = F.trim(position_code)
    position = F.when(is_true((code != "") & ~code.isin("1", "Y")), POSITION_PLAYER)
    review = F.when(is_true(other_review), OTHER_REVIEW)
    base = F.when(~identity, MISMATCH).when(~tracking, UNTRACKED)
    return F.coalesce(manual_reason, game_reason, review, position, base)


def challenger_role(player: Column, batter: Column, pitcher: Column) -> Column:
    return F.when(player == batter, "batter").when(player == pitcher, "pitcher").otherwise("catcher")


def opportunity_status(can_correct: Column, challenged: Column, inventory: Column) -> Column:
    return F.when(~can_correct, "not_correctable").when(challenged, "challenged").when(inventory > 0, "missed_available").when(inventory == 0, "out_of_challenges").otherwise("unknown")


def pitch_family(kind: Column) -> Column:
    return reduce(lambda c, f: c.when(kind.isin(PITCH_FAMILIES[f]), f), PITCH_FAMILIES, F.when(F.lit(False), "")).otherwise("other")


def out_index(inning: Column, bottom: Column, outs: Column) -> Column:
    return (inning - 1) * OUTS_PER_INNING + F.when(bottom, 3).otherwise(0) + outs


def stage(index: Column) -> Column:
    """Extra innings fold onto one."""
    last = REGULATION_INNINGS * OUTS_PER_INNING
    return F.when(index < last, index).otherwise(last + (index - last) % OUTS_PER_INNING)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def inverse_softplus(y: Column) -> Column:
    return y + F.log(-F.expm1(-y))


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps)
    return F.log(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(outcome: Column, p: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps)
    return -F.when(outcome, F.log(q)).otherwise(F.log(1 - q))


def break_even(gain: Column, loss: Column) -> Column:
    """The least chance of success worth a challenge: loss / (gain + loss), null where nothing is at stake."""
    return F.when(gain + loss > 0, loss / (gain + loss))


def width_parts(kappa: Column, width: Column) -> tuple[Column, Column]:
    """(sensory, action) widths: kappa * w and w * sqrt(1 - kappa^2)."""
    return kappa * width, width * F.sqrt(1 - kappa * kappa)


def expected_inventory_loss(rate: Column, value: Column, inventory: Column) -> Column:
    """What a spent challenge is expected to cost when chances come at ``rate``: its first or second unit's use."""
    rate, value = F.greatest(rate, F.lit(0.0)), F.greatest(value, F.lit(0.0))
    mean = F.when(rate > 1e-10, value / rate).otherwise(0.0)
    return mean * F.when(inventory <= 1, 1 - F.exp(-rate)).otherwise(1 - F.exp(-rate) * (1 + rate))


def reliability_tier(opportunities: Column, challenges: Column) -> Column:
    high, moderate = (opportunities >= 250) & (challenges >= 10), (opportunities >= 100) & (challenges >= 3)
    return F.when(high, "high").when(moderate, "moderate").otherwise("limited")


def fallback_reason(opportunities: Column, challenges: Column) -> Column:
    return F.when(challenges == 0, "no_observed_challenges").when(opportunities < 50, "fewer_than_50_opportunities").otherwise("hierarchical_partial_pooling")


def margin_success(role: Column, margin: Column) -> Column:
    """A margin of zero belongs to the strike region."""
    return F.when(role == "offense", margin > 0).when(role == "defense", margin >= 0)


def margin_bin(margin: Column, width: float) -> Column:
    """Half-open bins with zero as an edge; values within 1e-10 of an edge snap to it; exactly zero is in bin -1."""
    scaled = margin / width
    snapped = F.when(F.abs(scaled - F.rint(scaled)) < 1e-10, F.rint(scaled)).otherwise(scaled)
    return F.when(margin == 0, -1).otherwise(F.floor(snapped)).cast("int")


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / 2.5066282746310002


def normal_cdf(x: Column) -> Column:
    """Phi as whole-stage code: a fifth-degree polynomial in 1 / (1 + p |x|), within 8e-8 of the exact value.

    The coefficients are the published fixed values of this approximation.
    """
    t = 1 / (1 + F.abs(x) * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = normal_density(x) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def orthant_nodes(panels: int = 12, points: int = 8) -> list[tuple[float, float]]:
    """Nodes and weights on [0, 1]: Gauss-Legendre panels that halve towards 1, where near-perfect correlations need them."""
    x, w = np.polynomial.legendre.leggauss(points)
    ends = [1 - 0.5**i for i in range(panels)] + [1.0]
    return [(float(a + (b - a) * (t + 1) / 2), float((b - a) * v / 2)) for a, b in zip(ends[:-1], ends[1:], strict=True) for t, v in zip(x, w, strict=True)]


def orthant(h: Column, k: Column, rho: Column) -> Column:
    """P(X > h, Y > k) of standard normals with correlation ``rho``: independence plus the integral of the density over
    correlations from 0 to ``rho``, in the arc sine of the correlation. Perfect correlations have their limits."""
    nodes = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in orthant_nodes()])
    arc = F.asin(rho)

    def add(total: Column, n: Column) -> Column:
        s = F.sin(arc * n["t"])
        return total + n["w"] * F.exp(-(h * h + k * k - 2 * h * k * s) / (2 * (1 - s * s)))

    inner = normal_cdf(-h) * normal_cdf(-k) + arc * F.aggregate(nodes, F.lit(0.0), add) / (2 * math.pi)
    return F.when(rho >= 1, normal_cdf(-F.greatest(h, k))).when(rho <= -1, F.greatest(normal_cdf(-h) - normal_cdf(k), F.lit(0.0))).otherwise(inner)


def signal_probability(margin: Column, threshold: Column, sigma: Column) -> Column:
    """P(signal above threshold | margin) = Phi((m - r) / s); -Inf always acts, +Inf never, s = 0 compares."""
    inf = float("inf")
    return F.when(threshold == -inf, 1.0).when(threshold == inf, 0.0).when(sigma == 0, (margin > threshold).cast("double")).otherwise(normal_cdf((margin - threshold) / sigma))


def composite_key(*parts: Column, separator: str = "|") -> Column:
    return F.concat_ws(separator, *[p.cast("string") for p in parts])


def key_part(key: Column, place: int, separator: str = "|") -> Column:
    return F.split(key, f"[{separator}]")[place]


def first_or(values: Column, default) -> Column:
    """The first element of an array, or a default for empty and null ones."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(default))
