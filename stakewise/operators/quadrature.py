"""Means of a function over the upper tail of a normal, row by row, with errors, by adaptive quadrature in tasks.

A batch of rows is one work list of intervals. Each round applies a 15-point Kronrod rule and its embedded 7-point Gauss
rule to all intervals at once and halves those where the two disagree by more than their row can bear. Densities are taken
relative to that at the lower end, so far tails neither vanish nor lose figures.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The non-negative nodes of the Gauss-Kronrod pair (7, 15), the weights of the 15 and those of the 7 (0 where
#: the node is not one of theirs).
KRONROD = [
    (0.991455371120812639206854697526329, 0.022935322010529224963732008058970, 0.0),
    (0.949107912342758524526189684047851, 0.063092092629978553290700663189204, 0.129484966168869693270611432679082),
    (0.864864423359769072789712788640926, 0.104790010322250183839876322541518, 0.0),
    (0.741531185599394439863864773280788, 0.140653259715525918745189590510238, 0.279705391489276667901467771423780),
    (0.586087235467691130294144691693013, 0.169004726639267902826583426598550, 0.0),
    (0.405845151377397166906606412076961, 0.190350578064785409913256402421014, 0.381830050505118944950369775488975),
    (0.207784955007898467600689403773245, 0.204432940075298892414161999234649, 0.0),
    (0.000000000000000000000000000000000, 0.209482141084727828012999174891714, 0.417959183673469387755102040816327),
]
_POSITIVE = np.array(KRONROD[:7])
NODES = np.concatenate([-_POSITIVE[:, 0], [0.0], _POSITIVE[::-1, 0]])
WIDE, NARROW = (np.concatenate([_POSITIVE[:, i], [KRONROD[7][i]], _POSITIVE[::-1, i]]) for i in (1, 2))
#: Standard deviations after which a tail counts as nothing, and halvings at most.
REACH, DEEPEST = 9.0, 40
#: How many times the rules' disagreement counts as the error: at bends it may fall short of what the finer rule misses.
CAUTION = 20.0
#: Intervals that each row starts with; a bend narrower than some thousandth of one can be missed by both rules.
PANELS = 32


def tail_means(f: Callable[[np.ndarray], np.ndarray], threshold: np.ndarray, mean: np.ndarray, sd: np.ndarray, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """E[f(X) | X > threshold] of normals, and cautious estimates of the errors, for arrays of cases.

    Not a number where nothing lies above: an infinite threshold, or no spread and a mean not above it. Without spread the
    value is f(mean); a threshold of minus infinity leaves the whole normal.
    """
    threshold, mean, sd = (np.asarray(x, float) for x in (threshold, mean, sd))
    value, error = np.full(len(mean), np.nan), np.full(len(mean), np.nan)
    point = (sd == 0) & (mean > threshold)
    value[point], error[point] = f(mean[point]), 0.0
    live = np.flatnonzero((sd > 0) & (threshold < np.inf))
    start = np.maximum((threshold[live] - mean[live]) / sd[live], -REACH)
    # beyond the start the density falls at least as exp(-start * t - t^2 / 2)
    end = np.where(start > 0, start + np.minimum(REACH, 45 / np.maximum(start, 1e-300)), REACH)
    top, mass, bound = np.zeros(len(live)), np.zeros(len(live)), np.zeros(len(live))
    case, steps = np.repeat(np.arange(len(live)), PANELS), np.tile(np.arange(PANELS), len(live))
    low, high = (start[case] + (end - start)[case] * (steps + i) / PANELS for i in (0, 1))
    peak = np.maximum(start, 0) ** 2
    for depth in range(DEEPEST + 1):
        if not len(case):
            break
        half = (high - low) / 2
        z = (low + half)[:, None] + half[:, None] * NODES
        weight = np.exp(-(z * z - peak[case][:, None]) / 2)
        g = weight * f(mean[live][case][:, None] + sd[live][case][:, None] * z)
        whole, part = half * (g @ WIDE), half * (g @ NARROW)
        share = half * (weight @ WIDE)
        off = np.abs(whole - part) + np.abs(share - half * (weight @ NARROW))
        # an interval may take its part, by length, of what the row's mean can bear
        fine = (off <= tolerance * np.maximum((high - low) / (end - start)[case], 1e-3) * np.minimum(1, 1 / np.maximum(peak[case], 1) ** 0.5)) | (depth == DEEPEST)
        for total, x in ((top, whole), (mass, share), (bound, off)):
            np.add.at(total, case[fine], x[fine])
        rest = ~fine
        middle = (low + half)[rest]
        case, low, high = np.concatenate([case[rest]] * 2), np.concatenate([low[rest], middle]), np.concatenate([middle, high[rest]])
    value[live], error[live] = top / mass, CAUTION * bound / mass
    return value, error


def with_tail_means(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], threshold: Column, mean: Column, sd: Column, out: str = "chosen", tolerance: float = 1e-9) -> DataFrame:
    """``rows`` with ``out`` and ``out``_error; null where a number is missing or nothing lies above the threshold."""

    @F.pandas_udf("value double, error double")
    def means(t: pd.Series, m: pd.Series, s: pd.Series) -> pd.DataFrame:
        value, error = tail_means(f, *(x.to_numpy(float, na_value=np.nan) for x in (t, m, s)), tolerance)
        return pd.DataFrame({"value": pd.Series(value).astype(object).where(~np.isnan(value), None), "error": pd.Series(error).astype(object).where(~np.isnan(error), None)})

    found = rows.withColumn("__found", means(threshold.cast("double"), mean.cast("double"), sd.cast("double")))
    return found.withColumns({out: F.col("__found.value"), f"{out}_error": F.col("__found.error")}).drop("__found")
