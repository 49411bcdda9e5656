"""Numeric kernels on small arrays: quadrature, orthants, splines, lookups. Plain numpy, used inside tasks or on tables."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)
#: Coefficients of Cody's rational approximations to erf and erfc, highest terms first.
ERF_NEAR = ([1.85777706184603153e-1, 3.16112374387056560, 113.864154151050156, 377.485237685302021, 3209.37758913846947], [1.0, 23.6012909523441209, 244.024637934444173, 1282.61652607737228, 2844.23683343917062])
ERFC_MIDDLE = ([2.15311535474403846e-8, 0.564188496988670089, 8.88314979438837594, 66.1191906371416295, 298.635138197400131, 881.952221241769090, 1712.04761263407058, 2051.07837782607147, 1230.33935479799725], [1.0, 15.7449261107098347, 117.693950891312499, 537.181101862009858, 1621.38957456669019, 3290.79923573345963, 4362.61909014324716, 3439.36767414372164, 1230.33935480374942])
ERFC_FAR = ([1.63153871373020978e-2, 0.305326634961232344, 0.360344899949804439, 0.125781726111229246, 1.60837851487422766e-2, 6.58749161529837803e-4], [1.0, 2.56852019228982242, 1.87295284992346725, 0.527905102951428412, 6.05183413124413191e-2, 2.33520497626869185e-3])


def phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function to full precision."""
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / 2**0.5), float)


def horner(terms: list[float], x: np.ndarray) -> np.ndarray:
    """A polynomial, highest term first."""
    out = np.full_like(x, terms[0])
    for term in terms[1:]:
        out *= x
        out += term
    return out


def quick_phi(x: np.ndarray) -> np.ndarray:
    """``phi`` of one long array without a call a value, to twelve figures."""
    z = np.asarray(x, float) * -(0.5**0.5)
    y = np.abs(z)
    out = np.full_like(z, np.nan)
    for some, parts in ((y <= 0.46875, ERF_NEAR), ((y > 0.46875) & (y <= 4), ERFC_MIDDLE), (y > 4, ERFC_FAR)):
        at = np.flatnonzero(some)
        if not len(at):
            continue
        v = y[at]
        if parts is ERF_NEAR:
            out[at] = 0.5 - 0.5 * z[at] * horner(parts[0], v * v) / horner(parts[1], v * v)
            continue
        if parts is ERFC_MIDDLE:
            tail = horner(parts[0], v) / horner(parts[1], v)
        else:
            w = 1 / (v * v)
            tail = (math.pi**-0.5 - w * horner(parts[0], w) / horner(parts[1], w)) / v
        tail *= 0.5 * np.exp(-v * v)
        out[at] = np.where(z[at] > 0, tail, 1 - tail)
    return out


def density(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.square(x) / 2) / 2.5066282746310002


#: Coefficients of Wichura's rational approximations (algorithm AS 241, seven figures), constant terms first.
INVERSE_MIDDLE = ([3.3871327179, 50.434271938, 159.29113202, 59.109374720], [1.0, 17.895169469, 78.757757664, 67.187563600])
INVERSE_TAIL = ([1.4234372777, 2.7568153900, 1.3067284816, 0.17023821103], [1.0, 0.73700164250, 0.12021132975])
INVERSE_FAR = ([6.6579051150, 3.0812263860, 0.42868294337, 0.017337203997], [1.0, 0.24197894225, 0.012258202635])


def inverse_phi(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal for 0 < p < 1, to about seven figures."""
    p = np.asarray(p, float)
    ratio = lambda parts, x: horner(parts[0][::-1], x) / horner(parts[1][::-1], x)
    q = (p - 0.5).ravel()
    out = np.empty_like(q)
    middle = np.abs(q) <= 0.425
    near = q[middle]
    out[middle] = near * ratio(INVERSE_MIDDLE, 0.180625 - near * near)
    beyond = np.flatnonzero(~middle)
    r = np.sqrt(-np.log(np.minimum(p.ravel()[beyond], 1 - p.ravel()[beyond])))
    tail = ratio(INVERSE_TAIL, r - 1.6)
    far = np.flatnonzero(~(r <= 5))
    tail[far] = ratio(INVERSE_FAR, r[far] - 5)
    out[beyond] = np.sign(q[beyond]) * tail
    return out.reshape(p.shape)


def legendre(low: float, high: float, n: int = 64) -> tuple[np.ndarray, np.ndarray]:
    nodes, weights = np.polynomial.legendre.leggauss(n)
    half = (high - low) / 2
    return low + half * (nodes + 1), half * weights


def orthant(a: float, b: float, rho: float, n: int = 96) -> float:
    """P(X > a, Y > b) of standard normals with correlation ``rho``: one integral over y."""
    if rho >= 1:
        return float(1 - phi(max(a, b)))
    if rho <= -1:
        return float(max(0.0, phi(-a) - phi(b)))
    low = max(b, -9.0)
    if low >= 9:
        return 0.0
    y, w = legendre(low, 9.0, n)
    return float((w * density(y) * phi((rho * y - a) / np.sqrt(1 - rho * rho))).sum())


def mean_above(q, threshold: float, mean: float, sd: float, n: int = 64) -> float:
    """Mean of ``q(signal)`` over a normal signal beyond a threshold; not a number where nothing lies beyond."""
    if threshold == np.inf or sd == 0 and mean <= threshold:
        return float("nan")
    if sd == 0:
        return float(q(np.array([mean]))[0])
    low = max(threshold, mean - 9 * sd)
    high = max(mean + 9 * sd, low + sd)
    x, w = legendre(low, high, n)
    mass = w * density((x - mean) / sd)
    return float((mass * q(x)).sum() / mass.sum()) if mass.sum() > 0 else float(q(np.array([threshold]))[0])


def positive_area(x: np.ndarray, y: np.ndarray) -> float:
    """Trapezoid integral of y over the part of x above zero; a node is set at zero where x crosses it."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if (x < 0).any() and (x > 0).any() and not (x == 0).any():
        i = np.searchsorted(x, 0)
        x, y = np.insert(x, i, 0.0), np.insert(y, i, np.interp(0, x, y))
    keep = x >= 0
    return float(np.trapezoid(y[keep], x[keep])) if keep.sum() > 1 else 0.0


def smoothed(y: np.ndarray, weight: np.ndarray, strength: float) -> np.ndarray:
    """Penalised fit on an even grid: weighted squares plus ``strength`` times squared second differences."""
    d = np.diff(np.eye(len(y)), 2, axis=0)
    return np.linalg.solve(np.diag(weight) + strength * d.T @ d + 1e-12 * np.eye(len(y)), weight * y)


def natural_spline(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strengths: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Values at x of the natural cubic smoothing spline that the generalised cross-validation score prefers among
    ``strengths`` (by default, from almost interpolating to almost straight), and its strength.

    x is strictly increasing. Second derivatives at the inner points solve a pentadiagonal system, whose eigenvectors give
    fits and traces for all strengths at once. Two points or fewer are returned as they are.
    """
    x, y, weight = (np.asarray(a, float) for a in (x, y, weight))
    n = len(x)
    if n < 3:
        return y.copy(), 0.0
    h = np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    i = np.arange(n - 2)
    q[i, i], q[i + 1, i], q[i + 2, i] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    r[i, i] = (h[:-1] + h[1:]) / 3
    r[i[:-1], i[:-1] + 1] = r[i[:-1] + 1, i[:-1]] = h[1:-1] / 6
    root = np.sqrt(weight)
    # the roughness in weighted values: its eigenvalues shrink the values' parts by 1 / (1 + strength * eigenvalue)
    rough = (q / root[:, None]) @ np.linalg.solve(r, (q / root[:, None]).T)
    values, vectors = np.linalg.eigh((rough + rough.T) / 2)
    values[:2] = 0
    parts = vectors.T @ (root * y)
    if strengths is None:
        strengths = np.geomspace(1e-3 / values[-1], 1e3 / values[2], 241)
    scores = [n * (((1 - 1 / (1 + k * values)) * parts) ** 2).sum() / max(n - (1 / (1 + k * values)).sum(), 1e-9) ** 2 for k in strengths]
    best = float(strengths[int(np.argmin(scores))])
    return vectors @ (parts / (1 + best * values)) / root, best


def b_spline(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """Basis at x for inner ``knots`` with repeated ends; columns add up to one inside."""
    t = np.concatenate([[knots[0]] * degree, knots, [knots[-1]] * degree]).astype(float)
    x = np.clip(np.asarray(x, float), t[0], t[-1])[:, None]
    basis = ((t[:-1] <= x) & (x < t[1:])).astype(float)
    basis[:, len(t) - degree - 2] += (x[:, 0] == t[-1])
    for k in range(1, degree + 1):
        left, right = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        up = np.divide(x - t[: -k - 1], left, out=np.zeros((len(x), len(left))), where=left > 0)
        down = np.divide(t[k + 1 :] - x, right, out=np.zeros((len(x), len(right))), where=right > 0)
        basis = up * basis[:, :-1] + down * basis[:, 1:]
    return basis


def stage_design(stages: np.ndarray, last: int = 54, per_inning: int = 6, inner: int = 4) -> np.ndarray:
    """One row per stage: splines over regulation, outs of the half-inning, and a flag for extra innings."""
    stages = np.asarray(stages)
    base = b_spline(np.minimum(stages, last - 1), np.linspace(0, last - 1, inner))
    outs = np.stack([(stages % (per_inning // 2) == o).astype(float) for o in (1, 2)], 1)
    return np.concatenate([base, outs, (stages >= last).astype(float)[:, None]], 1)


def payoff(gain: np.ndarray, loss: np.ndarray, look: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Threshold on the signal, and the masses of acting and of success, for stakes ``gain`` against ``loss``.

    No gain: never (an infinite threshold). No loss: always. Otherwise act where q passes loss / (gain + loss); the
    lookup's q is monotone, so the threshold is where it crosses. The advantage is never below zero, that of waiting.
    """
    gain, loss = np.asarray(gain, float), np.asarray(loss, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        wanted = loss / (gain + loss)
    q, signal = look["q"], look["signal"]
    i = np.clip(np.searchsorted(q, np.nan_to_num(wanted)), 1, len(q) - 1)
    rise = np.maximum(q[i] - q[i - 1], 1e-300)
    at = signal[i - 1] + np.clip((wanted - q[i - 1]) / rise, 0, 1) * (signal[i] - signal[i - 1])
    at = np.where(wanted > look["q"][-1], np.inf, np.where(wanted <= look["q"][0], -np.inf, at))
    at = np.where(gain <= 0, np.inf, np.where(loss <= 0, -np.inf, at))
    act, win = tail_masses(at, look)
    return {"threshold": at, "action": act, "success": win, "advantage": np.maximum(0, win * np.maximum(gain, 0) - (act - win) * np.maximum(loss, 0))}


def tail_masses(threshold: np.ndarray, look: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Chance that the signal passes each threshold, and that it does so on a wrong call."""
    out = []
    for name in ("action_tail", "success_tail"):
        inner = np.interp(threshold, look["signal"], look[name])
        out.append(np.where(threshold == np.inf, 0.0, np.where(threshold == -np.inf, look[name][0], inner)))
    return out[0], out[1]
