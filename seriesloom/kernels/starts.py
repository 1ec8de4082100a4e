"""Start values for ARMA fits, and a simplex search that polishes them, for batches as in :mod:`arma`."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def burg(w: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """[B, order] autoregressive coefficients and the variances left, of rows [B, T] less their means, by Burg's recursion.

    A row without variance has zeros. order must be less than T.
    """
    n, steps = w.shape
    if not 0 <= order < steps:
        raise ValueError("the order must be less than the length")
    ahead = w - w.mean(1, keepdims=True)
    behind, phi, left = ahead.copy(), np.zeros((n, order)), (ahead**2).mean(1)
    for k in range(order):
        f, b = ahead[:, 1:], behind[:, :-1]
        power = (f * f).sum(1) + (b * b).sum(1)
        reflected = np.where(power > 0, 2 * (f * b).sum(1) / np.where(power > 0, power, 1), 0.0)[:, None]
        phi[:, :k] -= reflected * phi[:, :k][:, ::-1].copy()
        phi[:, k] = reflected[:, 0]
        ahead, behind = f - reflected * b, b - reflected * f
        left = left * (1 - reflected[:, 0] ** 2)
    return phi, left


def lagged(w: np.ndarray, count: int, first: int) -> np.ndarray:
    """[B, T - first, count]: the values 1 to count steps before each of those from first on."""
    steps = w.shape[1]
    return np.stack([w[:, first - i : steps - i] for i in range(1, count + 1)], 2) if count else np.zeros((len(w), steps - first, 0))


def hannan_rissanen(w: np.ndarray, p: int, q: int, sp: int = 0, sq: int = 0, m: int = 1) -> np.ndarray | None:
    """[B, p + q + sp + sq] coefficients by least squares on past values and on residuals of a long autoregression.

    The long order is max(p + q + 1, ceil(ln T)), counting the seasonal lags in p and q, at most T / 4. None if T is too short.
    """
    ar, ma = [*range(1, p + 1), *(m * i for i in range(1, sp + 1))], [*range(1, q + 1), *(m * i for i in range(1, sq + 1))]
    steps, count = w.shape[1], len(ar) + len(ma)
    reach, back = max(ar, default=0), max(ma, default=0)
    long = min(max(reach + back + 1, int(np.ceil(np.log(max(steps, 1))))), steps // 4) if ma else 0
    first = max(reach, long + back)
    if steps - first <= count + 1:
        return None
    z = w - w.mean(1, keepdims=True)
    e = np.zeros_like(z)
    if ma:
        e[:, long:] = z[:, long:] - np.einsum("btk,bk->bt", lagged(z, long, long), burg(z, long)[0])
    design = np.concatenate([lagged(z, reach, first)[:, :, [i - 1 for i in ar]], lagged(e, back, first)[:, :, [i - 1 for i in ma]]], 2)
    found = np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(design, z[:, first:], strict=True)])
    a, b = len(ar), len(ar) + q
    return np.concatenate([found[:, :p], found[:, a:b], found[:, p:a], found[:, b:]], 1)


def unconstrained(coefficients: np.ndarray, sign: float = -1.0, most: float = 2.0) -> np.ndarray:
    """Numbers that :func:`arma.stationary` turns into the coefficients; those of unstable rows are drawn inside, to most."""
    a, out = coefficients.copy(), np.zeros_like(coefficients)
    for k in range(coefficients.shape[1] - 1, -1, -1):
        r = np.clip(a[:, k], -np.tanh(most), np.tanh(most))
        out[:, k] = np.arctanh(r)
        head = a[:, :k]
        a[:, :k] = (head - sign * r[:, None] * head[:, ::-1]) / (1 - r[:, None] ** 2)
    return out


def simplex(f: Callable, x: np.ndarray, size: float = 0.1, rounds: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Nelder and Mead's search for each row of x at once; f as in :func:`arma.minimize`. Never worse than x."""
    s, k = x.shape
    rows = np.arange(s)
    if k == 0:
        return x, f(x, rows)
    corners = np.repeat(x[:, None], k + 1, 1)
    corners[:, 1:] += size * np.eye(k)

    def value(points: np.ndarray, at: np.ndarray) -> np.ndarray:
        return f(points.reshape(-1, k), np.repeat(at, points.shape[1])).reshape(len(at), -1)

    v = value(corners, rows)
    for _ in range(rounds):
        by = np.argsort(v, 1, kind="stable")
        v, corners = np.take_along_axis(v, by, 1), np.take_along_axis(corners, by[:, :, None], 1)
        at = np.flatnonzero(v[:, -1] - v[:, 0] > tol * (1 + np.abs(v[:, 0])))
        if not len(at):
            break
        worst, middle = corners[at, -1], corners[at, :-1].mean(1)
        tried = np.stack([middle + t * (middle - worst) for t in (1.0, 2.0, 0.5, -0.5)], 1)
        got = value(tried, at)
        over = got[:, 0] < v[at, 0]
        pick = np.where(over, np.where(got[:, 1] < got[:, 0], 1, 0), np.where(got[:, 0] < v[at, -2], 0, np.where(got[:, 0] < v[at, -1], 2, 3)))
        best = got[np.arange(len(at)), pick]
        better = best < np.where(pick == 2, got[:, 0], v[at, -1])
        i = at[better]
        corners[i, -1], v[i, -1] = tried[np.arange(len(at)), pick][better], best[better]
        j = at[~better]
        if len(j):
            corners[j, 1:] = (corners[j, 1:] + corners[j, :1]) / 2
            v[j, 1:] = value(corners[j, 1:], j)
    best = v.argmin(1)
    return corners[rows, best], v[rows, best]
