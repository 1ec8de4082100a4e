"""Unit-root regressions and seasonal strength of single series, in numpy."""

from __future__ import annotations

import math

import numpy as np

# Critical values of the KPSS test round a level and their levels.
KPSS_LEVEL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)
# Dickey-Fuller critical values by sample size (rows) and level (columns), without and with a trend.
SIZES = (25, 50, 100, 250, 500, 100000)
LEVELS = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
DRIFT = (
    (-3.75, -3.33, -3.00, -2.63, -0.37, 0.00, 0.34, 0.72),
    (-3.58, -3.22, -2.93, -2.60, -0.40, -0.03, 0.29, 0.66),
    (-3.51, -3.17, -2.89, -2.58, -0.42, -0.05, 0.26, 0.63),
    (-3.46, -3.14, -2.88, -2.57, -0.42, -0.06, 0.24, 0.62),
    (-3.44, -3.13, -2.87, -2.57, -0.43, -0.07, 0.24, 0.61),
    (-3.43, -3.12, -2.86, -2.57, -0.44, -0.07, 0.23, 0.60),
)
TREND = (
    (-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15),
    (-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24),
    (-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28),
    (-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31),
    (-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32),
    (-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33),
)
# Those of the coefficient form with a trend.
ALPHA = (
    (-22.5, -19.9, -17.9, -15.6, -3.66, -2.51, -1.53, -0.43),
    (-25.7, -22.4, -19.8, -16.8, -3.71, -2.60, -1.66, -0.65),
    (-27.4, -23.6, -20.7, -17.5, -3.74, -2.62, -1.73, -0.75),
    (-28.4, -24.4, -21.3, -18.0, -3.75, -2.64, -1.78, -0.82),
    (-28.9, -24.8, -21.5, -18.1, -3.76, -2.65, -1.78, -0.84),
    (-29.5, -25.1, -21.8, -18.3, -3.77, -2.66, -1.79, -0.87),
)


def dickey_fuller_p(stat: float, n: int, trend: bool) -> float:
    """The level of a statistic: linear in the sample size, then in the statistic, and cut off at the table's ends."""
    return table_p(stat, n, TREND if trend else DRIFT)


def table_p(stat: float, n: int, values: tuple) -> float:
    table = np.array(values)
    row = [np.interp(n, SIZES, column) for column in table.T]
    return float(np.interp(stat, row, LEVELS))


def regress(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their standard errors and the residuals."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    spread = np.linalg.pinv(x.T @ x).diagonal() * (e @ e) / max(len(y) - x.shape[1], 1)
    return beta, np.sqrt(np.maximum(spread, 0)), e


def adf(y: np.ndarray, lags: int | None = None, trend: bool = False) -> tuple[float, float]:
    """Statistic and level of the augmented Dickey-Fuller test; lags defaults to the cube root of n - 1."""
    k = int((len(y) - 1) ** (1 / 3)) if lags is None else lags
    d = np.diff(y)
    rows = np.arange(k, len(d))
    x = [np.ones(len(rows)), y[rows], *([rows + 1.0] if trend else []), *(d[rows - j] for j in range(1, k + 1))]
    beta, error, _ = regress(np.stack(x, 1), d[rows])
    stat = float(beta[1] / error[1])
    return stat, dickey_fuller_p(stat, len(d), trend)


def long_run(e: np.ndarray, lags: int) -> float:
    n = len(e)
    return float(e @ e / n + sum(2 / n * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1)))


def pp(y: np.ndarray, trend: bool = False, short: bool = True) -> tuple[float, float]:
    """Statistic and level of the Phillips-Perron test in its t form."""
    now, before = y[1:], y[:-1]
    n = len(now)
    x = [np.ones(n), *([np.arange(1, n + 1) - n / 2] if trend else []), before]
    beta, error, e = regress(np.stack(x, 1), now)
    inner, outer = float(e @ e / n), long_run(e, int((4 if short else 12) * (n / 100) ** 0.25))
    stat = math.sqrt(inner / outer) * (beta[-1] - 1) / error[-1] - (outer - inner) * math.sqrt(n) * error[-1] / (2 * math.sqrt(outer * inner))
    return float(stat), dickey_fuller_p(float(stat), n, trend)


def levels_of(stat: np.ndarray, n: int, trend: bool) -> np.ndarray:
    """Levels of the statistics of many series of one length."""
    table = np.array(TREND if trend else DRIFT)
    return np.interp(stat, [np.interp(n, SIZES, column) for column in table.T], LEVELS)


def regress_batch(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As regress, for [B, T, k] and [B, T]."""
    from seriesloom.kernels.seasonal import ols

    beta, e, inverse = ols(x, y)
    spread = np.diagonal(inverse, axis1=1, axis2=2) * (e * e).sum(1, keepdims=True) / max(y.shape[1] - x.shape[2], 1)
    return beta, np.sqrt(np.maximum(spread, 0)), e


def adf_batch(y: np.ndarray, lags: int | None = None, trend: bool = False) -> np.ndarray:
    """[B, 2]: as adf, for series of one length."""
    k = int((y.shape[1] - 1) ** (1 / 3)) if lags is None else lags
    d = np.diff(y)
    rows = np.arange(k, d.shape[1])
    if len(rows) < k + 3 + trend:
        return np.full((len(y), 2), np.nan)
    ones = np.ones((len(y), len(rows)))
    x = [ones, y[:, rows], *([ones * (rows + 1.0)] if trend else []), *(d[:, rows - j] for j in range(1, k + 1))]
    beta, error, _ = regress_batch(np.stack(x, 2), d[:, rows])
    with np.errstate(all="ignore"):
        stat = beta[:, 1] / error[:, 1]
    return np.stack([stat, levels_of(stat, d.shape[1], trend)], 1)


def pp_batch(y: np.ndarray, trend: bool = False, short: bool = True) -> np.ndarray:
    """[B, 2]: as pp, for series of one length."""
    now, before = y[:, 1:], y[:, :-1]
    n = now.shape[1]
    if n < 4:
        return np.full((len(y), 2), np.nan)
    ones = np.ones_like(now)
    beta, error, e = regress_batch(np.stack([ones, *([ones * (np.arange(1, n + 1) - n / 2)] if trend else []), before], 2), now)
    lags = int((4 if short else 12) * (n / 100) ** 0.25)
    inner = (e * e).sum(1) / n
    outer = inner + sum((2 / n * (1 - k / (lags + 1)) * (e[:, k:] * e[:, :-k]).sum(1) for k in range(1, lags + 1)), np.zeros(len(y)))
    with np.errstate(all="ignore"):
        stat = np.sqrt(inner / outer) * (beta[:, -1] - 1) / error[:, -1] - (outer - inner) * math.sqrt(n) * error[:, -1] / (2 * np.sqrt(outer * inner))
    return np.stack([stat, levels_of(stat, n, trend)], 1)


def pp_alpha(y: np.ndarray, short: bool = True) -> tuple[float, float]:
    """Statistic and level of the Phillips-Perron test in its coefficient form, with a trend."""
    now, before = y[1:], y[:-1]
    n = len(now)
    x = np.stack([np.ones(n), np.arange(1, n + 1) - n / 2, before], 1)
    beta, _, e = regress(x, now)
    inner, outer = float(e @ e / n), long_run(e, int((4 if short else 12) * (n / 100) ** 0.25))
    # n^6 / (24 D) with D the determinant of the moments of 1, t and the lagged series, which is that of X'X n / 12 times n (n² - 1)
    detrended = before - np.polyval(np.polyfit(np.arange(n), before, 1), np.arange(n))
    moment = n * n * (n * n - 1) / 12 * float(detrended @ detrended)
    stat = n * (beta[-1] - 1) - n**6 / (24 * moment) * (outer - inner)
    return float(stat), table_p(float(stat), n, ALPHA)


def kpss(y: np.ndarray, lag: int) -> float:
    """The level statistic with Bartlett weights."""
    e, n = y - y.mean(), len(y)
    spread = long_run(e, min(lag, n - 1))
    return float((np.cumsum(e) ** 2).sum() / n**2 / spread) if spread > 0 else float("nan")


def n_diffs(y: np.ndarray, most: int = 2, alpha: float = 0.05, test: str = "kpss") -> int:
    """How often to difference until the test (kpss, adf or pp) is content; a constant is."""
    for d in range(most):
        if len(y) < 4 or np.ptp(y) == 0:
            return d
        if test == "kpss":
            stat = kpss(y, max(1, int(3 * np.sqrt(len(y)) / 13)))
            need = np.interp(stat, KPSS_LEVEL, KPSS_P) < alpha
        else:
            need = {"adf": adf, "pp": pp}[test](y)[1] > alpha
        if not need:
            return d
        y = np.diff(y)
    return most


def moving_average(x: np.ndarray, k: int) -> np.ndarray:
    """NaN where the window doesn't fit or holds a NaN; the window starts k // 2 before."""
    out = np.full(len(x), np.nan)
    if len(x) >= k:
        out[k // 2 : k // 2 + len(x) - k + 1] = np.lib.stride_tricks.sliding_window_view(x, k).mean(1)
    return out


def to_edges(x: np.ndarray) -> np.ndarray:
    """The first and last values carried to the ends."""
    at = np.flatnonzero(~np.isnan(x))
    return np.where(np.isnan(x), np.interp(np.arange(len(x)), at, x[at]), x) if len(at) else np.zeros(len(x))


def smooth_phase(x: np.ndarray, window: int) -> np.ndarray:
    """Weighted means with tricube weights, whose reach is the longer side of the window that fits."""
    at = np.arange(len(x))
    lo, hi = np.maximum(at - window // 2, 0), np.minimum(at + window // 2, len(x) - 1)
    reach = np.maximum(np.maximum(at - lo, hi - at), 1)
    gap = np.abs(at[None] - at[:, None])
    weight = np.where((at >= lo[:, None]) & (at <= hi[:, None]), np.maximum(1 - (gap / reach[:, None]) ** 3, 0) ** 3, 0.0)
    return weight @ x / weight.sum(1)


def stl(y: np.ndarray, m: int, window: int = 11, trend_window: int | None = None, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and remainder of the simplified decomposition."""
    wide = trend_window or int(math.ceil(1.5 * m / (1 - 1.5 / window))) // 2 * 2 + 1
    trend = np.zeros(len(y))
    for _ in range(rounds):
        cycle = np.empty(len(y))
        for phase in range(m):
            cycle[phase::m] = smooth_phase((y - trend)[phase::m], window)
        seasonal = cycle - to_edges(moving_average(moving_average(moving_average(cycle, m), m), 3))
        trend = to_edges(moving_average(y - seasonal, wide))
    return trend, seasonal, y - trend - seasonal


def seasonal_strength(y: np.ndarray, m: int) -> float:
    if m < 2 or len(y) < 2 * m:
        return 0.0
    _, s, e = stl(y, m)
    whole = (s + e).var(ddof=1)
    return float(np.clip(1 - e.var(ddof=1) / whole, 0, 1)) if whole else 0.0
