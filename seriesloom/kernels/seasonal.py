"""Seasonal tests and period detection in numpy, for batches: the first axis of every array is the series."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from seriesloom.kernels.unitroot import seasonal_strength

# Canova-Hansen critical values for periods 2 to 12, and for 24, 52 and 365.
CH_CRITICAL = (0.4617146, 0.7479655, 1.0007818, 1.2375350, 1.4625240, 1.6920200, 1.9043096, 2.1169602, 2.3268562, 2.5406922, 2.7391007)
CH_LONG = {24: 5.098624, 52: 10.341416, 365: 65.44445}


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients [B, k], residuals [B, T] and the inverse of X'X [B, k, k], by QR with scaled columns."""
    size = np.sqrt((x**2).sum(1, keepdims=True))
    size[size == 0] = 1
    q, r = np.linalg.qr(x / size)
    back = np.linalg.pinv(r)
    beta = (back @ (q.transpose(0, 2, 1) @ y[..., None]))[..., 0] / size[:, 0]
    inverse = back @ back.transpose(0, 2, 1) / size.transpose(0, 2, 1) / size
    return beta, y - (x @ beta[..., None])[..., 0], inverse


def lagged(x: np.ndarray, lags: range, start: int) -> np.ndarray:
    """[B, T - start, lags]: values so many places before each place from start on."""
    return np.stack([x[:, start - k : x.shape[1] - k] for k in lags], 2)


def ch_critical(m: int) -> float:
    if 2 <= m <= 12:
        return CH_CRITICAL[m - 2]
    return CH_LONG.get(m, 0.269 * m**0.928)


def canova_hansen(y: np.ndarray, m: int) -> np.ndarray:
    """[B] statistics: whether the seasonal pattern is stable. Zero where its long-run covariance is singular."""
    n, t = y.shape[1], np.arange(1, y.shape[1] + 1)
    if n <= m:
        raise ValueError("the series must be longer than the period")
    waves = np.stack([f(2 * np.pi * (j // 2 + 1) * t / m) for j, f in zip(range(m - 1), [np.cos, np.sin] * m, strict=False)], 1)
    design = np.broadcast_to(np.column_stack([np.ones(n), waves]), (len(y), n, m))
    scores = waves[:, : 2 * (m // 2) - 1] * ols(design, y)[1][..., None]
    cover = scores.transpose(0, 2, 1) @ scores
    reach = int(np.floor(m * (n / 100) ** 0.25 + 0.5))
    for k in range(1, min(reach, n - 1) + 1):
        cross = scores[:, k:].transpose(0, 2, 1) @ scores[:, :-k]
        cover = cover + (1 - k / (reach + 1)) * (cross + cross.transpose(0, 2, 1))
    cover = cover / n
    walk = np.cumsum(scores, 1)
    out = np.zeros(len(y))
    fine = np.linalg.svd(cover, compute_uv=False).min(1) >= np.finfo(float).eps
    if fine.any():
        out[fine] = np.trace(np.linalg.solve(cover[fine], walk[fine].transpose(0, 2, 1) @ walk[fine]), axis1=1, axis2=2) / n**2
    return out


def ocsb_critical(m: int) -> float:
    """Fixed constants of the published response curve in the logarithm of the period."""
    x = np.log(m) - 0.7656451
    return -0.2937411 * np.exp(-0.2850853 * x - 0.05983644 * x * x) - 1.652202


def _ocsb(y: np.ndarray, m: int, lag: int, skip: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The t statistic [B], the autoregression's sum of squares [B], and its number of rows, after skip lost rows."""
    season, step = y[:, m:] - y[:, :-m], np.diff(y)
    both = np.diff(season)
    start, ks = m + 1 + skip, range(1, lag + 1)
    rows = y.shape[1] - start
    if rows < lag + 3:
        raise ValueError("too few rows")
    target, before = both[:, skip:], lagged(both, ks, skip)
    beta, e, _ = ols(before, target)

    def filtered(x: np.ndarray) -> np.ndarray:
        return x[:, lag:] - (lagged(x, ks, lag) @ beta[..., None])[..., 0]

    z4, z5 = filtered(season), filtered(step)
    # z4 begins at time m + lag and is taken one step back; z5 begins at 1 + lag and is taken a season back
    first, second = start - 1 - m - lag, start - m - 1 - lag
    x = np.concatenate([before, z4[:, first : first + rows, None], z5[:, second : second + rows, None]], 2)
    gamma, u, inverse = ols(x, target)
    error = np.sqrt(np.maximum(inverse[:, -1, -1], 0) * (u**2).sum(1) / (rows - lag - 2))
    with np.errstate(all="ignore"):
        return gamma[:, -1] / error, (e**2).sum(1), rows


def ocsb(y: np.ndarray, m: int, most: int = 3, criterion: str | None = "aic") -> np.ndarray:
    """[B] t statistics of the Osborn-Chui-Smith-Birchenhall regression.

    With a criterion (aic, bic or aicc) the lag is one below the best of 1 to most, and 1 at least; without, it is most.
    """
    chosen = np.full(len(y), most)
    if criterion:
        values = []
        for k in range(1, most + 1):
            try:
                _, sse, rows = _ocsb(y, m, k, most)
            except ValueError:
                values.append(np.full(len(y), np.inf))
                continue
            with np.errstate(all="ignore"):
                fit = rows * (np.log(2 * np.pi * sse / rows) + 1)
            more = {"aic": 2 * k, "bic": np.log(rows) * k, "aicc": 2 * k + 2 * k * (k + 1) / (rows - k - 1) if rows > k + 1 else np.inf}[criterion]
            values.append(np.where(np.isfinite(fit), fit + more, np.inf))
        chosen = np.maximum(np.argmin(np.stack(values, 1), 1), 1)
    out = np.full(len(y), np.nan)
    for k in np.unique(chosen):
        rows = chosen == k
        try:
            out[rows] = _ocsb(y[rows], m, int(k), int(k))[0]
        except ValueError:
            pass
    return out


def _hegy_parts(m: int) -> tuple[np.ndarray, list[tuple[str, list[int]]]]:
    """Weights [m, m] of the last m values, newest first, for each frequency, and which columns each statistic tests."""
    k = np.arange(1, m + 1)
    columns, tests = [np.ones(m)], [("t_1", [0])]
    if m % 2 == 0:
        columns.append((-1.0) ** k)
        tests.append(("t_2", [1]))
    for j in range(1, (m - 1) // 2 + 1):
        at = len(columns)
        columns += [np.cos(2 * np.pi * j * k / m), -np.sin(2 * np.pi * j * k / m)]
        tests.append((f"F_{at + 1}:{at + 2}", [at, at + 1]))
    tests += [(f"F_2:{m}", list(range(1, m))), (f"F_1:{m}", list(range(m)))]
    return np.stack(columns, 1), tests


def hegy_names(m: int) -> list[str]:
    return [name for name, _ in _hegy_parts(m)[1]]


def hegy(y: np.ndarray, m: int, deterministic: str = "ct", criterion: str | None = "aic", most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """[B, statistics] in the order of :func:`hegy_names`, and the lags [B].

    deterministic: c constant, t trend, D seasonal dummies. The lag is the criterion's best of 0 to most, or most without one.
    """
    n = y.shape[1]
    if n < 4 * m:
        raise ValueError("four whole cycles are needed")
    weights, tests = _hegy_parts(m)
    windows = np.lib.stride_tricks.sliding_window_view(y, m, axis=1)[:, :-1, ::-1]
    levels, change = windows @ weights, y[:, m:] - y[:, :-m]
    t = np.arange(1, n - m + 1)
    fixed = [np.ones(len(t))] if "c" in deterministic else []
    fixed += [t.astype(float)] if "t" in deterministic else []
    fixed += [((t - 1) % m == s).astype(float) for s in range(m - 1)] if "D" in deterministic else []
    free = len(fixed)

    def regress(p: int) -> tuple[np.ndarray, np.ndarray]:
        rows = n - m - p
        parts = [np.broadcast_to(np.stack(fixed, 1)[p:], (len(y), rows, free))] if fixed else []
        parts += [levels[:, p:]] + ([lagged(change, range(1, p + 1), p)] if p else [])
        x = np.concatenate(parts, 2)
        k = x.shape[2]
        if rows <= k + 1:
            return np.full(len(y), np.inf), np.full((len(y), len(tests)), np.nan)
        beta, e, inverse = ols(x, change[:, p:])
        sse = (e**2).sum(1)
        sigma2 = sse / (rows - k)
        found = []
        with np.errstate(all="ignore"):
            for name, columns in tests:
                at = free + np.array(columns)
                b = beta[:, at]
                if name.startswith("t"):
                    found.append(b[:, 0] / np.sqrt(inverse[:, at[0], at[0]] * sigma2))
                else:
                    block = np.linalg.pinv(inverse[:, at[:, None], at[None]], hermitian=True)
                    found.append((b * (block @ b[..., None])[..., 0]).sum(1) / (len(at) * sigma2))
            score = rows * np.log(sse / rows) + k * (np.log(rows) if criterion == "bic" else 2)
        return np.where(np.isfinite(score), score, np.inf), np.stack(found, 1)

    if criterion is None:
        return regress(most)[1], np.full(len(y), most)
    tried = [regress(p) for p in range(most + 1)]
    best = np.argmin(np.stack([s for s, _ in tried], 1), 1)
    return np.stack([f for _, f in tried])[best, np.arange(len(y))], best


@lru_cache(maxsize=64)
def _hegy_null(n: int, m: int, deterministic: str, criterion: str | None, most: int, draws: int) -> np.ndarray:
    """Sorted statistics [draws, statistics] of seasonal random walks of length n, from a fixed seed."""
    shocks = np.random.Generator(np.random.Philox(key=[n, m])).normal(size=(draws, -(-n // m) * m))
    walks = np.cumsum(shocks.reshape(draws, -1, m), 1).reshape(draws, -1)[:, :n]
    return np.sort(hegy(walks, m, deterministic, criterion, most)[0], 0)


def hegy_p(y: np.ndarray, m: int, deterministic: str = "ct", criterion: str | None = "aic", most: int = 3, draws: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, levels and lags. Levels are shares of simulated seasonal random walks of the same length that are more extreme."""
    stat, lag = hegy(y, m, deterministic, criterion, most)
    null = _hegy_null(y.shape[1], m, deterministic, criterion, most, draws)
    p = np.empty_like(stat)
    for i, name in enumerate(hegy_names(m)):
        below = np.searchsorted(null[:, i], stat[:, i]) / draws
        p[:, i] = below if name.startswith("t") else 1 - below
    return stat, np.where(np.isnan(stat), np.nan, p), lag


def autoregression(y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and innovation variance by Levinson and Durbin, of the order (10 log10 n at most) of the least AIC."""
    n = len(y)
    e, most = y - y.mean(), min(int(10 * np.log10(n)), n - 1)
    g = np.array([e[k:] @ e[: n - k] for k in range(most + 1)]) / n
    if g[0] <= 0:
        return np.zeros(0), float(g[0])
    phi, v = np.zeros(0), g[0]
    best = (np.log(v) + 2 / n, phi, v)
    for k in range(1, most + 1):
        a = (g[k] - phi @ g[k - 1 : 0 : -1]) / v
        phi, v = np.append(phi - a * phi[::-1], a), v * (1 - a * a)
        if not v > 0:
            break
        best = min(best, (np.log(v) + 2 * (k + 1) / n, phi, v), key=lambda x: x[0])
    return best[1], float(best[2])


def find_period(y: np.ndarray) -> int:
    """The period of the spectrum's peak; 1 where no peak is above 10. A peak at zero gives way to the next after the first rise."""
    n = len(y)
    if n < 4:
        return 1
    phi, v = autoregression(y)
    if not 0 < v < np.inf:
        return 1
    f = np.linspace(0, 0.5, 500)
    spectrum = v / np.abs(1 - np.exp(-2j * np.pi * f[:, None] * np.arange(1, len(phi) + 1)) @ phi) ** 2
    if spectrum.max() <= 10:
        return 1

    def period(i: int) -> int:
        p = int(1 / f[i] + 0.5) if i else 0
        return p if p < n else 0

    if found := period(int(spectrum.argmax())):
        return found
    rises = np.flatnonzero(np.diff(spectrum) > 0) + 1
    if not len(rises) or rises[0] >= len(f) - 1:
        return 1
    return period(int(rises[0] + 1 + spectrum[rises[0] + 1 :].argmax())) or 1


def seasonal_verdict(y: np.ndarray, m: int, test: str = "seas") -> np.ndarray:
    """[B] whether each series needs a seasonal difference: seas (strength), ch, ocsb or hegy."""
    if test == "seas":
        return np.array([seasonal_strength(x, m) > 0.64 for x in y])
    if test == "ch":
        return np.zeros(len(y), bool) if y.shape[1] < 2 * m + 5 else canova_hansen(y, m) > ch_critical(m)
    if test == "ocsb":
        return ocsb(y, m) > ocsb_critical(m)
    return hegy_p(y, m)[1][:, hegy_names(m).index(f"F_2:{m}")] > 0.05


def n_seasonal_diffs(y: np.ndarray, m: int, most: int = 1, test: str = "seas") -> np.ndarray:
    """[B] how often to difference at lag m until the test accepts; a constant or a series shorter than m is left."""
    if m < 2 or most < 1:
        raise ValueError("m must be 2 or more and most 1 or more")
    if test not in ("seas", "ch", "ocsb", "hegy"):
        raise ValueError(f"unknown test {test}")
    out, live = np.zeros(len(y), int), np.ones(len(y), bool)
    for _ in range(most):
        if y.shape[1] < m:
            break
        live &= np.ptp(y, 1) > 0
        if live.any():
            try:
                live[live] = seasonal_verdict(y[live], m, test)
            except ValueError:  # too short for the test
                break
        out += live
        y = y[:, m:] - y[:, :-m]
    return out
