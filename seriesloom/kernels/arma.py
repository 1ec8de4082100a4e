"""ARMA likelihoods and their optimiser in numpy, for batches: every array's first axis is a row of its own.

Rows never meet (no sum crosses the first axis), so a result doesn't depend on what else is in a batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from seriesloom.kernels import starts


def stationary(x: np.ndarray, sign: float = -1.0) -> np.ndarray:
    """[B, p] unconstrained numbers to coefficients of a stationary (sign -1) or invertible (sign 1) polynomial."""
    a = np.tanh(x)
    out = a.copy()
    for k in range(1, x.shape[1]):
        head = out[:, :k].copy()
        out[:, :k] = head + sign * a[:, k : k + 1] * head[:, ::-1]
    return out


def multiply(a: np.ndarray, b: np.ndarray, m: int, sign: float) -> np.ndarray:
    """Coefficients of (1 + sign Σ a_i B^i)(1 + sign Σ b_j B^jm), without the leading 1 and the sign."""
    n, p, q = len(a), a.shape[1], b.shape[1]
    left, right = np.zeros((n, p + 1)), np.zeros((n, q * m + 1))
    left[:, 0] = right[:, 0] = 1
    left[:, 1:] = sign * a
    for j in range(q):
        right[:, (j + 1) * m] = sign * b[:, j]
    out = np.zeros((n, p + q * m + 1))
    for i in range(p + 1):
        out[:, i : i + q * m + 1] += left[:, i : i + 1] * right
    return sign * out[:, 1:]


def css_residuals(w: np.ndarray, phi: np.ndarray, theta: np.ndarray, lost: np.ndarray | None = None) -> np.ndarray:
    """[B, T] residuals; those before the longest lag, or the first lost [B] of a row, are 0."""
    p, q = phi.shape[1], theta.shape[1]
    start = max(p, q) if lost is None else int(lost.min(initial=max(p, q)))
    past, e = np.concatenate([np.zeros((len(w), p)), w], 1), np.zeros((len(w), q + w.shape[1]))
    for t in range(start, w.shape[1]):
        x = w[:, t].copy()
        if p:
            x -= (phi * past[:, t : t + p][:, ::-1]).sum(1)
        if q:
            x -= (theta * e[:, t : t + q][:, ::-1]).sum(1)
        e[:, q + t] = x if lost is None else np.where(t >= lost, x, 0)
    return e[:, q:]


def css(w: np.ndarray, phi: np.ndarray, theta: np.ndarray, lost: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Half the count times the log of the variance, and the variance."""
    e = css_residuals(w, phi, theta, lost)
    n = w.shape[1] - (max(phi.shape[1], theta.shape[1]) if lost is None else lost)
    s = np.maximum((e * e).sum(1) / np.maximum(n, 1), 1e-300)
    return 0.5 * n * np.log(s), s


@lru_cache(maxsize=16)
def yule_walker(r: int) -> np.ndarray:
    """[r, (r + 1)²]: where autocovariance l stands in the equation of lag k with coefficient i."""
    i, k, lag = np.ogrid[1 : r + 1, : r + 1, : r + 1]
    return (np.abs(k - i) == lag).astype(float).reshape(r, -1)


def first_column(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The first column of the stationary covariance of the state [B, r], from phi [B, r] and theta [B, r - 1].

    The autocovariances solve a linear system a row; where one has no solution, as a sum over powers of the companion map.
    """
    n, r = phi.shape
    if not phi.any():
        return powers_column(phi, theta)
    psi, moving = np.zeros((n, r)), np.concatenate([np.ones((n, 1)), theta], 1)
    for k in range(r):
        psi[:, k] = moving[:, k] + (phi[:, :k] * psi[:, :k][:, ::-1]).sum(1)
    shocks = np.stack([(moving[:, k:] * psi[:, : r - k]).sum(1) for k in range(r)] + [np.zeros(n)], 1)
    system = np.eye(r + 1) - (phi @ yule_walker(r)).reshape(n, r + 1, r + 1)
    try:
        gamma = np.linalg.solve(system, shocks[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return powers_column(phi, theta)
    return np.stack([gamma[:, 0], *((phi[:, i:] * gamma[:, 1 : r - i + 1]).sum(1) + shocks[:, i] for i in range(1, r))], 1)


def powers_column(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    r = phi.shape[1]
    v = np.concatenate([np.ones((len(phi), 1)), theta], 1)
    out, calm = np.zeros_like(v), 0
    for _ in range(256 + 64 * r):
        part = v[:, :1] * v
        out += part
        calm = calm + 1 if (np.abs(part).max(1) <= 1e-17 * np.abs(out[:, 0])).all() else 0
        if calm >= max(4, r):
            break
        v = np.concatenate([v[:, 1:], np.zeros((len(v), 1))], 1) + phi * v[:, :1]
    return out


def exact(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The negative log likelihood with the variance concentrated out, and that variance, by the fast (CKMS) filter."""
    p, q, (n, steps) = phi.shape[1], theta.shape[1], w.shape
    r = max(p, q + 1)
    phi = np.pad(phi, ((0, 0), (0, r - p)))
    theta = np.pad(theta, ((0, 0), (0, r - 1 - q)))

    def move(x: np.ndarray) -> np.ndarray:
        y = phi * x[:, :1]
        y[:, :-1] += x[:, 1:]
        return y

    with np.errstate(all="ignore"):
        m = first_column(phi, theta)
        f = m[:, 0].copy()
        beta, g = f.copy(), move(m / f[:, None])
        a, logs, squares = np.zeros((n, r)), np.zeros(n), np.zeros(n)
        for t in range(steps):
            e = w[:, t] - a[:, 0]
            logs += np.log(f)
            squares += e * e / f
            a = move(a + m * (e / f)[:, None])
            lead = g[:, 0].copy()
            new_f = f - beta * lead * lead
            g_old = g
            g = move(g - (lead / f)[:, None] * m)
            m = m - (beta * lead)[:, None] * g_old
            beta = beta * f / new_f
            f = new_f
        s = squares / steps
        out = 0.5 * (steps * (np.log(2 * np.pi * s) + 1) + logs)
    return np.where(np.isfinite(out), out, 1e300), s


def minimize(f: Callable, x: np.ndarray, rounds: int = 100, tol: float = 1e-6, free: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """BFGS with backtracking for each row of x at once; f(points, rows) gives the value of each point for its row.

    free [rows, k] says which numbers of a row may move.
    """
    s, k = x.shape
    rows, eps = np.arange(s), 1e-6
    value = f(x, rows)
    if k == 0:
        return x, value

    def gradient(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        step = eps * np.concatenate([np.eye(k), -np.eye(k)])
        v = f((x[:, None] + step[None]).reshape(-1, k), np.repeat(rows, 2 * k)).reshape(-1, 2, k)
        slope = (v[:, 0] - v[:, 1]) / (2 * eps)
        return slope if free is None else slope * free[rows]

    g, h, live = gradient(x, rows), np.tile(np.eye(k), (s, 1, 1)), np.ones(s, bool)
    for _ in range(rounds):
        live &= np.abs(g).max(1) > tol
        at = np.flatnonzero(live)
        if not len(at):
            break
        d = -np.einsum("sij,sj->si", h[at], g[at])
        slope = (d * g[at]).sum(1)
        bad = slope >= 0
        d[bad], slope[bad] = -g[at][bad], -(g[at][bad] ** 2).sum(1)
        size = np.minimum(1.0, 2.0 / np.maximum(np.abs(d).max(1), 1e-12))
        open_, best, found = np.ones(len(at), bool), x[at].copy(), value[at].copy()
        for _ in range(25):
            i = np.flatnonzero(open_)
            if not len(i):
                break
            trial = x[at[i]] + size[i, None] * d[i]
            v = f(trial, at[i])
            fits = v <= value[at[i]] + 1e-4 * size[i] * slope[i]
            best[i[fits]], found[i[fits]] = trial[fits], v[fits]
            open_[i[fits]] = False
            size[i[~fits]] *= 0.5
        live[at[open_]] = False
        move = at[~open_]
        if not len(move):
            continue
        new_g = gradient(best[~open_], move)
        dx, dg = best[~open_] - x[move], new_g - g[move]
        stalled = value[move] - found[~open_] <= 1e-10 * (1 + np.abs(found[~open_]))
        x[move], value[move], g[move] = best[~open_], found[~open_], new_g
        live[move[stalled]] = False
        curve = (dx * dg).sum(1)
        ok = curve > 1e-12
        if ok.any():
            rho, y, z, j = 1 / curve[ok], dg[ok], dx[ok], move[ok]
            left = np.eye(k) - rho[:, None, None] * z[:, :, None] * y[:, None]
            h[j] = left @ h[j] @ left.transpose(0, 2, 1) + rho[:, None, None] * z[:, :, None] * z[:, None]
    return x, value


def difference(y: np.ndarray, d: int, seasonal_d: int, m: int) -> np.ndarray:
    for lag, times in ((1, d), (m, seasonal_d)):
        for _ in range(times):
            y = y[:, lag:] - y[:, :-lag]
    return y


class Fitted:
    """Models of one order for a batch of series [B, n]: phi, theta (expanded), coef, mean, sigma2, log_l, aic, aicc, bic, params.

    exog [B, n, k] are regressors with ARMA errors; coef [B, r] are the constant (on the differenced scale), if any, and their
    coefficients. method is css-ml, css (whose log_l leaves out constants, so never compare it with the others') or ml.

    free [B, p + q + sp + sq] makes some rows' orders lower: a partial autocorrelation held at zero at the end of a block is an
    order less, so that rows of different orders are fitted together.

    init is flat or hannan-rissanen, whose least squares start a search from coefficients (flat where a series is too short or
    free is given). polish ends with a simplex search, which keeps what it can't better.
    """

    def __init__(self, y: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, int, int, int] = (0, 0, 0, 1), mean: bool | None = None, rounds: int = 100, exog: np.ndarray | None = None, method: str = "css-ml", start: np.ndarray | None = None, ridge: float = 0.0, free: np.ndarray | None = None, init: str = "flat", polish: bool = False):
        (p, d, q), (sp, sd, sq, m) = order, seasonal
        self.y, self.order, self.seasonal, self.exog = y, order, seasonal, exog
        w = difference(y, d, sd, m)
        if w.shape[1] < 2:
            raise ValueError("too few values for this order")
        self.with_mean = (d + sd == 0) if mean is None else mean
        self.design = self._columns(exog, len(y), w.shape[1])
        k, r = p + q + sp + sq, self.design.shape[2]
        center = np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(self.design, w, strict=True)]) if r else np.zeros((len(y), 0))
        scale = np.maximum(w.std(1), 1e-12)[:, None] / np.maximum(np.sqrt((self.design**2).mean(1)), 1e-12)
        self.blocks = ((0, p, -1.0), (p, p + q, 1.0), (p + q, p + q + sp, -1.0), (p + q + sp, k, 1.0))

        def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            raw = [stationary(x[:, i:j], s) for i, j, s in self.blocks]
            return *self.expand(raw), raw

        self.lost = None
        if free is not None:
            lags = [free[:, i:j].sum(1) * (m if block > 1 else 1) for block, (i, j, _) in enumerate(self.blocks)]
            self.lost = np.maximum(lags[0] + lags[2], lags[1] + lags[3])

        def objective(kind: Callable) -> Callable:
            def value(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
                phi, theta, _ = parts(np.clip(x[:, :k], -4, 4))
                z = w[rows] - np.einsum("bth,bh->bt", self.design[rows], center[rows] + x[:, k:] * scale[rows]) if r else w[rows]
                found = css(z, phi, theta, None if self.lost is None else self.lost[rows])[0] if kind is css else kind(z, phi, theta)[0]
                return found + ridge * (x[:, :k] ** 2).sum(1) if ridge else found

            return value

        x = np.zeros((len(y), k + r))
        x[:, :k] = 0.1 if free is None else 0.1 * free
        if init == "hannan-rissanen" and free is None:
            raw = starts.hannan_rissanen(w - np.einsum("bth,bh->bt", self.design, center), p, q, sp, sq, m)
            if raw is not None:
                x[:, :k] = np.concatenate([starts.unconstrained(raw[:, i:j], s) for i, j, s in self.blocks], 1)
        elif init not in ("flat", "hannan-rissanen"):
            raise ValueError(f"no such start: {init}")
        moving = None if free is None else np.concatenate([free, np.ones((len(y), r), bool)], 1)
        if start is not None:
            x = start.copy()
        elif method != "ml":
            x, value = minimize(objective(css), x, rounds, free=moving)
        if method != "css":
            x, value = minimize(objective(exact), np.clip(x, -3, 3), rounds, free=moving)
        if polish and free is None:
            x, value = starts.simplex(objective(css if method == "css" else exact), x)
        self.x = x
        self.phi, self.theta, self.params = parts(np.clip(x[:, :k], -4, 4))
        self.coef = center + x[:, k:] * scale
        self.mean = self.coef[:, 0] if self.with_mean else np.zeros(len(y))
        self.w, n = w - np.einsum("bth,bh->bt", self.design, self.coef), w.shape[1]
        if method == "css":
            self.sigma2 = css(self.w, self.phi, self.theta, self.lost)[1]
            self.log_l = -0.5 * n * np.log(self.sigma2)
        else:
            value, self.sigma2 = exact(self.w, self.phi, self.theta)
            self.log_l = -value
        self.n, self.count = n, np.full(len(y), k) + r + 1 if free is None else free.sum(1) + r + 1
        count = self.count
        self.aic = 2 * count - 2 * self.log_l
        self.aicc = self.aic + np.where(n - count - 1 > 0, 2 * count * (count + 1) / np.maximum(n - count - 1, 1), np.inf)
        self.bic = count * np.log(n) - 2 * self.log_l
        self.hqic = 2 * count * np.log(np.log(n)) - 2 * self.log_l

    def expand(self, raw: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Whole polynomials from the four blocks of coefficients."""
        m = self.seasonal[3]
        return multiply(raw[0], raw[2], m, -1.0), multiply(raw[1], raw[3], m, 1.0)

    def _columns(self, exog: np.ndarray | None, rows: int, steps: int) -> np.ndarray:
        """Regressors on the differenced scale, the constant first; the last steps of them."""
        (_, d, _), (_, sd, _, m) = self.order, self.seasonal
        parts = [np.ones((rows, steps, 1))] if self.with_mean else []
        if exog is not None:
            parts.append(difference(exog, d, sd, m)[:, -steps:])
        return np.concatenate(parts, 2) if parts else np.zeros((rows, steps, 0))

    def residuals(self) -> np.ndarray:
        return css_residuals(self.w, self.phi, self.theta, self.lost)

    def forecast(self, h: int, z: float = 1.959963984540054, future: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[B, h] points and bounds; future [B, h, k] are the regressors ahead."""
        if (self.exog is None) != (future is None):
            raise ValueError("regressors ahead are needed with exog, and only then")
        (_, d, _), (_, sd, _, m) = self.order, self.seasonal
        p, q, t = self.phi.shape[1], self.theta.shape[1], self.w.shape[1]
        w = np.concatenate([self.w, np.zeros((len(self.w), h))], 1)
        e = np.concatenate([self.residuals(), np.zeros((len(self.w), h))], 1)
        for i in range(t, t + h):
            w[:, i] = sum((self.phi[:, j] * w[:, i - j - 1] for j in range(min(p, i))), np.zeros(len(w))) + sum((self.theta[:, j] * e[:, i - j - 1] for j in range(min(q, i))), np.zeros(len(w)))
        both = None if future is None else np.concatenate([self.exog, future], 1)
        ahead = w[:, t:] + np.einsum("bth,bh->bt", self._columns(both, len(w), h), self.coef)
        levels = [self.y]
        for lag in [1] * d + [m] * sd:
            levels.append(levels[-1][:, lag:] - levels[-1][:, :-lag])
        for level, lag in zip(levels[-2::-1], ([1] * d + [m] * sd)[::-1], strict=True):
            full = np.concatenate([level[:, -lag:], np.zeros_like(ahead)], 1)
            for i in range(h):
                full[:, lag + i] = ahead[:, i] + full[:, i]
            ahead = full[:, lag:]
        psi = np.zeros((len(w), h))
        psi[:, 0] = 1
        for i in range(1, h):
            psi[:, i] = (self.theta[:, i - 1] if i <= q else 0) + sum((self.phi[:, j] * psi[:, i - j - 1] for j in range(min(p, i))), np.zeros(len(w)))
        for lag in [1] * d + [m] * sd:
            for i in range(lag, h):
                psi[:, i] += psi[:, i - lag]
        half = z * np.sqrt(self.sigma2[:, None] * np.cumsum(psi**2, 1))
        return ahead, ahead - half, ahead + half


def free_of(orders: list[tuple[int, int, int, int]]) -> tuple[tuple[int, int, int, int], np.ndarray]:
    """The largest (p, q, sp, sq) of rows, and which numbers of each row's blocks are its own."""
    most = tuple(int(x) for x in np.max(orders, 0))
    return most, np.array([[i < o for o, n in zip(c, most, strict=True) for i in range(n)] for c in orders], bool).reshape(len(orders), sum(most))


def roots(coefficients: np.ndarray, sign: float) -> np.ndarray:
    """Roots of 1 + sign (c_1 z + c_2 z² ...); sign is -1 for autoregressive and 1 for moving-average parts."""
    c = np.trim_zeros(np.concatenate([[1.0], sign * np.asarray(coefficients, float)]), "b")
    return np.roots(c[::-1]) if len(c) > 1 else np.zeros(0, complex)


def integrated_psi(phi: np.ndarray, theta: np.ndarray, h: int, lags: list[int]) -> np.ndarray:
    """[B, h] moving-average weights, summed up along each lag of differencing."""
    psi = np.zeros((len(phi), h))
    psi[:, 0] = 1
    for i in range(1, h):
        psi[:, i] = (theta[:, i - 1] if i <= theta.shape[1] else 0) + sum((phi[:, j] * psi[:, i - j - 1] for j in range(min(phi.shape[1], i))), np.zeros(len(phi)))
    for lag in lags:
        for i in range(lag, h):
            psi[:, i] += psi[:, i - lag]
    return psi


def sample_paths(model: Fitted, h: int, n: int, keys: list[int], seed: int = 0, gaussian: bool = False, future: np.ndarray | None = None) -> np.ndarray:
    """[B, n, h] forecasts with resampled residuals (those that aren't zero) or normal shocks.

    Each series draws from a generator of its own key, so paths don't depend on how series are batched.
    """
    (_, d, _), (_, sd, _, m) = model.order, model.seasonal
    psi = integrated_psi(model.phi, model.theta, h, [1] * d + [m] * sd)
    point, e, out = model.forecast(h, future=future)[0], model.residuals(), np.empty((len(model.y), n, h))
    for i, key in enumerate(keys):
        rng = np.random.Generator(np.random.Philox(key=[seed, key % 2**64]))
        pool = e[i][e[i] != 0]
        shocks = rng.normal(0, np.sqrt(model.sigma2[i]), (n, h)) if gaussian or not len(pool) else rng.choice(pool, (n, h))
        spread = np.array([[psi[i, b - a] if b >= a else 0.0 for b in range(h)] for a in range(h)])
        out[i] = point[i] + shocks @ spread
    return out


def names(model: Fitted) -> list[str]:
    """What the displayed coefficients are called, in the order of :func:`displayed`."""
    (p, _, q), (sp, _, sq, _) = model.order, model.seasonal
    out = [f"{kind}{i + 1}" for kind, n in (("ar", p), ("ma", q), ("sar", sp), ("sma", sq)) for i in range(n)]
    return out + (["intercept"] if model.with_mean else []) + [f"beta{i + 1}" for i in range(model.coef.shape[1] - model.with_mean)]


def displayed(model: Fitted) -> np.ndarray:
    """[B, k] coefficients of the four blocks, the constant and the regressors."""
    return np.concatenate([*model.params, model.coef], 1)


def standard_errors(model: Fitted, eps: float = 1e-4) -> np.ndarray:
    """[B, k] from the numerical Hessian of the exact likelihood at the displayed coefficients; NaN where it can't be inverted."""
    at = displayed(model)
    n, k = at.shape
    w = difference(model.y, model.order[1], model.seasonal[1], model.seasonal[3])

    def value(points: np.ndarray) -> np.ndarray:
        """points [B, P, k] to [B, P]."""
        flat, rows = points.reshape(-1, k), np.repeat(np.arange(n), points.shape[1])
        raw = [flat[:, i:j] for i, j, _ in model.blocks]
        z = w[rows] - np.einsum("bth,bh->bt", model.design[rows], flat[:, model.blocks[3][1] :])
        return exact(z, *model.expand(raw))[0].reshape(n, -1)

    step = eps * np.eye(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    corners = np.stack([a * step[i] + b * step[j] for i, j in pairs for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]) if k else np.zeros((0, 0))
    out = np.full((n, k), np.nan)
    if not k:
        return out
    f = value(at[:, None] + corners[None]).reshape(n, -1, 4)
    slopes = (f[..., 0] - f[..., 1] - f[..., 2] + f[..., 3]) / (4 * eps * eps)
    for b in range(n):
        hessian = np.zeros((k, k))
        for (i, j), s in zip(pairs, slopes[b], strict=True):
            hessian[i, j] = hessian[j, i] = s
        try:
            spread = np.linalg.inv(hessian).diagonal()
        except np.linalg.LinAlgError:
            continue
        out[b] = np.sqrt(np.where(spread > 0, spread, np.nan))
    return out


def pi_weights(model: Fitted, n: int) -> np.ndarray:
    """[B, n] weights of the innovations as a sum over past values, differencing included."""
    (_, d, _), (_, sd, _, m) = model.order, model.seasonal
    a = np.concatenate([np.ones((len(model.phi), 1)), -model.phi], 1)
    for lag in [1] * d + [m] * sd:
        a = np.concatenate([a, np.zeros((len(a), lag))], 1) - np.concatenate([np.zeros((len(a), lag)), a], 1)
    out = np.zeros((len(a), n))
    out[:, : min(n, a.shape[1])] = a[:, :n]
    for k in range(1, n):
        q = min(model.theta.shape[1], k)
        out[:, k] -= (model.theta[:, :q] * out[:, k - q : k][:, ::-1]).sum(1)
    return out


def simulate(model: Fitted, n: int, draws: int, keys: list[int], seed: int = 0, burn: int = 100, exog: np.ndarray | None = None) -> np.ndarray:
    """[B, draws, n] with normal shocks and no history: burn values go first, and sums start from zero."""
    (_, d, _), (_, sd, _, m) = model.order, model.seasonal
    size, b = n + burn, len(model.phi)
    e = np.stack([np.random.Generator(np.random.Philox(key=[seed, key % 2**64])).normal(0, np.sqrt(model.sigma2[i]), (draws, size)) for i, key in enumerate(keys)])
    p, q, w = model.phi.shape[1], model.theta.shape[1], np.zeros((b, draws, size))
    for t in range(size):
        i, j = min(p, t), min(q, t)
        w[..., t] = e[..., t] + (model.phi[:, None, :i] * w[..., t - i : t][..., ::-1]).sum(2) + (model.theta[:, None, :j] * e[..., t - j : t][..., ::-1]).sum(2)
    w = w[..., burn:]
    if model.with_mean:
        w = w + model.mean[:, None, None]
    for lag in [1] * d + [m] * sd:
        for t in range(lag, n):
            w[..., t] += w[..., t - lag]
    if exog is not None:
        w = w + np.einsum("bth,bh->bt", exog, model.coef[:, model.with_mean :])[:, None]
    return w


def parameter_bootstrap(model: Fitted, keys: list[int], draws: int = 200, seed: int = 0, rounds: int = 50) -> np.ndarray:
    """[B, draws, k] displayed coefficients of models fitted to simulated series; NaN where a likelihood failed."""
    if draws < 10:
        raise ValueError("10 draws are the least")
    n = model.y.shape[1]
    y = simulate(model, n, draws, keys, seed, exog=model.exog).reshape(-1, n)
    exog = None if model.exog is None else np.repeat(model.exog, draws, 0)
    again = Fitted(y, model.order, model.seasonal, model.with_mean, rounds, exog)
    found = np.where((again.log_l > -1e299)[:, None], displayed(again), np.nan)
    return found.reshape(len(model.y), draws, -1)


def bias_corrected(model: Fitted, sampled: np.ndarray) -> np.ndarray:
    """[B, k] twice the coefficients less their bootstrap mean; those of the ARMA blocks stay within 0.99 of zero."""
    out = 2 * displayed(model) - np.nanmean(sampled, 1)
    k = model.blocks[3][1]
    out[:, :k] = np.clip(out[:, :k], -0.99, 0.99)
    return out


def signatures(pi: np.ndarray, kinds: tuple[str, ...], delta: float) -> dict[str, np.ndarray]:
    """[B, n] for each kind of outlier: what it leaves in the innovations from its own time on."""
    fading = pi.copy()
    for k in range(1, pi.shape[1]):
        fading[:, k] += delta * fading[:, k - 1]
    impulse = np.zeros_like(pi)
    impulse[:, 0] = 1
    return {kind: {"AO": pi, "LS": np.cumsum(pi, 1), "TC": fading, "IO": impulse}[kind] for kind in kinds}


def outliers(y: np.ndarray, order: tuple[int, int, int] = (0, 1, 1), seasonal: tuple[int, int, int, int] = (0, 0, 0, 1), kinds: tuple[str, ...] = ("AO", "LS"), critical: float | None = None, most: int = 5, delta: float = 0.7) -> list[list[tuple[int, str, float, float]]]:
    """For each series its outliers (place, kind, effect, size of the t statistic) in the order found.

    A round fits the models, projects their residuals on each signature at each place, and makes the largest beyond critical
    (3.5 below 200 values, then 4) a regressor. Effects are the last fit's. Series in one round have equally many regressors.
    """
    b, n = y.shape
    if n < 10:
        raise ValueError("10 values are the least")
    critical = critical or (3.5 if n < 200 else 4.0)
    lost = order[1] + seasonal[1] * seasonal[3]
    found: list[list] = [[] for _ in range(b)]
    live, columns = np.arange(b), np.zeros((b, n, 0))
    for turn in range(most + 1):
        if not len(live):
            break
        model = Fitted(y[live], order, seasonal, exog=columns[live] if turn else None)
        offset = model.coef.shape[1] - turn
        for row, i in enumerate(live):
            found[i] = [(t, kind, float(model.coef[row, offset + j]), size) for j, (t, kind, _, size) in enumerate(found[i])]
        if turn == most:
            break
        e = np.zeros((len(live), n))
        e[:, lost:] = model.residuals()
        width = 2 * n
        spectrum = np.fft.rfft(e, width, axis=1)
        psi = integrated_psi(model.phi, model.theta, n, [1] * order[1] + [seasonal[3]] * seasonal[1])
        best: list[tuple] = [(critical, -1, "")] * len(live)
        for kind, shape in signatures(pi_weights(model, n), kinds, delta).items():
            num = np.fft.irfft(spectrum * np.conj(np.fft.rfft(shape, width, axis=1)), width, axis=1)[:, :n]
            den = np.cumsum(shape**2, 1)[:, ::-1]
            size = np.abs(num) / np.sqrt(np.maximum(den, 1e-300)) / np.sqrt(model.sigma2)[:, None]
            size[:, :lost] = 0
            if kind == "LS":
                size[:, max(n - 2, lost + 1) :] = 0
            for row, i in enumerate(live):
                for t, other, _, _ in found[i]:
                    if other == kind:
                        size[row, t] = 0
                t = int(size[row].argmax())
                if size[row, t] > best[row][0]:
                    best[row] = (float(size[row, t]), t, kind)
        new = np.zeros((b, n, 1))
        for row, i in enumerate(live):
            size, t, kind = best[row]
            if t >= 0:
                after = np.arange(n - t)
                new[i, t:, 0] = {"AO": (after == 0) * 1.0, "LS": np.ones(n - t), "TC": delta**after, "IO": psi[row, : n - t]}[kind]
                found[i].append((t, kind, 0.0, size))
        live = live[[x[1] >= 0 for x in best]]
        columns = np.concatenate([columns, new], 2)
    return found
