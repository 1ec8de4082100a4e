"""Dense filters of undifferenced series, for batches: the check on the fast likelihood, and the one that takes missing values."""

from __future__ import annotations

import numpy as np

from seriesloom.kernels.arma import minimize, multiply, stationary


def stationary_covariance(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """[B, r, r] solution of P = T P T' + R R' by doubling."""
    move, shock = companion(phi, theta)
    p = shock[:, :, None] * shock[:, None]
    for _ in range(60):
        more = move @ p @ move.transpose(0, 2, 1)
        p, move = p + more, move @ move
        if np.abs(more).max() <= 1e-15 * np.abs(p).max():
            break
    return p


def companion(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b, r = len(phi), max(phi.shape[1], theta.shape[1] + 1)
    move, shock = np.zeros((b, r, r)), np.zeros((b, r))
    move[:, : phi.shape[1], 0] = phi
    move[:, np.arange(r - 1), np.arange(1, r)] = 1
    shock[:, 0], shock[:, 1 : theta.shape[1] + 1] = 1, theta
    return move, shock


def differencing(d: int, seasonal_d: int, m: int) -> np.ndarray:
    """Coefficients of past values that differencing takes off the present one."""
    c = np.ones(1)
    for lag in [1] * d + [m] * seasonal_d:
        c = np.convolve(c, np.concatenate([[1.0], np.zeros(lag - 1), [-1.0]]))
    return -c[1:]


def system(phi: np.ndarray, theta: np.ndarray, d: int, seasonal_d: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition [B, s, s], shock loading [B, s] and observation row [s]: the ARMA states, then past values of the series."""
    inner, load = companion(phi, theta)
    past = differencing(d, seasonal_d, m)
    b, r, k = len(phi), inner.shape[1], len(past)
    row = np.concatenate([[1.0], np.zeros(r - 1), past])
    move, shock = np.zeros((b, r + k, r + k)), np.zeros((b, r + k))
    move[:, :r, :r], shock[:, :r] = inner, load
    if k:
        move[:, r] = row
        move[:, np.arange(r + 1, r + k), np.arange(r, r + k - 1)] = 1
    return move, shock, row


def diffuse(y: np.ndarray, phi: np.ndarray, theta: np.ndarray, d: int = 0, seasonal_d: int = 0, m: int = 1, kappa: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Negative log likelihood [B] with the variance concentrated out, and that variance. NaN values of y are missing."""
    return filtered(y, phi, theta, d, seasonal_d, m, kappa)[:2]


def filtered(y: np.ndarray, phi: np.ndarray, theta: np.ndarray, d: int = 0, seasonal_d: int = 0, m: int = 1, kappa: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`diffuse`, then the state expected after the last value, its covariance for a variance of one, and the steps that count.

    Past values start exactly diffuse: steps that settle them don't count. With kappa they start with that variance
    instead, and the first d + seasonal_d m steps don't count.
    """
    move, shock, row = system(phi, theta, d, seasonal_d, m)
    b, size = shock.shape
    k = d + seasonal_d * m
    r = size - k
    at, known, vague = np.zeros((b, size)), np.zeros((b, size, size)), np.zeros((b, size, size))
    known[:, :r, :r] = stationary_covariance(phi, theta)
    (vague if kappa is None else known)[:, np.arange(r, size), np.arange(r, size)] = 1.0 if kappa is None else kappa
    noise, back = shock[:, :, None] * shock[:, None], move.transpose(0, 2, 1)
    logs, squares, count = np.zeros(b), np.zeros(b), np.zeros(b)
    for t in range(y.shape[1]):
        seen = ~np.isnan(y[:, t])
        e = np.where(seen, y[:, t] - at @ row, 0.0)
        m_known, m_vague = known @ row, vague @ row
        f_known, f_vague = m_known @ row, m_vague @ row
        open_ = seen & (f_vague > 1e-9)
        plain = seen & ~open_
        fk, fv = np.where(plain, f_known, 1.0), np.where(open_, f_vague, 1.0)
        counts = plain & (kappa is None or t >= k)
        logs += np.where(counts, np.log(fk), 0)
        squares += np.where(counts, e * e / fk, 0)
        count += counts
        gain = np.where(plain[:, None], m_known / fk[:, None], 0) + np.where(open_[:, None], m_vague / fv[:, None], 0)
        at = at + gain * e[:, None]
        outer = lambda u, v: u[:, :, None] * v[:, None]
        settled = known + outer(m_vague, m_vague) * (f_known / fv**2)[:, None, None] - (outer(m_known, m_vague) + outer(m_vague, m_known)) / fv[:, None, None]
        known = np.where(open_[:, None, None], settled, known - np.where(plain[:, None, None], outer(m_known, m_known) / fk[:, None, None], 0))
        vague = vague - np.where(open_[:, None, None], outer(m_vague, m_vague) / fv[:, None, None], 0)
        at = np.einsum("bij,bj->bi", move, at)
        known, vague = move @ known @ back + noise, move @ vague @ back
    with np.errstate(all="ignore"):
        s = squares / count
        return 0.5 * (count * (np.log(2 * np.pi * s) + 1) + logs), s, at, known, count


class Gapped:
    """Models of one order for a batch of series [B, n] in which NaN is missing, by the exactly diffuse likelihood.

    The constant is one on the differenced scale, for series differenced once at most. Attributes are as those of
    :class:`seriesloom.kernels.arma.Fitted`; n counts, for each series, the values that aren't used up by differencing.
    """

    def __init__(self, y: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, int, int, int] = (0, 0, 0, 1), mean: bool | None = None, rounds: int = 100):
        (p, d, q), (sp, sd, sq, m) = order, seasonal
        self.y, self.order, self.seasonal = y, order, seasonal
        self.with_mean = (d + sd == 0) if mean is None else mean
        if self.with_mean and d + sd > 1:
            raise ValueError("a constant needs a series that is differenced once at most")
        if (np.isfinite(y).sum(1) < d + sd * m + 2).any():
            raise ValueError("too few values for this order")
        blocks, k = ((0, p, -1.0), (p, p + q, 1.0), (p + q, p + q + sp, -1.0), (p + q + sp, p + q + sp + sq, 1.0)), p + q + sp + sq
        self.slope = 0.0 if d + sd == 0 else 1.0 / (m if sd else 1)
        ends = [np.flatnonzero(np.isfinite(row))[[0, -1]] for row in y]
        center = np.nanmean(y, 1) if d + sd == 0 else np.array([(row[j] - row[i]) / max(self.slope * (j - i), 1e-12) for row, (i, j) in zip(y, ends, strict=True)])
        scale = np.maximum(np.nanstd(y, 1), 1e-12) * (1.0 if d + sd == 0 else 0.1)

        def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = [stationary(np.clip(x[:, i:j], -4, 4), s) for i, j, s in blocks]
            return multiply(raw[0], raw[2], m, -1.0), multiply(raw[1], raw[3], m, 1.0)

        def value(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            z = y[rows] - (center[rows] + x[:, k] * scale[rows])[:, None] * self._line(0, y.shape[1]) if self.with_mean else y[rows]
            return np.nan_to_num(diffuse(z, *parts(x), d, sd, m)[0], nan=1e10, posinf=1e10)

        x = np.zeros((len(y), k + self.with_mean))
        x[:, :k] = 0.1
        self.x = minimize(value, x, rounds)[0] if x.shape[1] else x
        self.phi, self.theta = parts(self.x)
        self.mean = center + self.x[:, k] * scale if self.with_mean else np.zeros(len(y))
        self.coef = self.mean[:, None][:, : int(self.with_mean)]
        found, self.sigma2, self._state, self._spread, self.n = filtered(y - self.mean[:, None] * self._line(0, y.shape[1]), self.phi, self.theta, d, sd, m)
        self.log_l, count = -found, x.shape[1] + 1
        self.n = self.n.astype(int)
        self.aic = 2 * count - 2 * self.log_l
        self.aicc = self.aic + np.where(self.n - count - 1 > 0, 2 * count * (count + 1) / np.maximum(self.n - count - 1, 1), np.inf)
        self.bic = count * np.log(self.n) - 2 * self.log_l

    def _line(self, lo: int, hi: int) -> np.ndarray:
        """What a constant of one adds to places lo to hi."""
        return np.arange(lo, hi) * self.slope if self.slope else np.ones(hi - lo)

    def forecast(self, h: int, z: float = 1.959963984540054) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[B, h] points and bounds after the last place, whether or not it has a value."""
        (_, d, _), (_, sd, _, m) = self.order, self.seasonal
        move, shock, row = system(self.phi, self.theta, d, sd, m)
        at, known, points, errors = self._state, self._spread, [], []
        for _ in range(h):
            points.append(at @ row)
            errors.append(np.sqrt(np.maximum(known @ row @ row, 0) * self.sigma2))
            at, known = np.einsum("bij,bj->bi", move, at), move @ known @ move.transpose(0, 2, 1) + shock[:, :, None] * shock[:, None]
        n = self.y.shape[1]
        ahead = np.stack(points, 1) + self.mean[:, None] * self._line(n, n + h)
        half = z * np.stack(errors, 1)
        return ahead, ahead - half, ahead + half
