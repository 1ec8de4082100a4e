"""Order search in numpy for batches of series of one length: candidates of one order are fitted together, whoever asks for them."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np

from seriesloom.kernels.arma import Fitted, difference, free_of
from seriesloom.kernels.seasonal import find_period, n_seasonal_diffs
from seriesloom.kernels.unitroot import n_diffs

#: Candidates that are fitted together at most.
TOGETHER = 1024
STARTS = ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))


@dataclass(frozen=True)
class Options:
    """Limits of a search. None for d or seasonal_d leaves them to tests; m of 0 looks for the period of each series."""

    m: int = 1
    most_p: int = 5
    most_q: int = 5
    most_sp: int = 2
    most_sq: int = 2
    most_order: int = 5
    most_d: int = 2
    most_sd: int = 1
    d: int | None = None
    seasonal_d: int | None = None
    stationary: bool = False
    criterion: str = "aicc"
    test: str = "kpss"
    seasonal_test: str = "seas"
    alpha: float = 0.05
    allow_drift: bool | None = None
    allow_mean: bool | None = None
    stepwise: bool = True
    diagonals: bool = False
    toggle_constant: bool = False
    parsimony: float = 1e-6
    most_steps: int = 50
    rounds: int = 100
    approximate: bool = False
    holdout: int = 0
    n_fits: int | None = None
    seed: int = 0


Order = tuple[int, int, int, int, bool]


@dataclass
class Found:
    """The chosen order of a series and its score; tried holds every candidate's, NaN where it failed."""

    order: tuple[int, int, int]
    seasonal: tuple[int, int, int, int]
    constant: bool
    score: float
    tried: dict[Order, float]


def differencing(y: np.ndarray, exog: np.ndarray | None, o: Options) -> list[tuple[int, int, int]]:
    """(m, seasonal d, d) of each series: the seasonal first, then the other on what it leaves. Regressors' share goes before."""
    out = []
    for i, x in enumerate(y):
        m = o.m if o.m > 0 else find_period(x)
        if exog is not None:
            z = np.column_stack([np.ones(len(x)), exog[i]])
            x = x - z @ np.linalg.lstsq(z, x, rcond=None)[0]
        sd = 0 if o.stationary or m < 2 or o.most_sd < 1 else int(n_seasonal_diffs(x[None], m, o.most_sd, o.seasonal_test)[0])
        sd = sd if o.seasonal_d is None or o.stationary else o.seasonal_d
        rest = difference(x[None], 0, sd, m)[0]
        d = 0 if o.stationary else n_diffs(rest, o.most_d, o.alpha, o.test) if o.d is None else o.d
        out.append((m, sd, d))
    return out


class _Batch:
    def __init__(self, y: np.ndarray, exog: np.ndarray | None, o: Options):
        self.y, self.exog, self.o = y, exog, o
        self.levels = differencing(y, exog, o)
        self.tried: list[dict[Order, float]] = [{} for _ in y]

    def fits(self, i: int, c: Order) -> bool:
        p, q, sp, sq, _ = c
        o, (m, _, _) = self.o, self.levels[i]
        inside = 0 <= p <= o.most_p and 0 <= q <= o.most_q and 0 <= sp <= o.most_sp and 0 <= sq <= o.most_sq
        return inside and p + q + sp + sq <= o.most_order and (m > 1 or sp + sq == 0)

    def score(self, wanted: list[tuple[int, Order]]) -> None:
        """Puts the scores of what isn't yet known into tried; candidates alike in differencing, period and constant are fitted together."""
        groups: dict[tuple, list[tuple[int, Order]]] = {}
        for i, c in wanted:
            if c not in self.tried[i] and self.fits(i, c):
                self.tried[i][c] = np.nan
                groups.setdefault((self.levels[i], c[4]), []).append((i, c))
        for (level, constant), pairs in groups.items():
            for at in range(0, len(pairs), TOGETHER):
                some = pairs[at : at + TOGETHER]
                for (i, c), v in zip(some, self._fit(some, level, constant), strict=True):
                    self.tried[i][c] = v

    def _fit(self, pairs: list[tuple[int, Order]], level: tuple[int, int, int], constant: bool) -> list[float]:
        o, (m, sd, d), rows = self.o, level, [i for i, _ in pairs]
        (p, q, sp, sq), free = free_of([c[:4] for _, c in pairs])
        y, x = self.y[rows], None if self.exog is None else self.exog[rows]
        cut = y.shape[1] - o.holdout
        try:
            with np.errstate(all="ignore"):
                model = Fitted(y[:, :cut], (p, d, q), (sp, sd, sq, m), constant, o.rounds, None if x is None else x[:, :cut], "css" if o.approximate else "css-ml", free=free)
                if o.holdout:
                    ahead, real = model.forecast(o.holdout, future=None if x is None else x[:, cut:])[0], y[:, cut:]
                    size = np.abs(ahead) + np.abs(real)
                    value = np.where(size > 0, 200 * np.abs(ahead - real) / np.where(size > 0, size, 1), 0).mean(1)
                else:
                    value = getattr(model, o.criterion)
        except (ValueError, np.linalg.LinAlgError):
            return [np.nan] * len(pairs)
        return [float(v) if np.isfinite(v) and ll > -1e299 else np.nan for v, ll in zip(value, model.log_l, strict=True)]

    def best(self, i: int) -> tuple[float, Order] | None:
        known = [(v, c) for c, v in self.tried[i].items() if not np.isnan(v)]
        return min(known) if known else None


def size(c: Order) -> int:
    return sum(c[:4]) + c[4]


def moves(c: Order, o: Options) -> list[Order]:
    """Candidates one step away: one of the four orders by one, pairs of them if diagonals are wanted, or the constant."""
    steps = [s for s in product((-1, 0, 1), repeat=4) if sum(map(abs, s)) == 1 or o.diagonals and (s[0] and s[1] and not (s[2] or s[3]) or s[2] and s[3] and not (s[0] or s[1]))]
    out = [tuple(a + b for a, b in zip(c[:4], s, strict=True)) + (c[4],) for s in steps]
    return out + ([c[:4] + (not c[4],)] if o.toggle_constant else [])


def search(y: np.ndarray, o: Options = Options(), exog: np.ndarray | None = None) -> list[Found | None]:
    """The chosen order of each series; None where no candidate could be fitted."""
    if y.shape[1] < 10:
        raise ValueError("10 values are the least")
    batch = _Batch(y, exog, o)
    constants = []
    for _, sd, d in batch.levels:
        said = o.allow_drift if d + sd else o.allow_mean
        constants.append((d + sd == 0) if said is None else said)
    box = [range(n + 1) for n in (o.most_p, o.most_q, o.most_sp, o.most_sq)]
    if not o.stepwise:
        for i, constant in enumerate(constants):
            grid = [(*c, constant) for c in product(*box)]
            grid = [c for c in grid if batch.fits(i, c)]
            if o.n_fits is not None and o.n_fits < len(grid):
                picked = np.random.Generator(np.random.Philox(key=o.seed)).permutation(len(grid))[: o.n_fits]
                grid = [grid[j] for j in sorted(picked)]
            batch.score([(i, c) for c in grid])
    else:
        wanted = []
        for i, constant in enumerate(constants):
            for start in STARTS:
                c = [min(a, max(b)) if batch.levels[i][0] > 1 or j < 2 else 0 for j, (a, b) in enumerate(zip(start, box, strict=True))]
                for j in (3, 2, 1, 0):
                    c[j] -= min(c[j], max(0, sum(c) - o.most_order))
                wanted.append((i, (*c, constant)))
        batch.score(wanted)
        at = {i: b for i in range(len(y)) if (b := batch.best(i))}
        live = set(at)
        for _ in range(o.most_steps):
            batch.score([(i, c) for i in sorted(live) for c in moves(at[i][1], o)])
            for i in sorted(live):
                value, c = at[i]
                near = [(batch.tried[i][n], n) for n in moves(c, o) if not np.isnan(batch.tried[i].get(n, np.nan))]
                better = [(v, n) for v, n in near if value - v > (max(o.parsimony, 1e-6) if size(n) > size(c) else 1e-6)]
                if better:
                    at[i] = min(better)
                else:
                    live.discard(i)
            if not live:
                break
    out: list[Found | None] = []
    for i, (m, sd, d) in enumerate(batch.levels):
        best = at.get(i) if o.stepwise else batch.best(i)
        if best is None:
            out.append(None)
            continue
        value, (p, q, sp, sq, constant) = best
        out.append(Found((p, d, q), (sp, sd, sq, m), constant, value, batch.tried[i]))
    return out
