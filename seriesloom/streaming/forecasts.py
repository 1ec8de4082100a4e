"""Forecasts that follow a stream of (series_id, t, y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from seriesloom.kernels.arma import Fitted
from seriesloom.operators.series import KEY
from seriesloom.plans.models import NONE, Order, Seasonal

OUT = [KEY, "t", "h", "forecast", "lower", "upper"]


def joined(first: int, ys: list[float], waiting: dict[int, float], keep: int, patience: int, give_up: bool = False) -> tuple[int, list[float], dict[int, float]]:
    """The series from place first on with what waits joined to it at either end, and what still waits.

    A value waits behind a gap until rows fill it, until values lie more than patience places beyond the end, or until give_up.
    Then the gap is filled along a line, which rows that come later overwrite; after a gap of keep places or more the series
    starts anew. Values keep places or more before the last are dropped, so at most keep + patience are held.
    """
    ys, waiting = list(ys), dict(waiting)
    if not ys and waiting:
        first = min(waiting)
    while True:
        for t in sorted(waiting):
            if t == first + len(ys):
                ys.append(waiting.pop(t))
            elif first <= t < first + len(ys):
                ys[t - first] = waiting.pop(t)
        head = []
        while first - 1 in waiting:
            first -= 1
            head.append(waiting.pop(first))
        ys = head[::-1] + ys
        last = first + len(ys) - 1
        waiting = {t: y for t, y in waiting.items() if t > last - keep}
        after, before = [t for t in waiting if t > last], [t for t in waiting if t < first]
        if after and (give_up or max(after) - last > patience):
            t = min(after)
            if t - last > keep:
                first, ys = t, []
            else:
                ys += np.linspace(ys[-1], waiting[t], t - last + 1)[1:-1].tolist()
        elif before and give_up:
            t = max(before)
            ys, first = np.linspace(waiting[t], ys[0], first - t + 1)[1:-1].tolist() + ys, t + 1
        else:
            break
    extra = max(0, len(ys) - keep)
    return first + extra, ys[extra:], waiting


def follow(stream: DataFrame, order: Order, seasonal: Seasonal = NONE, *, h: int = 12, keep: int = 2000, rounds: int = 25, patience: int = 100, wait: float | None = None) -> DataFrame:
    """(series_id, t, h, forecast, lower, upper) of each series that got rows in a batch, from its last place t on.

    The state of a series is its last keep values, what waits behind a gap (:func:`joined`) and the last fit's parameters,
    which start the next fit. Rows may come in any order and again: the later arrival holds, and rows before the first place
    are joined as others are. Nulls and NaN count as gaps. With wait, a gap that stays open while no row of the series comes for
    so many seconds is filled, and the series forecast then; Spark runs batches without rows for that, so a query with the
    trigger availableNow wouldn't end. Fewer than ten values make no forecast.
    """

    def step(key, frames, state):
        first, ys, late_t, late_y, x = state.get if state.exists else (0, [], [], [], [])
        expired = wait is not None and state.hasTimedOut
        x, waiting = list(x), dict(zip(late_t, late_y, strict=True))
        for frame in frames:
            waiting.update((int(t), float(y)) for t, y in zip(frame["t"], frame["y"], strict=True) if not pd.isna(t) and not pd.isna(y))
        first, ys, waiting = joined(first, ys, waiting, keep, patience, expired)
        out = pd.DataFrame(columns=OUT)
        if len(ys) >= 10:
            try:
                model = Fitted(np.array([ys]), order, seasonal, rounds=rounds if x else 100, start=np.array([x]) if x else None)
                x = [float(v) for v in model.x[0]]
                bands = model.forecast(h)
                out = pd.DataFrame({KEY: key[0], "t": first + len(ys) - 1, "h": np.arange(1, h + 1), **{c: b[0] for c, b in zip(OUT[3:], bands, strict=True)}})
            except ValueError:
                pass  # too short for the order yet
        state.update((first, ys, list(waiting), list(waiting.values()), x))
        if waiting and wait is not None:
            state.setTimeoutDuration(max(1, int(wait * 1000)))
        yield out

    return stream.groupBy(KEY).applyInPandasWithState(step, f"{KEY} string, t int, h int, forecast double, lower double, upper double", "first int, ys array<double>, late_t array<int>, late_y array<double>, x array<double>", "update", "NoTimeout" if wait is None else "ProcessingTimeTimeout")
