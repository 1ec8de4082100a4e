"""Fits and forecasts of many series: series of one length and order in a task are fitted together, in lock step.

Rows are shuffled once, by series; what follows is a map over the packed series, so nothing is counted or shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.stats import n_diffs, normal_quantile
from seriesloom.kernels import arma, auto, power as powers, seasonal as tests, unitroot
from seriesloom.kernels.arma import Fitted
from seriesloom.kernels.statespace import Gapped
from seriesloom.operators.series import KEY, densify, pack

#: Series and candidates that are fitted together at most.
BATCH = 256

Order, Seasonal = tuple[int, int, int], tuple[int, int, int, int]
NONE: Seasonal = (0, 0, 0, 1)
MODEL = f"{KEY} string, p int, d int, q int, sp int, sd int, sq int, m int, phi array<double>, theta array<double>, mean double, beta array<double>, sigma2 double, log_l double, nobs int, aic double, aicc double, bic double"
FORECAST = f"{KEY} string, h int, forecast double, lower double, upper double"


def _packed(df: DataFrame, exog: list[str] | None = None) -> DataFrame:
    """Packed series and their lengths, spread by series over as many partitions as shuffles have (a fit costs more than its bytes say)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pack(df.repartition(n, KEY), exog).withColumn("n", F.size("ys"))


def _mapped(packed: DataFrame, run: Callable, schema: str, by: tuple[str, ...] = ("n",)) -> DataFrame:
    """run of rows alike in by, BATCH at a time."""

    def each(frames):
        for frame in frames:
            for _, rows in frame.groupby(list(by), sort=False):
                for at in range(0, len(rows), BATCH):
                    yield run(rows.iloc[at : at + BATCH])

    return packed.mapInPandas(each, schema)


def _values(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["ys"].to_numpy()).astype(float)


def _regressors(rows: pd.DataFrame, column: str = "xs") -> np.ndarray | None:
    return np.stack([np.stack(x) for x in rows[column]]).astype(float) if column in rows else None


def fit(df: DataFrame, order: Order, seasonal: Seasonal = NONE, *, exog: list[str] | None = None, mean: bool | None = None, method: str = "css-ml", init: str = "flat", polish: bool = False, power: float | None = None, shift: float = 0.0, drift: bool = False) -> DataFrame:
    """One model row for each series; exog names columns of regressors with ARMA errors; init and polish as in :class:`Fitted`.

    power is a Box-Cox power that series are transformed by before; drift adds a constant to a series differenced once, and
    is an error for one differenced oftener, where a constant would be a trend of higher degree. With method diffuse, places
    without a value between the first and last of a series are missing values (:class:`Gapped`, without regressors).
    """
    mean = _constant(order, seasonal, mean, drift)
    if method == "diffuse":
        return _mapped(_gapped(df, exog), lambda rows: _models(rows[KEY].to_numpy(), Gapped(_transformed(_values(rows), power, shift), order, seasonal, mean)), MODEL)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _models(rows[KEY].to_numpy(), Fitted(_transformed(_values(rows), power, shift), order, seasonal, mean, exog=_regressors(rows), method=method, init=init, polish=polish))

    return _mapped(_packed(df, exog), run, MODEL)


def _gapped(df: DataFrame, exog: list[str] | None) -> DataFrame:
    if exog:
        raise ValueError("the diffuse method takes no regressors")
    return _packed(densify(df.filter(F.col("y").isNotNull())))


def _constant(order: Order, seasonal: Seasonal, mean: bool | None, drift: bool) -> bool | None:
    if not drift:
        return mean
    if order[1] + seasonal[1] > 1:
        raise ValueError("a drift needs a series that is differenced once at most")
    return True


def _transformed(y: np.ndarray, power: float | None, shift: float) -> np.ndarray:
    if power is None:
        return y
    if (y + shift <= 0).any():
        raise ValueError("Box-Cox powers need positive values; give a shift")
    return powers.transform(y, power, shift)


def _models(keys, model: Fitted) -> pd.DataFrame:
    (p, d, q), (sp, sd, sq, m) = model.order, model.seasonal
    return pd.DataFrame({KEY: keys, "p": p, "d": d, "q": q, "sp": sp, "sd": sd, "sq": sq, "m": m, "phi": list(model.phi), "theta": list(model.theta), "mean": model.mean, "beta": list(model.coef[:, model.with_mean :]), "sigma2": model.sigma2, "log_l": model.log_l, "nobs": model.n, "aic": model.aic, "aicc": model.aicc, "bic": model.bic})


def _forecasts(keys, bands: tuple[np.ndarray, ...], names: tuple[str, ...] = ("forecast", "lower", "upper")) -> pd.DataFrame:
    h = bands[0].shape[1]
    return pd.DataFrame({KEY: np.repeat(keys, h), "h": np.tile(np.arange(1, h + 1), len(keys)), **{c: x.ravel() for c, x in zip(names, bands, strict=True)}})


def forecast(df: DataFrame, order: Order, seasonal: Seasonal = NONE, h: int = 12, *, exog: list[str] | None = None, future: DataFrame | None = None, mean: bool | None = None, level: float = 0.95, std_error: bool = False, power: float | None = None, shift: float = 0.0, drift: bool = False, method: str = "css-ml") -> DataFrame:
    """(series_id, h, forecast, lower, upper). With exog, future has (series_id, t, exog) for the h places after each series.

    level is that of the interval; std_error adds the forecast's error, on the scale of the model; power, shift, drift and method are as
    for :func:`fit`, and what is forecast is on the series' own scale (its median, with a power).
    """
    mean, z = _constant(order, seasonal, mean, drift), normal_quantile(0.5 + level / 2)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = _transformed(_values(rows), power, shift)
        if method == "diffuse":
            bands = Gapped(y, order, seasonal, mean).forecast(h, z)
        else:
            bands = Fitted(y, order, seasonal, mean, exog=_regressors(rows), method=method).forecast(h, z, _regressors(rows, "ahead"))
        error = (bands[2] - bands[0]) / z
        if power is not None:
            bands = tuple(powers.inverse(x, power, shift) for x in bands)
        return _forecasts(rows[KEY].to_numpy(), (*bands, error)[: 4 if std_error else 3], ("forecast", "lower", "upper", "std_error")[: 4 if std_error else 3])

    packed = _gapped(df, exog) if method == "diffuse" else _packed(df, exog)
    if exog:
        ahead = pack(future.withColumn("y", F.lit(0.0)), exog).select(KEY, F.slice("xs", 1, h).alias("ahead"))
        packed = packed.join(ahead, KEY)
    return _mapped(packed, run, f"{FORECAST}, std_error double" if std_error else FORECAST)


def search(df: DataFrame, *, most_p: int = 3, most_q: int = 3, most_order: int = 5, criterion: str = "aicc") -> DataFrame:
    """The best model row of each series over all (p, q) in the box, differenced as the KPSS test says.

    Candidates are made inside the task that has the series: all of series of one length and one d are fitted together,
    whatever their orders, and only the best of each is returned, as it was fitted.
    """
    grid = [(p, q, 0, 0) for p in range(most_p + 1) for q in range(most_q + 1) if p + q <= most_order]

    def some_of(rows: pd.DataFrame) -> pd.DataFrame:
        own = grid * len(rows)
        (p, q, _, _), free = arma.free_of(own)
        out = _models(np.repeat(rows[KEY].to_numpy(), len(grid)), Fitted(np.repeat(_values(rows), len(grid), 0), (p, int(rows["d"].iloc[0]), q), free=free))
        out["phi"], out["theta"] = [x[: c[0]] for x, c in zip(out["phi"], own, strict=True)], [x[: c[1]] for x, c in zip(out["theta"], own, strict=True)]
        out = out.assign(p=[c[0] for c in own], q=[c[1] for c in own])
        value = np.nan_to_num(out[criterion].to_numpy().reshape(len(rows), len(grid)), nan=np.inf)
        return out.iloc[np.arange(len(rows)) * len(grid) + value.argmin(1)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        step = max(1, auto.TOGETHER // len(grid))
        return pd.concat([some_of(rows.iloc[at : at + step]) for at in range(0, len(rows), step)])

    return _mapped(_packed(df).join(n_diffs(df), KEY), run, MODEL, ("n", "d"))


def _chosen(rows: pd.DataFrame, options: auto.Options) -> list[tuple[np.ndarray, auto.Found]]:
    """Rows that were given one order, and that order."""
    found = auto.search(_values(rows), options, _regressors(rows))
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(found):
        if f is not None:
            groups.setdefault((f.order, f.seasonal, f.constant), []).append(i)
    return [(np.array(at), found[at[0]]) for at in groups.values()]


def auto_arima(df: DataFrame, options: auto.Options = auto.Options(), *, exog: list[str] | None = None, failed: str = "drop") -> DataFrame:
    """One model row for each series, its orders found by a stepwise or full search.

    Series without any model are left out; with failed "keep" they have rows of nulls, and a column error says why.

    A search is a map over series: steps of one series don't wait for others' and no table is made for each step.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts, why = [], "no candidate could be fitted"
        try:
            chosen = _chosen(rows, options)
        except ValueError as x:
            if failed != "keep":
                raise
            chosen, why = [], str(x)
        for at, f in chosen:
            some = rows.iloc[at]
            parts.append(_models(some[KEY].to_numpy(), Fitted(_values(some), f.order, f.seasonal, f.constant, exog=_regressors(some))))
        out = pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in MODEL.split(", ")})
        if failed == "keep":
            rest = rows.loc[~rows[KEY].isin(out[KEY]), KEY]
            out = pd.concat([out.assign(error=None), pd.DataFrame({KEY: rest, "error": why})]).astype(object)
            out = out.where(out.notna(), None)
        return out

    if failed not in ("drop", "keep"):
        raise ValueError(f"no such policy: {failed}")
    return _mapped(_packed(df, exog), run, f"{MODEL}, error string" if failed == "keep" else MODEL)


def search_trace(df: DataFrame, options: auto.Options = auto.Options()) -> DataFrame:
    """(series_id, p, q, sp, sq, constant, score): every candidate of :func:`auto_arima`; score is null where its fit failed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = auto.search(_values(rows), options)
        out = [(key, *c, None if np.isnan(v) else v) for key, f in zip(rows[KEY], found, strict=True) if f for c, v in f.tried.items()]
        return pd.DataFrame(out, columns=[KEY, "p", "q", "sp", "sq", "constant", "score"])

    return _mapped(_packed(df), run, f"{KEY} string, p int, q int, sp int, sq int, constant boolean, score double")


def auto_forecast(df: DataFrame, h: int, options: auto.Options = auto.Options()) -> DataFrame:
    """(series_id, h, forecast, lower, upper) of each series' own orders."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for at, f in _chosen(rows, options):
            some = rows.iloc[at]
            parts.append(_forecasts(some[KEY].to_numpy(), Fitted(_values(some), f.order, f.seasonal, f.constant).forecast(h)))
        return pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in FORECAST.split(", ")})

    return _mapped(_packed(df), run, FORECAST)


def update(df: DataFrame, new: DataFrame, order: Order, seasonal: Seasonal = NONE, *, rounds: int = 25) -> DataFrame:
    """Model rows of df's series with new's later rows appended: a fit to df starts a short one to both."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, old = _values(rows), int(rows["old"].iloc[0])
        start = Fitted(y[:, :old], order, seasonal).x if old >= 10 else None
        return _models(rows[KEY].to_numpy(), Fitted(y, order, seasonal, rounds=rounds, start=start))

    both = df.select(KEY, "t", "y", F.lit(0).alias("late")).unionByName(new.select(KEY, "t", "y", F.lit(1).alias("late")))
    packed = _packed(both, ["late"]).withColumn("old", F.size(F.filter("xs", lambda x: x[0] == 0))).drop("xs")
    return _mapped(packed, run, MODEL, ("n", "old"))


def residuals(df: DataFrame, order: Order, seasonal: Seasonal = NONE) -> DataFrame:
    """(series_id, t, fitted, resid) in the sample, t counted from 0; the values that differencing takes have none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = _values(rows)
        model = Fitted(y, order, seasonal)
        e = model.residuals()
        n, lost = y.shape[1], y.shape[1] - e.shape[1]
        return pd.DataFrame({KEY: np.repeat(rows[KEY].to_numpy(), n - lost), "t": np.tile(np.arange(lost, n), len(rows)), "fitted": (y[:, lost:] - e).ravel(), "resid": e.ravel()})

    return _mapped(_packed(df), run, f"{KEY} string, t int, fitted double, resid double")


def summary(df: DataFrame, order: Order, seasonal: Seasonal = NONE, *, exog: list[str] | None = None) -> DataFrame:
    """(series_id, name, value, std_error, z, p): each coefficient and its error from the likelihood's Hessian."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        model = Fitted(_values(rows), order, seasonal, exog=_regressors(rows))
        value, error, names = arma.displayed(model), arma.standard_errors(model), arma.names(model)
        return pd.DataFrame({KEY: np.repeat(rows[KEY].to_numpy(), len(names)), "name": names * len(rows), "value": value.ravel(), "std_error": error.ravel()})

    from seriesloom.functions.stats import erfc

    found = _mapped(_packed(df, exog), run, f"{KEY} string, name string, value double, std_error double")
    found = found.withColumn("std_error", F.when(~F.isnan("std_error"), F.col("std_error"))).withColumn("z", F.col("value") / F.col("std_error"))
    return found.withColumn("p", erfc(F.abs("z") / 2**0.5))


def characteristic_roots(models: DataFrame) -> DataFrame:
    """(series_id, least_ar, least_ma, stationary, invertible) of model rows: the least size of roots, infinite where there are none."""

    def each(frames):
        for rows in frames:
            least = [[np.abs(r).min() if len(r := arma.roots(c, sign)) else np.inf for c in rows[column]] for column, sign in (("phi", -1.0), ("theta", 1.0))]
            yield pd.DataFrame({KEY: rows[KEY], "least_ar": least[0], "least_ma": least[1]})

    found = models.select(KEY, "phi", "theta").mapInPandas(each, f"{KEY} string, least_ar double, least_ma double")
    return found.withColumn("stationary", F.col("least_ar") > 1).withColumn("invertible", F.col("least_ma") > 1)


def diffuse_likelihood(df: DataFrame, order: Order, seasonal: Seasonal = NONE, kappa: float = 1e6) -> DataFrame:
    """(series_id, log_l, diffuse, approximate) of a fit: by the fast filter of differences, exactly diffuse, and with kappa."""
    from seriesloom.kernels import statespace

    def run(y: np.ndarray) -> np.ndarray:
        model, (_, d, _), (_, sd, _, m) = Fitted(y, order, seasonal, False), order, seasonal
        found = [-statespace.diffuse(y, model.phi, model.theta, d, sd, m, k)[0] for k in (None, kappa)]
        return np.stack([model.log_l, *found], 1)

    return per_batch(df, run, ["log_l", "diffuse", "approximate"])


def outliers(df: DataFrame, order: Order = (0, 1, 1), seasonal: Seasonal = NONE, *, kinds: tuple[str, ...] = ("AO", "LS"), critical: float | None = None, most: int = 5, delta: float = 0.7) -> DataFrame:
    """(series_id, t, kind, effect, size) in places counted from 0; kinds are AO, LS, TC and IO."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = arma.outliers(_values(rows), order, seasonal, kinds, critical, most, delta)
        return pd.DataFrame([(key, *x) for key, one in zip(rows[KEY], found, strict=True) for x in one], columns=[KEY, "t", "kind", "effect", "size"])

    return _mapped(_packed(df).filter("n >= 10"), run, f"{KEY} string, t int, kind string, effect double, size double")


def simulate(df: DataFrame, order: Order, seasonal: Seasonal = NONE, *, n: int, draws: int = 1, seed: int = 0) -> DataFrame:
    """(series_id, sim, t, y): series drawn from the model fitted to each, with normal shocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = arma.simulate(Fitted(_values(rows), order, seasonal), n, draws, [int(k) for k in rows["key"]], seed)
        return pd.DataFrame({KEY: np.repeat(rows[KEY].to_numpy(), draws * n), "sim": np.tile(np.repeat(np.arange(draws), n), len(rows)), "t": np.tile(np.arange(n), draws * len(rows)), "y": y.ravel()})

    return _mapped(_packed(df).withColumn("key", F.xxhash64(KEY)), run, f"{KEY} string, sim int, t int, y double")


def parameter_bootstrap(df: DataFrame, order: Order, seasonal: Seasonal = NONE, *, draws: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(series_id, name, value, corrected, mean, std_error, lower, upper) from refits to simulated series.

    corrected is twice the coefficient less the mean, within 0.99 of zero for ARMA coefficients. A series of which half the
    refits fail has nulls.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for at in range(0, len(rows), max(1, 4096 // draws)):
            some = rows.iloc[at : at + max(1, 4096 // draws)]
            model = Fitted(_values(some), order, seasonal)
            sampled = arma.parameter_bootstrap(model, [int(k) for k in some["key"]], draws, seed)
            sampled[np.isnan(sampled).any(2).mean(1) > 0.5] = np.nan
            with np.errstate(all="ignore"):
                low, high = np.nanquantile(sampled, [alpha / 2, 1 - alpha / 2], axis=1)
                found = {"value": arma.displayed(model), "corrected": arma.bias_corrected(model, sampled), "mean": np.nanmean(sampled, 1), "std_error": np.nanstd(sampled, 1, ddof=1), "lower": low, "upper": high}
            names = arma.names(model)
            parts.append(pd.DataFrame({KEY: np.repeat(some[KEY].to_numpy(), len(names)), "name": names * len(some), **{c: x.ravel() for c, x in found.items()}}))
        return pd.concat(parts)

    return _mapped(_packed(df).withColumn("key", F.xxhash64(KEY)), run, f"{KEY} string, name string, value double, corrected double, mean double, std_error double, lower double, upper double")


def bootstrap(df: DataFrame, order: Order, seasonal: Seasonal = NONE, *, h: int = 12, n: int = 1000, seed: int = 0, gaussian: bool = False) -> DataFrame:
    """(series_id, sim, h, value): sampled forecast paths; summarise with functions.stats.path_summary."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [int(k) for k in rows["key"]]
        paths = arma.sample_paths(Fitted(_values(rows), order, seasonal), h, n, keys, seed, gaussian)
        return pd.DataFrame({KEY: np.repeat(rows[KEY].to_numpy(), n * h), "sim": np.tile(np.repeat(np.arange(n), h), len(rows)), "h": np.tile(np.arange(1, h + 1), n * len(rows)), "value": paths.ravel()})

    return _mapped(_packed(df).withColumn("key", F.xxhash64(KEY)), run, f"{KEY} string, sim int, h int, value double")


def cross_validate(df: DataFrame, folds: DataFrame, order: tuple[int, int, int], seasonal: tuple[int, int, int, int] = (0, 0, 0, 1), *, horizon: int) -> DataFrame:
    """(series_id, fold, smape, mae, mse, rmse): each fold of each series is fitted as a series of its own."""
    from seriesloom.functions.stats import errors
    from seriesloom.operators.series import fold_rows

    rows = fold_rows(df, folds).withColumn("origin", F.struct(KEY, "fold"))
    name = F.to_json("origin")
    train = rows.filter("role = 'train'").select(name.alias(KEY), "t", "y")
    test = rows.filter("role = 'test'").join(folds.select(KEY, "fold", "test_lo"), [KEY, "fold"]).select(KEY, "fold", name.alias("name"), (F.col("t") - F.col("test_lo") + 1).alias("h"), F.col("y").alias("y_true"))
    pred = forecast(train, order, seasonal, horizon).select(F.col(KEY).alias("name"), "h", F.col("forecast").alias("y_pred"))
    return errors(test.join(pred, ["name", "h"]), KEY, "fold")


def per_series(df: DataFrame, function: Callable, columns: list[str]) -> DataFrame:
    """(series_id, columns): function(values) gives a number for each column."""
    return per_batch(df, lambda y: np.array([function(x) for x in y], float).reshape(len(y), len(columns)), columns)


def per_batch(df: DataFrame, function: Callable, columns: list[str], least: int = 1) -> DataFrame:
    """(series_id, columns): function([B, n]) gives [B, columns] for series of one length; those below least are left out. NaN is null."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.asarray(function(_values(rows)), float).reshape(len(rows), len(columns))
        return pd.DataFrame({KEY: rows[KEY].to_numpy(), **{c: found[:, i] for i, c in enumerate(columns)}})

    out = _mapped(_packed(df).filter(F.col("n") >= least), run, ", ".join([f"{KEY} string", *(f"{c} double" for c in columns)]))
    return out.select(KEY, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns))


def per_place(df: DataFrame, function: Callable, columns: list[str]) -> DataFrame:
    """(series_id, t, columns), t counted from 0: function([B, n]) gives [B, n] for each column, for series of one length."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = function(_values(rows))
        n = found[0].shape[1]
        return pd.DataFrame({KEY: np.repeat(rows[KEY].to_numpy(), n), "t": np.tile(np.arange(n), len(rows)), **{c: x.ravel() for c, x in zip(columns, found, strict=True)}})

    return _mapped(_packed(df), run, ", ".join([f"{KEY} string", "t int", *(f"{c} double" for c in columns)]))


def adf(df: DataFrame, *, lags: int | None = None, trend: bool = False, alpha: float = 0.05) -> DataFrame:
    return per_batch(df, lambda y: unitroot.adf_batch(y, lags, trend), ["stat", "p"]).withColumn("diff", F.col("p") > alpha)


def pp(df: DataFrame, *, trend: bool = False, short: bool = True, coefficient: bool = False, alpha: float = 0.05) -> DataFrame:
    """The test in its t form, or in its coefficient form (which has a trend)."""
    if coefficient:
        found = per_series(df, lambda y: unitroot.pp_alpha(y, short), ["stat", "p"])
    else:
        found = per_batch(df, lambda y: unitroot.pp_batch(y, trend, short), ["stat", "p"])
    return found.withColumn("diff", F.col("p") > alpha)


def exact_likelihood(df: DataFrame, phi: list[float], theta: list[float]) -> DataFrame:
    """(series_id, log_l, sigma2) of given coefficients, with the variance concentrated out."""

    def run(y: np.ndarray) -> np.ndarray:
        value, sigma2 = arma.exact(y, np.tile(np.array(phi, float), (len(y), 1)), np.tile(np.array(theta, float), (len(y), 1)))
        return np.stack([-value, sigma2], 1)

    return per_batch(df, run, ["log_l", "sigma2"])


def arch_lm(df: DataFrame, lags: int) -> DataFrame:
    """(series_id, lm, p): squared values on those of so many places before."""
    from seriesloom.functions.stats import chi2_tail

    def run(y: np.ndarray) -> np.ndarray:
        a = y**2
        x = np.concatenate([np.ones((len(a), a.shape[1] - lags, 1)), tests.lagged(a, range(1, lags + 1), lags)], 2)
        e, now = tests.ols(x, a[:, lags:])[1], a[:, lags:]
        return now.shape[1] * (1 - (e**2).sum(1) / ((now - now.mean(1, keepdims=True)) ** 2).sum(1))

    return per_batch(df, run, ["lm"], 2 * lags + 2).withColumn("p", chi2_tail(F.col("lm"), lags))


def stl(df: DataFrame, m: int, *, window: int = 11, trend_window: int | None = None) -> DataFrame:
    """(series_id, t, trend, seasonal, remainder), t counted from 0; a series of less than two cycles is left out."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.stack(unitroot.stl(y, m, window, trend_window)) for y in _values(rows)]
        n = parts[0].shape[1]
        return pd.DataFrame({KEY: np.repeat(rows[KEY].to_numpy(), n), "t": np.tile(np.arange(n), len(rows)), **{c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("trend", "seasonal", "remainder"))}})

    return _mapped(_packed(df).filter(F.col("n") >= 2 * m), run, f"{KEY} string, t int, trend double, seasonal double, remainder double")


def seasonal_strength(df: DataFrame, m: int, limit: float = 0.64) -> DataFrame:
    """(series_id, strength, seasonal_diff): whether seasonality is strong enough to difference."""
    return per_series(df, lambda y: unitroot.seasonal_strength(y, m), ["strength"]).withColumn("seasonal_diff", F.col("strength") > limit)


def canova_hansen(df: DataFrame, m: int) -> DataFrame:
    """(series_id, stat, critical, seasonal_diff); a series shorter than 2 m + 5 is left out."""
    found = per_batch(df, lambda y: tests.canova_hansen(y, m), ["stat"], 2 * m + 5).withColumn("critical", F.lit(tests.ch_critical(m)))
    return found.withColumn("seasonal_diff", F.col("stat") > F.col("critical"))


def ocsb(df: DataFrame, m: int, *, most: int = 3, criterion: str | None = "aic") -> DataFrame:
    """(series_id, stat, critical, seasonal_diff); stat is null where a series is too short."""
    found = per_batch(df, lambda y: tests.ocsb(y, m, most, criterion), ["stat"], m + 2).withColumn("critical", F.lit(float(tests.ocsb_critical(m))))
    return found.withColumn("seasonal_diff", F.col("stat") > F.col("critical"))


def hegy(df: DataFrame, m: int, *, deterministic: str = "ct", criterion: str | None = "aic", most: int = 3, draws: int = 1000) -> DataFrame:
    """(series_id, name, stat, p, lag) for each frequency and jointly; series of less than four cycles are left out.

    Levels come from simulated seasonal random walks of the same length.
    """
    names = tests.hegy_names(m)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        stat, p, lag = tests.hegy_p(_values(rows), m, deterministic, criterion, most, draws)
        return pd.DataFrame({KEY: np.repeat(rows[KEY].to_numpy(), len(names)), "name": names * len(rows), "stat": stat.ravel(), "p": p.ravel(), "lag": np.repeat(lag, len(names))})

    return _mapped(_packed(df).filter(F.col("n") >= 4 * m), run, f"{KEY} string, name string, stat double, p double, lag int")


def n_seasonal_diffs(df: DataFrame, m: int, *, most: int = 1, test: str = "seas") -> DataFrame:
    """(series_id, sd): how often to difference at lag m; test is seas, ch, ocsb or hegy."""
    return per_batch(df, lambda y: tests.n_seasonal_diffs(y, m, most, test), ["sd"]).select(KEY, F.col("sd").cast("int").alias("sd"))


def find_period(df: DataFrame) -> DataFrame:
    """(series_id, period): where an autoregression's spectrum has its peak; 1 without one."""
    return per_series(df, lambda y: tests.find_period(y), ["period"]).select(KEY, F.col("period").cast("int").alias("period"))


def save(models: DataFrame, path: str) -> None:
    models.withColumn("version", F.lit(1)).write.mode("overwrite").json(path)


def load(spark, path: str) -> DataFrame:
    """Saved models; raises if a row breaks what holds for every model."""
    rows = spark.read.schema(f"{MODEL}, version int").json(path)
    fits = (F.col("version") == 1) & (F.size("phi") == F.col("p") + F.col("sp") * F.col("m")) & (F.size("theta") == F.col("q") + F.col("sq") * F.col("m")) & (F.least("p", "d", "q", "sp", "sd", "sq") >= 0) & (F.col("sigma2") >= 0)
    if bad := rows.filter(~F.coalesce(fits, F.lit(False))).limit(1).collect():
        raise ValueError(f"not a valid model: {bad[0]}")
    return rows.drop("version")
