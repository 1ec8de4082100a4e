"""Tests, diagnostics, decomposition, metrics and features as native expressions over (series_id, t, y)."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.series import KEY, T, Y, acf, centred, interpolated, ordered, whole

# Critical values of the KPSS test and their levels.
KPSS_P = (0.10, 0.05, 0.025, 0.01)
KPSS_LEVEL = (0.347, 0.463, 0.574, 0.739)
KPSS_TREND = (0.119, 0.146, 0.176, 0.216)


def lag_length(n: Column, short: bool = True) -> Column:
    return F.floor((4 if short else 12) * F.pow(n / 100.0, F.lit(0.25))).cast("int")


def kpss(df: DataFrame, *, trend: bool = False, short: bool = True, lag: int | None = None, alpha: float = 0.05) -> DataFrame:
    """(series_id, n, stat, p, diff): stationarity round a level or a trend; the long-run variance has Bartlett weights.

    As many lag products are summed as the lag asks for, however long a series is.
    """
    if trend:
        x = F.col(T).cast("double")
        slope, mean_t, mean_y = F.regr_slope(F.col(Y), x).over(whole()), F.avg(x).over(whole()), F.avg(Y).over(whole())
        e = df.withColumn("e", F.col(Y) - mean_y - slope * (x - mean_t))
    else:
        e = centred(df)
    rows = e.withColumn("s", F.sum("e").over(ordered()))
    sums = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.sum(F.col("e") ** 2).alias("c0"), F.sum(F.col("s") ** 2).alias("walk"), _in_order("e").alias("es"))
    n = F.col("n")
    spread = F.col("c0") / n + _lagged("es", n, F.lit(lag) if lag is not None else lag_length(n, short))
    stat = F.col("walk") / (n * n) / F.col("spread")
    table = list(zip(KPSS_TREND if trend else KPSS_LEVEL, KPSS_P, strict=True))
    return sums.withColumn("spread", spread).withColumn("stat", stat).select(KEY, "n", "stat", interpolated(F.col("stat"), table).alias("p")).withColumn("diff", F.col("p") < alpha)


def _in_order(column: str) -> Column:
    """An aggregate: the column's values as an array in order, nulls in their places."""
    return F.transform(F.array_sort(F.collect_list(F.struct(T, column))), lambda r: r[column])


def _lagged(values: str, n: Column, lag: Column) -> Column:
    """What lags 1 to lag add to the long-run variance of an array of n residuals: their products, with Bartlett weights."""
    e, size = F.col(values), F.size(values)

    def product(k: Column) -> Column:
        rest = F.greatest(size - k, F.lit(0))
        return F.aggregate(F.zip_with(F.slice(e, k + 1, rest), F.slice(e, F.lit(1), rest), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda total, x: total + x)

    lags = F.when(lag > 0, F.sequence(F.lit(1), F.greatest(lag, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(lags, F.lit(0.0), lambda total, k: total + 2.0 / n * (1 - k / (lag + 1.0)) * product(k))


def n_diffs(df: DataFrame, *, most: int = 2, alpha: float = 0.05) -> DataFrame:
    """(series_id, d): how often to difference until the KPSS test accepts, with lag trunc(3 sqrt(n) / 13).

    All levels are columns of one pass: a single shuffle by series, whatever most is.
    """
    levels = range(most)
    rows = df.select(KEY, T, F.col(Y).alias("y0"))
    for k in levels[1:]:
        rows = rows.withColumn(f"y{k}", F.col(f"y{k - 1}") - F.lag(f"y{k - 1}").over(ordered()))
    rows = rows.select("*", *((F.col(f"y{k}") - F.avg(f"y{k}").over(whole())).alias(f"e{k}") for k in levels))
    rows = rows.select("*", *(F.sum(f"e{k}").over(ordered()).alias(f"s{k}") for k in levels))
    sums = rows.groupBy(KEY).agg(
        *(f for k in levels for f in (F.count(f"y{k}").alias(f"n{k}"), (F.min(f"y{k}") == F.max(f"y{k}")).alias(f"flat{k}"), F.sum(F.col(f"s{k}") ** 2).alias(f"walk{k}"), F.sum(F.col(f"e{k}") ** 2).alias(f"c{k}_0"))),
        *(_in_order(f"e{k}").alias(f"es{k}") for k in levels),
    )
    spreads = []
    for k in levels:
        n = F.col(f"n{k}")
        lag = F.greatest(F.lit(1), F.floor(3 * F.sqrt(n) / 13)).cast("int")
        spreads.append((F.col(f"c{k}_0") / n + _lagged(f"es{k}", n, lag)).alias(f"spread{k}"))
    found = sums.select("*", *spreads)
    d = F.lit(most)
    for k in reversed(levels):
        found = found.withColumn(f"p{k}", F.when(F.col(f"spread{k}") > 0, F.col(f"walk{k}") / (F.col(f"n{k}") * F.col(f"n{k}")) / F.col(f"spread{k}")))
        stays = F.col(f"flat{k}") | (interpolated(F.col(f"p{k}"), list(zip(KPSS_LEVEL, KPSS_P, strict=True))) >= alpha)
        d = F.when(F.coalesce(stays, F.lit(True)), k).otherwise(d)
    return found.select(KEY, d.cast("int").alias("d"))


def portmanteau(df: DataFrame, lags: int, order: int = 0) -> DataFrame:
    """(series_id, n, ljung_box, box_pierce, df, and the upper tails where df is even)."""
    finite = df.filter(F.col(Y).isNotNull() & ~F.isnan(Y))
    n = finite.groupBy(KEY).agg(F.count("*").alias("n"))
    r = acf(finite, lags).filter("lag > 0").join(n, KEY)
    q = r.groupBy(KEY, "n").agg(F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag"))).alias("w"), F.sum(F.col("acf") ** 2).alias("u"))
    dof = max(1, lags - order)
    q = q.select(KEY, "n", (F.col("n") * (F.col("n") + 2) * F.col("w")).alias("ljung_box"), (F.col("n") * F.col("u")).alias("box_pierce"), F.lit(dof).alias("df"))
    return q.withColumns({f"{c}_p": chi2_tail(F.col(c), dof) for c in ("ljung_box", "box_pierce")})


def chi2_tail(x: Column, dof: int) -> Column:
    """P(chi squared > x); native where dof is even: a Poisson sum. For odd dof the complementary error function's expansion starts it."""
    half = x / 2
    if dof % 2 == 0:
        return F.exp(-half) * sum((F.pow(half, F.lit(float(k))) / math.factorial(k) for k in range(dof // 2)), F.lit(0.0))
    tail = erfc(F.sqrt(half))
    return tail + F.exp(-half) * sum((F.pow(half, F.lit(k - 0.5)) / math.gamma(k + 0.5) for k in range(1, dof // 2 + 1)), F.lit(0.0))


def erfc(x: Column) -> Column:
    """For x of 0 and above, by a continued fraction beyond 2 and the Taylor series below."""
    series = F.lit(0.0)
    for k in reversed(range(60)):
        series = series + F.lit((-1) ** k / (math.factorial(k) * (2 * k + 1))) * F.pow(x, F.lit(float(2 * k + 1)))
    fraction = x
    for k in reversed(range(1, 40)):
        fraction = x + F.lit(k / 2.0) / fraction
    return F.when(x < 2, 1 - 2 / math.sqrt(math.pi) * series).otherwise(F.exp(-x * x) / (fraction * math.sqrt(math.pi)))


def jarque_bera(df: DataFrame) -> DataFrame:
    e = centred(df.filter(F.col(Y).isNotNull() & ~F.isnan(Y)))
    m = e.groupBy(KEY).agg(F.count("*").alias("n"), *(F.avg(F.pow("e", F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)))
    skew, kurt = F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / (F.col("m2") * F.col("m2"))
    jb = F.col("n") / 6.0 * (skew * skew + (kurt - 3) ** 2 / 4)
    return m.select(KEY, "n", skew.alias("skewness"), kurt.alias("kurtosis"), jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def arch_lm(df: DataFrame) -> DataFrame:
    """One lag: squared values on those before, (n - 1) times R squared."""
    sq = df.select(KEY, T, (F.col(Y) ** 2).alias("a")).withColumn("b", F.lag("a").over(ordered()))
    out = sq.filter(F.col("b").isNotNull()).groupBy(KEY).agg(F.count("*").alias("n"), F.regr_r2("a", "b").alias("r2"))
    return out.select(KEY, (F.col("n") * F.col("r2")).alias("lm")).withColumn("p", chi2_tail(F.col("lm"), 1))


def decompose(df: DataFrame, m: int, *, multiplicative: bool = False) -> DataFrame:
    """(series_id, t, y, trend, seasonal, random): a moving average of m, and the mean of each phase of what it leaves.

    The average at t is that of m values from t - m // 2 on. Phases are counted from the first position.
    """
    w = ordered().rowsBetween(-(m // 2), m - 1 - m // 2)
    trend = df.withColumn("trend", F.when(F.count(Y).over(w) == m, F.avg(Y).over(w)))
    off = F.col(Y) / F.col("trend") if multiplicative else F.col(Y) - F.col("trend")
    phase = F.pmod(F.col(T) - F.min(T).over(whole()), F.lit(m))
    out = trend.withColumn("off", off).withColumn("phase", phase)
    out = out.withColumn("seasonal", F.avg("off").over(Window.partitionBy(KEY, "phase")))
    rest = F.col("off") / F.col("seasonal") if multiplicative else F.col("off") - F.col("seasonal")
    return out.select(KEY, T, Y, "trend", "seasonal", rest.alias("random"))


def errors(pairs: DataFrame, *by: str) -> DataFrame:
    """SMAPE, MAE, MSE and RMSE of (y_true, y_pred) for each of by."""
    a, p = F.col("y_true"), F.col("y_pred")
    size = F.abs(a) + F.abs(p)
    out = pairs.groupBy(*by).agg(F.avg(F.when(size == 0, 0.0).otherwise(200 * F.abs(p - a) / size)).alias("smape"), F.avg(F.abs(p - a)).alias("mae"), F.avg((p - a) ** 2).alias("mse"))
    return out.withColumn("rmse", F.sqrt("mse"))


def mase_scale(train: DataFrame, season: int = 1) -> DataFrame:
    """(series_id, scale): the mean absolute difference at lag season."""
    d = train.withColumn("d", F.abs(F.col(Y) - F.lag(Y, season).over(ordered())))
    return d.groupBy(KEY).agg(F.avg("d").alias("scale"))


def seasonal_naive(df: DataFrame, season: int, horizon: int) -> DataFrame:
    """(series_id, t, y_true, y_pred): the last horizon values against those a season before, from the part before them."""
    n, place = F.count("*").over(whole()), F.row_number().over(ordered())
    back = [F.lag(Y, season * k).over(ordered()) for k in range(1, -(-horizon // season) + 1)]
    ahead = place - (n - horizon)
    pred = F.coalesce(*(F.when(ahead <= season * (k + 1), b) for k, b in enumerate(back)))
    return df.select(KEY, T, F.col(Y).alias("y_true"), pred.alias("y_pred"), ahead.alias("_a")).filter("_a > 0").drop("_a")


def fourier(df: DataFrame, m: int, k: int | None = None) -> DataFrame:
    """Adds sin_1, cos_1, ... for k pairs (half of m, unless given), for times counted from 1."""
    k = m // 2 if k is None else k
    if 2 * k > m:
        raise ValueError("2 k must be m at most")
    angle = lambda j: 2 * math.pi * j * (F.col(T) + 1) / m
    return df.select("*", *(f(angle(j)).alias(f"{name}_{j}") for j in range(1, k + 1) for name, f in (("sin", F.sin), ("cos", F.cos))))


def date_features(df: DataFrame, ds: str = "ds") -> DataFrame:
    """Adds one column for each weekday from Monday and the day of the month."""
    names = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
    return df.select("*", *((F.weekday(ds) == i).cast("int").alias(d) for i, d in enumerate(names)), F.dayofmonth(ds).alias("day"))


def future_dates(last: DataFrame, h: int, unit: str = "day") -> DataFrame:
    """From (series_id, ds) h later rows: unit day, week, month, quarter or year; month ends are clamped."""
    step = {"day": F.make_interval(days=F.col("h")), "week": F.make_interval(weeks=F.col("h")), "month": F.make_interval(months=F.col("h")), "quarter": F.make_interval(months=F.col("h") * 3), "year": F.make_interval(years=F.col("h"))}[unit]
    return last.select(KEY, "ds", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("h")).select(KEY, "h", (F.col("ds") + step).alias("ds"))


def box_cox(y: Column, lam: float, shift: float = 0.0) -> Column:
    x = y + shift
    return F.when(x > 0, F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam)


def inverse_box_cox(z: Column, lam: float, shift: float = 0.0) -> Column:
    """By a signed power; null where lam is negative and z above -1 / lam."""
    if abs(lam) < 1e-12:
        return F.exp(z) - shift
    x = z * lam + 1
    out = F.signum(x) * F.pow(F.abs(x), F.lit(1 / lam)) - shift
    return F.when(z > -1 / lam, None).otherwise(out) if lam < 0 else out


def information_criteria(models: DataFrame) -> DataFrame:
    """Adds aic, aicc, bic and hqic to rows with log_l, n and k."""
    ll, n, k = F.col("log_l"), F.col("n"), F.col("k")
    aic = -2 * ll + 2 * k
    return models.select("*", aic.alias("aic"), F.when(n - k - 1 > 0, aic + 2 * k * (k + 1) / (n - k - 1)).otherwise(F.lit(float("inf"))).alias("aicc"), (-2 * ll + k * F.ln(n)).alias("bic"), (-2 * ll + 2 * k * F.ln(F.ln(n))).alias("hqic"))


def outlier_regressor(df: DataFrame, kind: str, at: int, delta: float = 0.7) -> DataFrame:
    """Adds ``x``: an impulse (AO), a step (LS) or a fading change (TC) from position at on."""
    after = F.col(T) - at
    x = {"AO": F.when(after == 0, 1.0), "LS": F.when(after >= 0, 1.0), "TC": F.when(after >= 0, F.pow(F.lit(delta), after.cast("double")))}[kind]
    return df.withColumn("x", x.otherwise(0.0))


def css_residuals(df: DataFrame, phi: list[float], theta: list[float]) -> DataFrame:
    """(series_id, t, e): the residuals of given coefficients, t counted from 0, earlier ones 0; time in proportion to a series."""
    from seriesloom.kernels import arma
    from seriesloom.plans.models import per_place

    p, q = len(phi), len(theta)

    def run(y: np.ndarray) -> list[np.ndarray]:
        rows = lambda c: np.tile(np.array(c, float), (len(y), 1)).reshape(len(y), len(c))
        return [arma.css_residuals(y, rows(phi), rows(theta), np.full(len(y), max(p, q)))]

    return per_place(df, run, ["e"])


def psi_weights(phi: list[float], theta: list[float], h: int, d: int = 0, seasonal_d: int = 0, m: int = 1) -> list[float]:
    """The moving-average weights of a model, integrated d times and seasonal_d times at lag m."""
    psi = [1.0]
    for k in range(1, h):
        psi.append((theta[k - 1] if k <= len(theta) else 0.0) + sum(c * psi[k - i - 1] for i, c in enumerate(phi) if k > i))
    for lag, times in ((1, d), (m, seasonal_d)):
        for _ in range(times):
            for k in range(lag, h):
                psi[k] += psi[k - lag]
    return psi


def random_walk_forecast(df: DataFrame, h: int, z: float = 1.959963984540054) -> DataFrame:
    """(series_id, h, forecast, lower, upper) of (0,1,0): the last value, with spread sigma times the root of h."""
    d = df.withColumn("d", F.col(Y) - F.lag(Y).over(ordered()))
    last = d.groupBy(KEY).agg(F.max_by(Y, T).alias("last"), F.avg(F.col("d") ** 2).alias("sigma2"))
    rows = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("h"))
    half = z * F.sqrt(F.col("sigma2") * F.col("h"))
    return rows.select(KEY, "h", F.col("last").alias("forecast"), (F.col("last") - half).alias("lower"), (F.col("last") + half).alias("upper"))


def path_summary(paths: DataFrame, alpha: float = 0.05) -> DataFrame:
    """From (series_id, sim, h, value): mean, sample variance and linear quantiles for each horizon."""
    return paths.groupBy(KEY, "h").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.percentile("value", F.lit(alpha / 2)).alias("lower"), F.percentile("value", F.lit(1 - alpha / 2)).alias("upper"))


def candidate_grid(spark, p: int, q: int, sp: int, sq: int, most: int) -> DataFrame:
    """All (p, q, sp, sq) in the box whose sum is most or less."""
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    grid = spark.range(1).select(side(p).alias("p")).select("p", side(q).alias("q")).select("p", "q", side(sp).alias("sp")).select("p", "q", "sp", side(sq).alias("sq"))
    return grid.filter(F.col("p") + F.col("q") + F.col("sp") + F.col("sq") <= most)


def box_cox_lambda(df: DataFrame, *, low: int = -200, high: int = 200, shift: float = 0.0) -> DataFrame:
    """(series_id, lam): the profile likelihood's best power among hundredths from low / 100 to high / 100."""
    x = F.col(Y) + shift
    base = df.filter(x > 0).select(KEY, x.alias("x"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("k"))
    lam = F.col("k") / 100.0
    z = F.when(F.col("k") == 0, F.ln("x")).otherwise((F.pow("x", lam) - 1) / lam)
    fit = base.select(KEY, "k", z.alias("z"), F.ln("x").alias("l")).groupBy(KEY, "k").agg(F.count("*").alias("n"), F.var_pop("z").alias("v"), F.sum("l").alias("l"))
    value = F.when(F.col("v") > 0, -F.col("n") / 2.0 * F.ln("v") + (lam - 1) * F.col("l"))
    return fit.groupBy(KEY).agg((F.max_by("k", value) / 100.0).alias("lam"))


def box_cox_power(df: DataFrame, *, low: float = -2.0, high: float = 2.0, shift: float = 0.0, tol: float = 1e-7, floor: str = "drop") -> DataFrame:
    """(series_id, lam): the profile likelihood's best power between low and high, to tol, by a golden section.

    Values whose sum with shift isn't positive have no likelihood: with floor "drop" they don't count, with "raise" they are an error.
    A series with fewer than two different values has a null power.
    """
    from seriesloom.kernels import power
    from seriesloom.plans.models import per_batch

    if floor not in ("drop", "raise"):
        raise ValueError(f"no such floor: {floor}")
    if floor == "raise" and df.filter(F.col(Y) + shift <= 0).limit(1).count():
        raise ValueError("values are not positive")
    return per_batch(df.filter(F.col(Y) + shift > 0), lambda y: power.best(y + shift, low, high, tol)[:, None], ["lam"])


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def cv_summary(scores: DataFrame, metric: str = "smape") -> DataFrame:
    """(series_id, mean, std) of a metric over folds; std is 0 for a single fold."""
    return scores.groupBy(KEY).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"))


def out_of_fold(df: DataFrame, predictions: DataFrame) -> DataFrame:
    """(series_id, t, pred) for all places of df: that of the last fold which predicted it, null where none did.

    predictions: (series_id, fold, t, pred).
    """
    last = predictions.groupBy(KEY, T).agg(F.max_by("pred", "fold").alias("pred"))
    return df.select(KEY, T).join(last, [KEY, T], "left")
