"""Batched tests, searches inside tasks, powers, drift, levels, failed series, ranges of an interpolation grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import stats
from seriesloom.kernels import arma, power, unitroot
from seriesloom.operators import series
from seriesloom.plans import models


def walks(n=60, rows=6, seed=3):
    return np.cumsum(np.random.default_rng(seed).normal(size=(rows, n)), 1) + 30


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame([(f"s{i}", t, float(v)) for i, y in enumerate(walks()) for t, v in enumerate(y)], "series_id string, t int, y double").cache()


def test_first_column_against_psi_weights():
    rng = np.random.default_rng(0)
    for p, q in ((1, 0), (1, 1), (2, 1), (3, 4), (0, 3), (13, 14)):
        phi = arma.stationary(rng.normal(size=(5, p)) * 0.15) if p else np.zeros((5, 0))
        theta = arma.stationary(rng.normal(size=(5, q)) * 0.3, 1.0) if q else np.zeros((5, 0))
        r = max(p, q + 1)
        phi, theta = np.pad(phi, ((0, 0), (0, r - p))), np.pad(theta, ((0, 0), (0, r - 1 - q)))
        psi = arma.integrated_psi(phi, theta, 4000, [])
        assert np.allclose(arma.first_column(phi, theta)[:, 0], (psi**2).sum(1), rtol=1e-8)
        assert np.allclose(arma.first_column(phi, theta), arma.powers_column(phi, theta), rtol=1e-6, atol=1e-9)


def test_batched_unit_root_tests():
    y = walks(80, 20)
    for lags, trend in ((None, False), (0, True), (3, True)):
        assert np.allclose(unitroot.adf_batch(y, lags, trend), [unitroot.adf(x, lags, trend) for x in y])
    for trend, short in ((False, True), (True, False)):
        assert np.allclose(unitroot.pp_batch(y, trend, short), [unitroot.pp(x, trend, short) for x in y])
    assert np.isnan(unitroot.adf_batch(y[:, :5])).all() and np.isnan(unitroot.pp_batch(y[:, :3])).all()


def test_search_is_the_best_of_all_fits(panel):
    got = {r["series_id"]: r for r in models.search(panel, most_p=1, most_q=1).collect()}
    d = {r["series_id"]: r["d"] for r in stats.n_diffs(panel).collect()}
    for i, y in enumerate(walks()):
        fits = {(p, q): arma.Fitted(y[None], (p, d[f"s{i}"], q)).aicc[0] for p in (0, 1) for q in (0, 1)}
        r = got[f"s{i}"]
        assert fits[r["p"], r["q"]] <= min(fits.values()) + 0.05 and r["aicc"] == pytest.approx(fits[r["p"], r["q"]], abs=0.05)


def test_power_by_golden_section(spark, panel):
    x = np.exp(walks(60, 4) / 8)
    grid = np.linspace(-2, 2, 40001)
    best = power.best(x, -2, 2)
    for i, row in enumerate(x):
        values = [power.likelihood(row[None], np.array([g]))[0] for g in grid[::100]]
        near = grid[::100][int(np.argmax(values))]
        assert abs(best[i] - near) < 0.011 and power.likelihood(row[None], best[i : i + 1])[0] >= max(values) - 1e-9
    for lam in (-0.5, 0.0, 0.3, 2.0):
        assert np.allclose(power.inverse(power.transform(x, lam), lam), x)
    odd = panel.unionByName(panel.filter("series_id = 's0'").withColumns({"series_id": F.lit("flat"), "y": F.lit(5.0)})).unionByName(panel.filter("series_id = 's1'").withColumns({"series_id": F.lit("neg"), "y": F.col("y") - 30}))
    got = {r["series_id"]: r["lam"] for r in stats.box_cox_power(odd).collect()}
    assert got["flat"] is None and got["s0"] is not None and len(got) == 8
    with pytest.raises(ValueError):
        stats.box_cox_power(odd, floor="raise")


def test_forecast_levels_errors_powers_and_drift(panel):
    wide = {(r["series_id"], r["h"]): r for r in models.forecast(panel, (0, 1, 1), h=4, std_error=True).collect()}
    narrow = {(r["series_id"], r["h"]): r for r in models.forecast(panel, (0, 1, 1), h=4, level=0.5).collect()}
    for k, r in wide.items():
        assert r["upper"] - r["forecast"] == pytest.approx(1.959963984540054 * r["std_error"])
        assert narrow[k]["upper"] - narrow[k]["forecast"] == pytest.approx(0.6744897501960817 * r["std_error"], rel=1e-6)
    logs = {(r["series_id"], r["h"]): r for r in models.forecast(panel.withColumn("y", F.log("y")), (0, 1, 1), h=4).collect()}
    for r in models.forecast(panel, (0, 1, 1), h=4, power=0.0).collect():
        assert r["forecast"] == pytest.approx(np.exp(logs[r["series_id"], r["h"]]["forecast"]))
    with pytest.raises(ValueError):
        models.fit(panel, (0, 2, 0), drift=True)
    assert {r["series_id"]: r["mean"] for r in models.fit(panel, (0, 1, 0), drift=True).collect()} == pytest.approx({f"s{i}": np.diff(y).mean() for i, y in enumerate(walks())}, abs=1e-5)


def test_failed_series_keep_a_row(panel):
    some = panel.filter("t < 5 OR series_id = 's2'")
    got = {r["series_id"]: r for r in models.auto_arima(some, models.auto.Options(most_p=1, most_q=1), failed="keep").collect()}
    assert len(got) == 6 and got["s2"]["error"] is None and got["s2"]["aicc"] is not None
    assert all(got[f"s{i}"]["error"] and got[f"s{i}"]["aicc"] is None for i in (0, 1, 3, 4, 5))
    with pytest.raises(ValueError):
        models.auto_arima(some, failed="hide")


def test_residuals_of_given_coefficients_and_kpss_without_lags(panel):
    got = {(r["series_id"], r["t"]): r["e"] for r in stats.css_residuals(panel, [0.5, 0.1], [0.3]).collect()}
    for i, y in enumerate(walks()):
        e = np.zeros(len(y))
        for t in range(2, len(y)):
            e[t] = y[t] - 0.5 * y[t - 1] - 0.1 * y[t - 2] - 0.3 * e[t - 1]
        assert np.allclose([got[f"s{i}", t] for t in range(len(y))], e)
    zero = {r["series_id"]: r["stat"] for r in stats.kpss(panel, lag=0).collect()}
    assert zero == pytest.approx({f"s{i}": unitroot.kpss(y, 0) for i, y in enumerate(walks())})


def test_interpolation_grid_over_ranges(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=300).round(2), np.full(200, 7.0), [1e6, -1e6]])
    y = rng.normal(size=len(x))
    got = series.interpolation_grid(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double").repartition(5), "a", "b").orderBy("x").collect()
    points = sorted({a: y[x == a].mean() for a in x}.items())
    assert [(r["x"], r["next_x"]) for r in got] == [(a, b) for (a, _), (b, _) in zip(points, [*points[1:], (None, None)], strict=True)]
    assert all(r["y"] == pytest.approx(p[1]) for r, p in zip(got, points, strict=True)) and all(r["next_y"] == pytest.approx(p[1]) for r, p in zip(got, points[1:], strict=False))


def test_inverse_difference_of_a_matrix_with_heads(panel):
    both = panel.withColumn("x", F.col("y") ** 2)
    back = series.inverse_diff(series.diff(both, 3, 2, ["y", "x"]), 3, 2, heads=both.filter("t < 6"), column=["y", "x"])
    got = {(r["series_id"], r["t"]): (r["y"], r["x"]) for r in back.collect()}
    for r in both.filter("t >= 3").collect():
        assert got[r["series_id"], r["t"]] == pytest.approx((r["y"], r["x"]))


def test_out_of_fold_and_summary(spark, panel):
    pred = spark.createDataFrame([("s0", 0, 3, 1.0), ("s0", 1, 3, 2.0), ("s1", 0, 0, 5.0)], "series_id string, fold int, t int, pred double")
    got = {(r["series_id"], r["t"]): r["pred"] for r in stats.out_of_fold(panel, pred).collect()}
    assert len(got) == 360 and got["s0", 3] == 2.0 and got["s1", 0] == 5.0 and sum(v is not None for v in got.values()) == 2
    scores = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0)], "series_id string, fold int, mae double")
    assert {r["series_id"]: (r["mean"], r["std"]) for r in stats.cv_summary(scores, "mae").collect()} == {"a": (2.0, pytest.approx(2**0.5)), "b": (2.0, 0.0)}
