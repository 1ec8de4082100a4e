"""Seasonal tests, searches, regressors, outliers, state space, pipelines and streams: published values, identities, planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.kernels import arma, auto, seasonal, statespace, unitroot
from seriesloom.plans import models
from seriesloom.plans.pipeline import BoxCox, Dates, Fourier, Log, Pipeline
from seriesloom.streaming.forecasts import follow
from test_core import AIR, frame


def test_hegy_published():
    """Published statistics and levels for the logarithm of AIR with constant and trend, lag by AIC."""
    stat, p, lag = seasonal.hegy_p(np.log(AIR)[None], 12)
    named = dict(zip(seasonal.hegy_names(12), stat[0], strict=True))
    want = {"t_1": -2.147030308024102, "t_2": -2.657444227120304, "F_3:4": 0.03825076400527432, "F_9:10": 0.5283361183306475, "F_2:12": 1.416599792770282, "F_1:12": 1.695886059502519}
    assert lag[0] == 2 and {k: named[k] for k in want} == pytest.approx(want, rel=1e-8)
    levels = dict(zip(seasonal.hegy_names(12), p[0], strict=True))
    assert levels["t_1"] == pytest.approx(0.453, abs=0.06) and levels["t_2"] < 0.03 and levels["F_2:12"] == pytest.approx(0.2806, abs=0.1)


def test_seasonal_verdicts():
    both = np.stack([AIR, np.full(144, 3.0)])
    assert seasonal.n_seasonal_diffs(both, 12, 1, "ocsb").tolist() == [1, 0]
    assert seasonal.n_seasonal_diffs(both, 12, 1, "ch").tolist() == [0, 0]
    assert seasonal.n_seasonal_diffs(both, 12, 1, "seas").tolist() == [1, 0]
    with pytest.raises(ValueError):
        seasonal.n_seasonal_diffs(both, 1)
    with pytest.raises(ValueError):
        seasonal.n_seasonal_diffs(both, 12, 1, "none")


def test_batches_do_not_matter():
    y = np.random.default_rng(3).normal(size=(4, 96)).cumsum(1)
    for f in (lambda v: seasonal.canova_hansen(v, 12), lambda v: seasonal.ocsb(v, 12), lambda v: seasonal.hegy(v, 12)[0][:, 0]):
        assert np.allclose(f(y), np.concatenate([f(v[None]) for v in y]))


def test_find_period():
    assert seasonal.find_period(AIR) == 12 and seasonal.find_period(np.array([1.0, 2, 3])) == 1
    t = np.arange(240)
    for m in (7, 12, 24):
        assert seasonal.find_period(10 * np.cos(2 * np.pi * t / m) + np.random.default_rng(0).normal(size=240)) == m
    assert seasonal.find_period(np.random.default_rng(1).normal(size=200)) == 1


def test_phillips_perron_coefficient_form():
    y = np.random.default_rng(5).normal(size=120).cumsum()
    now, before, n = y[1:], y[:-1], 119
    i = np.arange(1, n + 1)
    x = np.stack([np.ones(n), i, before], 1)
    b = np.linalg.solve(x.T @ x, x.T @ now)
    e = now - x @ b
    d = n * n * (n * n - 1) * (before @ before) / 12 - n * (before @ i) ** 2 + n * (n + 1) * (before @ i) * before.sum() - n * (n + 1) * (2 * n + 1) * before.sum() ** 2 / 6
    want = n * (b[2] - 1) - n**6 / (24 * d) * (unitroot.long_run(e, 4) - e @ e / n)
    assert unitroot.pp_alpha(y)[0] == pytest.approx(want, rel=1e-6)


def test_airline_errors_and_diffuse_likelihood():
    y = np.log(AIR)[None]
    model = arma.Fitted(y, (0, 1, 1), (0, 1, 1, 12))
    assert model.log_l[0] == pytest.approx(244.6965, abs=1e-3) and model.aic[0] == pytest.approx(-483.3930, abs=2e-3)
    assert arma.standard_errors(model)[0] == pytest.approx([0.0896, 0.0731], abs=1e-3)
    assert -statespace.diffuse(y, model.phi, model.theta, 1, 1, 12)[0][0] == pytest.approx(model.log_l[0], abs=1e-6)
    assert -statespace.diffuse(y, model.phi, model.theta, 1, 1, 12, 1e6)[0][0] == pytest.approx(model.log_l[0], abs=0.05)
    gap = y.copy()
    gap[0, 60:63] = np.nan
    assert np.isfinite(statespace.diffuse(gap, model.phi, model.theta, 1, 1, 12)[0][0])


def test_regressors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1, 144, 2))
    model = arma.Fitted(np.log(AIR)[None] + x @ np.array([0.5, -0.3]), (0, 1, 1), (0, 1, 1, 12), exog=x)
    assert model.coef[0] == pytest.approx([0.5, -0.3], abs=0.02) and arma.names(model) == ["ma1", "sma1", "beta1", "beta2"]
    up = model.forecast(3, future=np.array([[[1.0, 0], [0, 0], [0, 0]]]))[0] - model.forecast(3, future=np.zeros((1, 3, 2)))[0]
    assert up[0] == pytest.approx([model.coef[0, 0], 0, 0], abs=1e-9)
    with pytest.raises(ValueError):
        model.forecast(3)


def test_outliers():
    y = np.random.default_rng(1).normal(size=(3, 150)).cumsum(1)
    y[0, 50] += 15
    y[1, 80:] += 20
    found = arma.outliers(y)
    assert found[0][0][:2] == (50, "AO") and found[0][0][2] == pytest.approx(15, abs=2)
    assert found[1][0][:2] == (80, "LS") and found[1][0][2] == pytest.approx(20, abs=2)
    assert all(x[3] > 3.5 for one in found for x in one)
    model = arma.Fitted(y, (0, 1, 1))
    pi, e = arma.pi_weights(model, 150), model.residuals()
    for i, one in enumerate(found):  # the first of each by plain projections on each signature at each place
        sizes = {}
        for kind, shape in (("AO", pi[i]), ("LS", np.cumsum(pi[i]))):
            for t in range(1, 150 if kind == "AO" else 148):
                sig = shape[: 150 - t]
                sizes[t, kind] = abs(sig @ e[i, t - 1 :]) / np.sqrt(sig @ sig * model.sigma2[i])
        best = max(sizes, key=sizes.get)
        assert ([best] if sizes[best] > 3.5 else []) == [x[:2] for x in one[:1]]
    with pytest.raises(ValueError):
        arma.outliers(y[:, :9])


def test_pi_weights():
    model = arma.Fitted(np.random.default_rng(2).normal(size=(1, 80)).cumsum(1), (0, 1, 1))
    theta = model.theta[0, 0]
    want = [1.0] + [-(1 + theta) * (-theta) ** k for k in range(5)]
    assert arma.pi_weights(model, 6)[0] == pytest.approx(want)


def test_bootstrap_of_parameters_centres_on_them():
    e = np.random.default_rng(4).normal(size=300)
    y = np.zeros(300)
    for t in range(1, 300):
        y[t] = 0.6 * y[t - 1] + e[t]
    model = arma.Fitted(y[None], (1, 0, 0))
    sampled = arma.parameter_bootstrap(model, [7], 100)
    assert np.nanmean(sampled[0, :, 0]) == pytest.approx(model.phi[0, 0], abs=0.03)
    assert np.nanstd(sampled[0, :, 0]) == pytest.approx(arma.standard_errors(model)[0, 0], rel=0.35)
    assert abs(arma.bias_corrected(model, sampled)[0, 0]) <= 0.99


@pytest.mark.parametrize("method", ["css", "css-ml"])
def test_orders_fitted_together(method):
    y = np.random.default_rng(0).normal(size=(4, 90)).cumsum(1)
    orders = [(0, 1, 1, 0), (2, 0, 0, 0), (1, 1, 0, 1), (0, 0, 0, 0)]
    most, free = arma.free_of(orders)
    both = arma.Fitted(y, (most[0], 1, most[1]), (most[2], 0, most[3], 12), free=free, method=method)
    for i, (p, q, sp, sq) in enumerate(orders):
        one = arma.Fitted(y[i : i + 1], (p, 1, q), (sp, 0, sq, 12), method=method)
        assert both.log_l[i] == pytest.approx(one.log_l[0], abs=1e-6) and both.aicc[i] == pytest.approx(one.aicc[0], abs=1e-6)
        assert both.forecast(3)[0][i] == pytest.approx(one.forecast(3)[0][0], abs=1e-5)


def test_search():
    y = np.log(AIR)[None]
    found = auto.search(y, auto.Options(m=12, most_p=2, most_q=2, most_sp=1, most_sq=1))[0]
    assert (found.order[1], found.seasonal[1]) == (1, 1) and found.score <= -483.2
    assert min(v for v in found.tried.values() if not np.isnan(v)) == found.score
    full = auto.search(AIR[None], auto.Options(most_p=1, most_q=1, stepwise=False))[0]
    assert len(full.tried) == 4 and full.seasonal == (0, 0, 0, 1)
    assert len(auto.search(AIR[None], auto.Options(most_p=1, most_q=1, stepwise=False, n_fits=2))[0].tried) == 2
    drift = auto.search(np.cumsum(np.random.default_rng(0).normal(1, 1, (1, 80)), 1), auto.Options(most_p=1, most_q=0, allow_drift=True))[0]
    assert drift.constant and drift.order[1] == 1


def test_panel_plans(spark):
    df = frame(spark, AIR, "a").unionByName(frame(spark, AIR[:100], "b")).withColumn("y", F.log("y"))
    fits = {r["series_id"]: r for r in models.fit(df, (0, 1, 1), (0, 1, 1, 12)).collect()}
    assert fits["a"]["log_l"] == pytest.approx(244.6965, abs=1e-3) and fits["b"]["nobs"] == 87
    again = models.update(df.filter("t < 90"), df.filter("t >= 90"), (0, 1, 1), (0, 1, 1, 12)).filter("series_id = 'a'").first()
    assert again["log_l"] == pytest.approx(244.6965, abs=0.05)
    assert models.characteristic_roots(models.fit(df, (0, 1, 1))).filter("invertible and stationary").count() == 2
    s = models.summary(df.filter("series_id = 'a'"), (0, 1, 1), (0, 1, 1, 12)).orderBy("name").collect()
    assert [r["name"] for r in s] == ["ma1", "sma1"] and s[0]["z"] == pytest.approx(s[0]["value"] / s[0]["std_error"]) and s[0]["p"] < 0.01
    assert {r["period"] for r in models.find_period(frame(spark, AIR)).collect()} == {12}
    empty = df.filter("false")
    assert models.fit(empty, (1, 0, 0)).count() == 0 and models.ocsb(empty, 12).count() == 0


def test_pipeline(spark):
    df = frame(spark, AIR)
    chain = Pipeline((("log", Log()), ("waves", Fourier(12))), (1, 1, 0))
    got = [r["forecast"] for r in chain.fit(df).predict(12).orderBy("h").collect()]
    assert len(got) == 12 and int(np.argmax(got)) in (6, 7) and 450 < max(got) < 800
    cut = chain.fit(df.filter("t < 120"))
    assert cut.update(df.filter("t >= 120")).predict(1).first()["forecast"] == pytest.approx(got[0], rel=1e-6)
    assert cut.refit(df.filter("t >= 120")).future(2).orderBy("h").first()["t"] == 144
    with pytest.raises(ValueError):
        Pipeline((("a", Log()), ("a", Log())), (1, 0, 0))
    dated = frame(spark, AIR[:60]).withColumn("ds", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, t)"))
    out = Pipeline((("power", BoxCox()), ("dates", Dates())), (1, 0, 0)).fit(dated).predict(3).collect()
    assert len(out) == 3 and all(r["lower"] < r["forecast"] < r["upper"] for r in out)


def test_stream_follows(spark, tmp_path):
    for i, part in enumerate((AIR[:60], AIR[60:80])):
        frame(spark, part).withColumn("t", F.col("t") + 60 * i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("series_id string, t int, y double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = follow(stream, (0, 1, 1), h=2).writeStream.outputMode("update").format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = {(r["t"], r["h"]): r["forecast"] for r in spark.table("followed").collect()}
    assert set(rows) == {(59, 1), (59, 2), (79, 1), (79, 2)}
    assert rows[79, 1] == pytest.approx(arma.Fitted(AIR[None, :80], (0, 1, 1)).forecast(1)[0][0, 0], rel=1e-3)
