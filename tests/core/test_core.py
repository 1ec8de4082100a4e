"""Published values and identities for the series operators and kernels."""

import time

import numpy as np
import pytest

import __spark_entry__
from seriesloom.functions import stats
from seriesloom.kernels import arma, unitroot
from seriesloom.operators import series
from seriesloom.plans import models

# The classic monthly airline passengers, 1949 to 1960.
AIR = np.array("""112 118 132 129 121 135 148 148 136 119 104 118 115 126 141 135 125 149 170 170 158 133 114 140 145 150 178 163
172 178 199 199 184 162 146 166 171 180 193 181 183 218 230 242 209 191 172 194 196 196 236 235 229 243 264 272 237 211 180 201
204 188 235 227 234 264 302 293 259 229 203 229 242 233 267 269 270 315 364 347 312 274 237 278 284 277 317 313 318 374 413 405
355 306 271 306 315 301 356 348 355 422 465 467 404 347 305 336 340 318 362 348 363 435 491 505 404 359 310 337 360 342 406 396
420 472 548 559 463 407 362 405 417 391 419 461 472 535 622 606 508 461 390 432""".split(), float)
WAVE = [1, 2, 3, 4, 5, 4, 3, 2, 1, 2, 3, 4, 5, 4, 3, 2, 1, 2, 3, 4]


def frame(spark, y, name="s"):
    return spark.createDataFrame([(name, t, float(v)) for t, v in enumerate(y)], "series_id string, t int, y double")


def values(df, column="y"):
    return [r[column] for r in df.orderBy("t").collect()]


def test_differences(spark):
    y = frame(spark, range(5))
    assert values(series.diff(y)) == [1, 1, 1, 1] and values(series.diff(y, 1, 2)) == [0, 0, 0]
    assert values(series.diff(y, 2)) == [2, 2, 2] and values(series.diff(y, 2, 2)) == [0]
    assert values(series.inverse_diff(y)) == [0, 0, 1, 3, 6, 10]
    assert values(series.inverse_diff(y, 2, 2)) == [0, 0, 0, 0, 0, 1, 2, 5, 8]


def test_diagnostics(spark):
    y = frame(spark, WAVE)
    q = stats.portmanteau(y, 5).first()
    assert q["ljung_box"] == pytest.approx(41.772662, abs=1e-5) and q["box_pierce"] == pytest.approx(31.654554, abs=1e-5)
    assert q["ljung_box_p"] == pytest.approx(6.548473e-08, rel=1e-4)
    jb = stats.jarque_bera(y).first()
    assert jb["jb"] == pytest.approx(0.843556, abs=1e-6) and jb["p"] == pytest.approx(0.655880, abs=1e-6)


def test_kpss_short(spark):
    y = frame(spark, [1, -1, 0, 2, -1, -2, 3])
    assert not stats.kpss(y).first()["diff"]
    assert stats.kpss(y, trend=True).first()["p"] == pytest.approx(0.01)


def test_metrics(spark):
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "y_true double, y_pred double")
    r = stats.errors(pairs).first()
    assert r["mae"] == 2 and r["mse"] == pytest.approx(14 / 3) and r["rmse"] == pytest.approx((14 / 3) ** 0.5)


def test_folds(spark):
    n = spark.createDataFrame([("s", 176)], "series_id string, n long")
    assert [tuple(r)[1:] for r in series.rolling_folds(n).orderBy("fold").limit(1).collect()] == [(0, 0, 58, 58, 59)]
    assert [tuple(r)[1:] for r in series.sliding_folds(n, horizon=6, step=4, window=12).orderBy("fold").limit(2).collect()] == [(0, 0, 12, 12, 18), (1, 4, 16, 16, 22)]


def dense(w, phi, theta):
    n = len(w)
    psi = stats.psi_weights(list(phi), list(theta), 3000)
    g = [sum(a * b for a, b in zip(psi, psi[k:], strict=False)) for k in range(n)]
    v = np.array([[g[abs(i - j)] for j in range(n)] for i in range(n)])
    s = w @ np.linalg.solve(v, w) / n
    return 0.5 * (n * (np.log(2 * np.pi * s) + 1) + np.linalg.slogdet(v)[1])


@pytest.mark.parametrize(("phi", "theta"), [([0.6], []), ([], [0.4]), ([0.5, -0.3], [0.7]), ([0.2], [0.3, 0.2, -0.1])])
def test_filter_equals_the_dense_likelihood(phi, theta):
    w = np.random.default_rng(0).normal(size=60)
    got = arma.exact(w[None], np.array([phi]).reshape(1, -1), np.array([theta]).reshape(1, -1))[0][0]
    assert got == pytest.approx(dense(w, phi, theta), abs=1e-8)


def test_airline_model():
    start = time.time()
    model = arma.Fitted(np.log(AIR)[None], (0, 1, 1), (0, 1, 1, 12))
    assert model.log_l[0] == pytest.approx(244.6965, abs=2e-3) and model.aic[0] == pytest.approx(-483.393, abs=5e-3)
    assert model.params[1][0, 0] == pytest.approx(-0.4018, abs=2e-3) and model.params[3][0, 0] == pytest.approx(-0.5570, abs=2e-3)
    assert model.sigma2[0] == pytest.approx(0.001348, abs=2e-6) and time.time() - start < 20


def test_batches_do_not_matter():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(6, 80)).cumsum(1)
    together, alone = arma.Fitted(y, (1, 1, 1)), [arma.Fitted(x[None], (1, 1, 1)) for x in y]
    assert np.allclose(together.log_l, [a.log_l[0] for a in alone], atol=1e-6)


def test_random_walk_forecast(spark):
    y = frame(spark, np.random.default_rng(2).normal(size=100).cumsum())
    a = models.forecast(y, (0, 1, 0), h=4).orderBy("h").collect()
    b = stats.random_walk_forecast(y, 4).orderBy("h").collect()
    assert all(abs(r[c] - s[c]) < 1e-9 for r, s in zip(a, b, strict=True) for c in ("forecast", "lower", "upper"))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_seasonal_strength_and_unit_roots():
    from seriesloom.kernels import unitroot

    assert unitroot.seasonal_strength(AIR, 12) == pytest.approx(0.9557, abs=1e-4)
    assert unitroot.adf(np.array([1, -1, 0, 2, -1, -2, 3.0]), trend=True)[1] == pytest.approx(0.01)
    walk = np.random.default_rng(5).normal(size=400).cumsum()
    for test in (unitroot.adf, unitroot.pp):
        assert test(walk)[1] > 0.05 and test(np.diff(walk))[1] == pytest.approx(0.01)


def test_bootstrap_does_not_depend_on_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    both = frame(spark, rng.normal(size=60), "a").unionByName(frame(spark, rng.normal(size=60), "b"))
    one = models.bootstrap(both, (0, 1, 0), h=3, n=400).orderBy("series_id", "sim", "h").collect()
    monkeypatch.setattr(models, "BATCH", 1)
    assert np.allclose([r["value"] for r in one], [r["value"] for r in models.bootstrap(both.repartition(5), (0, 1, 0), h=3, n=400).orderBy("series_id", "sim", "h").collect()])


def test_models_round_trip(spark, tmp_path):
    fitted = models.fit(frame(spark, AIR), (1, 1, 1), (0, 1, 1, 12))
    models.save(fitted, str(tmp_path / "m"))
    a, b = fitted.first(), models.load(spark, str(tmp_path / "m")).first()
    assert a["phi"] == pytest.approx(b["phi"]) and a["log_l"] == pytest.approx(b["log_l"])
    from pyspark.sql import functions as F

    models.save(fitted.withColumn("p", F.lit(3)), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="not a valid model"):
        models.load(spark, str(tmp_path / "bad"))


def test_roots_and_lambda(spark):
    assert sorted(abs(arma.roots([0.5], -1.0))) == pytest.approx([2.0])
    assert len(arma.roots([], 1.0)) == 0
    assert -0.4 < stats.box_cox_lambda(frame(spark, AIR)).first()["lam"] < 0.3


def test_n_diffs(spark):
    rng = np.random.default_rng(8)
    noise = rng.normal(size=300)
    both = frame(spark, noise, "noise").unionByName(frame(spark, noise.cumsum(), "walk")).unionByName(frame(spark, noise.cumsum().cumsum(), "twice")).unionByName(frame(spark, np.ones(50), "flat"))
    assert {r[0]: r[1] for r in stats.n_diffs(both).collect()} == {"noise": 0, "walk": 1, "twice": 2, "flat": 0}
    assert stats.n_diffs(frame(spark, np.log(AIR))).first()["d"] == 1


def kpss_by_definition(y, lag, trend=False):
    t, n = np.arange(len(y)), len(y)
    e = y - np.polyval(np.polyfit(t, y, 1), t) if trend else y - y.mean()
    spread = e @ e / n + 2 / n * sum((1 - k / (lag + 1)) * (e[k:] @ e[: n - k]) for k in range(1, min(lag, n - 1) + 1))
    return (np.cumsum(e) ** 2).sum() / n**2 / spread


def test_kpss_sums_every_lag(spark):
    y = np.random.default_rng(1).normal(size=400).cumsum()
    one = frame(spark, y)
    for options, lag in (({"short": False}, 16), ({"lag": 30}, 30), ({"lag": 25, "trend": True}, 25), ({}, 5), ({"lag": 500}, 500)):
        assert stats.kpss(one, **options).first()["stat"] == pytest.approx(kpss_by_definition(y, lag, options.get("trend", False)), rel=1e-9)


def test_n_diffs_of_long_series(spark):
    rng, long = np.random.default_rng(0), {}
    while len(long) < 3:  # series for which 12 of 13 or more lag products give another answer
        y = np.zeros(4032)
        for i, x in enumerate(rng.normal(size=4032)):
            y[i] = 0.95 * y[i - 1] + x
        n, e = len(y), y - y.mean()
        cut = (np.cumsum(e) ** 2).sum() / n**2 / (e @ e / n + 2 / n * sum((1 - k / 15) * (e[k:] @ e[: n - k]) for k in range(1, 13)))
        if (cut > 0.463) != (kpss_by_definition(y, 14) > 0.463):
            long[f"s{len(long)}"] = y
    rows = frame(spark, [], "none")
    for name, y in long.items():
        rows = rows.union(frame(spark, y, name))
    assert {r[0]: r[1] for r in stats.n_diffs(rows).collect()} == {name: unitroot.n_diffs(y) for name, y in long.items()}
