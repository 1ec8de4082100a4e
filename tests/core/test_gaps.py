"""Fits and forecasts of series with missing values by the diffuse likelihood."""

import numpy as np
import pytest

from seriesloom.kernels import arma, statespace
from seriesloom.plans import models


def series(n=200, seed=1):
    rng, y = np.random.default_rng(seed), np.zeros(n)
    for t in range(1, n):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    return y + 5


@pytest.mark.parametrize("order", [(1, 0, 0), (0, 1, 1), (1, 1, 0)])
def test_whole_series_are_fitted_as_by_the_fast_filter(order):
    y = series()[None] if order[1] == 0 else np.cumsum(series() - 5)[None]
    a, b = statespace.Gapped(y, order), arma.Fitted(y, order)
    assert a.log_l[0] == pytest.approx(b.log_l[0], abs=1e-3) and a.aicc[0] == pytest.approx(b.aicc[0], abs=1e-2)
    assert a.sigma2[0] == pytest.approx(b.sigma2[0], rel=1e-2)
    for x, z in zip(a.forecast(6), b.forecast(6), strict=True):
        assert x == pytest.approx(z, rel=0.02, abs=0.05)


def test_drift():
    y = (0.5 * np.arange(120) + np.cumsum(np.random.default_rng(2).normal(size=120)))[None]
    a, b = statespace.Gapped(y, (0, 1, 0), mean=True), arma.Fitted(y, (0, 1, 0), mean=True)
    assert a.mean[0] == pytest.approx(b.mean[0], rel=1e-2) and a.forecast(5)[0] == pytest.approx(b.forecast(5)[0], rel=1e-2)
    with pytest.raises(ValueError):
        statespace.Gapped(y, (0, 2, 0), mean=True)


def test_missing_values_against_the_likelihood_over_gaps(spark):
    y, rng = series(300), np.random.default_rng(5)
    at = np.array([0, *np.sort(rng.permutation(np.arange(1, 299))[:240]), 299])

    def by_gaps(phi, mean):
        """A value is normal about phi to the power of the gap, times the value before it."""
        e, back = y[at] - mean, phi ** np.diff(at)
        v = np.concatenate([[1.0], 1 - back**2]) / (1 - phi**2)
        u = np.concatenate([e[:1], e[1:] - back * e[:-1]])
        return -0.5 * (len(at) * (np.log(2 * np.pi * (u * u / v).mean()) + 1) + np.log(v).sum())

    df = spark.createDataFrame([("a", int(t), float(y[t])) for t in at], "series_id string, t int, y double")
    got = models.fit(df, (1, 0, 0), method="diffuse").collect()
    assert len(got) == 1 and got[0]["nobs"] == 242
    phi, mean = got[0]["phi"][0], got[0]["mean"]
    assert got[0]["log_l"] == pytest.approx(by_gaps(phi, mean), abs=1e-6)
    assert all(by_gaps(phi + a, mean + b) <= got[0]["log_l"] + 1e-4 for a in np.linspace(-0.3, 0.3, 13) for b in np.linspace(-0.6, 0.6, 13))
    ahead = models.forecast(df, (1, 0, 0), h=3, method="diffuse").orderBy("h").collect()
    assert ahead[0]["forecast"] == pytest.approx(mean + phi * (y[299] - mean), rel=1e-6)
    assert [r["h"] for r in ahead] == [1, 2, 3] and all(r["lower"] < r["forecast"] < r["upper"] for r in ahead)
    with pytest.raises(ValueError):
        models.fit(df, (1, 0, 0), method="diffuse", exog=["y"])
