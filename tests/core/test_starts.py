"""Start values and the simplex search, against simulated series and known answers."""

import numpy as np
import pytest

from seriesloom.kernels import arma, starts
from seriesloom.plans import models
from test_core import AIR, frame


def simulated(phi, theta, n=4000, seed=1):
    e = np.random.default_rng(seed).normal(size=n + 200)
    w = np.zeros(n + 200)
    for t in range(30, n + 200):
        w[t] = e[t] + sum(a * w[t - i - 1] for i, a in enumerate(phi)) + sum(b * e[t - i - 1] for i, b in enumerate(theta))
    return w[200:]


def test_burg_recovers_autoregressions():
    w = np.stack([simulated([0.6, -0.3], []), simulated([0.2, 0.4], [], seed=2)])
    phi, left = starts.burg(w, 2)
    assert np.abs(phi - [[0.6, -0.3], [0.2, 0.4]]).max() < 0.06 and np.abs(left - 1).max() < 0.1
    assert (starts.burg(w[1:], 2)[0] == phi[1:]).all()  # rows don't meet
    assert (starts.burg(np.ones((1, 9)), 2)[0] == 0).all()
    with pytest.raises(ValueError):
        starts.burg(w[:, :3], 3)


def test_hannan_rissanen_recovers_arma():
    found = starts.hannan_rissanen(simulated([0.7], [0.4])[None], 1, 1)
    assert np.abs(found - [[0.7, 0.4]]).max() < 0.08
    found = starts.hannan_rissanen(simulated([0, 0, 0, 0.6], [0.3])[None], 0, 1, 1, 0, 4)
    assert np.abs(found - [[0.3, 0.6]]).max() < 0.08
    assert starts.hannan_rissanen(np.arange(6.0)[None], 2, 2) is None


def test_unconstrained_is_the_inverse():
    x = np.random.default_rng(3).uniform(-1.5, 1.5, (20, 3))
    for sign in (-1.0, 1.0):
        assert np.abs(starts.unconstrained(arma.stationary(x, sign), sign) - x).max() < 1e-8
    assert np.isfinite(starts.unconstrained(np.array([[1.7, 0.4]]))).all()


def test_simplex_reaches_the_least():
    goal = np.array([[1.0, -2.0], [0.5, 3.0], [0.0, 0.0]])
    x, v = starts.simplex(lambda p, rows: ((p - goal[rows]) ** 2 * [1, 5]).sum(1), np.zeros((3, 2)), rounds=500)
    assert np.abs(x - goal).max() < 1e-3 and v.max() < 1e-6


def test_simplex_polishes_a_likelihood():
    w = simulated([0.7], [0.4], 300)[None]
    f = lambda x, rows: arma.exact(w[rows], arma.stationary(x[:, :1]), arma.stationary(x[:, 1:], 1.0))[0]
    raw = starts.hannan_rissanen(w, 1, 1)
    x = np.concatenate([starts.unconstrained(raw[:, :1]), starts.unconstrained(raw[:, 1:], 1.0)], 1)
    fast, slow = arma.minimize(f, x.copy()), starts.simplex(f, x)
    assert slow[1][0] <= f(x, np.arange(1))[0] and abs(fast[1][0] - slow[1][0]) < 1e-4


def test_fits_from_either_start_agree():
    """Fixed value: the published log likelihood of the airline model."""
    y = np.log(AIR)[None]
    flat = arma.Fitted(y, (0, 1, 1), (0, 1, 1, 12))
    other = arma.Fitted(y, (0, 1, 1), (0, 1, 1, 12), init="hannan-rissanen", polish=True)
    assert other.log_l[0] == pytest.approx(244.6965, abs=1e-3) and other.log_l[0] >= flat.log_l[0] - 1e-6
    short = arma.Fitted(np.random.default_rng(0).normal(size=(1, 12)), (2, 0, 2), init="hannan-rissanen")
    assert np.isfinite(short.log_l).all()


def test_fit_passes_them_on(spark):
    found = models.fit(frame(spark, simulated([0.7], [], 200)), (1, 0, 0), init="hannan-rissanen", polish=True).first()
    plain = models.fit(frame(spark, simulated([0.7], [], 200)), (1, 0, 0)).first()
    assert found["log_l"] == pytest.approx(plain["log_l"], abs=1e-5)
