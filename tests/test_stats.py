import datetime as dt
import math

import numpy as np
import pytest

from quantloom.plans import lp, stats


def test_p_values():
    assert stats.two_sided_t(2.228, 10) == pytest.approx(0.05, abs=5e-3)
    assert stats.two_sided_t(2.0, 10) == pytest.approx(0.0734, abs=5e-3)
    assert stats.two_sided_t(0, 10) == 1 and stats.two_sided_t(3, 0) == 1


def test_degenerate_t():
    assert stats.t_statistic(0.1, 0.0, 5) == (math.inf, 0.0)
    assert stats.t_statistic(0.0, 0.0, 5) == (-math.inf, 0.0)
    assert stats.t_statistic(0.1, 0.2, 1) == (0.0, 1.0)


def test_guard():
    good = stats.multiple_testing_guard(0.1, 0.05, 100, 1e-6, 10)
    assert good["adjusted_p"] == pytest.approx(1e-5) and good["passed"]
    bad = stats.multiple_testing_guard(0.1, 0.05, 100, 0.04, 50)
    assert bad["adjusted_p"] == 1.0 and not bad["passed"]
    assert stats.expected_max_normal(1) == 0


def test_split():
    s = stats.train_test_split(dt.date(2024, 1, 1), dt.date(2025, 1, 1))
    assert s.test[1] == dt.date(2025, 1, 1) and (s.test[0] - s.train[1]).days == 31
    with pytest.raises(stats.SplitError):
        stats.train_test_split(dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    assert stats.out_of_sample(None, dt.date(2024, 1, 1)) and not stats.out_of_sample(dt.date(2024, 1, 1), dt.date(2024, 1, 1))


def test_weights_and_selection():
    w = stats.optimal_weights(["a", "b"], np.array([3.0, 5.0]), np.array([[2.0, 1.0], [1.0, 3.0]]), 10)
    assert w["a"] / w["b"] == pytest.approx(0.8 / 1.4)
    assert stats.optimal_weights(["a", "b"], np.ones(2), np.zeros((2, 2)), 10) == {"a": 0.5, "b": 0.5}
    assert stats.select_signals(["a", "b", "c"], {("a", "b"): -0.9, ("a", "c"): 0.1}) == (["a", "c"], {"b": "a"})


def _cvar(x, beta=0.95):
    return -np.sort(x)[: max(1, math.floor((1 - beta) * len(x) + 1e-9))].mean()


def test_mean_cvar_is_feasible_and_rewards_return():
    rng = np.random.default_rng(1)
    returns = rng.normal(0.0005, 0.02, (63, 30))
    mean = returns.mean(0)
    books = [lp.mean_cvar(returns, mean, risk_aversion=a) for a in (0.0, 1.0, 10.0)]
    for w in books:
        assert abs(w.sum()) < 1e-6 and np.abs(w).sum() <= 1 + 1e-6 and np.abs(w).max() <= 0.05 + 1e-6
    gains = [float(w @ mean) for w in books]
    assert gains[0] <= gains[1] + 1e-9 <= gains[2] + 2e-9
    heuristic = np.clip(mean - mean.mean(), -0.05, 0.05)
    heuristic /= max(np.abs(heuristic).sum(), 1)
    assert _cvar(returns @ books[0]) <= _cvar(returns @ heuristic) + 1e-4
