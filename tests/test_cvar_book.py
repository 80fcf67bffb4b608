"""The mean-CVaR book: the best of all names, of which few reach the driver."""

import datetime as dt
import tracemalloc

import numpy as np

from quantloom.plans import lp, portfolio


def test_memory_grows_with_the_names_not_with_their_square():
    rng = np.random.default_rng(5)
    returns, mean = rng.normal(0, 0.05, (63, 1500)), rng.normal(0, 0.01, 1500)
    tracemalloc.start()
    w = lp.mean_cvar(returns, mean)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6
    assert abs(w.sum()) < 1e-6 and np.abs(w).sum() <= 1 + 1e-6 and np.abs(w).max() <= 0.05 + 1e-6


def test_book_over_many_names_is_the_best_of_all(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n, days = 900, [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(13)]
    prices = 100 * np.cumprod(1 + rng.normal(0, 0.05, (13, n)), axis=0)
    bars = spark.createDataFrame([(f"T{j:03d}", d, float(prices[i, j])) for i, d in enumerate(days) for j in range(n)], "ticker string, date date, adjusted_close double")
    raw = rng.normal(0, 1, n)
    scores = spark.createDataFrame([(f"T{j:03d}", days[-1], float(x)) for j, x in enumerate(raw)], "ticker string, date date, raw_score double")
    solved = []
    monkeypatch.setattr(portfolio, "priced_cvar", lambda returns, mean, **limits: solved.append(len(mean)) or lp.priced_cvar(returns, mean, **limits))
    book, facts = portfolio.cvar_portfolio(scores, bars, days[-1], max_position=0.1)
    got = {r["ticker"]: r["weight"] for r in book.collect()}
    z = (raw - raw.mean()) / raw.std()
    want = lp.mean_cvar(prices[1:] / prices[:-1] - 1, z * portfolio.RETURN_PER_Z, max_position=0.1)
    assert len(got) == n and max(solved) < n
    assert np.abs(np.array([got[f"T{j:03d}"] for j in range(n)]) - want).max() < 1e-4
    assert facts["turnover"] > 0.5


def test_equal_names_and_wild_returns_are_solved():
    rng = np.random.default_rng(3)
    returns, mean = rng.lognormal(0, 1.2, (63, 50)) - 1, rng.normal(0, 0.03, 50)
    once, copies = lp.mean_cvar(returns, mean, max_position=0.3), lp.mean_cvar(np.tile(returns, 6), np.tile(mean, 6), max_position=0.05)
    assert np.abs(copies.reshape(6, 50).sum(axis=0) - once).max() < 1e-4
