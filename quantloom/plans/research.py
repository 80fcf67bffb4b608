"""From records to a book: four signals, those alike left out, weights by their ICs, one combined score, the tilt."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import core, signals
from quantloom.plans import stats
from quantloom.plans.portfolio import tilt_portfolio
from quantloom.sources.storage import checkpointed

#: In order of preference where two are alike.
SIGNALS = ("earnings_surprise", "fundamental_factors", "ownership_momentum", "supply_chain")


def four_signals(bars: DataFrame, estimates: DataFrame, fundamentals: DataFrame, ownership: DataFrame, links: DataFrame, dates: DataFrame) -> DataFrame:
    """signal, date, ticker, raw_score, rank_score of all four signals on all dates."""
    parts = (
        signals.earnings_surprise_on(estimates, dates), signals.fundamental_factors(fundamentals, dates),
        signals.ownership_momentum(ownership, dates), signals.supply_chain(links, bars, dates),
    )
    named = [p.select(F.lit(name).alias("signal"), *signals.OUT) for name, p in zip(SIGNALS, parts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


def ic_weights(ics: DataFrame) -> dict[str, float]:
    """Weights of signals by the means and covariances of their ICs over common days; only those reach the driver."""
    common = core.common_ic(ics)
    means = {r["signal"]: r["mean_ic"] for r in core.ic_summary(common).collect()}
    cov = {(r["a"], r["b"]): r["cov"] for r in core.ic_covariance(ics).collect()}
    names = sorted(means)
    n = common.select("date").distinct().count()
    matrix = [[0.0 if cov[a, b] is None else cov[a, b] for b in names] for a in names]
    return stats.optimal_weights(names, np.array([means[x] for x in names]), np.array(matrix), n)


def research_book(scores: DataFrame, bars: DataFrame, horizon: int = 21, min_n: int = 5, **book: object) -> tuple[DataFrame, dict]:
    """The last score day's book and how it came about: kept and dropped signals, weights, risk and turnover.

    ``scores`` (signal, date, ticker, raw_score) are written once; signals without an IC on a common day get no weight.
    """
    scores = checkpointed(scores.select("signal", "date", "ticker", "raw_score"))
    there = {r["signal"] for r in scores.select("signal").distinct().collect()}
    rho = {(r["a"], r["b"]): r["mean_rho"] for r in core.signal_correlation(scores, min_n).collect()}
    order = [s for s in SIGNALS if s in there] + sorted(there - set(SIGNALS))
    kept, dropped = stats.select_signals(order, rho)
    own = scores.where(F.col("signal").isin(kept))
    weights = ic_weights(checkpointed(core.daily_ic(own, core.forward_return(bars, horizon), min_n)))
    day = own.agg(F.max("date")).first()[0]
    if day is None:
        raise ValueError("no scores")
    combined = core.combine_signals(own.where(F.col("date") == day), weights)
    weighted, facts = tilt_portfolio(combined, bars, day, **book)
    return weighted, facts | {"day": day, "kept": kept, "dropped": dropped, "weights": weights}
