"""The seven-test verdict on a signal, the fundamental backtest, and its train/test pair."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import core, signals
from quantloom.plans import stats
from quantloom.sources.providers import PointInTime
from quantloom.sources.storage import AuditLog, canonical, checkpointed, write_artifact

# The thresholds of the verdict.
LEAST_IC, LEAST_ICIR, LEAST_DECAYED_IC, LEAST_NEUTRAL_IC, MOST_CORRELATION = 0.015, 0.5, 0.01, 0.015, 0.5
HORIZON, DECAY_HORIZON, REGIMES_POSITIVE = 21, 63, 3
REGIMES = ("bull", "bear", "high_vol", "low_vol")


def evaluate(scores: DataFrame, forward: DataFrame, min_n: int = 5) -> dict:
    """Mean IC, its deviation, ratio, t, p, share of positive days, days."""
    row = core.ic_summary(core.daily_ic(scores, forward, min_n)).first()
    if row is None:
        raise ValueError("no date had a computable IC")
    t, p = stats.t_statistic(row["mean_ic"], row["ic_std"], row["n_days"])
    return row.asDict() | {"t": t, "p": p}


def run_backtest(scores: DataFrame, bars: DataFrame, n_trials: int = 1, others: DataFrame | None = None, sectors: DataFrame | None = None, min_n: int = 5, audit: AuditLog | None = None) -> dict:
    """The verdict with all statistics. ``scores`` hold one signal; ``others`` and ``sectors`` add tests six and seven.

    Bars, and scores joined with all three forward returns, are written once; every statistic reads those tables.
    """
    bars = checkpointed(bars.select("ticker", "date", "adjusted_close"))
    ahead = bars.select("ticker", "date", *((F.lead("adjusted_close", h).over(core.by_ticker()) / F.col("adjusted_close") - 1).alias(f"fwd_{h}") for h in (1, HORIZON, DECAY_HORIZON)))
    joined = checkpointed(scores.select("signal", "date", "ticker", "raw_score").join(ahead, ["ticker", "date"], "left"))
    own = joined.select("signal", "date", "ticker", "raw_score")
    forward = {h: joined.where(F.col(f"fwd_{h}").isNotNull()).select("ticker", "date", F.col(f"fwd_{h}").alias("fwd")).distinct() for h in (1, HORIZON, DECAY_HORIZON)}
    report = evaluate(own, forward[HORIZON], min_n)
    decayed = evaluate(own, forward[DECAY_HORIZON], min_n)["mean_ic"]
    ics = core.daily_ic(own, forward[HORIZON], min_n)
    regimes = {r["regime"]: r["mean_ic"] for r in core.regime_ic(ics, core.regime_labels(bars)).collect()}  # four rows at most
    guard = stats.multiple_testing_guard(report["mean_ic"], report["ic_std"], report["n_days"], report["p"], n_trials)
    book = core.portfolio_stats(core.long_short(own, forward[1], min_n=min_n)).first()
    correlation = neutral = None
    if others is not None:
        name = own.first()["signal"]
        correlation = core.signal_correlation(own.unionByName(others.select(*own.columns)), min_n).where((F.col("a") == name) | (F.col("b") == name)).agg(F.max("mean_abs_rho")).first()[0]
    if sectors is not None:
        row = core.ic_summary(core.daily_ic(core.sector_neutral(own, sectors), forward[HORIZON], min_n)).first()
        neutral = row["mean_ic"] if row else None
    positive = sum(regimes.get(r, 0.0) > 0 for r in REGIMES)
    tests = (
        (report["mean_ic"] <= LEAST_IC, f"mean IC {report['mean_ic']:.4f} not over {LEAST_IC}"), (report["icir"] <= LEAST_ICIR, f"ICIR {report['icir']:.4f} not over {LEAST_ICIR}"),
        (not guard["passed"], f"multiple testing: {guard['reason']}"), (not decayed > LEAST_DECAYED_IC, f"mean IC after {DECAY_HORIZON} days {decayed:.4f} not over {LEAST_DECAYED_IC}"),
        (positive < REGIMES_POSITIVE, f"positive in {positive} of {len(REGIMES)} regimes"), (correlation is not None and correlation >= MOST_CORRELATION, f"correlation {correlation} with a known signal"),
        (neutral is not None and neutral <= LEAST_NEUTRAL_IC, f"sector-neutral IC {neutral} not over {LEAST_NEUTRAL_IC}"),
    )
    reasons = [why for failed, why in tests if failed]
    stat = book.asDict() if book else {"annualized_return": 0.0, "sharpe": 0.0, "max_drawdown": 0.0}
    result = report | {k: stat[k] for k in ("annualized_return", "sharpe", "max_drawdown")} | {"decayed_ic": decayed, "regimes": regimes, "adjusted_p": guard["adjusted_p"], "max_abs_correlation": correlation, "sector_neutral_ic": neutral, "passed": not reasons, "reasons": reasons}
    if audit is not None:
        audit.record("backtest.completed", {"signal": result["signal"], "passed": result["passed"], "reasons": reasons})
    return result


def fundamental_backtest(bars: DataFrame, fundamentals: DataFrame, start: dt.date, end: dt.date, *, score_every: int = 5, lookback_days: int = 550, n_trials: int = 1, out: str | None = None, audit: AuditLog | None = None) -> dict:
    """Score every ``score_every``-th trading day from what was known, all days in one plan, and judge the signal."""
    priced = core.as_of(bars, end, "date").where(F.col("date") >= F.lit(start))
    facts = core.as_of(fundamentals, end, "report_date").where(F.col("report_date") >= F.lit(start - dt.timedelta(days=lookback_days)))
    scores = signals.fundamental_factors(facts, core.score_dates(priced, score_every)).withColumn("signal", F.lit("fundamental_factors"))
    result = run_backtest(scores, priced, n_trials, audit=audit)
    if out:
        write_artifact(out, canonical(_plain(result)).encode())
    return result


def _plain(result: Mapping) -> dict:
    """The result with numbers that JSON doesn't know as text."""
    return {k: _plain(v) if isinstance(v, Mapping) else v if not isinstance(v, float) or math.isfinite(v) else str(v) for k, v in result.items()}


def train_test_backtest(bars: DataFrame, fundamentals: DataFrame, split: stats.Split, *, out: str | None = None, **options) -> Mapping[str, dict]:
    """Two independent runs, each seeing only what its window's end allows; ``out`` gets both."""
    result = {name: fundamental_backtest(bars, fundamentals, *window, **options) for name, window in (("train", split.train), ("test", split.test))}
    if out:
        write_artifact(out, canonical(_plain(result)).encode())
    return result


def provider_backtest(source, tickers: Sequence[str] | None, start: dt.date, end: dt.date, *, lookback_days: int = 550, audit: AuditLog | None = None, **options) -> dict:
    """``fundamental_backtest`` over a provider that is pinned to the window's end."""
    pinned = PointInTime(source, end, audit, lazy=True)
    bars, facts = pinned.prices(tickers, start, end), pinned.fundamentals(tickers, start - dt.timedelta(days=lookback_days), end)
    return fundamental_backtest(bars, facts, start, end, lookback_days=lookback_days, audit=audit, **options)


def provider_train_test(source, tickers: Sequence[str] | None, split: stats.Split, *, out: str | None = None, **options) -> Mapping[str, dict]:
    """Two runs, each over the provider pinned to its own window's end; ``out`` gets both."""
    result = {name: provider_backtest(source, tickers, *window, **options) for name, window in (("train", split.train), ("test", split.test))}
    if out:
        write_artifact(out, canonical(_plain(result)).encode())
    return result
