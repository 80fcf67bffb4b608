"""Point-in-time, return, validation, combination and portfolio operators: DataFrame in, DataFrame out.

Two time axes are kept apart: factor expressions step over the dense panel's calendar slots, everything
here steps over a ticker's own observations.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.cross_section import demeaned, rank01, rank_correlation, with_zscore, zscore
from quantloom.sources.storage import checkpointed

#: The day a record became known, per kind of record.
KNOWN_ON = {"prices": "date", "estimates": "estimate_date", "fundamentals": "report_date", "ownership": "as_of_date"}


def by_ticker() -> WindowSpec:
    """A ticker's own observations in order."""
    return W.partitionBy("ticker").orderBy("date")


# Point in time


class LeakError(ValueError):
    """A record from after the cutoff, or one that isn't point-in-time, where none may be."""


def as_of(df: DataFrame, cutoff: dt.date | str, known_on: str) -> DataFrame:
    """Records known on the cutoff or before. Applied before any window, so that none sees the future."""
    return df.where(F.col(known_on) <= F.lit(cutoff).cast("date"))


def knowledge_days(tables: Mapping[str, DataFrame]) -> DataFrame:
    """kind, ticker, known_on of the records of every kind in ``KNOWN_ON``."""
    parts = [df.select(F.lit(kind).alias("kind"), "ticker", F.col(KNOWN_ON[kind]).cast("date").alias("known_on")) for kind, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def leak_report(df: DataFrame, cutoff: dt.date | str, known_on: str) -> DataFrame:
    """One row: how many records come after the cutoff, and the earliest such day."""
    late = F.col(known_on) > F.lit(cutoff).cast("date")
    return df.agg(F.count(F.when(late, 1)).alias("n_late"), F.min(F.when(late, F.col(known_on))).alias("earliest"))


def assert_point_in_time(df: DataFrame, cutoff: dt.date | str, known_on: str, context: str = "") -> DataFrame:
    """``df`` itself, or a LeakError."""
    found = leak_report(df, cutoff, known_on).first()
    if found["n_late"]:
        raise LeakError(f"{context}: {found['n_late']} records after {cutoff}, earliest {found['earliest']}")
    return df


def guarded_point_in_time(df: DataFrame, cutoff: dt.date | str, known_on: str, context: str = "") -> DataFrame:
    """``df`` with a check in its plan: the action that reads a record from after the cutoff fails."""
    day = F.lit(cutoff).cast("date")
    late = F.raise_error(F.concat(F.lit(f"{context}: a record after {cutoff}: "), F.coalesce(F.col(known_on).cast("string"), F.lit("no day")))).cast("boolean")
    return df.where(F.when(F.col(known_on).isNull() | (F.col(known_on) <= day), F.lit(True)).otherwise(late))


def require_flagged(df: DataFrame, cutoff: dt.date | str | None = None, known_on: str | None = None) -> DataFrame:
    """``df`` itself, or a LeakError if a record in scope isn't flagged point-in-time."""
    scope = as_of(df, cutoff, known_on) if known_on else df
    n = scope.where("not is_point_in_time").limit(1).count()
    if n:
        raise LeakError("records that are not point-in-time cannot be used")
    return df


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, columns: Sequence[str]) -> DataFrame:
    """Attach to each left row the latest right row of its key on or before it (NULLs if none).

    One union and one running window: linear in the rows, where a range join is not. Right rows of one
    day: the greatest by ``columns``.
    """
    mark = F.struct(*(F.col(c) for c in columns))
    one = right.groupBy(key, right_on).agg(F.max(mark).alias("m")).select(F.col(key), F.col(right_on).alias("__t"), F.lit(0).alias("__side"), "m", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"))
    two = left.select(F.col(key), F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(one.schema["m"].dataType).alias("m"), F.struct("*").alias("__l"))
    run = W.partitionBy(key).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    filled = one.unionByName(two).withColumn("m", F.last("m", ignorenulls=True).over(run)).where("__side = 1")
    return filled.select("__l.*", *(F.col(f"m.{c}").alias(c) for c in columns))


def score_dates(bars: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th distinct trading day, from the first; one row per day passes through the window."""
    place = F.row_number().over(W.orderBy("date")) - 1
    return bars.select("date").distinct().withColumn("i", place).where(F.col("i") % max(1, every) == 0).select("date")


def latest_dates(df: DataFrame, n: int) -> DataFrame:
    return df.select("date").distinct().orderBy(F.desc("date")).limit(n)


def split_label(day: Column, train: tuple[dt.date, dt.date], test: tuple[dt.date, dt.date]) -> Column:
    """``train``, ``test``, or NULL for embargoed days; windows include both ends."""
    return F.when(day.between(*train), "train").when(day.between(*test), "test")


def assert_out_of_sample(train: DataFrame, test: DataFrame, known_on: str, embargo_days: int = 0) -> None:
    """A LeakError unless all of ``test`` became known after ``train``, with so many days between; an empty side passes."""
    last = train.agg(F.max(F.col(known_on).cast("date"))).first()[0]
    first = test.agg(F.min(F.col(known_on).cast("date"))).first()[0]
    if last is None or first is None:
        return
    between = (first - last).days - 1
    if between < 0:
        raise LeakError(f"test records start on {first}, train records end on {last}")
    if between < embargo_days:
        raise LeakError(f"{between} days between train and test records, {embargo_days} required")


# Returns


def forward_return(bars: DataFrame, horizon: int = 21) -> DataFrame:
    """ticker, date, fwd: the adjusted close ``horizon`` observations ahead over today's, less one."""
    if horizon <= 0:
        raise ValueError(f"horizon must be positive, got {horizon}")
    return bars.select("ticker", "date", (F.lead("adjusted_close", horizon).over(by_ticker()) / F.col("adjusted_close") - 1).alias("fwd")).where("fwd is not null")


def observed_return(bars: DataFrame, back: int = 1) -> DataFrame:
    """ticker, date, ret over the ticker's own last ``back`` observations."""
    return bars.select("ticker", "date", (F.col("adjusted_close") / F.lag("adjusted_close", back).over(by_ticker()) - 1).alias("ret")).where("ret is not null")


def market_return(bars: DataFrame) -> DataFrame:
    return observed_return(bars).groupBy("date").agg(F.avg("ret").alias("market"))


# Validation


def daily_ic(scores: DataFrame, forward: DataFrame, min_n: int = 5) -> DataFrame:
    """signal, date, n, ic: rank correlation of raw scores and forward returns per signal and day."""
    return paired_ic(scores.select("signal", "date", "ticker", "raw_score").join(forward, ["ticker", "date"]), min_n)


def paired_ic(pairs: DataFrame, min_n: int = 5) -> DataFrame:
    """The same of scores that carry their forward return (fwd) already: no join, and no second look at the bars."""
    return rank_correlation(pairs, "raw_score", "fwd", ["signal", "date"], min_n).withColumnRenamed("rho", "ic")


def ic_summary(ics: DataFrame) -> DataFrame:
    """Per signal: mean, sample deviation (0 for one day), ratio (0 without deviation), share of positive days, days."""
    std = F.coalesce(F.stddev_samp("ic"), F.lit(0.0))
    return (
        ics.groupBy("signal").agg(F.avg("ic").alias("mean_ic"), std.alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"), F.count(F.lit(1)).alias("n_days"))
        .withColumn("icir", F.when(F.col("ic_std") > 0, F.col("mean_ic") / F.nullif("ic_std", F.lit(0.0))).otherwise(0.0))
    )


def regime_labels(bars: DataFrame, trend_window: int = 21, vol_window: int = 21) -> DataFrame:
    """date, regime (one or two rows a day): bull or bear by trailing mean, high_vol or low_vol against the median.

    The median is the whole sample's, as the method defines it. The windows run over one row per day.
    """
    by = W.orderBy("date")
    vol = F.when(F.count("market").over(by.rowsBetween(1 - vol_window, 0)) >= 2, F.stddev_pop("market").over(by.rowsBetween(1 - vol_window, 0)))
    daily = market_return(bars).select("date", F.avg("market").over(by.rowsBetween(1 - trend_window, 0)).alias("trend"), vol.alias("vol"))
    labelled = daily.crossJoin(daily.agg(F.median("vol").alias("middle")))  # one row
    tags = F.array(F.when(F.col("trend") >= 0, "bull").otherwise("bear"), F.when(F.col("vol") >= F.col("middle"), "high_vol").when(F.col("vol") < F.col("middle"), "low_vol"))
    return labelled.select("date", F.explode(F.array_compact(tags)).alias("regime"))


def regime_ic(ics: DataFrame, regimes: DataFrame) -> DataFrame:
    return ics.join(regimes, "date").groupBy("signal", "regime").agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_days"))


def long_short(scores: DataFrame, forward: DataFrame, fraction: float = 1 / 3, min_n: int = 5, cost_bps: float = 1.0) -> DataFrame:
    """signal, date, ls: mean forward return of the top part less that of the bottom part, less costs."""
    by = W.partitionBy("signal", "date")
    ranked = (
        scores.select("signal", "date", "ticker", "raw_score").join(forward, ["ticker", "date"])
        .withColumns({"place": F.row_number().over(by.orderBy("raw_score", "ticker")), "n": F.count(F.lit(1)).over(by)}).where(F.col("n") >= min_n)
        .withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fraction)).cast("int")))
    )
    top, low = F.avg(F.when(F.col("place") > F.col("n") - F.col("k"), F.col("fwd"))), F.avg(F.when(F.col("place") <= F.col("k"), F.col("fwd")))
    return ranked.groupBy("signal", "date").agg((top - low - cost_bps / 10_000).alias("ls"))


def equity_curve(returns: DataFrame, column: str = "ls", by: str = "signal") -> DataFrame:
    """Running equity from 1.0 and drawdown against the running peak, which starts at 1.0."""
    run = W.partitionBy(by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    grown = returns.withColumn("equity", F.product(1 + F.col(column)).over(run)).withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(run)))
    return grown.withColumn("drawdown", F.least(F.lit(0.0), F.col("equity") / F.col("peak") - 1))


def portfolio_stats(returns: DataFrame, column: str = "ls", by: str = "signal", periods: int = 252) -> DataFrame:
    """Per group: mean times ``periods``, Sharpe ratio (sample deviation; 0 without), largest drawdown (not above 0)."""
    std = F.coalesce(F.stddev_samp(column), F.lit(0.0))
    sharpe = F.when(F.col("std") > 0, F.col("mean") / F.nullif("std", F.lit(0.0)) * F.sqrt(F.lit(float(periods)))).otherwise(0.0)
    return (
        equity_curve(returns, column, by).groupBy(by).agg(F.avg(column).alias("mean"), std.alias("std"), F.min("drawdown").alias("max_drawdown"))
        .select(by, (F.col("mean") * periods).alias("annualized_return"), sharpe.alias("sharpe"), "max_drawdown")
    )


def signal_correlation(scores: DataFrame, min_n: int = 5) -> DataFrame:
    """a, b, mean_rho, mean_abs_rho, n_days for every pair of signals (a < b) over their common days."""
    other = scores.select(F.col("signal").alias("b"), "date", "ticker", F.col("raw_score").alias("y"))
    pairs = scores.select(F.col("signal").alias("a"), "date", "ticker", F.col("raw_score").alias("x")).join(other, ["date", "ticker"]).where("a < b")
    daily = rank_correlation(pairs, "x", "y", ["a", "b", "date"], min_n)
    return daily.groupBy("a", "b").agg(F.avg("rho").alias("mean_rho"), F.avg(F.abs("rho")).alias("mean_abs_rho"), F.count(F.lit(1)).alias("n_days"))


def sector_neutral(scores: DataFrame, sectors: DataFrame) -> DataFrame:
    """Scores less their (signal, date, sector) mean; tickers without a sector are left out."""
    joined = scores.join(sectors, "ticker")
    return joined.withColumn("raw_score", demeaned("raw_score", ["signal", "date", "sector"]))


# Combination


def common_ic(ics: DataFrame) -> DataFrame:
    """The IC rows of the days that every signal has."""
    k = ics.agg(F.countDistinct("signal").alias("k"))
    days = ics.groupBy("date").agg(F.countDistinct("signal").alias("n")).crossJoin(k).where("n = k").select("date")
    return ics.join(days, "date")


def ic_covariance(ics: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """a, b, cov over common days, with the ridge added on the diagonal."""
    common = common_ic(ics)
    other = common.select(F.col("signal").alias("b"), "date", F.col("ic").alias("y"))
    cov = common.select(F.col("signal").alias("a"), "date", F.col("ic").alias("x")).join(other, "date").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))
    return cov.withColumn("cov", F.col("cov") + F.when(F.col("a") == F.col("b"), ridge).otherwise(0.0))


def combine_signals(scores: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """date, ticker, raw_score, rank_score: weighted sums of per-day population z-scores."""
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.create_map()
    scored = scores.withColumn("z", zscore("raw_score", ["signal", "date"])).withColumn("w", F.coalesce(F.element_at(weight, F.col("signal")), F.lit(0.0)) if weights else F.lit(0.0))
    return scored.groupBy("date", "ticker").agg(F.sum(F.col("z") * F.col("w")).alias("raw_score")).withColumn("rank_score", rank01("raw_score", "date"))


# Portfolio and risk


def trailing_vol(bars: DataFrame, cutoff: dt.date | str, lookback: int = 63) -> DataFrame:
    """ticker, vol: population deviation of its last returns up to the cutoff (two or more)."""
    last = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date")))
    recent = observed_return(as_of(bars, cutoff, "date")).withColumn("i", last).where(F.col("i") <= lookback)
    return recent.groupBy("ticker").agg(F.stddev_pop("ret").alias("vol"), F.count("ret").alias("n")).where("n >= 2").select("ticker", "vol")


def tilt(scores: DataFrame, vols: DataFrame, floor: float = 1e-4) -> DataFrame:
    """ticker, weight: the day's z-score over volatility; missing or zero volatility takes the median of the positive ones."""
    middle = vols.where("vol > 0").agg(F.coalesce(F.median("vol"), F.lit(floor)).alias("middle"))
    z = with_zscore(scores, "raw_score", "z")
    vol = F.greatest(F.coalesce(F.when(F.col("vol") != 0, F.col("vol")), F.col("middle")), F.lit(floor))
    return z.join(vols, "ticker", "left").crossJoin(middle).select("ticker", (F.col("z") / vol).alias("weight"))


def enforce(weights: DataFrame, max_position: float = 0.05, max_gross: float = 1.0, neutral: bool = True) -> DataFrame:
    """Demean, cap each name, scale the larger leg down, scale gross to its limit: each step one global aggregate over the weights, which are written once."""
    w = checkpointed(weights.select("ticker", "weight"))
    if neutral:
        w = w.crossJoin(w.agg(F.avg("weight").alias("m"))).select("ticker", (F.col("weight") - F.col("m")).alias("weight"))
    w = w.withColumn("weight", F.greatest(F.lit(-max_position), F.least(F.lit(max_position), "weight")))
    if neutral:
        legs = w.agg(F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("weight"))), F.lit(0.0)).alias("up"), F.coalesce(-F.sum(F.when(F.col("weight") < 0, F.col("weight"))), F.lit(0.0)).alias("down"))
        both = (F.col("up") > 0) & (F.col("down") > 0)
        up = F.when(both & (F.col("up") > F.col("down")) & (F.col("weight") > 0), F.col("down") / F.nullif("up", F.lit(0.0)))
        down = F.when(both & (F.col("down") > F.col("up")) & (F.col("weight") < 0), F.col("up") / F.nullif("down", F.lit(0.0)))
        w = w.crossJoin(legs).select("ticker", (F.col("weight") * F.coalesce(up, down, F.lit(1.0))).alias("weight"))
    gross = w.agg(F.sum(F.abs("weight")).alias("g"))
    return w.crossJoin(gross).select("ticker", F.when(F.col("g") > max_gross, F.col("weight") * (max_gross / F.nullif("g", F.lit(0.0)))).otherwise(F.col("weight")).alias("weight"))


def turnover(new: DataFrame, old: DataFrame) -> DataFrame:
    both = new.select("ticker", F.col("weight").alias("n")).join(old.select("ticker", F.col("weight").alias("o")), "ticker", "full")
    return both.agg(F.coalesce(F.sum(F.abs(F.coalesce("n", F.lit(0.0)) - F.coalesce("o", F.lit(0.0)))), F.lit(0.0)).alias("turnover"))


def violations(weights: DataFrame, max_position: float = 0.05, max_gross: float = 1.0, neutral: bool = True) -> DataFrame:
    """kind, ticker, amount of every broken limit."""
    names = weights.where(F.abs("weight") > max_position + 1e-9).select(F.lit("position").alias("kind"), "ticker", F.abs("weight").alias("amount"))
    sums = weights.agg(F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))
    none = F.lit(None).cast("string").alias("ticker")
    gross = sums.where(F.col("gross") > max_gross + 1e-9).select(F.lit("gross").alias("kind"), none, F.col("gross").alias("amount"))
    net = sums.where(F.abs("net") > 0.05).select(F.lit("net").alias("kind"), none, F.col("net").alias("amount"))
    return names.unionByName(gross).unionByName(net) if neutral else names.unionByName(gross)


def scenarios(bars: DataFrame, cutoff: dt.date | str, lookback: int = 63) -> DataFrame:
    """date, ticker, ret of the last ``lookback`` return days up to the cutoff."""
    returns = observed_return(as_of(bars, cutoff, "date"))
    return returns.join(F.broadcast(latest_dates(returns, lookback)), "date")  # at most ``lookback`` rows


def scenario_returns(weights: DataFrame, scenario: DataFrame) -> DataFrame:
    """date, ret of a book: names without a return that day count as 0."""
    joined = scenario.join(weights, "ticker", "left")
    return joined.groupBy("date").agg(F.coalesce(F.sum(F.col("weight") * F.col("ret")), F.lit(0.0)).alias("ret"))


def tail_risk(returns: DataFrame, beta: float = 0.95) -> DataFrame:
    """One row: expected return, value at risk and conditional value at risk of a scenario series (0 for an empty one)."""
    ranked = returns.select("ret", F.row_number().over(W.orderBy("ret", "date")).alias("i")).crossJoin(returns.agg(F.count(F.lit(1)).alias("n")))
    share = F.lit(1 - beta).cast("double")
    at = F.least("n", F.greatest(F.lit(1), F.ceil(share * F.col("n")).cast("long")))
    tail = F.greatest(F.lit(1), F.floor(share * F.col("n") + 1e-9).cast("long"))
    return ranked.agg(
        F.coalesce(F.avg("ret"), F.lit(0.0)).alias("expected_return"),
        F.coalesce(-F.max(F.when(F.col("i") == at, F.col("ret"))), F.lit(0.0)).alias("var"),
        F.coalesce(-F.avg(F.when(F.col("i") <= tail, F.col("ret"))), F.lit(0.0)).alias("cvar"),
    )
