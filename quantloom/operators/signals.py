"""The composite signals, for one day or for all score days in one plan.

Every signal returns date, ticker, raw_score, rank_score. Inputs are cut to what was known before any window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.cross_section import rank01, zscore
from quantloom.operators.core import as_of, as_of_join, by_ticker, require_flagged
from quantloom.sources.storage import checkpointed

DEFAULT_ACCURACY = 0.5
#: Tickers from which an analyst's coverage isn't joined with itself any more.
WIDE_COVERAGE = 256
OUT = ("date", "ticker", "raw_score", "rank_score")


def _finish(df: DataFrame, raw: Column) -> DataFrame:
    return df.withColumn("raw_score", raw).withColumn("rank_score", rank01("raw_score", "date")).select(*OUT)


def _weighted(df: DataFrame, parts: Sequence[str], weights: Sequence[float]) -> DataFrame:
    z = df.withColumns({f"z_{p}": zscore(p, "date") for p in parts})
    terms = [F.col(f"z_{p}") * F.lit(float(w)) for p, w in zip(parts, weights, strict=True)]
    return _finish(z, sum(terms[1:], terms[0]))


def grid(dates: DataFrame, rows: DataFrame) -> DataFrame:
    """Every score date with every ticker of ``rows``: the two axes, not their records."""
    return dates.select("date").distinct().crossJoin(rows.select("ticker").distinct())


def peer_trend(covered: DataFrame, now: DataFrame, wide: int = WIDE_COVERAGE) -> DataFrame:
    """date, ticker, trend: the mean expert view (``now``: date, ticker, expert) of the tickers that share an analyst with it.

    ``covered`` holds ticker, analyst_id and the day since which the analyst covers it; two tickers are peers from the day on which an
    analyst had covered both. Analysts of up to ``wide`` tickers are joined with themselves, so that a row meets no more than ``wide``. Tickers
    that have the same set of wider analysts on a day share one union of their coverages, summed once for the set; the ticker itself and its
    other peers are taken out or added; tickers without a view of their own may be in the result, too. So no pairs are made within a wide coverage: it costs its rows for each such set.
    """
    covered = checkpointed(covered)
    sizes = covered.groupBy("analyst_id").agg(F.count("*").alias("n"))
    views = now.select(F.col("ticker").alias("peer"), "date", F.col("expert").alias("theirs"))
    narrow = covered.join(sizes.where(F.col("n") <= wide).select("analyst_id"), "analyst_id", "left_semi")
    other = narrow.select(F.col("ticker").alias("peer"), "analyst_id", F.col("since").alias("p_since"))
    pairs = narrow.join(other, "analyst_id").where("ticker <> peer").groupBy("ticker", "peer").agg(F.min(F.greatest("since", "p_since")).alias("since"))
    near = pairs.join(views, "peer").where("date >= since").select("date", "ticker", "peer", "theirs")
    if sizes.where(F.col("n") > wide).isEmpty():
        return near.groupBy("date", "ticker").agg(F.avg("theirs").alias("trend"))
    broad = covered.join(sizes.where(F.col("n") > wide).select("analyst_id"), "analyst_id", "left_semi")
    seen = broad.join(now, "ticker").where("date >= since").select("date", "ticker", "analyst_id", "expert")
    sets = seen.groupBy("date", "ticker").agg(F.first("expert").alias("own"), F.sort_array(F.collect_list("analyst_id")).alias("analysts")).withColumn("key", F.sha2(F.to_json("analysts"), 256))
    sets = checkpointed(sets)
    wanted = sets.dropDuplicates(["date", "key"]).select("date", "key", F.explode("analysts").alias("analyst_id"))
    union = seen.join(wanted, ["date", "analyst_id"]).groupBy("date", "key", F.col("ticker").alias("peer")).agg(F.first("expert").alias("theirs"))
    union = checkpointed(union)
    whole = sets.join(union.groupBy("date", "key").agg(F.sum("theirs").alias("s"), F.count("*").alias("n")), ["date", "key"]).select("date", "ticker", (F.col("s") - F.col("own")).alias("s"), (F.col("n") - 1).alias("n"))
    more = near.join(sets.select("date", "ticker", "key"), ["date", "ticker"], "left").join(union.select("date", "key", "peer"), ["date", "key", "peer"], "left_anti")
    parts = whole.unionByName(more.groupBy("date", "ticker").agg(F.sum("theirs").alias("s"), F.count("*").alias("n")))
    return parts.groupBy("date", "ticker").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0").select("date", "ticker", (F.col("s") / F.col("n")).alias("trend"))


def earnings_surprise(estimates: DataFrame, day: dt.date | str, metric: str = "EPS", weights: Sequence[float] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """Expert consensus against the simple one, the same of peers that share an analyst, and agreement."""
    known = checkpointed(require_flagged(as_of(estimates, day, "estimate_date").where(F.col("metric") == metric)))
    accuracy = F.coalesce("analyst_accuracy", F.lit(DEFAULT_ACCURACY))
    own = (
        known.withColumn("a", accuracy).groupBy("ticker")
        .agg(F.sum(F.col("a") * F.col("value")).alias("av"), F.sum("a").alias("a"), F.avg("value").alias("mean"), F.when(F.count("value") > 1, F.stddev_pop("value")).otherwise(0.0).alias("spread"))
        .select(F.lit(day).cast("date").alias("date"), "ticker", F.when(F.col("a") > 0, F.col("av") / F.nullif("a", F.lit(0.0)) - F.col("mean")).otherwise(0.0).alias("expert"), (-F.col("spread")).alias("management"))
    )
    trend = peer_trend(known.groupBy("ticker", "analyst_id").agg(F.min("estimate_date").alias("since")), own)
    parts = own.join(trend, ["date", "ticker"], "left").withColumn("trend", F.coalesce("trend", F.lit(0.0)))
    return _weighted(parts, ("expert", "trend", "management"), weights)


def earnings_surprise_on(estimates: DataFrame, dates: DataFrame, metric: str = "EPS", weights: Sequence[float] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """``earnings_surprise`` of every date in one plan, as a loop over the days would give it.

    A ticker's figures are running aggregates over its estimates; two tickers are peers from the day on which an analyst
    had covered both.
    """
    last = dates.agg(F.max("date")).first()[0]
    scoped = estimates.where(F.col("metric") == metric)
    known = require_flagged(as_of(scoped, last, "estimate_date") if last else scoped.limit(0)).withColumn("a", F.coalesce("analyst_accuracy", F.lit(DEFAULT_ACCURACY)))
    run = W.partitionBy("ticker").orderBy("estimate_date").rangeBetween(W.unboundedPreceding, 0)
    held, spread = F.sum("a").over(run), F.when(F.count("value").over(run) > 1, F.stddev_pop("value").over(run)).otherwise(0.0)
    expert = F.when(held > 0, F.sum(F.col("a") * F.col("value")).over(run) / F.nullif(held, F.lit(0.0)) - F.avg("value").over(run)).otherwise(0.0)
    own = known.select("ticker", "estimate_date", expert.alias("expert"), (-spread).alias("management"))
    now = checkpointed(as_of_join(grid(dates, own), own, "ticker", "date", "estimate_date", ["expert", "management"]).where("management is not null"))
    trend = peer_trend(known.groupBy("ticker", "analyst_id").agg(F.min("estimate_date").alias("since")), now)
    parts = now.join(trend, ["date", "ticker"], "left").withColumn("trend", F.coalesce("trend", F.lit(0.0)))
    return _weighted(parts, ("expert", "trend", "management"), weights)


def fundamental_factors(fundamentals: DataFrame, dates: DataFrame, weights: Sequence[float] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """Low accruals, return on assets and revenue acceleration of the latest period known on each date."""
    by = W.partitionBy("ticker").orderBy("report_date")
    last, older = F.lag("revenue", 1).over(by), F.lag("revenue", 2).over(by)
    speed = F.when((last != 0) & (older != 0), (F.col("revenue") / F.nullif(last, F.lit(0.0)) - 1) - (last / F.nullif(older, F.lit(0.0)) - 1))
    facts = require_flagged(fundamentals).select(
        "ticker", "report_date", (-(F.col("net_income") - F.col("operating_cash_flow")) / F.col("total_assets")).alias("accruals"),
        (F.col("net_income") / F.col("total_assets")).alias("roa"), F.coalesce(speed, F.lit(0.0)).alias("acceleration"),
    )
    parts = as_of_join(grid(dates, facts), facts, "ticker", "date", "report_date", ["accruals", "roa", "acceleration"]).where("accruals is not null")
    return _weighted(parts, ("accruals", "roa", "acceleration"), weights)


def ownership_change(ownership: DataFrame, lookback_days: int = 90) -> DataFrame:
    """ticker, as_of_date, latest, baseline: each snapshot with the one ``lookback_days`` before it, else the first."""
    if lookback_days <= 0:
        raise ValueError(f"lookback_days must be positive, got {lookback_days}")
    shots = ownership.select("ticker", "as_of_date", F.col("institutional_ownership_pct").alias("latest"), F.date_sub("as_of_date", lookback_days).alias("cutoff"))
    earlier = ownership.select("ticker", F.col("as_of_date").alias("b_date"), F.col("institutional_ownership_pct").alias("earlier"))
    first = F.first("latest").over(W.partitionBy("ticker").orderBy("as_of_date"))
    joined = as_of_join(shots.withColumn("first", first), earlier, "ticker", "cutoff", "b_date", ["earlier"])
    return joined.select("ticker", "as_of_date", "latest", F.coalesce("earlier", "first").alias("baseline"))


def ownership_momentum(ownership: DataFrame, dates: DataFrame, lookback_days: int = 90) -> DataFrame:
    change = ownership_change(require_flagged(ownership), lookback_days).select("ticker", "as_of_date", (F.col("latest") - F.col("baseline")).alias("momentum"))
    parts = as_of_join(grid(dates, change), change, "ticker", "date", "as_of_date", ["momentum"]).where("momentum is not null")
    return _finish(parts, zscore("momentum", "date"))


def trailing_return(bars: DataFrame, lookback: int = 21) -> DataFrame:
    """ticker, date, ret over the last ``lookback`` observations, or since the first bar; from the second bar on."""
    base = F.coalesce(F.lag("adjusted_close", lookback).over(by_ticker()), F.first("adjusted_close").over(by_ticker()))
    rows = bars.select("ticker", "date", (F.col("adjusted_close") / base - 1).alias("ret"), F.row_number().over(by_ticker()).alias("i"))
    return rows.where("i >= 2").select("ticker", "date", "ret")


def supply_chain(links: DataFrame, bars: DataFrame, dates: DataFrame, lookback: int = 21) -> DataFrame:
    """Weighted trailing return of related tickers; links without a return or of no total weight are left out."""
    moved = trailing_return(bars, lookback).select(F.col("ticker").alias("related_ticker"), F.col("date").alias("r_date"), "ret")
    related = dates.select("date").distinct().crossJoin(links.select("related_ticker").distinct())
    known = as_of_join(related, moved, "related_ticker", "date", "r_date", ["ret"]).where("ret is not null")
    joined = require_flagged(links).join(known, "related_ticker").groupBy("date", "ticker").agg(F.sum(F.col("weight") * F.col("ret")).alias("wr"), F.sum("weight").alias("w"))
    parts = joined.where("w <> 0").withColumn("flow", F.col("wr") / F.col("w"))
    return _finish(parts, zscore("flow", "date"))
