"""Portfolio constructors: the tilt by volatility and the mean-CVaR book. Of a day's names only those that may be held reach the driver."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.cross_section import with_zscore
from quantloom.operators import core
from quantloom.plans.lp import priced_cvar
from quantloom.sources.storage import checkpointed

RETURN_PER_Z = 0.01
#: Names that the first and the widest round of pricing add to the linear program; a gain from a name below GAIN counts as none.
NAMES_A_ROUND, MOST_A_ROUND, GAIN = 256, 4096, 1e-8


def tilt_portfolio(scores: DataFrame, bars: DataFrame, day: dt.date | str, previous: DataFrame | None = None, lookback: int = 63, beta: float = 0.95, **limits) -> tuple[DataFrame, dict]:
    """Weights of ``day``'s combined scores (ticker, date, raw_score) and the book's expected return, CVaR and turnover."""
    today = scores.where(F.col("date") == F.lit(day).cast("date")).select("ticker", "raw_score")
    if today.isEmpty():
        raise ValueError(f"no combined scores on {day}")
    book = core.enforce(core.tilt(today, core.trailing_vol(bars, day, lookback)), **limits)
    return book, _facts(book, bars, day, previous, lookback, beta)


def _facts(book: DataFrame, bars: DataFrame, day: dt.date | str, previous: DataFrame | None, lookback: int, beta: float) -> dict:
    risk = core.tail_risk(core.scenario_returns(book, core.scenarios(bars, day, lookback)), beta).first().asDict()
    return risk | {"turnover": core.turnover(book, previous if previous is not None else book.limit(0)).first()[0]}


def cvar_portfolio(scores: DataFrame, bars: DataFrame, day: dt.date | str, previous: DataFrame | None = None, lookback: int = 63, beta: float = 0.95, risk_aversion: float = 1.0, **limits) -> tuple[DataFrame, dict]:
    """The book of least CVaR less rewarded return over all of the day's names, by column generation.

    The driver solves the program of some names. Its prices go to the table of all names, and the names that would better the book most come
    back, until there is none: then the book is the best of all names. A best book needs at most gross / cap names at their cap and one for
    each scenario besides, so what reaches the driver doesn't grow with the names.
    """
    spark = scores.sparkSession
    today = scores.where(F.col("date") == F.lit(day).cast("date"))
    today = checkpointed(with_zscore(today, "raw_score", "z").select("ticker", (F.col("z") * RETURN_PER_Z).alias("mean")))
    if today.isEmpty():
        raise ValueError(f"no combined scores on {day}")
    rows = checkpointed(core.scenarios(bars, day, lookback).join(today.select("ticker"), "ticker", "left_semi"))
    days = [r["date"] for r in rows.select("date").distinct().orderBy("date").collect()]  # ``lookback`` at most
    if not days:
        raise ValueError("no scenarios")
    # One column of the program for each name; days without a return count as 0.
    paths = rows.groupBy("ticker").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("date") == F.lit(d), F.col("ret"))), F.lit(0.0)) for d in days)).alias("rets"))
    none = F.array_repeat(F.lit(0.0), len(days))
    names = checkpointed(today.join(paths, "ticker", "left").select("ticker", "mean", F.coalesce("rets", none).alias("rets")))
    most = max(NAMES_A_ROUND, math.ceil(2 * limits.get("max_gross", 1.0) / limits.get("max_position", 0.05)))
    found = names.orderBy(F.desc(F.abs("mean")), "ticker").limit(most).collect()
    held = {}
    while found:
        most = max(most, min(2 * most, MOST_A_ROUND))
        held |= {r["ticker"]: (r["mean"], r["rets"]) for r in found}
        weights, price, gross, net = priced_cvar(np.array([x for _, x in held.values()]).T, np.array([m for m, _ in held.values()]), beta=beta, risk_aversion=risk_aversion, **limits)
        path = F.aggregate(F.zip_with("rets", F.array(*(F.lit(float(p)) for p in price)), lambda r, p: r * p), F.lit(0.0), lambda s, x: s + x)
        gain = F.abs(F.col("mean") * float(risk_aversion) + path + float(net)) + float(gross)
        found = names.where(~F.col("ticker").isin(list(held))).withColumn("gain", gain).where(F.col("gain") > GAIN).orderBy(F.desc("gain"), "ticker").limit(most).collect()
    chosen = [(t, w) for t, w in zip(held, weights.tolist(), strict=True) if w]
    book = names.select("ticker").join(F.broadcast(spark.createDataFrame(chosen, "ticker string, weight double")), "ticker", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return book, _facts(book, bars, day, previous, lookback, beta)
