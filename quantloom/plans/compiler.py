"""Compiles factor expressions into staged window plans over a dense panel.

Equal subtrees become one column, over all expressions of a batch. Operators of a stage share their
window's partitioning: all time-series operators that are ready run together (by ticker), then all
cross-section operators (by date), so a batch costs one exchange per change of axis.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.plans.dsl import CROSS_SECTION, FEATURES, TIME_SERIES, Expr

TINY = 1e-12


def _by_ticker() -> WindowSpec:
    return W.partitionBy("ticker").orderBy("date")


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def panel(bars: DataFrame) -> DataFrame:
    """All dates by all tickers, gaps NULL; ``ret`` steps over calendar slots. Dates and tickers are the axes, not the rows."""
    axes = bars.select("date").distinct().crossJoin(bars.select("ticker").distinct())
    wide = axes.join(bars.select("date", "ticker", "open", "high", "low", "close", "volume", F.col("adjusted_close").alias("adjclose")), ["date", "ticker"], "left")
    before = F.lag("adjclose", 1).over(_by_ticker())
    return wide.withColumn("ret", F.when(F.abs(before) > TINY, F.col("adjclose") / F.nullif(before, F.lit(0.0)) - 1))


def _pointwise(op: str, a: Column, b: Column | None) -> Column:
    match op:
        case "neg":
            return -a
        case "abs":
            return F.abs(a)
        case "sign":
            return F.signum(a)
        case "log1p_abs":
            return F.signum(a) * F.log1p(F.abs(a))
        case "add":
            return a + b
        case "sub":
            return a - b
        case "mul":
            return a * b
        case "div":
            return F.when(F.abs(b) > TINY, a / F.nullif(b, F.lit(0.0)))
        case "max":
            return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
        case "min":
            return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
    raise ValueError(f"unknown operator {op}")


def _time_series(op: str, x: Column, window: int) -> Column:
    if window < 1:
        raise ValueError(f"{op}: window must be at least 1, got {window}")
    back = F.lag(x, window).over(_by_ticker())
    frame = _by_ticker().rowsBetween(1 - window, 0)
    match op:
        case "delay":
            return back
        case "delta":
            return x - back
        case "momentum":
            return F.when(F.abs(back) > TINY, x / F.nullif(back, F.lit(0.0)) - 1)
        case "ts_std" if window == 1:
            return F.when(x.isNotNull(), 0.0)
    over = {"ts_mean": F.avg, "ts_std": F.stddev_samp, "ts_min": F.min, "ts_max": F.max}[op]
    return F.when(F.count(x).over(frame) == window, over(x).over(frame))


def _cross_section(op: str, name: str) -> Column:
    x, day = F.col(name), W.partitionBy("date")
    n = F.count(x).over(day)
    if op == "cs_rank":
        place = F.row_number().over(W.partitionBy("date", x.isNull()).orderBy(x, "ticker"))
        return F.when(x.isNotNull() & (n >= 2), (place - 1) / F.nullif(n - 1, F.lit(0)))
    std = F.stddev_samp(x).over(day)
    return F.when(x.isNotNull() & (n >= 2), F.when(std <= TINY, 0.0).otherwise((x - F.avg(x).over(day)) / F.nullif(std, F.lit(0.0))))


def evaluate(dense: DataFrame, expressions: Mapping[str, Expr], also: Sequence[str] = ()) -> DataFrame:
    """date, ticker, columns of ``dense`` that are to come along, and one column per named expression."""
    todo: dict[str, Expr] = {}
    for e in expressions.values():
        for n in e.nodes():
            todo.setdefault(str(n), n)
    done = {f: f for f in FEATURES}
    left = [n for s, n in sorted(todo.items(), key=lambda x: len(x[0])) if n.args]
    out = dense

    def run(kinds: Sequence[str] | None) -> bool:
        nonlocal out, left
        ready = [n for n in left if all(str(a) in done for a in n.args) and (n.op in kinds if kinds else n.op not in TIME_SERIES + CROSS_SECTION)]
        if not ready:
            return False
        columns = {}
        for n in ready:
            args = [F.col(done[str(a)]) for a in n.args]
            if n.op in TIME_SERIES:
                value = _time_series(n.op, args[0], n.window)
            elif n.op in CROSS_SECTION:
                value = _cross_section(n.op, done[str(n.args[0])])
            else:
                value = _pointwise(n.op, args[0], args[1] if len(args) > 1 else None)
            columns[f"__f{len(done) + len(columns)}"] = finite(value)
        for name, n in zip(columns, ready, strict=True):
            done[str(n)] = name
        left = [n for n in left if str(n) not in done]
        out = out.withColumns(columns)
        return True

    while left:
        while run(None) or run(TIME_SERIES):
            pass
        run(CROSS_SECTION)
    return out.select("date", "ticker", *also, *(F.col(done[str(e)]).alias(name) for name, e in expressions.items()))


def long_scores(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """signal, date, ticker, raw_score, for dates with two values or more."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("raw_score")) for n in names)))
    tall = values.select("date", "ticker", pairs.alias("s")).select("s.signal", "date", "ticker", "s.raw_score").where("raw_score is not null")
    return tall.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("signal", "date"))).where("n >= 2").drop("n")
