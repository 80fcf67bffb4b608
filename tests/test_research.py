import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import core, lifecycle, signals
from quantloom.plans import research
from quantloom.sources import market

DAY = dt.date(2026, 1, 5)


def day(i):
    return DAY + dt.timedelta(days=i)


def test_earnings_surprise_of_all_dates_equals_a_loop_over_them(spark):
    rows = [(f"T{i % 4}", f"AN{i * 7 % 5}", day(i % 9), "EPS" if i % 6 else "Revenue", float(i * 13 % 11), None if i % 5 == 0 else 0.1 * (i % 4), True) for i in range(40)]
    est = spark.createDataFrame(rows, "ticker string, analyst_id string, estimate_date date, metric string, value double, analyst_accuracy double, is_point_in_time boolean")
    days = [day(i) for i in (-1, 0, 2, 5, 30)]
    found = {(r["date"], r["ticker"]): r["raw_score"] for r in signals.earnings_surprise_on(est, spark.createDataFrame([(d,) for d in days], "date date")).collect()}
    expected = {(r["date"], r["ticker"]): r["raw_score"] for d in days for r in signals.earnings_surprise(est, d).collect()}
    assert expected and found == pytest.approx(expected)


def test_registry_steps(spark):
    events = spark.createDataFrame([], "name string, seq long, status string, mean_ic double, icir double")
    events = lifecycle.insert(events, spark.createDataFrame([("a", 0.1), ("b", None)], "name string, mean_ic double"))
    for twice in ([("a",)], [("c",), ("c",)]):
        with pytest.raises(lifecycle.RegistryError, match="already"):
            lifecycle.insert(events, spark.createDataFrame(twice, "name string"))
    events = lifecycle.update_metrics(events, "a", icir=0.7, mean_ic=None)
    events = lifecycle.advance(events, "a", "VALIDATED")
    now = lifecycle.require(events, "a")
    assert (now["status"], now["mean_ic"], now["icir"], now["seq"]) == ("VALIDATED", 0.1, 0.7, 3)
    assert lifecycle.bad_transitions(events).isEmpty() and lifecycle.get(events, "x") is None
    for wrong in (lambda: lifecycle.advance(events, "b", "PRODUCTION"), lambda: lifecycle.require(events, "x"), lambda: lifecycle.update_metrics(events, "a", status="RETIRED")):
        with pytest.raises(lifecycle.RegistryError):
            wrong()


def test_out_of_sample(spark):
    table = lambda *days: spark.createDataFrame([(day(i),) for i in days], "date date")
    core.assert_out_of_sample(table(0, 3), table(4, 9), "date")
    core.assert_out_of_sample(table(0, 3), table(9), "date", 5)
    core.assert_out_of_sample(table(), table(1), "date", 5)
    for train, test, embargo in (((0, 3), (3,), 0), ((0, 3), (8,), 5)):
        with pytest.raises(core.LeakError):
            core.assert_out_of_sample(table(*train), table(*test), "date", embargo)


def test_from_records_to_a_book(spark, small):
    bars = market.bars(spark, small)
    scores = research.four_signals(bars, market.estimates(spark, small), market.fundamentals(spark, small), market.ownership(spark, small), market.links(spark, small), core.score_dates(bars, 12))
    book, facts = research.research_book(scores, bars, horizon=3)
    assert facts["kept"] and sum(map(abs, facts["weights"].values())) == pytest.approx(1.0)
    assert core.violations(book).isEmpty() and abs(book.agg(F.sum("weight")).first()[0]) < 0.05 and book.count() > 0
    with pytest.raises(ValueError):
        research.research_book(scores.limit(0), bars)
