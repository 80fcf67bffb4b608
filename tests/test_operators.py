import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.functions.cross_section import average_rank, rank01, zscore
from quantloom.operators import contracts, core, lifecycle, signals
from quantloom.sources.storage import AuditLog, verify_artifact, write_artifact

DAY = dt.date(2026, 1, 5)


def day(i):
    return DAY + dt.timedelta(days=i)


def bars(spark, closes):
    return spark.createDataFrame([(t, day(i), float(c)) for t, cs in closes.items() for i, c in enumerate(cs)], "ticker string, date date, adjusted_close double")


def test_ranks_and_z(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 9.0)], "t string, x double").withColumn("date", F.lit(1))
    out = {r["t"]: r for r in df.select("t", average_rank("x", "date").alias("r"), rank01("x", "date").alias("u"), zscore("x", "date").alias("z")).collect()}
    assert [out[t]["r"] for t in "abcd"] == [1, 2.5, 2.5, 4] and out["d"]["u"] == 1.0
    assert sum(r["z"] for r in out.values()) == pytest.approx(0)


def test_single_value_is_neutral(spark):
    df = spark.createDataFrame([(1, 5.0)], "date int, x double")
    assert tuple(df.select(rank01("x", "date"), zscore("x", "date")).first()) == (0.5, 0.0)


def test_forward_return(spark):
    out = core.forward_return(bars(spark, {"A": [100, 110, 121, 133.1]}), 1).collect()
    assert len(out) == 3 and all(r["fwd"] == pytest.approx(0.1) for r in out)
    with pytest.raises(ValueError):
        core.forward_return(bars(spark, {"A": [1]}), 0)


def test_daily_ic_needs_five_names_and_variance(spark):
    scores = spark.createDataFrame([("s", day(d), f"T{i}", float(i) if d < 2 else 1.0) for d in range(3) for i in range(5 if d else 4)], "signal string, date date, ticker string, raw_score double")
    forward = spark.createDataFrame([(f"T{i}", day(d), i * 0.01) for d in range(3) for i in range(5)], "ticker string, date date, fwd double")
    out = core.daily_ic(scores, forward).collect()
    assert [(r["date"], r["n"]) for r in out] == [(day(1), 5)] and out[0]["ic"] == pytest.approx(1.0)


def test_as_of_join_is_inclusive_and_backward(spark):
    left = spark.createDataFrame([("A", day(0)), ("A", day(2)), ("A", day(5)), ("B", day(5))], "ticker string, date date")
    right = spark.createDataFrame([("A", day(2), 1.0), ("A", day(4), 2.0)], "ticker string, known date, v double")
    out = {(r["ticker"], r["date"]): r["v"] for r in core.as_of_join(left, right, "ticker", "date", "known", ["v"]).collect()}
    assert out == {("A", day(0)): None, ("A", day(2)): 1.0, ("A", day(5)): 2.0, ("B", day(5)): None}


def test_leaks(spark):
    df = spark.createDataFrame([(day(0),), (day(3),)], "d date")
    assert core.as_of(df, day(0), "d").count() == 1
    with pytest.raises(core.LeakError, match="1 records"):
        core.assert_point_in_time(df, day(1), "d")
    with pytest.raises(core.LeakError):
        core.require_flagged(spark.createDataFrame([(False,)], "is_point_in_time boolean"))


def test_results_do_not_change_when_the_future_arrives(spark):
    past = bars(spark, {"A": [1, 2, 3, 4], "B": [4, 3, 5, 1]})
    more = past.unionByName(bars(spark, {"A": [9] * 9, "B": [8] * 9}).withColumn("date", F.date_add("date", 30)))
    vol = lambda b: {r["ticker"]: r["vol"] for r in core.trailing_vol(b, day(3)).collect()}
    assert vol(past) == vol(more)


def test_tail_risk(spark):
    returns = spark.createDataFrame([(day(i), r) for i, r in enumerate([-0.10, -0.05, -0.01, 0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06])], "date date, ret double")
    out = core.tail_risk(returns, 0.8).first()
    assert (out["var"], out["cvar"]) == (pytest.approx(0.05), pytest.approx(0.075))
    assert tuple(core.tail_risk(returns.limit(0)).first()) == (0.0, 0.0, 0.0)


def test_enforce_and_turnover(spark):
    raw = spark.createDataFrame([("A", 3.0), ("B", 1.0), ("C", -1.0), ("D", -9.0)], "ticker string, weight double")
    book = core.enforce(raw, 0.3, 1.0)
    w = {r["ticker"]: r["weight"] for r in book.collect()}
    assert abs(sum(w.values())) < 1e-12 and max(map(abs, w.values())) <= 0.3 and core.violations(book, 0.3).count() == 0
    one = spark.createDataFrame([("A", 0.1), ("B", -0.1)], raw.schema)
    two = spark.createDataFrame([("A", 0.1), ("C", 0.05)], raw.schema)
    assert core.turnover(one, two).first()[0] == pytest.approx(0.15)


def test_contract_reasons(spark):
    rows = [("aapl ", DAY, 1.0, 2.0, 0.5, 1.5, 10.0, 1.5), ("B", DAY, 3.0, 2.0, 0.5, 1.5, -1.0, 1.5)]
    good, bad = contracts.validate(spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, adjusted_close double"), contracts.PRICE)
    assert good.first()["ticker"] == "AAPL" and bad.first()["reasons"] == ["volume not negative", "open outside range"]
    with pytest.raises(ValueError, match="open outside range"):
        contracts.require_valid(bad, contracts.PRICE)


def test_earnings_surprise_orders_beat_over_miss(spark):
    rows = [(t, f"AN{i}", DAY, "EPS", v, a, True) for t, vs in {"BEAT": (1.2, 1.0, 0.8), "MISS": (0.8, 1.0, 1.2), "EVEN": (1.0, 1.0, 1.0)}.items() for i, (v, a) in enumerate(zip(vs, (0.9, 0.5, 0.1), strict=True))]
    est = spark.createDataFrame(rows, "ticker string, analyst_id string, estimate_date date, metric string, value double, analyst_accuracy double, is_point_in_time boolean")
    out = {r["ticker"]: r["raw_score"] for r in signals.earnings_surprise(est, DAY, weights=(1, 0, 0)).collect()}
    assert out["BEAT"] > out["EVEN"] > out["MISS"]


def test_lifecycle(spark):
    events = spark.createDataFrame([("a", 1, "DISCOVERED"), ("a", 2, "VALIDATED"), ("a", 3, "PRODUCTION"), ("b", 1, "STAGING")], "name string, seq long, status string")
    assert {(r["name"], r["seq"]) for r in lifecycle.bad_transitions(events).collect()} == {("a", 3), ("b", 1)}
    assert {r["name"]: r["status"] for r in lifecycle.latest(events).collect()} == {"a": "PRODUCTION", "b": "STAGING"}


def test_audit_and_artifacts_notice_tampering(tmp_path):
    log = AuditLog(tmp_path / "audit.jsonl")
    log.record("one", {"x": 1})
    log.record("two", {"x": 2})
    assert log.verify()
    log.path.write_text(log.path.read_text().replace('"x": 1', '"x": 7'))
    assert not log.verify()
    write_artifact(tmp_path / "a.json", b"{}")
    assert verify_artifact(tmp_path / "a.json")
    (tmp_path / "a.json").write_bytes(b"[]")
    assert not verify_artifact(tmp_path / "a.json")
