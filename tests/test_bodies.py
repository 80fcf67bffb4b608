"""The feeds' data source: pushed-down days, one partition and clock for each host, answers asked for once."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from quantloom.operators import core
from quantloom.sources import bodies
from quantloom.sources.http import AuthError, Feed, FeedError
from quantloom.sources.providers import PointInTime, PublicProvider, TableProvider

FIRST, LAST = dt.date(2026, 1, 1), dt.date(2026, 7, 1)


def addresses():
    """Addresses that tasks can make without this module."""

    def address(ticker, first, last):
        return f"https://{'a' if ticker < 'T5' else 'b'}.example/{ticker}?{first}..{last}"

    return address


def counting(path):
    """A transport that notes each request in a file."""

    def answer(url, headers):
        with open(path, "a") as f:
            f.write(url + "\n")
        return (404, b"") if "T7" in url else (200, url.encode())

    return answer


def test_registered_source_pushes_days_down_and_skips_unknown_tickers(spark, tmp_path):
    log = tmp_path / "requests"
    bodies.register(spark, "test_bodies", Feed(transport=counting(str(log))), addresses(), [f"T{k}" for k in range(9)], skipped=(404,))
    rows = spark.read.format("test_bodies").load().where("first_day >= date'2026-02-01' and last_day <= date'2026-03-01' and ticker <> 'T1'").collect()
    assert sorted(r["ticker"] for r in rows) == [f"T{k}" for k in range(9) if k not in (1, 7)]
    assert all(r["body"].endswith("2026-02-01..2026-03-01") and r["first_day"] == dt.date(2026, 2, 1) for r in rows)
    assert spark.read.format("test_bodies").load().where("first_day >= date'2026-03-02' and last_day <= date'2026-03-01'").count() == 0
    bodies.register(spark, "test_bodies_strict", Feed(transport=counting(str(log))), addresses(), ["T7"])
    with pytest.raises(PySparkException, match="404"):
        spark.read.format("test_bodies_strict").load().collect()


def test_two_actions_fetch_once(spark, tmp_path):
    log = tmp_path / "requests"
    found = bodies.fetched(spark, "test_once", Feed(transport=counting(str(log))), addresses(), ["T1", "T2", "T8"], FIRST, LAST)
    assert found.count() == 3 and found.where("ticker = 'T2'").count() == 1
    assert sorted(log.read_text().split()) == sorted(addresses()(t, FIRST, LAST) for t in ("T1", "T2", "T8"))


def test_requests_to_a_host_have_one_clock():
    now, asked = [100.0], []

    def sleep(seconds):
        now[0] += seconds

    def transport(url, headers):
        asked.append((url.split("/")[2], now[0]))
        now[0] += 0.1  # the answer takes its time
        return (503, b"") if len(asked) == 3 else (200, b"x")

    feed = Feed(transport=transport, sleep=sleep, clock=lambda: now[0], spacing_s=0.25)
    reader = bodies.BodyReader(feed, addresses(), [f"T{k}" for k in range(9)] * 4, FIRST, LAST, ())
    parts = reader.partitions()
    assert sorted(p.host for p in parts) == ["a.example", "b.example"]  # however many tasks, a host has one
    for part in parts:
        begin = len(asked)
        assert len(list(reader.read(part))) == len(part.requests)
        times = [t for _, t in asked[begin:]]
        assert {h for h, _ in asked[begin:]} == {part.host} and min(b - a for a, b in zip(times, times[1:])) >= 0.25 - 1e-9


def test_refused_login_is_an_error_of_its_own():
    waits = []
    for status in (401, 403):
        with pytest.raises(AuthError) as e:
            Feed.with_login("user", "key", transport=lambda u, h, status=status: (status, b"no"), sleep=waits.append).read("https://x")
        assert isinstance(e.value, FeedError) and e.value.status == status
    assert waits == []


def test_public_provider_asks_once_for_the_asked_days(spark, tmp_path):
    log = tmp_path / "requests"

    def answer(url, headers):
        with open(str(log), "a") as f:
            f.write(url + "\n")
        quote = {k: [1.0] for k in ("open", "high", "low", "close", "volume")}
        return 200, json.dumps({"chart": {"result": [{"meta": {"gmtoffset": 0}, "timestamp": [1767623400], "indicators": {"quote": [quote], "adjclose": [{"adjclose": [2.0]}]}}]}}).encode()

    bars = PublicProvider(spark, Feed(transport=answer)).prices(["AA", "BB"], FIRST, LAST)
    assert bars.count() == 2 and {r["adjusted_close"] for r in bars.collect()} == {2.0}
    urls = Path(log).read_text().split()
    assert len(urls) == 2 and all("period1=1767225600&period2=1782950400" in u for u in urls)


def test_lazy_pin_runs_no_job_and_fails_the_callers_action(spark, small):
    class Leaky(TableProvider):
        def prices(self, tickers, start, end):
            return super().prices(tickers, start, dt.date(2005, 1, 1))

    day, asked = dt.date(1998, 1, 1), (None, dt.date(1996, 1, 1), dt.date(2001, 1, 1))

    def jobs(group, make):
        spark.sparkContext.setJobGroup(group, group)
        made = make()
        return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    _, own = jobs("no-pin", lambda: TableProvider(spark, small).prices(*asked))  # reading a table's schema is a job
    fine, pinned = jobs("lazy-pin", lambda: PointInTime(TableProvider(spark, small), day, lazy=True).prices(*asked))
    _, eager = jobs("eager-pin", lambda: PointInTime(TableProvider(spark, small), day).prices(*asked))
    late = PointInTime(Leaky(spark, small), day, lazy=True).prices(*asked)
    assert pinned == own < eager
    assert fine.agg({"date": "max"}).first()[0] <= day
    with pytest.raises(PySparkException, match="a record after 1998-01-01"):
        late.where("volume > 0").count()
    assert core.guarded_point_in_time(spark.createDataFrame([(None,)], "date date"), day, "date").count() == 1
