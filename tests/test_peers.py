"""Peers that share an analyst and suppliers that share parts, with wide coverages and popular parts."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from quantloom.operators import signals
from quantloom.sources import market


def brute_trend(covered, now):
    out = {}
    for day in {d for d, _, _ in now}:
        experts = {t: e for d, t, e in now if d == day}
        holds = defaultdict(set)
        for t, a, since in covered:
            if since <= day:
                holds[a].add(t)
        for t in experts:
            peers = set().union(*(h for h in holds.values() if t in h)) - {t}
            known = [experts[p] for p in peers if p in experts]
            if known:
                out[day, t] = sum(known) / len(known)
    return out


@pytest.mark.parametrize("wide", [1, 4, 1000])
def test_peer_trend_equals_brute_force(spark, wide):
    rng = random.Random(wide)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(12)]
    tickers = [f"T{k:02d}" for k in range(40)]
    covered = [(t, "everyone", rng.choice(days)) for t in tickers]
    covered += [(t, "half", rng.choice(days)) for t in tickers[::2]] + [(t, f"a{rng.randrange(8)}", days[0]) for t in rng.sample(tickers, 25)]
    covered = list({(t, a): s for t, a, s in covered}.items())
    covered = [(t, a, s) for (t, a), s in covered]
    now = [(d, t, rng.uniform(-1, 1)) for d in (days[0], days[5], days[11]) for t in tickers if rng.random() < 0.8]
    got = signals.peer_trend(spark.createDataFrame(covered, "ticker string, analyst_id string, since date"), spark.createDataFrame(now, "date date, ticker string, expert double"), wide=wide).collect()
    want = brute_trend(covered, now)
    viewed = {(d, t) for d, t, _ in now}
    got = [r for r in got if (r["date"], r["ticker"]) in viewed]  # tickers without a view of their own may have peers, too
    assert {(r["date"], r["ticker"]) for r in got} == set(want)
    assert all(abs(r["trend"] - want[r["date"], r["ticker"]]) < 1e-9 for r in got)


def test_one_analyst_on_all_tickers_makes_no_pairs(spark):
    n = 3000
    covered = spark.range(n).selectExpr("concat('T', id) AS ticker", "'everyone' AS analyst_id", "date'2024-01-01' AS since")
    now = spark.range(n).selectExpr("date'2024-02-01' AS date", "concat('T', id) AS ticker", "double(id) AS expert")
    rows = {r["ticker"]: r["trend"] for r in signals.peer_trend(covered, now).collect()}
    total = n * (n - 1) / 2
    assert len(rows) == n and all(abs(rows[f"T{k}"] - (total - k) / (n - 1)) < 1e-6 for k in range(0, n, 97))


@pytest.mark.parametrize("wide", [2, 5, 512])
def test_shared_parts_equal_brute_force(spark, wide):
    rng = random.Random(3)
    lines = {(p, s): rng.randrange(1, 5) for p in range(6) for s in rng.sample(range(30), (30, 17, 3, 1, 8, 11)[p])}
    want = defaultdict(int)
    for (p, x), k in lines.items():
        for (q, y), m in lines.items():
            if p == q and x < y:
                want[x, y] += k * m
    per_part = spark.createDataFrame([(p, s, k) for (p, s), k in lines.items()], "part long, supplier long, k long")
    assert {(r["low"], r["high"]): r["n"] for r in market.shared_parts(per_part, wide).collect()} == dict(want)
