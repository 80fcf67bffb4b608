"""Command line: the fundamental backtest over a provider.

python -m quantloom --provider tables --folder DIR --start 1996-01-01 --end 2001-12-31 [--oos]
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from quantloom.plans.backtest import provider_backtest, provider_train_test
from quantloom.plans.stats import train_test_split
from quantloom.settings import Settings, logged
from quantloom.sources.feeds import universe
from quantloom.sources.http import Feed
from quantloom.sources.providers import provider
from quantloom.sources.storage import AuditLog


def arguments(given: Sequence[str] | None = None) -> argparse.Namespace:
    settings = Settings.load()
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--provider", default=settings.provider)
    p.add_argument("--folder")
    p.add_argument("--prices-url", help="the vendor's feed of prices; its login is set by QUANTLOOM_VENDOR_USER and QUANTLOOM_VENDOR_KEY")
    p.add_argument("--tickers", help="comma-separated; all of the provider's if left out")
    p.add_argument("--universe-top", type=int, help="the first so many companies of the public listing")
    p.add_argument("--start", type=dt.date.fromisoformat, required=True)
    p.add_argument("--end", type=dt.date.fromisoformat, required=True)
    p.add_argument("--score-every", type=int, default=5)
    p.add_argument("--n-trials", type=int, default=1)
    p.add_argument("--oos", action="store_true", help="a train and a test run")
    p.add_argument("--embargo-days", type=int, default=30)
    p.add_argument("--out")
    p.add_argument("--audit")
    return p.parse_args(given)


def source_of(spark: SparkSession, a: argparse.Namespace):
    """The provider that the arguments name; a vendor's needs a login."""
    options = {k: v for k, v in (("folder", a.folder), ("prices_url", a.prices_url)) if v}
    if a.provider == "vendor":
        settings = Settings.load()
        settings.require("vendor_user", "vendor_key")
        options["feed"] = Feed.with_login(settings.vendor_user, settings.vendor_key)
    return provider(spark, a.provider, **options)


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    source = source_of(spark, a)
    audit = AuditLog(a.audit) if a.audit else None
    tickers = a.tickers.split(",") if a.tickers else None
    if a.universe_top:
        tickers = [r["ticker"] for r in universe(source.listing(), a.universe_top).collect()]
    options = {"score_every": a.score_every, "n_trials": a.n_trials, "audit": audit, "out": a.out}
    if a.oos:
        return provider_train_test(source, tickers, train_test_split(a.start, a.end, embargo_days=a.embargo_days), **options)
    return provider_backtest(source, tickers, a.start, a.end, **options)


def main(given: Sequence[str] | None = None) -> None:
    a = arguments(given)
    spark = SparkSession.builder.appName("quantloom").getOrCreate()
    print(json.dumps(logged(run)(spark, a), default=str, indent=1))


if __name__ == "__main__":
    main()
