"""A Spark data source of feeds' answers: one partition for each host, so that its requests have one clock.

``register(spark, name, feed, address, tickers)`` makes ``spark.read.format(name).load()`` a table of ticker, first_day, last_day and
body. Filters ``first_day >= x`` and ``last_day <= y`` are pushed down into the days that are asked for. Tickers that the feed
doesn't know have no row; other errors fail the action.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from quantloom.sources.http import Feed, FeedError
from quantloom.sources.storage import checkpointed

#: Address of a ticker's answer for an inclusive range of days.
Address = Callable[[str, dt.date, dt.date], str]
SCHEMA = "ticker string, first_day date, last_day date, body string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class HostPart(InputPartition):
    """All requests to one host."""

    host: str
    requests: list[tuple[str, str]]
    first: dt.date
    last: dt.date


class BodyReader(DataSourceReader):
    def __init__(self, feed: Feed, address: Address, tickers: Sequence[str], first: dt.date, last: dt.date, skipped: Sequence[int]):
        self.feed, self.address, self.tickers, self.first, self.last, self.skipped = feed, address, tickers, first, last, skipped

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, GreaterThanOrEqual | EqualTo) and f.attribute == ("first_day",):
                self.first = max(self.first, f.value)
            elif isinstance(f, LessThanOrEqual | EqualTo) and f.attribute == ("last_day",):
                self.last = min(self.last, f.value)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        if self.first > self.last:
            return []
        by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for t in self.tickers:
            url = self.address(t, self.first, self.last)
            by_host[urlsplit(url).netloc].append((t, url))
        return [HostPart(host, own, self.first, self.last) for host, own in by_host.items()]

    def read(self, part: HostPart | None) -> Iterator[tuple]:
        for ticker, url in part.requests if part else ():  # no part: nothing is asked for
            try:
                yield ticker, part.first, part.last, self.feed.read(url).decode()
            except FeedError as e:
                if e.status not in self.skipped:
                    raise


def register(spark: SparkSession, name: str, feed: Feed, address: Address, tickers: Sequence[str], first: dt.date = dt.date(1900, 1, 1), last: dt.date = dt.date(9999, 12, 31), skipped: Sequence[int] = ()) -> None:
    """Make ``name`` a format: the answers to ``tickers``, of days from ``first`` to ``last`` unless filters ask for fewer."""

    class Bodies(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> BodyReader:
            return BodyReader(feed, address, tickers, first, last, skipped)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Bodies)


def fetched(spark: SparkSession, name: str, feed: Feed, address: Address, tickers: Sequence[str], first: dt.date, last: dt.date, skipped: Sequence[int] = ()) -> DataFrame:
    """The answers (ticker, first_day, last_day, body), asked for once and written: every later action reads what is written."""
    register(spark, name, feed, address, tickers, skipped=skipped)
    asked = spark.read.format(name).load().where(f"first_day >= date'{first}' and last_day <= date'{last}'")
    return checkpointed(asked)
