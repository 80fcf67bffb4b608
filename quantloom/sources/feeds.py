"""Parsers of JSON feeds: chart bars, company facts, vendor prices, listings. Raw text columns in, contract rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CHART = (
    "chart struct<result: array<struct<meta: struct<gmtoffset: long>, timestamp: array<long>, indicators: struct<"
    "quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>, "
    "adjclose: array<struct<adjclose: array<double>>>>>>>"
)


def chart_bars(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Price bars from chart payloads (ticker, body): halted bars dropped, dates by the exchange's offset, close for a missing adjusted close."""
    one = raw.select("ticker", F.from_json("body", _CHART).alias("j")).select("ticker", F.get("j.chart.result", F.lit(0)).alias("r"))
    at = one.select("ticker", "r", F.get("r.indicators.quote", F.lit(0)).alias("q"), F.get("r.indicators.adjclose", F.lit(0)).alias("a"), F.posexplode("r.timestamp").alias("i", "ts"))
    fields = {c: F.get(f"q.{c}", F.col("i")) for c in ("open", "high", "low", "close", "volume")}
    day = F.to_date(F.timestamp_seconds(F.col("ts") + F.coalesce("r.meta.gmtoffset", F.lit(0))))
    rows = at.select("ticker", day.alias("date"), *(c.alias(n) for n, c in fields.items()), F.get("a.adjclose", F.col("i")).alias("adj")).dropna(subset=list(fields))
    if start:
        rows = rows.where(F.col("date") >= start)
    if end:
        rows = rows.where(F.col("date") <= end)
    return rows.select("ticker", "date", "open", "high", "low", "close", "volume", F.coalesce("adj", "close").alias("adjusted_close"))


# Reporting tags by concept, in order of preference; forms of original filings.
CONCEPTS = {
    "total_assets": ("Assets",),
    "net_income": ("NetIncomeLoss",),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    "revenue": ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"),
}
FORMS = ("10-K", "10-Q")
_ENTRY = "array<struct<start: string, end: string, val: double, filed: string, fy: int, fp: string, form: string>>"
_FACTS = f"facts struct<`us-gaap`: map<string, struct<units: struct<USD: {_ENTRY}>>>>"


def company_facts(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Fundamentals from company-facts payloads (ticker, body).

    For each period and concept the preferred tag wins, then the earliest filing, the shortest duration,
    the latest period end. Amendments don't count, and neither do periods that miss a concept.
    """
    ranks = F.create_map(*(F.lit(x) for f, tags in CONCEPTS.items() for i, t in enumerate(tags) for x in (t, f"{i}:{f}")))
    tags = raw.select("ticker", F.explode(F.from_json("body", _FACTS)["facts"]["us-gaap"]).alias("tag", "fact")).withColumn("rank", F.try_element_at(ranks, F.col("tag"))).where("rank is not null")
    entries = tags.select("ticker", F.split("rank", ":").alias("rank"), F.posexplode("fact.units.USD").alias("pos", "e")).where(F.col("e.form").isin(*FORMS) & F.col("e.fy").isNotNull() & F.col("e.fp").isNotNull())
    days = F.coalesce(F.datediff(F.to_date("e.end"), F.to_date("e.start")), F.lit(0))
    order = (F.col("rank")[0].cast("int"), F.col("e.filed"), days, F.col("e.end").desc(), F.col("pos"))
    by = W.partitionBy("ticker", "e.fy", "e.fp", F.col("rank")[1])
    won = entries.withColumn("n", F.row_number().over(by.orderBy(*order))).where("n = 1").select("ticker", "e.fy", "e.fp", F.col("rank")[1].alias("field"), "e.val", F.to_date("e.filed").alias("filed"))
    value = {f: F.max(F.when(F.col("field") == f, F.col("val"))).alias(f) for f in CONCEPTS}
    rows = won.groupBy("ticker", "fy", "fp").agg(F.countDistinct("field").alias("k"), F.max("filed").alias("report_date"), *value.values()).where(F.col("k") == len(CONCEPTS))
    if start:
        rows = rows.where(F.col("report_date") >= start)
    if end:
        rows = rows.where(F.col("report_date") <= end)
    quarter = F.when(F.col("fp").rlike("^Q[1-4]$"), F.substring("fp", 2, 1).cast("int")).otherwise(4)
    return rows.select("ticker", "report_date", F.col("fy").alias("fiscal_year"), quarter.alias("fiscal_quarter"), *CONCEPTS)


def _or(value: Column, other: Column) -> Column:
    """The vendor's zero means missing."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), other)


def vendor_prices(quotes: DataFrame, adjusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good bars and skipped ones from the vendor's split-adjusted quotes and total-return closes (both ``body``).

    Identifiers end in ``-US``; missing prices take the close, missing volume 0; bars that break the price contract are skipped.
    """
    shape = "data array<struct<requestId: string, date: string, price: double, priceOpen: double, priceHigh: double, priceLow: double, volume: double>>"
    flat = lambda df: df.select(F.explode(F.from_json("body", shape)["data"]).alias("d")).select("d.*")
    base, total = flat(quotes), flat(adjusted).select("requestId", "date", F.col("price").alias("tr"))
    close = F.col("price")
    rows = base.join(total, ["requestId", "date"], "left").select(
        F.upper(F.split_part("requestId", F.lit("-"), F.lit(1))).alias("ticker"), F.to_date("date").alias("date"), _or(F.col("priceOpen"), close).alias("open"),
        _or(F.col("priceHigh"), close).alias("high"), _or(F.col("priceLow"), close).alias("low"), close.alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("tr", close).alias("adjusted_close"),
    )
    from quantloom.operators.contracts import PRICE, validate

    return validate(rows, PRICE)


def universe(listing: DataFrame, n: int) -> DataFrame:
    """The first ``n`` companies of a listing (pos, cik, ticker), one ticker each: the first in listing order."""
    if n <= 0:
        raise ValueError(f"n must be positive, got {n}")
    firsts = listing.groupBy("cik").agg(F.min("pos").alias("pos"), F.min_by("ticker", "pos").alias("ticker"))
    return firsts.orderBy("pos").limit(n).select("pos", "cik", "ticker")


def cik_of(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """ticker, cik (ten digits) for wanted tickers in any case; NULL where the listing has none."""
    known = listing.groupBy(F.upper("ticker").alias("ticker")).agg(F.min_by("cik", "pos").alias("cik"))
    return wanted.select(F.upper(F.trim("ticker")).alias("ticker")).distinct().join(known, "ticker", "left").select("ticker", F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))
