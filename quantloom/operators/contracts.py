"""Record contracts: declared schemas with rules, and a validator that splits good rows from bad ones.

A bad row carries the list of reasons; strict validation raises when there is one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Enumerations.
SOURCES = ("factset", "edgar", "yahoo", "fixture", "backup")
METRICS = ("EPS", "Revenue", "EBITDA", "EBIT", "NetIncome", "FCF")
RELATIONSHIPS = ("supplier", "customer")
STATUSES = ("DISCOVERED", "VALIDATED", "STAGING", "PRODUCTION", "RETIRED")


@dataclass(frozen=True)
class Contract:
    """Fields with their types, and SQL rules by reason; a rule that is false or NULL makes the row bad."""

    name: str
    fields: tuple[tuple[str, str], ...]
    rules: tuple[tuple[str, str], ...]
    upper: tuple[str, ...] = ("ticker",)


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


def _ticker(c: str = "ticker") -> tuple[str, str]:
    return (f"{c} length", f"length({c}) between 1 and 12")


PRICE = Contract(
    "price",
    (("ticker", "string"), ("date", "date"), *((c, "double") for c in ("open", "high", "low", "close", "volume", "adjusted_close"))),
    (
        _ticker(), *((f"{c} positive", f"{c} > 0") for c in ("open", "high", "low", "close", "adjusted_close")), ("volume not negative", "volume >= 0"),
        ("high under low", "high >= low"), ("open outside range", "open between low and high"), ("close outside range", "close between low and high"),
    ),
)
ESTIMATE = Contract(
    "estimate",
    (("ticker", "string"), ("analyst_id", "string"), ("estimate_date", "date"), ("metric", "string"), ("value", "double"), ("analyst_accuracy", "double")),
    (_ticker(), ("metric unknown", _in("metric", METRICS)), ("value missing", "value is not null"), ("accuracy outside [0, 1]", "analyst_accuracy is null or analyst_accuracy between 0 and 1")),
)
FUNDAMENTAL = Contract(
    "fundamental",
    (("ticker", "string"), ("report_date", "date"), ("fiscal_year", "int"), ("fiscal_quarter", "int"), *((c, "double") for c in ("total_assets", "net_income", "operating_cash_flow", "revenue"))),
    (_ticker(), ("year outside 1990 to 2100", "fiscal_year between 1990 and 2100"), ("quarter outside 1 to 4", "fiscal_quarter between 1 and 4"), ("assets not positive", "total_assets > 0"), ("revenue negative", "revenue >= 0")),
)
OWNERSHIP = Contract(
    "ownership",
    (("ticker", "string"), ("as_of_date", "date"), ("institutional_ownership_pct", "double"), ("institution_count", "long")),
    (_ticker(), ("share outside [0, 1]", "institutional_ownership_pct between 0 and 1"), ("count negative", "institution_count >= 0")),
)
LINK = Contract(
    "link",
    (("ticker", "string"), ("related_ticker", "string"), ("relationship", "string"), ("weight", "double")),
    (_ticker(), _ticker("related_ticker"), ("self link", "ticker <> related_ticker"), ("relationship unknown", _in("relationship", RELATIONSHIPS)), ("weight outside [0, 1]", "weight between 0 and 1")),
    ("ticker", "related_ticker"),
)
SCORE = Contract(
    "score",
    (("ticker", "string"), ("date", "date"), ("signal_name", "string"), ("signal_version", "string"), ("raw_score", "double"), ("rank_score", "double")),
    (_ticker(), ("rank outside [0, 1]", "rank_score between 0 and 1"), ("version", r"signal_version rlike '^\\d+\\.\\d+\\.\\d+$'")),
    (),
)


def normalized(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's fields, cast; strings trimmed, tickers upper-cased."""

    def field(name: str, kind: str) -> Column:
        c = F.col(name).cast(kind)
        c = F.trim(c) if kind == "string" else c
        return (F.upper(c) if name in contract.upper else c).alias(name)

    return df.select(*(field(n, k) for n, k in contract.fields))


def checked(df: DataFrame, contract: Contract) -> DataFrame:
    """The rows with their list of reasons, empty for good ones."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), reason) for reason, rule in contract.rules)))
    return normalized(df, contract).withColumn("reasons", reasons)


def validate(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    rows = checked(df, contract)
    return rows.where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0)


def require_valid(df: DataFrame, contract: Contract) -> DataFrame:
    good, bad = validate(df, contract)
    found = bad.limit(1).collect()
    if found:
        raise ValueError(f"{contract.name}: {', '.join(found[0]['reasons'])}")
    return good
