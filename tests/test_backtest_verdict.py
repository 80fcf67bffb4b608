"""The registered report gives its verdict."""

from quantloom.queries import QUERIES


def test_report_has_the_verdict(spark, small):
    found = {r["statistic"]: r["amount"] for r in QUERIES["backtest_report"](spark, small).collect()}
    failed = [k for k in found if k.startswith("failed: ")]
    assert found["passed"] == (0.0 if failed else 1.0)
