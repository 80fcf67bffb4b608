"""Settings, logging, and the command line over tables and the vendor's login."""

import datetime as dt
import json
import logging

import pytest

import quantloom.__main__ as cli
from quantloom.plans import backtest, stats
from quantloom.settings import Settings, get_logger, logged
from quantloom.sources.http import Feed
from quantloom.sources.providers import TableProvider
from quantloom.sources.storage import AuditLog, verify_artifact


def test_settings_from_the_environment():
    s = Settings.load({"QUANTLOOM_PROFILE": "production", "QUANTLOOM_VENDOR_USER": " me ", "OTHER": "x"})
    assert (s.profile, s.vendor_user, s.provider) == ("production", "me", "synthetic") and "key" not in repr(s)
    with pytest.raises(ValueError, match="QUANTLOOM_VENDOR_KEY, QUANTLOOM_CONTACT"):
        s.require("vendor_user", "vendor_key", "contact")
    with pytest.raises(ValueError, match="unknown profile"):
        Settings.load({"QUANTLOOM_PROFILE": "nowhere"})


def test_calls_are_logged_as_json_lines(capsys):
    logger = get_logger(__name__, "INFO")
    logger.handlers[0].setStream(__import__("sys").stderr)

    @logged
    def half(x):
        return 1 / x

    assert half(2) == 0.5
    with pytest.raises(ZeroDivisionError):
        half(0)
    good, bad = (json.loads(x) for x in capsys.readouterr().err.splitlines())
    assert good["event"] == "call.completed" and good["function"].endswith("half") and good["seconds"] >= 0
    assert bad["event"] == "call.failed" and "ZeroDivisionError" in bad["error"] and bad["level"] == "ERROR"
    assert logging.getLogger("quantloom." + __name__).propagate is False


def test_command_line_over_tables(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(backtest, "HORIZON", 3)  # two windows of a few years of months have no 63 months to come
    monkeypatch.setattr(backtest, "DECAY_HORIZON", 6)
    out, audit = tmp_path / "r.json", tmp_path / "a.jsonl"
    given = ["--provider", "tables", "--folder", small, "--start", "1996-01-01", "--end", "2001-12-31", "--score-every", "1", "--out", str(out), "--audit", str(audit)]
    result = cli.run(spark, cli.arguments(given))
    assert isinstance(result["passed"], bool) and verify_artifact(out) and AuditLog(audit).verify()
    both = cli.run(spark, cli.arguments([*given, "--oos", "--embargo-days", "40"]))
    assert set(both) == {"train", "test"} and json.loads(out.read_text()).keys() == {"train", "test"}
    with pytest.raises(SystemExit):
        cli.arguments(["--start", "1996-01-01"])


def test_vendor_login_comes_from_the_settings(spark, monkeypatch):
    a = cli.arguments(["--provider", "vendor", "--prices-url", "https://vendor.example/p", "--start", "2024-01-01", "--end", "2024-02-01"])
    monkeypatch.delenv("QUANTLOOM_VENDOR_USER", raising=False)
    with pytest.raises(ValueError, match="QUANTLOOM_VENDOR_USER, QUANTLOOM_VENDOR_KEY"):
        cli.source_of(spark, a)
    monkeypatch.setenv("QUANTLOOM_VENDOR_USER", "me")
    monkeypatch.setenv("QUANTLOOM_VENDOR_KEY", "secret")
    assert cli.source_of(spark, a).feed.headers["Authorization"] == Feed.with_login("me", "secret").headers["Authorization"]


def test_each_window_has_its_own_pin(spark, small, monkeypatch):
    monkeypatch.setattr(backtest, "HORIZON", 3)
    monkeypatch.setattr(backtest, "DECAY_HORIZON", 6)
    asked = []

    class Spy(TableProvider):
        def prices(self, tickers, start, end):
            asked.append(("prices", start, end))
            return super().prices(tickers, start, end)

        def fundamentals(self, tickers, start, end):
            asked.append(("fundamentals", start, end))
            return super().fundamentals(tickers, start, end)

    split = stats.train_test_split(dt.date(1996, 1, 1), dt.date(2001, 12, 31))
    backtest.provider_train_test(Spy(spark, small), None, split, score_every=1)
    assert [(m, end) for m, _, end in asked] == [("prices", split.train[1]), ("fundamentals", split.train[1]), ("prices", split.test[1]), ("fundamentals", split.test[1])]
    assert asked[1][1] == split.train[0] - dt.timedelta(days=550)
