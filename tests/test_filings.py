"""Streams of filings: the first of a key stays, batches that come again replace themselves, no files give no rows."""

import datetime as dt

from quantloom.streaming.filings import activity, first_filings, run_to_end

SCHEMA = "key string, at timestamp, value double"


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_first_filings_over_several_batches(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    for rows in ([("a", day(1), 1.0), ("a", day(2), 1.0), ("b", day(2), 2.0)], [("a", day(3), 1.0), ("c", day(3), 3.0)], [("b", day(4), 2.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path))
    found = run_to_end(first_filings(stream(spark, str(tmp_path)), ["key"], "at"), "append")
    assert found.columns == ["key", "at", "value"]
    assert sorted((r["key"], r["value"]) for r in found.collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    daily = run_to_end(activity(stream(spark, str(tmp_path)), "at", "key", "value"))
    assert sum(r["n"] for r in daily.collect()) == 6


def test_no_files(spark, tmp_path):
    found = run_to_end(first_filings(stream(spark, str(tmp_path)), ["key"], "at"), "append")
    assert found.count() == 0 and found.columns == ["key", "at", "value"]
