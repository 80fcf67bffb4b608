"""Rolling factors of a stream equal those of the batch."""

import pytest
from pyspark.sql import functions as F

from quantloom.plans import compiler
from quantloom.plans.dsl import parse
from quantloom.sources import market
from quantloom.streaming.filings import run_to_end
from quantloom.streaming.rolling import Rolling, rolling


@pytest.mark.parametrize("kind", ["ts_mean", "ts_std"])
def test_stream_equals_batch(spark, small, tmp_path, kind):
    bars = market.bars(spark, small).where("date < '1998-06-01'")
    dense = compiler.panel(bars).select("date", "ticker", "close")
    days = [r["date"] for r in dense.select("date").distinct().orderBy("date").collect()]
    for k in range(0, len(days), 10):  # a file, and a batch, for each ten days
        dense.where(F.col("date").isin(days[k : k + 10])).withColumnRenamed("close", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:04d}")
    stream = spark.readStream.schema("date date, ticker string, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(r["date"], r["ticker"]): r["value"] for r in run_to_end(rolling(stream, kind, 3), "append").collect()}
    batch = compiler.evaluate(compiler.panel(bars), {"x": parse(f"({kind} close 3)")}).select("date", "ticker", "x").collect()
    assert len(got) == len(batch) and any(r["x"] is not None for r in batch) and any(r["x"] is None for r in batch)
    for r in batch:
        value = got[r["date"], r["ticker"]]
        assert (value is None) == (r["x"] is None) and (value is None or abs(value - r["x"]) <= 1e-9 * max(1, abs(r["x"])))


def test_windows_are_checked():
    with pytest.raises(ValueError, match="window must be at least 1"):
        Rolling("ts_mean", 0)
