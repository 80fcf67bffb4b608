"""The miner's ICs of wide columns are those of the long scores, and a table's own shuffles go when it is written."""

import datetime as dt
import glob
import os
import random
import time

from pyspark.sql import functions as F

from quantloom.operators.core import daily_ic
from quantloom.plans.compiler import long_scores
from quantloom.plans.miner import wide_ics


def test_wide_ics_equal_long_ones(spark):
    rng = random.Random(4)
    days = [dt.date(2024, 1, k) for k in range(1, 7)]
    some = lambda: None if rng.random() < 0.3 else float(rng.randrange(6))
    rows = [(d, f"T{k}", some(), some(), some(), 1.0) for d in days for k in range(9 if d.day < 5 else 3)]
    table = spark.createDataFrame(rows, "date date, ticker string, fwd double, e0 double, e1 double, e2 double")
    forward = table.where("fwd is not null").select("ticker", "date", "fwd")
    want = {(r["signal"], r["date"]): (r["n"], r["ic"]) for r in daily_ic(long_scores(table.drop("fwd"), ["e0", "e1", "e2"]), forward).collect()}
    got = {(r["signal"], r["date"]): (r["n"], r["ic"]) for r in wide_ics(table, ["e0", "e1", "e2"], 5).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_written_tables_leave_no_shuffles(spark):
    from quantloom.sources.storage import checkpointed

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {p for d in local for p in glob.glob(os.path.join(d, "*", "shuffle_*"))}
    before = held()
    made = checkpointed(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count())
    for _ in range(50):  # they go in the background
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert made.count() == 1000
