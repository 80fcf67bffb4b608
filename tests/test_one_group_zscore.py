"""The z-score over all rows needs no window, which would be one task."""

import statistics

from quantloom.operators import core


def test_tilt_has_no_window(spark):
    raw = [1.0, 2.0, 4.0, 9.0]
    scores = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(raw)], "ticker string, raw_score double")
    vols = spark.createDataFrame([(f"t{i}", 0.5) for i in range(4)], "ticker string, vol double")
    out = core.tilt(scores, vols)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {f"t{i}": (x - statistics.mean(raw)) / statistics.pstdev(raw) / 0.5 for i, x in enumerate(raw)}
    found = {r["ticker"]: r["weight"] for r in out.collect()}
    assert all(abs(found[k] - v) < 1e-9 for k, v in want.items())
    assert {r["weight"] for r in core.tilt(scores.limit(1), vols).collect()} == {0.0}
