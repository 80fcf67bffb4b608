"""Lags, ranks and as-of joins over groups that no task holds whole; the registry's racing writers; the scan of a tree."""

import datetime as dt
import hashlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from quantloom.operators import core, lifecycle, ranges
from quantloom.sources.registry import Registry


@pytest.fixture
def parts(spark):
    """Many small ranges, as a large table would have."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def entries(n, chain="c"):
    out, before = [], None
    for k in range(n):
        body = f"{before}:{k}"
        digest = hashlib.sha256(body.encode()).hexdigest()
        out.append((chain, k, body, before, digest))
        before = digest
    return out


def test_one_long_chain_over_many_tasks(spark, parts):
    rows = entries(900) + entries(3, "d")
    rows[400] = (*rows[400][:2], "spoiled", *rows[400][3:])
    rows[701] = (*rows[701][:3], "x", rows[701][4])
    df = spark.createDataFrame(rows, "chain string, seq long, body string, prev_hash string, hash string").repartition(5)
    assert ranges.ranged(df, "chain", "seq").select(ranges.PART).distinct().count() > 5
    got, want = lifecycle.long_chain(df), lifecycle.chain(df)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert [(r["chain"], r["seq"]) for r in got.where("not ok").orderBy("seq").collect()] == [("c", 400), ("c", 701)]


def test_average_ranks_of_one_wide_day(spark, parts):
    rng = random.Random(1)
    rows = [(d, k, rng.choice([None, 1.0, 1.0, float(rng.randrange(40)), rng.random()])) for d, n in (("x", 700), (None, 30), ("y", 1)) for k in range(n)]
    got = ranges.average_ranks(spark.createDataFrame(rows, "d string, k int, v double"), ["d"], "v").collect()
    assert len(got) == len(rows)
    for r in got:
        own = [v for d, _, v in rows if d == r["d"] and v is not None]
        want = None if r["v"] is None else sum(v < r["v"] for v in own) + (sum(v == r["v"] for v in own) + 1) / 2
        assert r["rank"] == want


def test_bucketed_as_of_join_equals_the_plain_one(spark, parts):
    rng = random.Random(2)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(2000))
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = spark.createDataFrame([(key(), day(), k) for k in range(600)], "ticker string, date date, k int")
    right = spark.createDataFrame([(key(), day(), rng.random(), rng.choice([None, 1.0])) for _ in range(60)] + [("late", dt.date(2030, 1, 1), 1.0, 1.0)], "ticker string, report date, u double, v double")
    plain = core.as_of_join(left, right, "ticker", "date", "report", ["u", "v"])
    for days in (1, 30, 400, 5000):
        got = ranges.as_of_buckets(left, right, "ticker", "date", "report", ["u", "v"], days)
        assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


SCHEMA = "name string, seq long, status string, ic double"


def test_racing_writers_cannot_both_insert_a_name(spark, tmp_path):
    stores = [Registry(spark, str(tmp_path / "registry"), SCHEMA) for _ in range(4)]
    new = spark.createDataFrame([("alpha", 0.1)], "name string, ic double")
    gate, outcomes = threading.Barrier(4), []

    def write(store):
        gate.wait()
        try:
            outcomes.append(store.insert(new))
        except lifecycle.RegistryError as e:
            outcomes.append(str(e))

    threads = [threading.Thread(target=write, args=(s,)) for s in stores]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, outcomes)) == ["1"] + ["signal already registered: alpha"] * 3
    store = stores[0]
    assert store.advance("alpha", "VALIDATED") == 2 and store.update_metrics("alpha", ic=0.2) == 3
    with pytest.raises(lifecycle.RegistryError):
        store.advance("alpha", "PRODUCTION")
    now = lifecycle.require(store.events(), "alpha")
    assert (now["status"], now["ic"], now["seq"], store.version()) == ("VALIDATED", 0.2, 3, 3) and store.events(1).count() == 1


def test_a_commit_goes_on_from_what_others_wrote(spark, tmp_path):
    store = Registry(spark, str(tmp_path), SCHEMA)
    other = Registry(spark, str(tmp_path), SCHEMA)
    calls = []

    def change(events):
        if not calls:  # another writer comes between reading and writing
            calls.append(other.insert(spark.createDataFrame([("beta", 1.0)], "name string, ic double")))
        return lifecycle.insert(events, spark.createDataFrame([("gamma", 2.0)], "name string, ic double"))

    assert store.commit(change) == 2 and calls == [1]
    assert sorted(r["name"] for r in store.events().collect()) == ["beta", "gamma"]


CASES = (
    ("lib/x.py", "def f():\n    print('hi')\n", [("lib/x.py", 2, "print call")]),
    ("lib/y.py", "try:\n    pass\nexcept:\n    pass\n", [("lib/y.py", 3, "bare except")]),
    ("lib/z.py", "import os\r\nA = os.environ['X']\r\n", [("lib/z.py", 2, "environment access")]),
    ("lib/settings.py", "import os\nA = os.getenv('X')\n", []),
    ("lib/k.py", 'api_key = "abc123secret"\n', [("lib/k.py", 1, "credential literal")]),
    ("lib/operators/w.py", "from datetime import date\nCUTOFF = date.today()\n", [("lib/operators/w.py", 2, "wall clock")]),
    ("lib/plans/w.py", "from datetime import datetime\nNOW = datetime.now()\n", [("lib/plans/w.py", 2, "wall clock")]),
    ("lib/sources/w.py", "from datetime import datetime\nNOW = datetime.now()\n", []),
    ("lib/notes.txt", "print('not code')\n", []),
)


def test_scan_of_a_source_tree(spark, tmp_path):
    for path, code, _ in CASES:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(code.encode())
    got = sorted(tuple(r) for r in lifecycle.scan_tree(spark, str(tmp_path)).collect())
    assert got == sorted(f for *_, found in CASES for f in found)


def test_own_code_breaks_no_rule(spark):
    from conftest import ROOT

    found = lifecycle.scan_tree(spark, ROOT + "/quantloom").where(F.col("path") != "operators/lifecycle.py").collect()
    assert [tuple(r) for r in found if r["rule"] in ("bare except", "credential literal", "wall clock", "print call")] == []
