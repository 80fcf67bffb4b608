"""Every query with an SQL twin gives the same rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from quantloom.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(small, t)}.parquet')")
    return con


def canon(rows):
    return sorted(tuple("" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = df.select(*columns).collect()
    wanted = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert canon(map(tuple, found)) == canon(wanted)
