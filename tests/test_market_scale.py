"""Tables from lines are dealt over more partitions the more lines there are, and links are those of tickers."""

import duckdb
import pytest

from quantloom.queries import ORACLE_SQL, QUERIES
from quantloom.sources import market


@pytest.mark.parametrize("made", [market.ownership, lambda s, d: market.bars(s, d, "week")])
def test_partitions_grow_with_the_lines(spark, small, monkeypatch, made):
    assert market.parts_for(10_000_000, spark) == 20
    monkeypatch.setattr(market, "parts_for", lambda *_: 13)
    assert made(spark, small).rdd.getNumPartitions() == 13


def test_links_of_suppliers_that_share_a_ticker(spark, tmp_path):
    con = duckdb.connect()
    con.execute("""COPY (SELECT i AS l_orderkey, i % 7 AS l_partkey, CASE i % 4 WHEN 0 THEN 123450 + i % 5 WHEN 1 THEN 12345 WHEN 2 THEN i % 11 ELSE 200000 + 10 * (i % 3) END AS l_suppkey, 1 AS l_linenumber, 1.0 AS l_quantity,
        1.0 AS l_extendedprice, 0.0 AS l_discount, 0.0 AS l_tax, 'R' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1998-01-01' AS l_shipdate FROM range(300) t(i)) TO '""" + f"{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    found = QUERIES["links"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL['links']})").fetchall()
    assert want and sorted(map(tuple, found.collect())) == sorted(want)
