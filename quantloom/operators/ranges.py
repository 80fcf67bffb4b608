"""Order-dependent operators over groups of any size: rows are dealt by ranges of their order, and what crosses a border is carried between parts.

A window over a group puts all its rows into one task. Here a group's rows lie in as many parts as they need; within a part Spark's windows
do the work, and one row for each part tells what stood before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.sources.storage import checkpointed

#: Groups of a larger share of the rows than one in so many are broadcast to them.
HOT_SHARE = 1000
PART = "__part"


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and written, with the number of each row's part; equal keys lie in one part."""
    return checkpointed(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[f"__{c}"])
    return on


def attach(rows: DataFrame, groups: DataFrame, by: Sequence[str], size: str, total: int) -> DataFrame:
    """``rows`` joined (inner) to ``groups``, one row for each value of ``by``, with ``size`` rows each of ``total``.

    Groups of over ``total`` / HOT_SHARE rows, of which there are fewer than HOT_SHARE, are broadcast; the others meet their rows by key.
    """
    named = groups.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in groups.columns if c not in by))
    large = F.col(size) > max(1, total // HOT_SHARE)
    hot, rest = named.where(large), named.where(~large)
    # Rows of hot groups stay where they are; only the others are dealt.
    cold = rows.join(F.broadcast(hot), _same(rows, hot, by), "left_anti")
    both = rows.join(F.broadcast(hot), _same(rows, hot, by)).unionByName(cold.join(rest, _same(cold, rest, by)))
    return both.drop(*(f"__{c}" for c in by))


def lagged(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    """``df`` with ``out``: what ``column`` held in the row before, by ``order`` within ``by``. Orders must not repeat in a group."""
    placed = ranged(df, *by, *order)
    inner = W.partitionBy(*by, PART).orderBy(*order)
    last = placed.groupBy(*by, PART).agg(F.max_by(F.struct(F.col(column).alias("x")), F.struct(*order)).alias("last"))
    edges = last.select(*(F.col(c).alias(f"__{c}") for c in (*by, PART)), F.lag("last").over(W.partitionBy(*by).orderBy(PART)).alias("__edge"))
    numbered = placed.withColumns({out: F.lag(column).over(inner), "__first": F.row_number().over(inner) == 1})
    joined = numbered.join(edges, _same(numbered, edges, (*by, PART)))
    return joined.withColumn(out, F.when(F.col("__first"), F.col("__edge.x")).otherwise(F.col(out))).select(*df.columns, out)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """``df`` with the average rank (from 1, ties share their mean) of ``value`` within ``by``; NULLs have none and don't count."""
    df = checkpointed(df)
    known = df.where(F.col(value).isNotNull())
    placed = ranged(known.groupBy(*by, value).agg(F.count("*").alias("__n")), *by, value)
    parts = placed.groupBy(*by, PART).agg(F.sum("__n").alias("__m"))
    before = parts.select(*(F.col(c).alias(f"__{c}") for c in (*by, PART)), F.coalesce(F.sum("__m").over(W.partitionBy(*by).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    run = F.sum("__n").over(W.partitionBy(*by, PART).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranks = placed.join(before, _same(placed, before, (*by, PART))).select(*by, value, "__n", (F.col("__offset") + run - (F.col("__n") - 1) / 2.0).alias(out))
    ranks = checkpointed(ranks)
    total = ranks.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    found = attach(known, ranks, (*by, value), "__n", total).drop("__n")
    return found.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def as_of_buckets(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, columns: Sequence[str], days: int = 365) -> DataFrame:
    """``core.as_of_join`` for keys that hold a large share of the rows: its windows run within buckets of ``days``, and the last value
    before each bucket, one row for each key and bucket, is carried into it."""
    mark = F.struct(*(F.col(c) for c in columns))
    one = right.groupBy(key, right_on).agg(F.max(mark).alias("m")).select(F.col(key), F.col(right_on).alias("__t"), F.lit(0).alias("__side"), "m", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"))
    two = left.select(F.col(key), F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(one.schema["m"].dataType).alias("m"), F.struct("*").alias("__l"))
    bucket = F.floor(F.datediff("__t", F.lit("1970-01-01").cast("date")) / days)
    rows = checkpointed(one.unionByName(two).withColumn("__bucket", bucket))
    last = rows.groupBy(key, "__bucket").agg(F.max_by("m", F.when(F.col("__side") == 0, F.col("__t"))).alias("last"))
    carried = last.select(F.col(key).alias(f"__{key}"), F.col("__bucket").alias("____bucket"), F.last("last", ignorenulls=True).over(W.partitionBy(key).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    run = W.partitionBy(key, "__bucket").orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    filled = rows.withColumn("m", F.last("m", ignorenulls=True).over(run)).where("__side = 1")
    filled = filled.join(carried, _same(filled, carried, (key, "__bucket"))).withColumn("m", F.coalesce("m", "carried"))
    return filled.select("__l.*", *(F.col(f"m.{c}").alias(c) for c in columns))
