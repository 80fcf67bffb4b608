"""Cross-section and statistics building blocks as Spark columns.

Missing values are NULL throughout. Standard deviations come in two kinds: cross-section z-scores use the
population, factor-language operators and return statistics the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

By = str | Sequence[str]


def _cols(by: By) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def zscore(x: str, by: By) -> Column:
    """(x - mean) / population deviation; 0 for fewer than two values or when all are equal."""
    w = W.partitionBy(*_cols(by))
    flat = (F.count(x).over(w) < 2) | (F.min(x).over(w) == F.max(x).over(w))
    return F.when(flat, 0.0).otherwise((F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)))


def with_zscore(df: DataFrame, x: str, name: str) -> DataFrame:
    """``df`` with the z-score of ``x`` over all its rows, from one aggregate row instead of a window in one task."""
    whole = df.agg(F.count(x).alias("__n"), F.min(x).alias("__low"), F.max(x).alias("__high"), F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__dev"))
    z = F.when((F.col("__n") < 2) | (F.col("__low") == F.col("__high")), 0.0).otherwise((F.col(x) - F.col("__mean")) / F.nullif(F.col("__dev"), F.lit(0.0)))
    return df.crossJoin(F.broadcast(whole)).withColumn(name, z).drop("__n", "__low", "__high", "__mean", "__dev")


def average_rank(x: str, by: By) -> Column:
    """1-based ranks; ties share their mean rank."""
    by = _cols(by)
    return F.rank().over(W.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(*by, x)) - 1) / F.lit(2.0)


def rank01(x: str, by: By) -> Column:
    """Average rank scaled to [0, 1]; 0.5 for a single value."""
    n = F.count(F.lit(1)).over(W.partitionBy(*_cols(by)))
    return F.when(n < 2, 0.5).otherwise((average_rank(x, by) - 1) / F.nullif(n - 1, F.lit(0)))


def demeaned(x: str, by: By) -> Column:
    return F.col(x) - F.avg(x).over(W.partitionBy(*_cols(by)))


def pearson(x: str, y: str) -> Column:
    """Aggregate correlation; NULL (not an error) when a side has no variance or there are under two pairs."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (F.count(F.lit(1)) < 2)
    return F.when(~flat, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def rank_correlation(pairs: DataFrame, x: str, y: str, by: By, min_n: int = 5) -> DataFrame:
    """Spearman correlation of x and y per group: by, n, rho. Groups under ``min_n`` or without variance are left out."""
    by = _cols(by)
    ranked = pairs.select(*by, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    rho = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("rx", "ry").alias("rho"))
    return rho.where((F.col("n") >= min_n) & F.col("rho").isNotNull())


def score_table(df: DataFrame, raw: str, name: str, version: str, inputs: Sequence[str], by: By = "date") -> DataFrame:
    """``df`` as signal scores: raw_score and rank_score (average-rank [0, 1]), stamped with signal, version and inputs."""
    scored = df.withColumn("raw_score", F.col(raw)).withColumn("rank_score", rank01("raw_score", by))
    return scored.withColumns({"signal": F.lit(name), "version": F.lit(version), "inputs": F.array(*map(F.lit, inputs)).cast("array<string>")})
