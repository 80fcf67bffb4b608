"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.frames import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; a root is one node of its component.

    In every round each node joins the neighbour that comes first in a pseudo-random order (or stays, if it comes
    first itself), and edges are drawn between what the nodes joined. Stars, which leaders make, take two
    rounds; on paths the expected number of nodes with edges falls by a constant factor. Every round is
    written to the shared folder. No edges give no rows.
    """
    left = materialize(edges.select("a", "b").where("a <> b").distinct())
    out, rounds = left.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("m"))
        joined = materialize(first.select(F.col("a").alias("node"), F.when(F.xxhash64("a") <= F.xxhash64("m"), F.col("a")).otherwise(F.col("m")).alias("root")))
        rounds.append(joined)
        ends = left.join(joined.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(joined.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = materialize(ends.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
    if rounds:

        def follow(have: DataFrame, then: DataFrame) -> DataFrame:
            return have.join(then.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))

        out = materialize(reduce(follow, rounds).where("node <> root"))
    return out
