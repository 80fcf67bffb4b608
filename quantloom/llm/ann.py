"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the normalised vectors are quantised separately; a pair of centroids is a cell.
A query walks the cells by the sum of its distances to the two centroids, with a heap, until the
cells hold a share of all entries; those entries are reranked by their exact cosine on the
original vectors in double precision. The share is what pilot queries need within the sample for
``TARGET_RECALL``: small where vectors have near neighbours, large where they have none. Neighbours are nearer in the
whole table than in a sample of it, so its recall is the target or more.

Identical vectors are one entry with their smallest ids (as many as a result can hold), so a vector
that very many rows share costs no more than another. Entries are dealt to groups of about
``GROUP_ENTRIES``, large cells over several groups; a group keeps only each query's best.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part;
every length of vectors has its own index; ties go to the smaller vec_id; fewer candidates
than asked for give fewer rows; an empty table gives none. Of rows that repeat an id the one with the least vector
(in the order of arrays) stands for the id. Further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.frames import materialize

#: Entries that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Recall that the walk's length is fitted to, by so many of the sample's vectors, searched by brute force in the sample.
TARGET_RECALL = 0.95
PILOT = 256
GROUP_ENTRIES = 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids from a seeded start."""
    rng = np.random.default_rng(5)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


class MultiIndex:
    """The centroids of both halves, and how many entries each cell holds."""

    def __init__(self, sample: np.ndarray, k: int):
        self.width, self.half = sample.shape[1], sample.shape[1] // 2
        self.left, self.right = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)
        self.counts = np.zeros(len(self.left) * len(self.right), np.int64)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = ((x[:, : self.half], self.left), (x[:, self.half :], self.right))
        return tuple((p**2).sum(1)[:, None] + (c**2).sum(1) - 2 * p @ c.T for p, c in parts)

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.distances(x)
        return one.argmin(1) * len(self.right) + two.argmin(1)

    def needed_share(self, x: np.ndarray, k: int, recall: float = TARGET_RECALL, pilot: int = PILOT) -> float:
        """The share of the vectors ``x`` that walks must hold for so many of the ``k`` nearest of the first ``pilot`` ones."""
        if len(x) < 2:
            return 1.0
        cell = self.cells(x)
        counts = np.bincount(cell, minlength=len(self.counts))
        one, two = self.distances(x[:pilot])
        shares = []
        for i in range(len(one)):
            cosine = x @ x[i]
            cosine[i] = -np.inf
            near = np.argpartition(-cosine, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
            order = np.argsort((one[i][:, None] + two[i]).ravel(), kind="stable")
            reached = np.empty(len(order))
            reached[order] = np.cumsum(counts[order]) / len(x)
            shares.append(reached[cell[near]])
        return float(np.quantile(np.concatenate(shares), recall))

    def walk(self, one: np.ndarray, two: np.ndarray, want: float) -> list[int]:
        """Cells by summed distance until they hold ``want`` entries: a heap over the sorted distances' grid."""
        a, b = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
        d, e = one[a].tolist(), two[b].tolist()
        heap, out, have, width = [(d[0] + e[0], 0, 0)], [], 0, len(b)
        while heap and have < want:
            _, i, j = heapq.heappop(heap)
            cell = a[i] * width + b[j]
            if self.counts[cell]:
                out.append(cell)
                have += int(self.counts[cell])
            if j + 1 < width:
                heapq.heappush(heap, (d[i] + e[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (d[i + 1] + e[0], i + 1, 0))
        return out


def _thin(keep: int):
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the rows of a batch with the same vector, the ``keep`` smallest ids."""
        for batch in batches:
            order = np.argsort(batch.column("vec_id").to_numpy(), kind="stable")
            seen: dict[int, int] = {}
            stay = []
            for i, h in zip(order.tolist(), batch.column("h").to_numpy()[order].tolist(), strict=True):
                seen[h] = seen.get(h, 0) + 1
                if seen[h] <= keep:
                    stay.append(i)
            yield batch.take(pa.array(stay, pa.int64()))

    return thin


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 5, share: float | None = None, group_entries: int = GROUP_ENTRIES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest rows found for every row of ``queries``, itself left out.

    Both tables hold vec_id and embedding; queries are rows of ``embeddings``.
    """
    spark = embeddings.sparkSession
    sound = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    one = F.min("embedding").alias("embedding")
    rows = embeddings.where("vec_id is not null").where(sound).groupBy("vec_id").agg(one).select("vec_id", "embedding", F.xxhash64("embedding").alias("h"))
    asking = queries.where("vec_id is not null").where(sound).groupBy("vec_id").agg(one)
    # A query is answered among the vectors of its length; each length has its own index.
    widths = sorted(r[0] for r in asking.select(F.size("embedding")).distinct().collect())
    found = [_nearest_of(rows.where(F.size("embedding") == w), asking.where(F.size("embedding") == w), w, k, share, group_entries, sample) for w in widths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _nearest_of(rows: DataFrame, queries: DataFrame, width: int, k: int, share: float | None, group_entries: int, sample: int) -> DataFrame:
    """``nearest`` over sound vectors of one length."""
    thin = rows.mapInArrow(_thin(k + 1), rows.schema)
    entries = materialize(
        thin.groupBy("h", "embedding").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids")).select("h", "embedding", "ids", F.col("ids")[0].alias("entry"))
    )
    total = entries.count()
    asked = materialize(
        queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.xxhash64("embedding").alias("h"))
        .distinct().join(entries.select("h", "embedding", "entry"), "h").where("q = embedding").select("query_id", "entry")
    )
    searched = entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "embedding")
    n_queries = searched.count()

    fit = entries.orderBy(F.xxhash64("entry")).limit(sample).select("embedding").toArrow()  # at most ``sample`` rows
    fitted = unit(_matrix(fit.column(0), width))
    index = MultiIndex(fitted, max(2, round(2 * total**0.25)))
    wanted = max((index.needed_share(fitted, k) if share is None else share) * total, k + 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = index.cells(unit(_matrix(batch.column("embedding"), width)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    kind = f"entry long, embedding {entries.schema['embedding'].dataType.simpleString()}"
    placed = materialize(entries.select("entry", "embedding").mapInArrow(assign, f"{kind}, cell int"))
    for r in placed.groupBy("cell").count().collect():  # about 4 sqrt(total) rows
        index.counts[r["cell"]] = r["count"]
    first = np.append(0, np.cumsum(index.counts))
    q_blocks = max(1, -(-n_queries // group_entries))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each entry to its group: a cell's entries are spread evenly over the groups that its range meets."""
        for batch in batches:
            cell, entry = batch.column("cell").to_numpy(), batch.column("entry").to_numpy()
            spread = (entry.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.int64) % np.maximum(index.counts[cell], 1)
            group = (first[cell] + spread) // group_entries
            yield pa.RecordBatch.from_arrays([pa.array(group), *batch.columns], names=["g", *batch.schema.names])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to the groups of the cells that it walks."""
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = index.distances(unit(_matrix(batch.column("embedding"), width)))
            g, b, row, cells = [], [], [], []
            for i, entry in enumerate(batch.column("entry").to_pylist()):
                by_group: dict[int, list[int]] = {}
                for cell in index.walk(one[i], two[i], wanted):
                    for group in range(int(first[cell]) // group_entries, (int(first[cell + 1]) - 1) // group_entries + 1):
                        by_group.setdefault(group, []).append(cell)
                for group, own in by_group.items():
                    g.append(group), b.append(entry % q_blocks), row.append(i), cells.append(own)
            picked = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(b, pa.int64()), *picked.columns, pa.array(cells, pa.list_(pa.int32()))], names=["g", "b", *picked.schema.names, "cells"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best entries of a group for each of its queries, by exact cosine."""
        query, entry, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            x, ids, cell = unit(_matrix(right.column("embedding"), width)), right.column("entry").to_numpy(), right.column("cell").to_numpy()
            q, names, walked = unit(_matrix(left.column("embedding"), width)), left.column("entry").to_numpy(), left.column("cells").to_pylist()
            for a in range(0, len(q), 256):
                cosine = q[a : a + 256] @ x.T
                for i, own in enumerate(cosine):
                    seen = np.zeros(len(index.counts), bool)
                    seen[walked[a + i]] = True
                    mine = np.flatnonzero(seen[cell])
                    if len(mine) > k + 1:
                        least = np.partition(own[mine], len(mine) - k - 1)[len(mine) - k - 1]
                        mine = mine[own[mine] >= least]
                    mine = mine[np.lexsort((ids[mine], -own[mine]))][: k + 1]
                    query.append(np.full(len(mine), names[a + i])), entry.append(ids[mine]), score.append(own[mine])
        return pa.table({"q_entry": np.concatenate(query), "entry": np.concatenate(entry), "score": np.concatenate(score)})

    routed = materialize(searched.mapInArrow(route, f"g long, b long, {kind}, cells array<int>"))
    # A group's entries go to the blocks of queries that ask for it, once to each.
    asks = routed.select(F.col("g").alias("group"), F.col("b").alias("block")).distinct()
    dealt = placed.mapInArrow(deal, f"g long, {kind}, cell int").join(asks, F.col("g") == F.col("group")).select("group", "block", "entry", "embedding", "cell")
    found = routed.groupBy("g", "b").cogroup(dealt.groupBy("group", "block")).applyInArrow(rerank, "q_entry long, entry long, score double")
    top = found.withColumn("n", F.row_number().over(W.partitionBy("q_entry").orderBy(F.desc("score"), "entry"))).where(F.col("n") <= k + 1)
    named = top.join(entries.select("entry", "ids"), "entry").select("q_entry", "score", F.explode("ids").alias("vec_id"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(named, asked["entry"] == named["q_entry"]).where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
