"""Exact deduplication by a Golomb-coded fingerprint exchange.

Every partition sends, to each owner of a hash range, the sorted fingerprints of its texts as a
Golomb-Rice coded set. Owners answer each partition with a bitmap of the fingerprints that occur
more than once. Only these suspects' texts are shuffled, grouped by their bytes and so verified.

Defined results: a null text counts as empty; texts are equal when they are identical once the
white space of ``[\\x20\\x09-\\x0D]`` is deleted; in a group the row with most code points in
its original text stays, then the smallest doc_id (null ids last). Repeated rows with one doc_id
share its fate here, while ``drop_exact_copies`` leaves one row of a group. Tables may be empty and may carry any further columns, which are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.frames import materialize, one_row_each, owner_count
from quantloom.llm.golomb import decode, encode

#: Bits of a fingerprint; false suspects are sorted out by their bytes.
FINGERPRINT_BITS = 48
#: A chunk is what a task sends at once.
CHUNK_ROWS = 200_000
#: Rows whose fingerprints an owner holds, about.
OWNER_ROWS = 500_000
#: Groups of over 1/HOT_GROUPS of all rows, fewer than HOT_GROUPS, are sent to their rows instead of these to one task.
HOT_GROUPS = 1_000

_WHITE = b" \t\n\x0b\x0c\r"
_SENT = (
    "kind byte, chunk string, owner int, slot int, doc_id long, text_key long, n_points long, digest binary, "
    "n int, rice int, quotients binary, remainders binary, repeated binary"
)


def normalized(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _sender(owners: int, chunk_rows: int):
    span = 1 << FINGERPRINT_BITS
    edges = [(i * span + owners - 1) // owners for i in range(owners + 1)]

    def chunk_out(name: str, ids: list, keys: list, points: list, digests: list) -> Iterator[pa.RecordBatch]:
        prints = np.array([int.from_bytes(d[: FINGERPRINT_BITS // 8], "big") for d in digests], np.int64)
        unique, back, count = np.unique(prints, return_inverse=True, return_counts=True)
        owner = np.searchsorted(np.array(edges[1:], np.int64), unique, side="right")
        first = np.searchsorted(owner, np.arange(owners + 1))
        slot = np.arange(len(unique)) - first[owner]
        n = len(ids)
        none = pa.nulls
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.zeros(n, np.int8)), pa.array([name] * n), pa.array(owner[back].astype(np.int32)), pa.array(slot[back].astype(np.int32)),
                pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(points, pa.int64()), pa.array(digests, pa.binary()),
                none(n, pa.int32()), none(n, pa.int32()), none(n, pa.binary()), none(n, pa.binary()), none(n, pa.binary()),
            ],
            names=_NAMES,
        )
        rows = []
        for o in np.unique(owner).tolist():
            a, b = first[o], first[o + 1]
            k, quotients, remainders = encode(unique[a:b] - edges[o], edges[o + 1] - edges[o])
            rows.append((o, b - a, k, quotients, remainders, np.packbits(count[a:b] > 1).tobytes()))
        m = len(rows)
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(m, np.int8)), pa.array([name] * m), pa.array(cols[0], pa.int32()), none(m, pa.int32()), none(m, pa.int64()), none(m, pa.int64()),
                none(m, pa.int64()), none(m, pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[3:]),
            ],
            names=_NAMES,
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sent = TaskContext.get(), 0
        ids, keys, points, digests = [], [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            keys += batch.column("text_key").to_pylist()
            for text in batch.column("text"):
                text = text.as_py() or ""
                points.append(len(text))
                digests.append(hashlib.sha256(text.encode().translate(None, _WHITE)).digest())
            if len(ids) >= chunk_rows:
                yield from chunk_out(f"{task.partitionId()}-{sent}", ids, keys, points, digests)
                sent, (ids, keys, points, digests) = sent + 1, ([], [], [], [])
        if ids:
            yield from chunk_out(f"{task.partitionId()}-{sent}", ids, keys, points, digests)

    return send


_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _answer(group: pa.Table) -> pa.Table:
    """One owner's fingerprints from all chunks -> a bitmap of repeated ones for each chunk."""
    rows = group.to_pylist()
    sets = [decode(r["n"], r["rice"], r["quotients"], r["remainders"]) for r in rows]
    again = [np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]).astype(bool) for r in rows]
    unique, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = count > 1
    many[back[np.concatenate(again)]] = True
    flags, out, begin = many[back], [], 0
    for r in rows:
        bits = np.packbits(flags[begin : begin + r["n"]], bitorder="little")
        out.append(np.pad(bits, (0, -len(bits) % 8)).view(np.int64))
        begin += r["n"]
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows]), "owner": pa.array([r["owner"] for r in rows], pa.int32()),
        "bitmap": pa.array(out, pa.list_(pa.int64())),
    })


def exact_groups(documents: DataFrame, owners: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, text_key, keep_id, group_size, kept and text_sha256 of every row of ``documents`` (doc_id, text)."""
    total = documents.count()
    owners = owners or owner_count(total, OWNER_ROWS)
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sent = materialize(docs.mapInArrow(_sender(owners, chunk_rows), _SENT))
    answers = (
        sent.where("kind = 1").select("chunk", "owner", "n", "rice", "quotients", "remainders", "repeated")
        .groupBy("owner").applyInArrow(_answer, "chunk string, owner int, bitmap array<long>")
    )
    marked = (
        sent.where("kind = 0").select("chunk", "owner", "slot", "doc_id", "text_key", "n_points", "digest")
        .join(answers, ["chunk", "owner"])
        .withColumn("suspect", F.expr("shiftrightunsigned(bitmap[slot div 64], slot % 64) & 1") == 1)
        .select("doc_id", "text_key", "n_points", F.lower(F.hex("digest")).alias("text_sha256"), "suspect")
    )
    marked = materialize(marked)
    suspects = marked.where("suspect")
    wanted = suspects.select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key")).distinct()
    verified = materialize(
        docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key")), "left_semi")
        .groupBy(normalized(F.col("text")).alias("bytes"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"))
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
        .select(F.sha2("bytes", 256).alias("text_sha256"), "n_points", "n", "first_id")
        .groupBy("text_sha256")
        .agg(F.sum("n").alias("group_size"), F.max_by("first_id", F.struct("n_points", -F.coalesce("first_id", F.lit(2**63 - 1)))).alias("keep_id"))
    )
    large = F.col("group_size") > max(1, total // HOT_GROUPS)
    hot = F.broadcast(verified.where(large))  # fewer than ``HOT_GROUPS`` rows
    rest = suspects.join(hot, "text_sha256", "left_anti").join(verified.where(~large), "text_sha256", "left")
    found = suspects.join(hot, "text_sha256").unionByName(rest).select("doc_id", "text_key", "keep_id", "group_size", "text_sha256")
    alone = marked.where("not suspect").select("doc_id", "text_key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    return found.unionByName(alone).select("doc_id", "text_key", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(documents: DataFrame, owners: int | None = None) -> DataFrame:
    """One row of each group of ``documents``, with their columns as they were; of rows with one id the longest original stays."""
    return one_row_each(documents, materialize(exact_groups(documents, owners).select("doc_id", "text_key", "kept", F.col("text_sha256").alias("grp"))))
