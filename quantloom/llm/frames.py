"""Helpers shared by the training-data operators: reading, materialising, Arrow text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Owners that a task of an exchange serves, about, and partitions that an exchange is never dealt to more than, but by the session.
OWNERS_A_TASK, MOST_PARTITIONS = 4, 50_000
#: Spark's setting by which a query's shuffle files are removed when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that the vectorised kernels take at a time; bounds the working set of a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole input table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage is cut, and no executor's loss repeats the work."""
    spark, path = df.sparkSession, _fresh_path(df.sparkSession)
    with _own_shuffles_removed(spark):
        df.write.parquet(path)
    return _read(spark, path, df.schema)


def materialize_parts(df: DataFrame, by: str, parts: int) -> list[DataFrame]:
    """``df`` written as one table for each of the numbers 0 to ``parts`` - 1 that its column ``by`` holds; the column is left out."""
    spark, path = df.sparkSession, _fresh_path(df.sparkSession)
    with _own_shuffles_removed(spark):
        df.write.partitionBy(by).parquet(path)
    for k in range(parts):  # a part without rows has no folder yet
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={k}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)
    return [_read(spark, f"{path}/{by}={k}", df.drop(by).schema) for k in range(parts)]


def joined_parts(parts: list[DataFrame]) -> DataFrame:
    """The rows of several written tables of one schema, as one."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(p.written_to for p in parts))


def _fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quantloom/{uuid.uuid4().hex}"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    written = spark.read.schema(schema).parquet(path)
    written.written_to = path
    return written


@contextmanager
def _own_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile is read from its table: its shuffles aren't needed again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)


def discard(*tables: DataFrame) -> None:
    """Remove what ``materialize`` has written for ``tables``, of which no plan may be run any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def owner_count(amount: int, most: int) -> int:
    """How many hash ranges an exchange is dealt to, so that each gets about ``most`` of the ``amount``; eight at least."""
    return max(8, -(-amount // most))


def dealt(rows: DataFrame, owner: str, owners: int) -> DataFrame:
    """``rows`` dealt by their owner, over more partitions the more owners there are; never over fewer than the session's."""
    session = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(session, min(owners // OWNERS_A_TASK, MOST_PARTITIONS)), owner)


#: A group of a larger share of the rows than one in so many is broadcast to them by ``join_groups``.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: Column, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups`` (one row each, ``size`` rows in it) so that no task gets the rows of a large group alone.

    Groups of over ``total`` / HOT_SHARE rows, fewer than HOT_SHARE of them, are broadcast to their rows; the others
    meet theirs by their key. ``how`` is inner or left_semi; ``on`` names columns of both, that differ.
    """
    large = F.col(size) > max(1, total // HOT_SHARE)
    return rows.join(F.broadcast(groups.where(large)), on, how).unionByName(rows.join(groups.where(~large), on, how))


def text_volume(documents: DataFrame) -> int:
    """Bytes of all texts."""
    return documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def crc_bucket(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text (a longer row stands alone)."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def one_row_each(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """One of the ``kept`` rows of each group, with the columns of ``documents``.

    ``groups`` holds doc_id, text_key (xxhash64 of the text), kept and grp; rows whose grp is null are
    groups of their own. Where several rows of a group are kept (repeated rows, one id for
    several texts, ids that are all null) the longest text stays, then the least text key and row hash.
    """
    same = documents["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(documents["text"]) == F.col("__key"))
    named = groups.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "kept", F.col("grp").alias("__grp"))
    crowded = named.where("kept and __grp is not null").groupBy("__grp").agg(F.count("*").alias("n")).where("n > 1").select("__grp")
    several = named.where("kept").join(crowded, "__grp").select("__id", "__key", "__grp").distinct()
    apart = named.where("not kept").select("__id", "__key").unionByName(several.select("__id", "__key")).distinct()
    hashed = [c for c, kind in documents.dtypes if "map<" not in kind and kind != "variant"]
    order = F.struct(-F.length(F.coalesce(documents["text"], F.lit(""))), "__key", F.xxhash64(*(documents[c] for c in hashed)))
    row = F.struct(*(documents[c] for c in documents.columns))
    chosen = documents.join(several, same).groupBy("__grp").agg(F.min_by(row, order).alias("row")).select("row.*")
    return documents.join(apart, same, "left_anti").unionByName(chosen)
