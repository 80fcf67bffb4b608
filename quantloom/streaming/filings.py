"""Streams of dated records: late data by watermark, first filing wins, windowed activity."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_table(spark: SparkSession, folder: str, file: str, schema: T.StructType) -> DataFrame:
    """A stream over the files of one table."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def first_filings(stream: DataFrame, keys: Sequence[str], at: str, lateness: str = "30 days") -> DataFrame:
    """The first arrival of each key; repeats within the watermark are dropped, so amendments don't rewrite history."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))


def activity(stream: DataFrame, at: str, kind: str, value: str, width: str = "1 day", lateness: str = "30 days") -> DataFrame:
    """Rows and summed values per tumbling window and kind."""
    return (
        stream.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
    )


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what is there now and return it; each batch is written to the shared folder, none held by the driver.

    A batch that is tried again replaces what its first try wrote.
    """
    from quantloom.sources.storage import shared_folder

    spark = stream.sparkSession
    where = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    done: set[int] = set()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out" if mode == "complete" else f"{where}/out/batch={number}")
        done.add(number)

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{where}/out").select(*stream.columns)
