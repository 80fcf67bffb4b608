"""Rolling factors kept up by a stream: each ticker's last slots are its state, so a new bar costs its window and not its history."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantloom.sources.storage import checkpointed, shared_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SLOT = T.StructType([T.StructField("date", T.DateType()), T.StructField("value", T.DoubleType())])
OUT = T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), T.StructField("value", T.DoubleType())])


def _mean(values: list[float]) -> float:
    return math.fsum(values) / len(values)


def _deviation(values: list[float]) -> float:
    """Of a sample; 0 for one value."""
    middle = _mean(values)
    return math.sqrt(math.fsum((v - middle) ** 2 for v in values) / (len(values) - 1)) if len(values) > 1 else 0.0


KINDS = {"ts_mean": _mean, "ts_std": _deviation, "ts_min": min, "ts_max": max}


class Rolling(StatefulProcessor):
    """A full trailing window of a ticker's slots; a missing value in it gives a missing result.

    Slots come in the order of their days from batch to batch; within a batch they are sorted. A slot whose day isn't later than the last one
    seen is a repeat or late, and is left out.
    """

    def __init__(self, kind: str, window: int):
        if window < 1:
            raise ValueError(f"{kind}: window must be at least 1, got {window}")
        self.kind, self.window = kind, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getListState("slots", _SLOT)

    def handleInputRows(self, key, rows: Iterator[Row], timer) -> Iterator[Row]:  # noqa: N802
        held = [(s[0], s[1]) for s in self.slots.get()]
        fresh = False
        for day, value in sorted(((r["date"], r["value"]) for r in rows), key=lambda s: s[0]):
            if held and day <= held[-1][0]:
                continue
            held = [*held[1 - self.window :], (day, value)] if self.window > 1 else [(day, value)]
            fresh = True
            full = len(held) == self.window and all(v is not None for _, v in held)
            yield Row(date=day, ticker=key[0], value=float(KINDS[self.kind]([v for _, v in held])) if full else None)
        if fresh:
            self.slots.put(held)

    def close(self) -> None:
        pass


def rolling(stream: DataFrame, kind: str, window: int) -> DataFrame:
    """date, ticker, value of ``kind`` over the last ``window`` slots of a stream of panel slots (date, ticker, value)."""
    stream.sparkSession.conf.set(STATE_STORE, ROCKS)
    return stream.select("date", "ticker", "value").groupBy("ticker").transformWithState(Rolling(kind, window), OUT, "Append", "None")


def replayed(slots: DataFrame, days: Sequence[str]) -> DataFrame:
    """A stream of ``slots``, cut into batches at ``days``: what is before the first, from it to the second, and so on."""
    spark, folder = slots.sparkSession, f"{shared_folder(slots.sparkSession)}/replays/{uuid.uuid4().hex}"
    slots = checkpointed(slots)
    for k, (begin, end) in enumerate(zip(["0001-01-01", *days], [*days, "9999-12-31"], strict=True)):
        slots.where(f"date >= date'{begin}' and date < date'{end}'").coalesce(1).write.parquet(f"{folder}/{k:04d}")
    return spark.readStream.schema(slots.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
