"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.exact_dedup import drop_exact_copies
from quantloom.llm.frames import materialize, table
from quantloom.llm.mixing import mix
from quantloom.llm.near_dedup import drop_near_copies
from quantloom.llm.packing import pack
from quantloom.llm.registry import tokenizer_file
from quantloom.llm.toxicity import drop_toxic

#: No SQL expresses the learned filter, the pseudo-random mixture or the packing.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar (trained on the labelled rows among them) doesn't reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest original of each group of equal texts."""
    return drop_exact_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them. Packing places pieces by their lengths, so their order isn't kept."""
    return mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in training sequences."""
    return pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
