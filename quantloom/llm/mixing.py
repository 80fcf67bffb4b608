"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its share of the tokens raised to an exponent and normalised; the exponent (one
over the temperature) is bisected until the weights have a target entropy, or until no source is
repeated more often than a limit. Each source then gets a budget of tokens, which is realised as
whole passes over its documents and one cut pass. A pass is a pseudo-random permutation of the
source's documents, dealt in blocks of hash ranges: only the block in which the budget ends is
looked at document by document.

Defined results: tokens are runs of bytes other than ``[\\x20\\x09-\\x0D]``, none in a null text; a null source is a
source of its own; sources without tokens get no weight and no pass. Repeated rows are rows of their
own; those that repeat an id and its text are drawn together. An empty table gives no rows. In a cut pass documents are
taken in the pass's order for as long as they fit the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.frames import materialize

#: A pass deals its documents to 2^PLACE_BITS places; those are looked at in 2^BLOCK_BITS blocks, then that many blocks of one
#: of them, then document by document.
PLACE_BITS, BLOCK_BITS = 30, 11
#: Exponents that one pass over the shares tries; each pass narrows the interval by so much.
GRID = 32
PASSES = 6
#: No source may be repeated more often than this, on average over its documents.
REPETITION_LIMIT = 1.25


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_shares(tokens: DataFrame) -> DataFrame:
    """Tokens, documents and share of every source that has tokens (source, n_tokens)."""
    sums = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")).where("tokens > 0")
    total = sums.agg(F.sum("tokens").alias("total"))
    return sums.crossJoin(total).withColumn("share", F.col("tokens") / F.col("total"))


def find_exponent(shares: DataFrame, budget: int, target_entropy: float | None, repetition_limit: float | None) -> float:
    """The least exponent in [0, 1] that keeps the repetition limit, or the one that has the target entropy (in nats).

    Both fall as the exponent grows, the mean entropy and the largest repetition (weight over share);
    at 1 weights are the shares. An unreachable target gives the nearer end.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tries = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        powered = shares.select("share", "tokens", F.explode(F.array(*map(F.lit, tries))).alias("exponent")).withColumn("power", F.pow("share", "exponent"))
        found = (
            powered.groupBy("exponent")
            .agg(F.sum("power").alias("z"), F.sum(F.col("power") * F.log("power")).alias("e"), F.max(F.col("power") / F.col("tokens")).alias("r"))
            .select("exponent", (F.log("z") - F.col("e") / F.col("z")).alias("entropy"), (F.col("r") / F.col("z") * budget).alias("repetition"))
            .orderBy("exponent").collect()
        )  # fmt: skip  GRID + 1 rows
        if not found:
            return 1.0
        above = [x["exponent"] for x in found if (x["entropy"] > target_entropy + 1e-12 if target_entropy is not None else x["repetition"] > repetition_limit + 1e-12)]
        if not above:
            return low
        if max(above) >= high:
            return high
        i = tries.index(max(above))
        low, high = tries[i], tries[i + 1]
    return high


def mix(
    documents: DataFrame, budget: int | None = None, target_entropy: float | None = None, repetition_limit: float | None = REPETITION_LIMIT, seed: int = 0, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """The mixture: every row of ``documents`` as often as it is drawn, with all its columns.

    Added columns: mix_tokens, mix_weight (of its source), mix_epoch (which pass) and mix_order (its
    place in the mixture, from 0 to 1: sorted by it, every stretch holds the sources by their weights).
    ``budget`` is in tokens, by default as many as the documents have. Further columns may have any names; one that is
    called like an added column is replaced by it.
    """
    own = [c for c in documents.columns if c.lower() not in ("mix_tokens", "mix_weight", "mix_epoch", "mix_order")]
    row = F.struct(*(documents[c] for c in own)).alias("__row")
    draw = F.pmod(F.xxhash64(F.lit(seed), documents["doc_id"], documents["text"]), F.lit(2**62)).alias("__draw")
    facts = materialize(documents.select(documents["source"].alias("source"), n_tokens(documents["text"]).alias("n_tokens"), draw))
    shares = materialize(source_shares(facts))
    budget = budget if budget is not None else int(shares.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    exponent = find_exponent(shares, budget, target_entropy, repetition_limit)
    total = shares.agg(F.sum(F.pow("share", F.lit(exponent))).alias("z"))
    weights = materialize(
        shares.crossJoin(total)  # one row
        .withColumn("weight", F.pow("share", F.lit(exponent)) / F.col("z"))
        .withColumn("repeats", F.col("weight") * budget / F.col("tokens"))
        .select(
            F.col("source").alias("w_source"), "weight", "repeats", F.floor("repeats").cast("int").alias("passes"),
            F.floor(F.col("weight") * budget - F.floor("repeats") * F.col("tokens")).cast("long").alias("rest"),
        )
    )

    def place(epoch: Column) -> Column:
        """The document's place in a pass, from 0 to 2^PLACE_BITS - 1."""
        return F.pmod(F.xxhash64("__draw", epoch), F.lit(1 << PLACE_BITS))

    # The cut pass: the block in which the budget ends is found digit by digit, 2^block_bits blocks of a source at a time.
    cut = facts.join(weights.select("w_source", "passes", "rest"), F.expr("source <=> w_source")).select("w_source", "rest", "n_tokens", "__draw", place(F.col("passes")).alias("at"))
    edge = weights.select(F.col("w_source").alias("e_source"), F.lit(0).cast("long").alias("e_block"), F.lit(0).cast("long").alias("e_before"))
    shift = PLACE_BITS
    while shift > PLACE_BITS - 2 * block_bits:
        inside = cut.join(edge, F.expr(f"w_source <=> e_source and shiftright(at, {shift}) = e_block"))
        shift -= block_bits
        sums = inside.groupBy("w_source", "rest", "e_before", F.shiftright("at", shift).alias("block")).agg(F.sum("n_tokens").alias("tokens"))
        earlier = F.sum("tokens").over(W.partitionBy("w_source").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
        found = sums.withColumn("before", F.col("e_before") + F.coalesce(earlier, F.lit(0))).where("before <= rest and before + tokens > rest")
        edge = materialize(found.select(F.col("w_source").alias("e_source"), F.col("block").alias("e_block"), F.col("before").alias("e_before")))
    inside = cut.join(edge, F.expr(f"w_source <=> e_source and shiftright(at, {shift}) = e_block"))
    drawn = inside.groupBy("w_source", "rest", "e_before", "at", "__draw").agg(F.sum("n_tokens").alias("tokens"))  # repeated rows are drawn together
    running = F.col("e_before") + F.sum("tokens").over(W.partitionBy("w_source").orderBy("at", "__draw"))
    last = drawn.withColumn("running", running).where("running <= rest").groupBy(F.col("w_source").alias("l_source")).agg(F.max(F.struct("at", "__draw")).alias("last"))
    limits = materialize(
        weights.join(edge, F.expr("w_source <=> e_source"), "left").join(last, F.expr("w_source <=> l_source"), "left")
        .select("w_source", "weight", "repeats", "passes", "e_block", F.col("last.at").alias("last_at"), F.col("last.__draw").alias("last_draw"))
    )
    held = documents.select(row, n_tokens(documents["text"]).alias("mix_tokens"), draw)
    drawn = held.join(limits, F.expr("__row.source <=> w_source")).withColumn("at", place(F.col("passes"))).withColumn("block", F.shiftright("at", shift))
    # A source whose rest covers a whole pass up to rounding has no edge: then no block cuts it.
    more = F.when(F.col("e_block").isNull(), F.lit(True)).when(F.col("block") != F.col("e_block"), F.col("block") < F.col("e_block"))
    more = more.otherwise(F.coalesce(F.struct("at", F.col("__draw").alias("draw")) <= F.struct(F.col("last_at").alias("at"), F.col("last_draw").alias("draw")), F.lit(False)))
    times = F.col("passes") + F.when(more, 1).otherwise(0)
    return (
        drawn.withColumn("times", times).where("times > 0")
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
        .select(
            "__row.*", "mix_tokens", F.col("weight").alias("mix_weight"), "mix_epoch",
            ((F.col("mix_epoch") + place(F.col("mix_epoch")) / F.lit(float(1 << PLACE_BITS))) / F.greatest("repeats", F.lit(1e-12))).alias("mix_order"),
        )
    )


def entropy_of(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)
