"""Repair of conversations' structure by Hirschberg's divide and conquer over a four-state automaton.

A sound conversation's role initials are ``(s?(ua)+)?``. The automaton's states are: nothing yet, ``s`` last, ``u`` last, ``a`` last; the
first and the last accept. Rows are kept (0), given the role that the state asks for (1), or deleted (2; blank rows and
duplicates must be); rows with the role that the state asks for are inserted (5); a truncated row that isn't deleted adds 5. For a run of
rows the forward vector holds, for each state after the first half, the least cost and the rank of its least edits
(no two are prefixes of each other, as edits of one row end with K, R or D); the backward vector the least cost from each state to the end.
They meet in the middle, the least optimal crossing is chosen, and both halves are solved between known states, so that no
table of the whole run is held.

The same crossing works between blocks. A block (at most ``BLOCK_ROWS`` rows or about ``BLOCK_BYTES``) is summarised by costs and
ranks from each state to each state; summaries are combined in groups of at most ``FAN`` until one is left for a
conversation, and the crossings are handed down again. Rows are sorted by ranges, so that a long conversation is dealt over many
tasks, and copies of a row are counted before they are sorted. Only the digest of a conversation's repaired text, which is
sequential, is computed by one task, as a stream.

Defined results: null ids, turns, roles and texts count as one space where they are written (ids and turns stay null in the result and in the order).
Rows of equal turns are ordered by their role and text after damage. Roles go by their first character; an empty role has none and
fits nowhere. A conversation's damage and order don't depend on how rows are dealt. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.frames import materialize

BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: Summaries that are combined at a time.
FAN = 1024
#: Groups (role and text within a conversation) of at least this share of the rows are broadcast to their rows; so fewer than 1,000.
HEAVY = 0.001
DROP, EMPTY, BARE, REPEAT, FORCE_USER = 0, 1, 2, 3, 4

# States (nothing, s, u, a), what each asks for, and the costs of edits.
ASKED = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}
#: Pairs of role initials that may stand next to each other.
LEGAL = ("su", "ua", "au")
NEVER = 1 << 60


@lru_cache(maxsize=None)
def steps(kind: str, cut: bool) -> tuple[tuple[int, int, int, str], ...]:
    """All edits of one row of role initial ``kind``, truncated or not: (state before, state after, cost, edits), at most two insertions first."""
    out = []
    for start in range(4):
        state, paid, edits = start, 0, ""
        for _ in range(3):
            out.append((start, state, paid + DELETE, edits + "D"))
            out.append((start, ASKED[state][1], paid + REROLE + TRUNCATED * cut, edits + "R"))
            if (state, kind) in KEEPS:
                out.append((start, KEEPS[state, kind], paid + TRUNCATED * cut, edits + "K"))
            state, paid, edits = ASKED[state][1], paid + INSERT, edits + "I"
    return tuple(out)


#: Insertions after the last row: (state before, state after, cost, edits).
ENDING = tuple((s, t, INSERT * n, "I" * n) for s in range(4) for n, t in enumerate((s, ASKED[s][1], ASKED[ASKED[s][1]][1])))

Row = tuple[str, bool]
Vector = list[tuple[int, int]]  # for each state: least cost, and rank of its least edits


def advance(vector: Vector, row: Row) -> Vector:
    """The forward vector after one more row."""
    best: list[tuple[int, int, str] | None] = [None] * 4
    for start, state, cost, edits in steps(*row):
        if vector[start][0] < NEVER:
            found = (vector[start][0] + cost, vector[start][1], edits)
            if best[state] is None or found < best[state]:
                best[state] = found
    return ranked(best)


def ranked(best: list) -> Vector:
    """Costs with the ranks of (earlier rank, edits or later rank)."""
    order = {key: i for i, key in enumerate(sorted({x[1:] for x in best if x is not None}))}
    return [(NEVER, 0) if x is None else (x[0], order[x[1:]]) for x in best]


def forward(rows: list[Row], state: int) -> Vector:
    vector: Vector = [(0, 0) if s == state else (NEVER, 0) for s in range(4)]
    for row in rows:
        vector = advance(vector, row)
    return vector


def backward(rows: list[Row], ends: list[int]) -> list[int]:
    """Least costs from each state to the end of ``rows``, where state s costs ``ends[s]`` more."""
    costs = ends
    for row in reversed(rows):
        new = [NEVER] * 4
        for start, state, cost, _ in steps(*row):
            new[start] = min(new[start], cost + costs[state])
        costs = new
    return costs


def crossing(left: Vector, right: list[int]) -> int:
    """The state in which the cheapest path, of the cheapest that with the least edits before, crosses."""
    return min((cost + right[s], rank, s) for s, (cost, rank) in enumerate(left))[2]


def hirschberg(rows: list[Row], start: int, end: int) -> list[str]:
    """The least of the cheapest edits of each row, on the way from state ``start`` to state ``end``."""
    if not rows:
        return []
    if len(rows) == 1:
        return [min((cost, edits) for s, t, cost, edits in steps(*rows[0]) if (s, t) == (start, end))[1]]
    half = len(rows) // 2
    middle = crossing(forward(rows[:half], start), backward(rows[half:], [0 if s == end else NEVER for s in range(4)]))
    return hirschberg(rows[:half], start, middle) + hirschberg(rows[half:], middle, end)


def closed(vector: Vector) -> tuple[int, int, str]:
    """The last row's state, the cost, and the insertions after it, of the cheapest way to accept (least edits first)."""
    found = min((vector[s][0] + cost, vector[s][1], edits, s) for s, t, cost, edits in ENDING if t in ACCEPTING)
    return found[3], found[0], found[2]


@lru_cache(maxsize=1 << 16)
def solve_short(rows: tuple[Row, ...]) -> tuple[int, tuple[str, ...], str]:
    return solve(list(rows))


def solve(rows: list[Row]) -> tuple[int, tuple[str, ...], str]:
    """Cost, each row's edits, and the insertions at the end, of a whole conversation's rows that aren't deleted in any case."""
    end, cost, tail = closed(forward(rows, 0))
    return cost, tuple(hirschberg(rows, 0, end)), tail


def apply_edits(edits: str, state: int, role: str, text: str) -> tuple[list[str], int]:
    """The repaired rows (``role:text``) that a row's edits leave, and the state after."""
    out = []
    for e in edits:
        asked, after = ASKED[state]
        if e == "I":
            out.append(f"{NAMES[asked]}:")
        elif e == "R":
            out.append(f"{NAMES[asked]}:{text}")
        elif e == "K":
            out.append(f"{role}:{text}")
            after = KEEPS[state, role[:1]]
        else:
            continue
        state = after
    return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, equal ones counted: conv_id, turn, role, text, copies."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat_ws(":", said["conv_id"], said["turn"]).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said["role"].alias("role"), said["text"].alias("text"), fate.alias("fate")).where(F.col("fate") != DROP)
    text = F.when(F.col("fate") == EMPTY, "").when(F.col("fate") == BARE, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == FORCE_USER, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == REPEAT, 2).otherwise(1).cast("long").alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def faulty(rows: DataFrame, heavy: float = HEAVY) -> DataFrame:
    """``rows`` with fault: 0 none, 1 blank, 2 a duplicate of a row of an earlier turn, 3 truncated. Further copies of a row aren't regarded."""
    word = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    keyed = rows.withColumns({"same": F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256), "last": F.right(word, F.lit(1))})
    keyed = materialize(keyed.withColumn("own", F.xxhash64("conv_id", "same")))
    first = keyed.groupBy("conv_id", "same", "own").agg(F.min(F.struct(F.col("turn").isNotNull().alias("dated"), "turn")).alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1").select(F.col("own").alias("k_own"), F.col("conv_id").alias("k_conv"), F.col("same").alias("k_same"), "first", "n"))
    most = max(1, keyed.count() * heavy)
    # A group of many rows is broadcast to them, as no more than 1 / heavy are so large; the others meet by their key.
    many, few = (first.where(of).drop("n") for of in (F.col("n") >= most, F.col("n") < most))
    alike = F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("same") == F.col("k_same"))
    told = keyed.join(F.broadcast(many), (F.col("own") == F.col("k_own")) & alike, "left").withColumnRenamed("first", "first_many").drop("k_own", "k_conv", "k_same")
    salted = told.withColumn("salt", F.when(F.col("first_many").isNull(), F.col("own")).otherwise(F.xxhash64("own", "turn")))
    found = salted.join(few, (F.col("salt") == F.col("k_own")) & alike, "left")
    first_turn = F.coalesce("first_many", "first")
    later = first_turn.isNotNull() & ~F.col("turn").eqNullSafe(first_turn["turn"])
    fault = F.when(F.col("last") == "", 1).when(later, 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    return found.select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))


_ROWS = "conv_id long, part long, open boolean, deleted long, kinds array<string>, roles array<string>, texts array<string>, cut array<boolean>, after array<long>"
_STATS = "first_turn long, last_turn long, turns long, rows long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
_SOLVED = "costs array<long>, ranks array<int>, cost long, audit string, repaired binary, digest string"
_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<boolean>": pa.list_(pa.bool_()),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in columns.split(", ")])


class Block:
    """Consecutive rows of a conversation: those that may stay, how many are deleted after each, and what the report counts."""

    def __init__(self, conv_id: int | None, part: int, open_: bool):
        self.row = {"conv_id": conv_id, "part": part, "open": open_, "deleted": 0, "kinds": [], "roles": [], "texts": [], "cut": [], "after": []}
        self.row |= dict.fromkeys(("first_turn", "last_turn", "first_role", "last_role")) | dict.fromkeys(("turns", "rows", "blank", "duplicate", "truncated", "illegal"), 0)
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        row, kind = self.row, role[:1]
        if turn is not None:
            if row["first_turn"] is None:
                row["first_turn"] = turn
            row["turns"] += turn != row["last_turn"]
            row["last_turn"] = turn
        if row["rows"]:
            row["illegal"] += row["last_role"] + kind not in LEGAL
        row["illegal"] += (copies - 1) * (kind + kind not in LEGAL)
        if row["first_role"] is None:
            row["first_role"] = kind
        row["last_role"] = kind
        row["rows"] += copies
        if fault == 1:
            row["blank"] += copies
        elif fault == 2:
            row["duplicate"] += copies
        else:
            row["truncated"] += fault == 3
            row["duplicate"] += copies - 1
            row["kinds"].append(kind), row["roles"].append(role), row["texts"].append(text), row["cut"].append(fault == 3), row["after"].append(0)
            self.size += len(text) + 64
            copies -= 1
        if row["after"]:
            row["after"][-1] += copies
        else:
            row["deleted"] += copies

    def rows(self) -> list[Row]:
        return list(zip(self.row["kinds"], self.row["cut"], strict=True))

    def full(self, most: int) -> bool:
        return len(self.row["kinds"]) >= most or self.size >= BLOCK_BYTES

    def finished(self) -> dict:
        """The block with its summary if it is open, else with the whole conversation's repair and without its texts."""
        row, rows = self.row, self.rows()
        if row["open"]:
            vectors = [forward(rows, s) for s in range(4)]
            return row | {"costs": [c for v in vectors for c, _ in v], "ranks": [r for v in vectors for _, r in v]}
        cost, edits, tail = solve_short(tuple(rows)) if len(rows) <= 64 else solve(rows)
        audit, repaired = repair(row, edits, 0, tail)
        return row | {"kinds": [], "roles": [], "texts": [], "cut": [], "after": [], "cost": cost + DELETE * (row["rows"] - len(rows)), "audit": audit, "repaired": repaired, "digest": hashlib.sha256(repaired).hexdigest()}


def repair(row: dict, edits: tuple[str, ...] | list[str], state: int, tail: str) -> tuple[str, bytes]:
    """The audit, and the repaired rows joined by newlines, of a block from ``state`` on; ``tail`` are insertions at its end."""
    audit, out = ["D" * row["deleted"]], []
    for own, role, text, after in zip(edits, row["roles"], row["texts"], row["after"], strict=True):
        added, state = apply_edits(own, state, role, text)
        out += added
        audit += [own, "D" * after]
    out += apply_edits(tail, state, "", "")[0]
    return "".join([*audit, tail]), "\n".join(out).encode()


def _blocks(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_blocks(batches, block_rows)

    return run


def _cut_blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> blocks. A partition's first and last conversations may go on elsewhere and stay open, as do those of several blocks."""
    part, schema = TaskContext.get().partitionId() << 32, _schema(f"{_ROWS}, {_STATS}, {_SOLVED}")
    block: Block | None = None
    ready: list[dict] = []
    weight, opening = 0, True
    for batch in batches:
        for conv, turn, role, text, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True):
            if block is None or block.row["conv_id"] != conv or block.full(block_rows):
                if block is not None:
                    goes_on = block.row["conv_id"] == conv
                    block.row["open"] |= goes_on
                    weight += block.size
                    ready.append(block.finished())
                    opening = goes_on
                block = Block(conv, part, opening)
                part += 1
            block.add(turn, role, text, copies, fault)
        if weight > BLOCK_BYTES or len(ready) > 4096:
            yield pa.RecordBatch.from_pylist(ready, schema=schema)
            ready, weight = [], 0
    if block is not None:
        block.row["open"] = True
        ready.append(block.finished())
    yield pa.RecordBatch.from_pylist(ready, schema=schema)


def combine(summaries: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """The summary (costs and ranks from each state to each state) of consecutive parts."""
    costs, ranks = [], []
    for start in range(4):
        vector: Vector = [(0, 0) if s == start else (NEVER, 0) for s in range(4)]
        for own_costs, own_ranks in summaries:
            vector = _over(vector, own_costs, own_ranks)
        costs += [c for c, _ in vector]
        ranks += [r for _, r in vector]
    return costs, ranks


def _over(vector: Vector, costs: list[int], ranks: list[int]) -> Vector:
    best: list[tuple[int, int, int] | None] = [None] * 4
    for s, (cost, rank) in enumerate(vector):
        for t in range(4):
            if cost < NEVER and costs[4 * s + t] < NEVER:
                found = (cost + costs[4 * s + t], rank, ranks[4 * s + t])
                if best[t] is None or found < best[t]:
                    best[t] = found
    return ranked(best)


def cross(summaries: list[tuple[list[int], list[int]]], start: int, end: int) -> list[int]:
    """The states in which the least cheapest path from ``start`` to ``end`` crosses between consecutive parts."""
    if len(summaries) < 2:
        return []
    half = len(summaries) // 2
    left: Vector = [(0, 0) if s == start else (NEVER, 0) for s in range(4)]
    for own in summaries[:half]:
        left = _over(left, *own)
    right = [0 if s == end else NEVER for s in range(4)]
    for costs, _ in reversed(summaries[half:]):
        right = [min(costs[4 * s + t] + right[t] for t in range(4)) for s in range(4)]
    middle = crossing(left, right)
    return [*cross(summaries[:half], start, middle), middle, *cross(summaries[half:], middle, end)]


_NODE = "conv_id long, part long, costs array<long>, ranks array<int>"


def _up(span: int):
    def up(group: pa.Table) -> pa.Table:
        rows = group.sort_by("part").to_pylist()
        costs, ranks = combine([(r["costs"], r["ranks"]) for r in rows])
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "part": rows[0]["part"] // span, "costs": costs, "ranks": ranks}], schema=_schema(_NODE))

    return up


def _down(left: pa.Table, right: pa.Table) -> pa.Table:
    """A group's parts and the states that it begins and ends in -> the states that each part begins and ends in."""
    rows = left.sort_by("part").to_pylist()
    (known,) = right.to_pylist()
    states = [known["start"], *cross([(r["costs"], r["ranks"]) for r in rows], known["start"], known["end"]), known["end"]]
    out = [{"conv_id": r["conv_id"], "part": r["part"], "start": a, "end": b} for r, a, b in zip(rows, states[:-1], states[1:], strict=True)]
    return pa.Table.from_pylist(out, schema=_schema("conv_id long, part long, start int, end int"))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            end, cost, tail = closed(list(zip(r["costs"][:4], r["ranks"][:4], strict=True)))
            out.append({"conv_id": r["conv_id"], "part": r["part"], "start": 0, "end": end, "cost": cost, "tail": tail})
        yield pa.RecordBatch.from_pylist(out, schema=_schema("conv_id long, part long, start int, end int, cost long, tail string"))


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open blocks and the states that they begin and end in -> their audits and repaired rows."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            audit, repaired = repair(r, hirschberg(list(zip(r["kinds"], r["cut"], strict=True)), r["start"], r["end"]), r["start"], "")
            out.append({"conv_id": r["conv_id"], "part": r["part"], "audit": audit, "repaired": repaired})
        yield pa.RecordBatch.from_pylist(out, schema=_schema("conv_id long, part long, audit string, repaired binary"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and part -> the digest of each conversation's pieces joined by newlines."""
    key: object = _digests
    state, empty = hashlib.sha256(), True
    schema = _schema("conv_id long, repaired_sha256 string")
    for batch in batches:
        out = []
        for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("repaired").to_pylist(), strict=True):
            if key is _digests or conv != key:
                if key is not _digests:
                    out.append({"conv_id": key, "repaired_sha256": state.hexdigest()})
                key, state, empty = conv, hashlib.sha256(), True
            if piece:
                state.update(piece if empty else b"\n" + piece)
                empty = False
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if key is not _digests:
        yield pa.RecordBatch.from_pylist([{"conv_id": key, "repaired_sha256": state.hexdigest()}], schema=schema)


def _solve_open(blocks: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """States that each open block begins and ends in, and each open conversation's cost and last insertions."""
    # Parts are (partition, number in it): numbers are combined first, then partitions.
    levels = [materialize(blocks.where("open").select("conv_id", "part", "costs", "ranks"))]
    spans: list[int] = []
    width = 1 << 32
    while True:
        most = levels[-1].groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        span = min(fan, width) if width > 1 else fan
        highest = levels[-1].agg(F.max(F.col("part") % width)).first()[0] if width > 1 else None
        if highest is not None and highest < span:
            span, width = width, 1  # all numbers of a partition in one group
        elif width > 1:
            width //= span
        grouped = levels[-1].groupBy("conv_id", F.floor(F.col("part") / span).cast("long").alias("up")).applyInArrow(_up(span), _NODE)
        levels.append(materialize(grouped))
        spans.append(span)
    roots = materialize(levels[-1].mapInArrow(_roots, "conv_id long, part long, start int, end int, cost long, tail string"))
    known = roots.select("conv_id", "part", "start", "end")
    for level, span in zip(reversed(levels[:-1]), reversed(spans), strict=True):
        up = F.floor(F.col("part") / span).cast("long").alias("up")
        above = known.select("conv_id", F.col("part").alias("up"), "start", "end")
        known = materialize(level.groupBy("conv_id", up).cogroup(above.groupBy("conv_id", "up")).applyInArrow(_down, "conv_id long, part long, start int, end int"))
    return known, roots.select("conv_id", "cost", "tail")


def _repaired(conversations: DataFrame, fan: int, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The report, all blocks (closed ones with their repaired rows and digest), and the repaired pieces of open conversations."""
    rows = faulty(damaged(conversations)).withColumn("dated", F.col("turn").isNotNull())
    order = ["conv_id", "dated", "turn", "role", "text"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies", "fault")
    blocks = materialize(ordered.mapInArrow(_blocks(block_rows), f"{_ROWS}, {_STATS}, {_SOLVED}"))
    known, costs = _solve_open(blocks, fan)
    placed = blocks.where("open").select(*(c.split()[0] for c in _ROWS.split(", "))).join(known.withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    opened = materialize(placed.mapInArrow(_between, "conv_id long, part long, audit string, repaired binary"))
    audits = opened.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "audit"))).alias("pieces"))
    tails = costs.withColumnRenamed("conv_id", "c")
    told = audits.join(tails, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", F.col("cost").alias("open_cost"), F.concat(F.array_join("pieces.audit", ""), "tail").alias("open_audit"), "tail")
    counts = blocks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("rows", "turns", "blank", "duplicate", "truncated", "illegal")), F.sum(F.size("kinds")).alias("free"), F.min("first_turn").alias("low"), F.max("last_turn").alias("high"), F.max("cost").alias("cost"), F.max("audit").alias("audit"), F.max("digest").alias("digest"))
    # Where two blocks meet: a turn that both hold was counted twice, and their adjacent roles are a pair of their own.
    before = W.partitionBy("conv_id").orderBy("part")
    edges = blocks.where("open").select("conv_id", (F.lag("last_turn").over(before) == F.col("first_turn")).alias("shared"), F.concat(F.lag("last_role").over(before), "first_role").alias("pair"))
    met = edges.groupBy(F.col("conv_id").alias("m")).agg(F.count_if("shared").alias("shared"), F.count_if(~F.col("pair").isin(*LEGAL)).alias("apart"))
    counts = counts.join(met, F.col("conv_id").eqNullSafe(F.col("m")), "left").drop("m")
    zero = F.lit(0).cast("long")
    counts = counts.withColumns({"turns": F.col("turns") - F.coalesce("shared", zero), "illegal": F.col("illegal") + F.coalesce("apart", zero)})
    return _report(conversations, counts, told), blocks, _ends(opened, costs)


def _ends(opened: DataFrame, costs: DataFrame) -> DataFrame:
    ends = costs.where("tail <> ''").select("conv_id", F.lit((1 << 63) - 1).alias("part"), F.expr("cast(if(tail = 'I', 'assistant:', 'user:\nassistant:') as binary)").alias("repaired"))
    return opened.select("conv_id", "part", "repaired").unionByName(ends)


def _report(conversations: DataFrame, counts: DataFrame, told: DataFrame) -> DataFrame:
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = F.lit(0).cast("long")
    joined = every.join(counts.withColumnRenamed("conv_id", "k"), F.col("conv_id").eqNullSafe(F.col("k")), "left").join(told.withColumnRenamed("conv_id", "t"), F.col("conv_id").eqNullSafe(F.col("t")), "left")
    return joined.select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), zero).alias("gaps"), *(F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")),
        F.coalesce("cost", F.col("open_cost") + DELETE * (F.col("rows") - F.col("free")), zero).alias("cost"), F.coalesce("audit", "open_audit", F.lit("")).alias("audit"), "digest",
    )


def repair_conversations(conversations: DataFrame, fan: int = FAN, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The report of every conversation, and its repaired rows: conv_id, part (pieces in order), repaired (``role:text`` joined by newlines)."""
    report, blocks, pieces = _repaired(conversations, fan, block_rows)
    return report.drop("digest"), blocks.where("not open").select("conv_id", "part", "repaired").unionByName(pieces)


def repaired_digests(conversations: DataFrame, fan: int = FAN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The report (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) with the SHA-256 of every conversation's repaired rows."""
    report, _, pieces = _repaired(conversations, fan, block_rows)
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    digests = ordered.mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "d")
    digest = F.coalesce("digest", "repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return report.join(digests, F.col("conv_id").eqNullSafe(F.col("d")), "left").select(*(c for c in report.columns if c != "digest"), digest)
