"""Best-fit packing by a configuration linear program.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` tokens. Over the histogram of
piece lengths (at most CAPACITY numbers, whatever the corpus) the configuration LP is solved by
multiplicative weights: a configuration is a multiset of lengths that fits a sequence, priced by a
knapsack dynamic program. The fractional solution is rounded down, and best fit over the histogram packs
what rounding leaves. The plan is a table of rank ranges per length, so that every
piece finds its sequence and offset by arithmetic on its rank among the pieces of its length.

Defined results: a null text counts as empty and still gets the end token; repeated rows are packed
each; no rows give no rows. Longer documents than a sequence are cut so that all pieces but the first
are full. Further columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.frames import materialize, slices

CAPACITY = 1024
END_ID = 2
#: Words and bytes, about, that a worker's memo of encoded words may hold; it is emptied when full. Longer words than MEMO_WORD aren't kept.
MEMO_WORDS, MEMO_BYTES, MEMO_WORD = 700_000, 160 << 20, 128
_ENTRY_BYTES = 160
#: Words that are encoded as one text.
TOGETHER = 256
#: Rounds of the LP, pricing programs in a round, and how fast weights follow the coverage.
ROUNDS = 60
GROUPS = 6
EPSILON = 0.005

_CLEAN_CUT = re.compile(r"(?<=\S) (?=\S)")
# The characters that stand for bytes in a byte-level vocabulary (printable ones for themselves, the
# others counted from 256).
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def leading_spaces(tokenizer) -> np.ndarray:
    """Which ids of a byte-level tokenizer stand for tokens that begin with a space."""
    out = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        out[i] = token.startswith(chr(_BYTE_CHARACTERS[0x20]))
    return out


def encode_words(tokenizer, leading: np.ndarray, words: list[str]) -> list[bytes]:
    """The ids of " " and each of ``words`` (without spaces, and no white space at their ends), as 32-bit integers.

    Words are encoded ``TOGETHER`` at a time, as a text: its pattern never joins a word and the space that follows, so every token that
    begins with a space begins a word, if there are as many as words; otherwise each is encoded alone.
    """
    out: list[bytes] = []
    for begin in range(0, len(words), TOGETHER):
        own = words[begin : begin + TOGETHER]
        (coded,) = tokenizer.encode_batch_fast([" " + " ".join(own)], add_special_tokens=False)
        ids = np.array(coded.ids, np.uint32)
        heads = np.flatnonzero(leading[ids])
        if len(heads) == len(own) and heads[0] == 0:
            raw, edges = ids.tobytes(), [*(4 * heads).tolist(), 4 * len(ids)]
            out += [raw[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
        else:
            out += [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast([" " + w for w in own], add_special_tokens=False)]
    return out


class WordEncoder:
    """Encodes texts by a byte-level BPE tokenizer, word by word.

    Its pattern attaches a single space between two visible characters to the word that follows, so a text's
    ids are the ids of " word" after " word". Each distinct word is encoded once, many together; what isn't such a word goes
    through the tokenizer with its text.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.leading = leading_spaces(self.tokenizer)
        self.memo: dict[str, bytes | None] = {}
        self.memo_words, self.memo_bytes, self.held = memo_words, memo_bytes, 0
        self.long: list[str] = []  # words of the texts at hand that aren't kept

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        self.long += (w for w in words if len(w) > MEMO_WORD)
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        coded = encode_words(self.tokenizer, self.leading, plain)
        self.memo.update(dict.fromkeys(words))  # what has other spaces needs a closer look
        self.memo.update(zip(plain, coded, strict=True))
        self.held += sum(map(len, words)) + sum(map(len, coded)) + _ENTRY_BYTES * len(words)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [t.split(" ") for t in texts]
        if len(self.memo) > self.memo_words or self.held > self.memo_bytes:
            self.memo.clear()
            self.held = 0
        self._learn(set().union(*split).difference(self.memo))
        heads = self._encode([x[0] for x in split])
        memo = self.memo
        out, get = [], memo.__getitem__
        for text, words, head in zip(texts, split, heads, strict=True):
            if words[0] and not words[0][-1].isspace():
                try:
                    out.append(head + b"".join(map(get, words[1:])))
                    continue
                except TypeError:
                    pass
            parts = _CLEAN_CUT.split(text)
            rest = [self.memo.get(p) for p in parts[1:]]
            odd = [i for i, x in enumerate(rest) if x is None]
            for i, x in zip(odd, self._encode([f" {parts[i + 1]}" for i in odd]), strict=True):
                rest[i] = x
            out.append(self._encode(parts[:1])[0] + b"".join(rest))
        for w in [w for w in self.long if w in memo]:
            self.held -= len(w) + len(memo.pop(w) or b"") + _ENTRY_BYTES
        self.long.clear()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    tail = np.array([end_id], np.uint32).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(path), str(TaskContext.get().partitionId()), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for run in slices(batch, "text", 2 << 20):
                ids, number, start, long, crc, rank, own = [], [], [], [], [], [], []
                texts = [t or "" for t in run.column("text").to_pylist()]
                for doc, coded in zip(run.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    coded += tail
                    n = len(coded) // 4
                    at = n % capacity or capacity
                    edges = [0, *range(at, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        piece = coded[4 * a : 4 * b]
                        ids.append(doc), number.append(k), start.append(a), long.append(b - a), crc.append(zlib.crc32(piece)), rank.append(int(seen[b - a]))
                        seen[b - a] += 1
                        if with_ids:
                            own.append(np.frombuffer(piece, np.uint32).astype(np.int32))
                arrays = [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, long, crc)), pa.array([part] * len(ids), pa.string()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(own, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * with_ids])

    return cut


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack dynamic program: the greatest value for every capacity, and the item taken last (or -1)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - lengths[:k]] + value[:k]
            j = int(gain.argmax())
            if gain[j] > best[c]:
                best[c], choice[c] = gain[j], j
    return best, choice


def configuration(first: int, lengths: list[int], choice: list[int], capacity: int) -> tuple[int, ...]:
    """The best configuration that holds the item ``first``, as sorted item numbers."""
    items, c = [first], capacity - lengths[first]
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            items.append(choice[c])
            c -= lengths[choice[c]]
    return tuple(sorted(items))


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], float]]:
    """The configuration LP by multiplicative weights: configurations (item numbers) and how often each is used.

    Weights start at the volume bound's prices. Every round asks that another 1/rounds of each
    length's demand be covered; for what isn't yet, the pricing program gives the best configuration
    holding it. What gets covered beyond its due grows cheaper by a factor, what lags dearer.
    """
    weight = lengths / capacity
    covered = np.zeros(len(lengths))
    used: dict[tuple[int, ...], float] = {}
    long = lengths.tolist()
    groups = np.array_split(np.arange(len(lengths))[::-1], min(GROUPS, len(lengths)))
    for t in range(1, rounds + 1):
        for group in groups:
            choice = price(lengths, weight, capacity)[1].tolist()
            for i in group.tolist():
                due = demand[i] * t / rounds - covered[i]
                if due > 0:
                    items = configuration(i, long, choice, capacity)
                    amount = due / items.count(i)
                    used[items] = used.get(items, 0.0) + amount
                    for k in items:
                        covered[k] += amount
            ahead = covered / demand - t / rounds
            weight = lengths / capacity * np.exp(np.clip(-EPSILON * rounds * ahead, -1, 1))
    scale = float(demand @ lengths) / max(float(covered @ lengths), 1e-9)
    return [(k, v * scale) for k, v in used.items()]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over a histogram: configurations and how often each is used.

    Sequences with the same content are kept as one entry, so that the work depends on the lengths
    alone and not on how many pieces have them.
    """
    space: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    levels = 0
    for long in sorted(histogram, reverse=True):
        left = histogram[long]
        while left:
            fitting = levels >> long << long
            if not fitting:
                fill = capacity // long  # fresh sequences, as full of this length as they get
                free, config, many = capacity, (), max(1, left // fill)
                now = min(fill, left)
            else:
                free = (fitting & -fitting).bit_length() - 1
                config, many = space[free].popitem()
                now = 1
                if many > left:
                    space[free][config] = many - left
                    many = left
                if not space[free]:
                    levels ^= 1 << free
            left -= many * now
            config, free = config + (long,) * now, free - long * now
            space[free][config] = space[free].get(config, 0) + many
            levels |= 1 << free
    return [x for level in space for x in level.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, slots per sequence, offset) of every run of the plan.

    The size of the plan is bounded by the capacity, the rounds, not by the corpus.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    next_rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def use(config: dict[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for long, slots in config.items():
            runs.append((long, next_rank[long], times * slots, sequences, slots, offset))
            next_rank[long] += times * slots
            left[long] -= times * slots
            offset += long * slots
        sequences += times

    if left.get(capacity):
        use({capacity: 1}, left[capacity])
    lengths = np.array(sorted(k for k, v in left.items() if v > 0), np.int64)
    if len(lengths):
        demand = np.array([left[k] for k in lengths.tolist()], np.int64)
        for items, amount in sorted(fractional(lengths, demand, capacity, rounds), key=lambda x: (-int(lengths[list(x[0])].sum()), -x[1])):
            config = Counter(lengths[list(items)].tolist())
            times = min(int(amount), *(left[k] // n for k, n in config.items()))
            if times > 0:
                use(config, times)
    for config, times in best_fit({k: v for k, v in left.items() if v > 0}, capacity):
        use(Counter(config), times)
    return runs


def _placer(runs: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    key = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = table[np.searchsorted(key, long << 48 | rank, side="right") - 1]
            sequence, slot = np.divmod(rank - run[:, 1], run[:, 4])
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(run[:, 3] + sequence), pa.array(run[:, 5] + slot * long)],
                names=[*names, "sequence_id", "offset"],
            )

    return place


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    extra = ", ids array<int>" * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part string, rank long" + extra
    pieces = materialize(documents.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity, end_id, with_ids), schema))
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("rank") + F.col("base")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + extra + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placer(plan(histogram, capacity)), out)
