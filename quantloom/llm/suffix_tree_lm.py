"""Scoring by a probabilistic suffix tree over words.

The tree's states are contexts: the last one, two, three ... words. A context is a candidate when it occurs
``LEAST_COUNT`` times in the training corpus, whatever its size, and its own suffix is a state; it becomes a state when its
next-symbol distribution diverges from its suffix's by ``LEAST_GAIN`` nats a symbol, every occurrence left out of its
own count. Levels are added until no candidate becomes a state. A token is predicted in the longest
state that stands before it:

    P(x | s) = (c(s, x) [if c >= 2] + (K + n1(s)) P(x | suffix of s)) / (c(s) + K)

with n1 the number of x seen once after s, and (c(x) + 1) / (N + V + 1) at the root.

Texts are read once and become chunks of word numbers: the owners of words give each one a number, frequent ones small ones. For every level a chunk sends its distinct (context, symbol) pairs, packed, to the
owners of the contexts' hash ranges; owners sum them, test the contexts and answer with the counts in the order in which they were
asked. With the answers a chunk goes on to its next state: the scores of what is settled, and the tokens whose
contexts may still grow. So counts and contexts stay distributed, a chunk learns about its own contexts only, and no level is gone
through twice. Owners, and then chunks, take their turns in up to ``ROUNDS`` rounds: what a round has read is removed before the next one, so
that of what is written only a round's share lies on the disk twice. Probabilities travel with the questions and come back with the answers;
a waiting state holds none. A context that holds over ``SPLIT_SHARE`` of the tokens is dealt over several owners by its
symbols: its once-seen symbols are summed first, then its test. Only the sums of these (at most 1 / SPLIT_SHARE a level) pass through the
driver, and the result doesn't hang on the number of owners.

Defined results: tokens are runs of bytes other than ``[\\x20\\x09-\\x0D]``, A to Z lower-cased, and one end; a null text
counts as empty; without training tokens N and V are 0. Repeated rows count and are scored each. Words, and contexts of several, are
told apart by 64-bit hashes; counts are 64-bit. From the second level on, probabilities are held in 32 bits between levels. An
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.frames import crc_bucket, discard, joined_parts, materialize_parts, owner_count, text_bytes, text_volume
from quantloom.llm.words import LOWER, SPACE, hash_words, mix, run_bounds

#: Occurrences from which words can be a context.
LEAST_COUNT = 8
KAPPA = 2.0
#: Divergence from the suffix, in nats per symbol, from which a context is kept.
LEAST_GAIN = 0.01
#: Contexts of a larger share of the tokens are split over owners.
SPLIT_SHARE = 2.0**-16
#: Bytes of text in a chunk, about, and of the corpus for each owner.
CHUNK_BYTES, OWNER_BYTES = 4 << 20, 8 << 20
#: Rounds in which the owners of a level, and its chunks, are served at most, and owners from which another one is added.
ROUNDS, ROUND_OWNERS = 4, 12
#: Contexts of so many words are sent as their words' numbers, which are smaller than a hash.
SPELT = 4

END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_ROUTE = np.uint64(2**64 - 2**40)


def _zip(a: np.ndarray, level: int = 1) -> bytes:
    """The numbers' first bytes, then their second bytes, and so on, compressed: most are small."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def _unzip(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    planes = raw.reshape(size, len(raw) // size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _key(context: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hash of a context and a symbol, or of a context and the word before it."""
    return mix(x + context.astype(np.uint64) * _PAIR)


def _context(words: list[np.ndarray]) -> np.ndarray:
    """Of contexts' words, the last one first: the word, or a hash of several."""
    out = words[0]
    for word in words[1:]:
        out = _key(out, word)
    return out


def _spelt(words: list[np.ndarray]) -> np.ndarray:
    """Contexts as their words' numbers, counted from one; the texts' beginning is 0."""
    return np.concatenate([np.where(w == BEGIN, np.uint64(0), w + np.uint64(1)) for w in words])


def _read_contexts(sent: np.ndarray, depth: int) -> np.ndarray:
    """The contexts of a question, as their words' numbers or hashes."""
    if depth > SPELT:
        return sent
    return _context([np.where(w > 0, w - np.uint64(1), BEGIN) for w in sent.reshape(depth, -1)])


def _share(h: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """Which of ``parts`` equal ranges the hashes fall in, by their first 24 bits."""
    return ((h >> np.uint64(40)) * np.asarray(parts, np.uint64) >> np.uint64(24)).astype(np.int64)


def _ordered(route: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keys that are sorted by their route (which picks the owner, and is one for a context's keys), 64 bits in all."""
    return route & _ROUTE | key >> np.uint64(24)


@dataclass
class Level:
    """The contexts of one depth that are split over owners: hashes (sorted), symbols seen once, kept or not."""

    context: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    once: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    kept: np.ndarray = field(default_factory=lambda: np.empty(0, bool))


@dataclass
class Model:
    """What every task holds: the number of owners, and totals."""

    owners: int
    n: int = 0
    v: int = 0

    @property
    def split_from(self) -> float:
        """Occurrences from which a context is split: more than an owner's share of the tokens, and than ``SPLIT_SHARE``."""
        return max(self.n / self.owners, SPLIT_SHARE * self.n, 1)

    def parts(self, total: np.ndarray) -> np.ndarray:
        return np.where(total >= self.split_from, 1 + total * self.owners // max(self.n, 1), 1)


#: A chunk's rows, tokens (numbers of the chunk's distinct words), these words' corpus-wide numbers and counts, and the places that are
#: asked about, with their contexts' totals.
_STATE = ("docs", "size", "code", "word", "count", "asked", "total")
_KINDS = {"size": np.int64, "code": np.uint32, "word": np.uint64, "count": np.int64, "asked": np.uint32, "total": np.int64}


class Chunk:
    """A chunk's tokens, and what answers have told about them.

    ``docs`` holds doc_id, counted, wanted, n_tokens, n_known, base_score and score of its rows; the score is of the tokens that are no longer asked about.
    """

    def __init__(self, model: Model, depth: int, state: dict):
        self.model, self.depth = model, depth
        self.docs: pa.Table = state["docs"]
        self.size, self.code, self.word, self.count = (state[c] for c in ("size", "code", "word", "count"))
        self.asked = state["asked"].astype(np.int64)
        self.row = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.place = np.arange(len(self.code)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        if depth > 1:  # the answers bring the probabilities
            self.p, self.total = None, state["total"]
        elif depth:  # both follow from the words' counts
            self.p, self.total = self._root(self.code[self.asked]), self._totals()
        self._look()

    @classmethod
    def read(cls, model: Model, rows: pa.Table) -> Chunk:
        """The chunk of rows (doc_id, text, counted, wanted). Its words are numbered in the order in which their owners are asked."""
        texts = rows.column("text").chunk(0) if rows.column("text").num_chunks else pa.array([], pa.string())
        data, at = text_bytes(texts)
        words, edges = hash_words(LOWER[data], at, SPACE)
        n = rows.num_rows
        ends = edges[1:] + np.arange(n)
        x = np.empty(len(words) + n, np.uint64)
        inner = np.ones(len(x), bool)
        inner[ends] = False
        x[ends], x[inner] = END, words
        route, first, code = np.unique(mix(x), return_index=True, return_inverse=True)
        size = np.diff(edges) + 1
        docs = rows.select(["doc_id", "counted", "wanted"]).append_column("n_tokens", pa.array(size))
        for name, kind in (("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())):
            docs = docs.append_column(name, pa.array(np.zeros(n), pa.float64()).cast(kind))
        chunk = cls(model, 0, {"docs": docs, "size": size, "code": code.astype(np.uint32), "word": np.empty(0, np.uint64), "count": np.empty(0, np.int64), "asked": np.empty(0, np.uint32)})
        chunk.hashes, chunk.route = x[first], route
        return chunk

    def _root(self, code: np.ndarray) -> np.ndarray:
        return (self.count[code] + 1.0) / (self.model.n + self.model.v + 1.0)

    def _totals(self) -> np.ndarray:
        """How often the word before each asked token stands, or the texts' beginning: as often as their end, as every counted text has one of each."""
        before = self.count[self.code[np.maximum(self.asked - 1, 0)]]
        return np.where(self.place[self.asked] == 0, self.count[self.code[self.size[0] - 1]] if len(self.size) else 0, before)

    def _look(self) -> None:
        """The asked tokens' symbols, and their contexts: a word's number, or a hash of several."""
        at = self.asked
        self.x = self.word[self.code[at]] if self.depth and len(at) else np.empty(0, np.uint64)
        self.context = _context([self._before(at, d) for d in range(1, self.depth + 1)]) if self.depth and len(at) else np.zeros(len(at), np.uint64)

    def _before(self, at: np.ndarray, d: int) -> np.ndarray:
        """The word that stands ``d`` places before each of ``at``, or the texts' beginning."""
        return np.where(self.place[at] >= d, self.word[self.code[np.maximum(at - d, 0)]], BEGIN)

    def _slices(self, route: np.ndarray) -> list[tuple[int, slice]]:
        own = _share(route, self.model.owners)
        edges = np.append(run_bounds(own), len(own)) if len(own) else np.zeros(1, np.int64)
        return [(int(own[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def ask_words(self) -> list[tuple[int, dict]]:
        """The chunk's distinct words and how often counted texts hold them, for their owners."""
        counted = self.docs.column("counted").to_numpy()[self.row]
        n = np.bincount(self.code, counted, len(self.hashes)).astype(np.int64)
        return [(owner, {"x": self.hashes[keys].tobytes(), "n": _zip(n[keys])}) for owner, keys in self._slices(self.route)]

    def ask(self) -> list[tuple[int, slice]]:
        """Prepare the level's distinct keys, sorted by owner and context: (owner, where its keys are)."""
        model, x, context = self.model, self.x, self.context
        route = mix(context)
        many = np.flatnonzero(self.total >= model.split_from)
        route[many] = mix(context[many] + _share(mix(x[many]), model.parts(self.total[many])).astype(np.uint64) + np.uint64(1))
        key = _ordered(route, _key(context, x))
        order = np.argsort(key)
        heads = run_bounds(key[order])
        self.slot = np.empty(len(x), np.int64)
        self.slot[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(x))))
        self.first = order[heads]
        counted = self.docs.column("counted").to_numpy()[self.row[self.asked]]
        self.n = np.bincount(self.slot, counted, len(heads)).astype(np.int64)
        return self._slices(route[self.first])

    def question(self, keys: slice) -> dict[str, bytes]:
        at = self.first[keys]
        heads = run_bounds(self.context[at])
        runs = np.diff(np.append(heads, len(at)))
        # Of the first level's probabilities their counts are sent.
        p = self.count[self.code[self.asked[at]]] if self.depth == 1 else self.p[at].astype(np.float32)
        contexts = _spelt([self._before(self.asked[at[heads]], d) for d in range(1, self.depth + 1)]) if self.depth <= SPELT else self.context[at[heads]]
        return {"x": _zip(self.x[at]), "n": _zip(self.n[keys]), "contexts": _zip(contexts), "runs": _zip(runs), "totals": _zip(self.total[at[heads]]), "p": _zip(p)}

    def hear_words(self, answers: dict[int, dict], keys: list[tuple[int, slice]], more: bool) -> None:
        """Take the owners' answers: corpus-wide numbers and counts of the words."""
        self.word, self.count = np.zeros(keys[-1][1].stop, np.uint64), np.zeros(keys[-1][1].stop, np.int64)
        for owner, own in keys:
            self.count[own], self.word[own] = _unzip(answers[owner]["counts"], np.int64), _unzip(answers[owner]["ids"], np.uint64)
        p, rows = self._root(self.code), len(self.size)
        self._put("n_known", np.bincount(self.row, self.count[self.code] > 0, rows))
        self._put("base_score", np.bincount(self.row, np.log10(p), rows))
        self.asked = np.arange(len(self.code))
        total = self._totals()
        self._settle(p, (total >= LEAST_COUNT) & more, total)

    def hear(self, answers: dict[int, dict], split: Level, more: bool) -> None:
        """Take the owners' answers to what was asked: counts, and the contexts' symbols seen once and fates; go deeper for ``more``."""
        asked = self.ask()
        n, once, kept = np.zeros(len(self.first), np.int64), np.zeros(len(self.first), np.int64), np.zeros(len(self.first), bool)
        held = np.ones(len(self.first), np.float32)
        for owner, keys in asked:
            told = answers[owner]
            n[keys] = _unzip(told["counts"], np.int64)
            heads = run_bounds(self.context[self.first[keys]])
            runs = np.diff(np.append(heads, keys.stop - keys.start))
            if self.depth > 1:
                held[keys] = _unzip(told["p"], np.float32)
            once[keys], kept[keys] = np.repeat(_unzip(told["once"], np.int64), runs), np.repeat(_unzip(told["kept"], np.bool_), runs)
        if len(split.context):
            context = self.context[self.first]
            at = np.minimum(np.searchsorted(split.context, context), len(split.context) - 1)
            found = split.context[at] == context
            once, kept = np.where(found, split.once[at], once), np.where(found, split.kept[at], kept)
        count, stay, p = n[self.slot], kept[self.slot], self.p.copy() if self.depth == 1 else held[self.slot].astype(np.float64)
        c = count[stay]
        p[stay] = (np.where(c >= 2, c, 0) + (KAPPA + once[self.slot][stay]) * p[stay]) / (self.total[stay] + KAPPA)
        # A longer context stands as often as its last word was counted in the context before.
        gram = np.zeros(len(self.code), np.int64)
        gram[self.asked] = count
        total = gram[np.maximum(self.asked - 1, 0)]
        self._settle(p, stay & (self.place[self.asked] >= self.depth) & (total >= LEAST_COUNT) & more, total)

    def _put(self, name: str, values: np.ndarray) -> None:
        at = self.docs.column_names.index(name)
        self.docs = self.docs.set_column(at, name, pa.array(values).cast(self.docs.schema.field(name).type))

    def _settle(self, p: np.ndarray, on: np.ndarray, total: np.ndarray) -> None:
        """Keep the tokens ``on`` as candidates of the next depth: one word more, often enough, with a state as suffix. The others are scored."""
        settled = self.asked[~on]
        self._put("score", self.docs.column("score").to_numpy() + np.bincount(self.row[settled], np.log10(p[~on]), len(self.size)))
        self.asked, self.p, self.total = self.asked[on], p[on], total[on]
        self.depth += 1
        # Of the words, those that a further context can reach, and the first text's end, whose count the first level needs; frequent ones first.
        used = np.zeros(len(self.code) + 1, bool)
        for d in range(self.depth + 1):
            used[np.maximum(self.asked - d, -1)] = True
        used = used[:-1]
        if len(self.size):
            used[self.size[0] - 1] = True
        number, code = np.unique(self.code[used], return_inverse=True)
        often = np.argsort(-np.bincount(code, minlength=len(number)), kind="stable")
        rank = np.empty(len(number), np.uint32)
        rank[often] = np.arange(len(number))
        self.word, self.count = self.word[number[often]], self.count[number[often]] if self.depth == 1 else self.count[:0]
        fresh = np.zeros(len(self.code), np.uint32)
        fresh[used] = rank[code]
        self.code = fresh
        self._look()

    def packed(self) -> dict:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.docs.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd"))) as out:
            out.write_table(self.docs)
        nothing = np.empty(0)
        # Places are sent as steps, which are small.
        values = {"size": self.size, "code": self.code, "word": self.word, "count": self.count, "asked": np.diff(self.asked, prepend=0), "total": self.total if self.depth > 1 else nothing}
        return {"docs": sink.getvalue().to_pybytes()} | {c: _zip(x.astype(_KINDS[c]), 3) for c, x in values.items()}


def _unpacked(model: Model, depth: int, row: dict) -> Chunk:
    state = {c: _unzip(row[c], _KINDS[c]) for c in _STATE[1:]}
    state["asked"] = np.cumsum(state["asked"].astype(np.int64))
    return Chunk(model, depth, state | {"docs": pa.ipc.open_stream(row["docs"]).read_all().combine_chunks()})


_ASKED = "owner int, chunk string, x binary, n binary, contexts binary, runs binary, totals binary, p binary, " + ", ".join(f"s_{c} binary" for c in _STATE)
_TOLD = "chunk string, owner int, counts binary, ids binary, once binary, kept binary, p binary, context long, gain double, n long, v long, split binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in columns.split(", ")])


def _sent(chunk: Chunk, name: str, more: bool) -> list[dict]:
    """A chunk's state (without an owner), and its questions to owners for ``more``."""
    state = {"owner": None, "chunk": name} | {f"s_{c}": x for c, x in chunk.packed().items()}
    if not chunk.depth:
        asked = chunk.ask_words()
    else:
        asked = [(owner, chunk.question(keys)) for owner, keys in (chunk.ask() if more else ())]
    return [state, *({"owner": owner, "chunk": name, **question} for owner, question in asked)]


def _reader(model: Model):
    """Rows (doc_id, text, counted, wanted) -> chunks of about ``CHUNK_BYTES`` of text, and their questions about words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sent, parts, held = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts).combine_chunks()
            parts.clear()
            for r in _sent(Chunk.read(model, rows), f"{task}-{sent}", True):
                yield pa.RecordBatch.from_pylist([r], schema=_schema(_ASKED))

        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                _, at = text_bytes(batch.column("text"))
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + CHUNK_BYTES - held, side="right")) - 1)
                parts.append(batch.slice(begin, end - begin))
                held += int(at[end] - at[begin])
                begin = end
                if held >= CHUNK_BYTES or begin < batch.num_rows:
                    yield from flush()
                    sent, held = sent + 1, 0
        if parts:
            yield from flush()

    return read


def _next_level(model: Model, depth: int, split: Level, more: bool):
    """A chunk's state and the answers of level ``depth`` -> its next state and questions."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        chunk, answers = _unpacked(model, depth, {c: row[f"s_{c}"] for c in _STATE}), {r["owner"]: r for r in right.to_pylist()}
        if depth:
            chunk.hear(answers, split, more)
        else:  # words were asked about in the order of their owners
            edges = np.cumsum([0, *(len(_unzip(answers[o]["counts"], np.int64)) for o in sorted(answers))])
            chunk.hear_words(answers, [(o, slice(a, b)) for o, a, b in zip(sorted(answers), edges[:-1], edges[1:], strict=True)], more)
        return pa.Table.from_pylist(_sent(chunk, row["chunk"], more), schema=_schema(_ASKED))

    return go


def left_out_gain(n: np.ndarray, p: np.ndarray, total: np.ndarray, once: np.ndarray) -> np.ndarray:
    """What a context's distribution gains over its suffix's (``p``) on its own occurrences, each left out of the counts."""
    seen = np.where(n >= 3, n - 1, 0) + (KAPPA + once + np.where(n == 2, 1, np.where(n == 1, -1, 0))) * p
    return np.where(n > 0, n * np.log(np.maximum(seen, 1e-300) / (np.maximum(total - 1, 0) + KAPPA) / p), 0.0)


def _answerer(model: Model, depth: int):
    """An owner's questions from all chunks -> sums for each, and rows of totals and of split contexts' parts (without a chunk)."""

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        x = [_unzip(r["x"], np.uint64) if depth else np.frombuffer(r["x"], np.uint64) for r in rows]
        size = [len(a) for a in x]
        x, n = np.concatenate(x), np.concatenate([_unzip(r["n"], np.int64) for r in rows])
        out, tail = [], dict.fromkeys(c.split()[0] for c in _TOLD.split(", "))
        if depth:
            heads = [_read_contexts(_unzip(r["contexts"], np.uint64), depth) for r in rows]
            runs = np.concatenate([_unzip(r["runs"], np.int64) for r in rows])
            total, context = np.repeat(np.concatenate([_unzip(r["totals"], np.int64) for r in rows]), runs), np.repeat(np.concatenate(heads), runs)
            p = np.concatenate([(_unzip(r["p"], np.int64) + 1.0) / (model.n + model.v + 1.0) if depth == 1 else _unzip(r["p"], np.float32).astype(np.float64) for r in rows])
        key = _ordered(mix(context), _key(context, x)) if depth else x
        order = np.argsort(key)
        pairs = run_bounds(key[order])
        sums = np.add.reduceat(n[order], pairs)
        slot = np.empty(len(x), np.int64)
        slot[order] = np.repeat(np.arange(len(pairs)), np.diff(np.append(pairs, len(x))))
        counts = sums[slot]
        if not depth:
            out.append(tail | {"n": int(sums.sum()), "v": int((sums > 0).sum())})
            number = np.empty(len(sums), np.uint64)
            number[np.argsort(-sums, kind="stable")] = np.arange(len(sums), dtype=np.uint64) * np.uint64(model.owners) + np.uint64(rows[0]["owner"])
            ids = number[slot]
        else:
            at = order[pairs]
            by = np.argsort(context[at], kind="stable")  # contexts whose routes share their first bits may lie mixed
            at, sums = at[by], sums[by]
            groups = run_bounds(context[at])
            width = np.diff(np.append(groups, len(at)))
            once = np.add.reduceat((sums == 1).astype(np.int64), groups)
            whole = total[at[groups]]
            names = context[at[groups]]
            alone = model.parts(whole) == 1
            kept = alone & (np.add.reduceat(left_out_gain(sums, p[at], np.repeat(whole, width), np.repeat(once, width)), groups) / whole >= LEAST_GAIN)
            out.append(tail | {"v": int(kept.sum())})
            if not alone.all():
                part = np.repeat(~alone, width)
                held = (names[~alone], width[~alone], whole[~alone], sums[part], p[at][part])
                out += [tail | {"context": c, "n": k} for c, k in zip(held[0].view(np.int64).tolist(), once[~alone].tolist(), strict=True)]
                out.append(tail | {"split": pickle.dumps([_zip(a) for a in held])})
        begin = 0
        for i, r in enumerate(rows):
            own = tail | {"chunk": r["chunk"], "owner": r["owner"], "counts": _zip(counts[begin : begin + size[i]])}
            begin += size[i]
            if not depth:
                own["ids"] = _zip(ids[begin - size[i] : begin])
            else:
                g = np.searchsorted(names, heads[i])
                own |= {"once": _zip(once[g]), "kept": _zip(kept[g]), "p": r["p"] if depth > 1 else None}
            out.append(own)
        return pa.Table.from_pylist(out, schema=_schema(_TOLD))

    return answer


def _split_gains(level: Level):
    """Parts of split contexts -> what each gains, now that all its symbols seen once are known."""

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("split").to_pylist():
                names, width, whole, sums, p = (_unzip(a, kind) for a, kind in zip(pickle.loads(packed), (np.uint64, np.int64, np.int64, np.int64, np.float64), strict=True))
                once = level.once[np.searchsorted(level.context, names)]
                gain = np.add.reduceat(left_out_gain(sums, p, np.repeat(whole, width), np.repeat(once, width)), np.cumsum(width) - width)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(gain / whole)], names=["context", "gain"])

    return gains


def _split_level(told: DataFrame) -> tuple[Level, int]:
    """The split contexts of a level (at most 1 / SPLIT_SHARE rows), and the number of all that are kept."""
    kept = told.where("v is not null").agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
    rows = told.where("context is not null").groupBy("context").agg(F.sum("n").alias("once")).collect()
    context = np.array([r["context"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(context)
    level = Level(context[order], np.array([r["once"] for r in rows], np.int64)[order], np.zeros(len(rows), bool))
    if rows:
        gains = told.where("split is not null").select("split").mapInArrow(_split_gains(level), "context long, gain double").groupBy("context").agg(F.sum("gain").alias("gain")).collect()
        for r in gains:
            level.kept[np.searchsorted(level.context, np.int64(r["context"]).view(np.uint64))] = r["gain"] >= LEAST_GAIN
    return level, int(kept + level.kept.sum())


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of chunks that ask no more -> the wanted texts' scores."""
    for batch in batches:
        for packed in batch.column("s_docs").to_pylist():
            docs = pa.ipc.open_stream(packed).read_all().combine_chunks()
            yield from docs.filter(docs.column("wanted")).select(["doc_id", "n_tokens", "n_known", "base_score", "score"]).to_batches()


def _scored(rows: DataFrame, owners: int | None, depth: int | None) -> DataFrame:
    """Scores of the wanted ones of ``rows`` (doc_id, text, counted, wanted)."""
    model = Model(owners or owner_count(text_volume(rows), OWNER_BYTES))
    rounds = min(ROUNDS, max(1, model.owners // ROUND_OWNERS))
    sent = [_parted(rows.mapInArrow(_reader(model), _ASKED), rounds)]
    level, split, more = 0, Level(), True
    while more:
        told = []
        for k in range(rounds):
            asked = [s[rounds + k] for s in sent]
            answers = joined_parts(asked).groupBy("owner").applyInArrow(_answerer(model, level), _TOLD)
            told.append(materialize_parts(answers.withColumn("kind", F.expr(f"if(chunk is null, {rounds}, {_chunk_round(rounds)})")), "kind", rounds + 1))
            discard(*asked)
        totals = joined_parts([t[rounds] for t in told])
        more = depth is None or level < depth
        if not level:
            n, v = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
            model = Model(model.owners, n, v)
        else:
            split, kept = _split_level(totals)
            more &= kept > 0
        before, sent = sent, []
        for k in range(rounds):
            states, answers = [s[k] for s in before], [t[k] for t in told]
            heard = joined_parts(answers).select("chunk", "owner", "counts", "ids", "once", "kept", "p").groupBy("chunk")
            waiting = joined_parts(states).select("chunk", *(f"s_{c}" for c in _STATE)).groupBy("chunk")
            sent.append(_parted(waiting.cogroup(heard).applyInArrow(_next_level(model, level, split, more), _ASKED), rounds))
            discard(*states, *answers)
        discard(*(t[rounds] for t in told))
        level += 1
    scored = joined_parts([s[k] for s in sent for k in range(rounds)]).select("s_docs").mapInArrow(_scores, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def _chunk_round(rounds: int) -> str:
    """A chunk's round, by other bits of its hash than those that deal it to a partition."""
    return f"int(pmod(hash(chunk) div 65536, {rounds}))"


def _parted(sent: DataFrame, rounds: int) -> list[DataFrame]:
    """Chunks' states and then their questions, in tables of their own for each round, so that they go when they are answered."""
    kind = F.expr(f"if(owner is null, {_chunk_round(rounds)}, {rounds} + owner % {rounds})")
    return materialize_parts(sent.withColumn("kind", kind), "kind", 2 * rounds)


def score(documents: DataFrame, training: DataFrame, owners: int | None = None, depth: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of ``documents`` (doc_id, text).

    The tree is learned from the texts of ``training``; ``depth`` bounds its levels, which the divergence tests do otherwise.
    """
    asked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("counted"), F.lit(True).alias("wanted"))
    learned = training.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("counted"), F.lit(False).alias("wanted"))
    return _scored(asked.unionByName(learned), owners, depth)


def held_out_scores(documents: DataFrame) -> DataFrame:
    """Scores of all rows by a tree trained on those whose crc32(doc_id) mod 7 is not 2."""
    held_out = crc_bucket("doc_id", 7) == 2
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out).alias("counted"), F.lit(True).alias("wanted"))
    return _scored(rows, None, None).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
