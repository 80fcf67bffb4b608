"""Alignment of a text's tokens under two tokenizers, by diagonal run skipping over their end offsets.

Tokens of both sides are given by their end offsets in bytes. From an aligned place the two end arrays are
compared at the current index shift: stretches where token for token ends alike are jumped by exponential
probing (slices of 1, 2, 4 ... ends, then halved until the stretch's end is found). Where the ends differ, the group is
resolved locally, the side that ends first going on, until both end together; that sets the new shift.

How often two ids are linked is a matter of the whole corpus. Texts are packed into chunks; a chunk sends each of its distinct
id pairs once with its number of links, Spark sums them, finds the highest of each B id, and answers the
chunks' pairs. Groups of the sums are pairs of vocabulary entries, so no key grows with a source or with copies.

Defined results: texts that are null, empty, or whose tokens don't spell a space and the text (an unknown piece, a literal
U+2581) have no tokens: zeros and the empty string. Repeated rows are aligned and counted each. Texts of over
``SEGMENT`` characters are taken in segments that begin at single spaces, where both tokenizers start a token. Very long texts without any
space are encoded at once. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.frames import materialize, slices
from quantloom.llm.packing import _BYTE_CHARACTERS, _CLEAN_CUT, encode_words, leading_spaces

#: Characters of a text that are aligned at a time, and bytes of text in a chunk, about.
SEGMENT, CHUNK_BYTES = 1 << 20, 16 << 20
#: Bytes of a worker's memo of encoded words, about (emptied when full), and the longest word that it holds.
MEMO_BYTES, MEMO_WORD = 96 << 20, 64
_ENTRY_BYTES = 320


class TokenPair:
    """Two tokenizers, their tokens' bytes, and a memo of the words that both have encoded.

    Both begin a token at a single space between two visible characters, so the ids of " " and a text are those of " " and its words.
    """

    def __init__(self, byte_path: str, piece_path: str, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = {chr(c): b for b, c in _BYTE_CHARACTERS.items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = b"".join(bytes([byte_of[c]]) if c in byte_of else c.encode("latin-1") if ord(c) < 256 else c.encode() for c in token)
        self.leading = leading_spaces(self.a)
        self.bytes_b = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}
        self.memo_bytes, self.held = memo_bytes, 0
        self.listed = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"]

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode(self, texts: list[str], plain: bool = False) -> list[tuple[bytes, bytes]]:
        """The ids of " " and each of ``texts``, as 32-bit integers; none where a side doesn't spell them. ``plain`` ones are words, which A takes together."""
        if not texts:
            return []
        ids_a = encode_words(self.a, self.leading, texts) if plain else [array("I", x.ids).tobytes() for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        listed = self.b.encode(texts, num_threads=1)
        size_b = np.fromiter(map(len, listed), np.int64, len(listed))
        flat = np.fromiter(chain.from_iterable(listed), np.uint32, int(size_b.sum()))
        raw, edges = flat.tobytes(), np.append(0, 4 * np.cumsum(size_b)).tolist()
        ids_b = [raw[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
        own = [b" " + t.encode() for t in texts]
        ids = np.frombuffer(b"".join(ids_a), np.uint32)
        size_a = np.fromiter(map(len, ids_a), np.int64, len(ids_a)) // 4
        spelt = _spelt(self.bytes_a, self.length_a, ids, size_a, own) & _spelt(self.bytes_b, self.length_b, flat, size_b, own)
        return [pair if ok else (b"", b"") for pair, ok in zip(zip(ids_a, ids_b, strict=True), spelt.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of " " and each of ``texts``, on both sides; None where a side doesn't spell them."""
        split = [t.split(" ") for t in texts]
        if self.held > self.memo_bytes:
            self.memo.clear()
            self.held = 0
        new = [w for w in set().union(*split).difference(self.memo) if len(w) <= MEMO_WORD]
        plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        self.memo.update(dict.fromkeys(new))  # what has other spaces needs a closer look
        self.memo.update(zip(plain, self._encode(plain, True), strict=True))
        self.held += sum(map(len, new)) + _ENTRY_BYTES * len(new)
        out, get = [], self.memo.get
        for text, words in zip(texts, split, strict=True):
            found = list(map(get, words))
            if None in found:
                words = _CLEAN_CUT.split(text)
                found = [get(w) for w in words]
                odd = [i for i, x in enumerate(found) if x is None]
                for i, x in zip(odd, self._encode([words[i] for i in odd]), strict=True):
                    found[i] = x
            sides = tuple(zip(*found, strict=True))
            out.append(None if b"" in sides[0] else tuple(np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in sides))
        return out

    def groups_text(self, a: np.ndarray, b: np.ndarray, aligned: Alignment) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of the groups."""
        p, q = aligned.group_a, aligned.group_b
        sizes = [np.diff(x, prepend=0) for x in (p, q)]
        code = np.empty(len(a) + len(b), np.int64)
        place = [np.arange(len(a)) + np.repeat(q - sizes[1], sizes[0]), np.arange(len(b)) + np.repeat(p, sizes[1])]
        for at, ids, ends, mark in zip(place, (a, b), (p, q), (1, 2), strict=True):
            marks = np.zeros(len(ids), np.int64)
            marks[ends - 1] = mark
            code[at] = 3 * ids + marks
        return "".join(map(self.listed.__getitem__, code.tolist()))[:-1]


def _spelt(table: list[bytes], length: np.ndarray, ids: np.ndarray, size: np.ndarray, own: list[bytes]) -> np.ndarray:
    """Which of ``own`` are spelt by their ids (``size`` of them each): their bytes are as many, and equal."""
    total = np.append(0, np.cumsum(length[ids]))
    ends = np.cumsum(size)
    ok = total[ends] - total[ends - size] == np.fromiter(map(len, own), np.int64, len(own))
    kept = [x for x, good in zip(own, ok.tolist(), strict=True) if good]
    said = np.frombuffer(b"".join(map(table.__getitem__, ids[np.repeat(ok, size)].tolist())), np.uint8)
    wrong = np.flatnonzero(said != np.frombuffer(b"".join(kept), np.uint8))
    if len(wrong):
        at = np.searchsorted(np.cumsum(list(map(len, kept))), wrong, side="right")
        ok[np.flatnonzero(ok)[at]] = False
    return ok


@dataclass
class Alignment:
    """Groups, as the ends of their index ranges on both sides, and the linked token places."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _spread(first: list[int], length: list[int]) -> np.ndarray:
    """The numbers first, first + 1 ... of each stretch, ``length`` of them."""
    long = np.array(length, np.int64)
    return np.arange(int(long.sum())) + np.repeat(np.array(first, np.int64) - (np.cumsum(long) - long), long)


def align(ends_a: list[int], ends_b: list[int]) -> Alignment:
    """Groups and links of two tokenisations of the same bytes, given by their tokens' increasing end offsets."""
    runs: tuple[list[int], list[int], list[int]] = ([], [], [])  # stretches: places on both sides, length
    group_a, group_b, link_a, link_b = [], [], [], []  # what irregular groups hold
    i, j, n = 0, 0, len(ends_a)
    while i < n:
        x, y = ends_a[i], ends_b[j]
        if x == y:  # a stretch of the diagonal: probe 1, 2, 4 ... further, then halve
            k, width = 1, 1
            while (own := ends_a[i + k : i + k + width]) and own == ends_b[j + k : j + k + width]:
                k += len(own)
                width *= 2
            while width > 1:
                width //= 2
                if (own := ends_a[i + k : i + k + width]) and own == ends_b[j + k : j + k + width]:
                    k += len(own)
            runs[0].append(i), runs[1].append(j), runs[2].append(k)
            i, j = i + k, j + k
            continue
        while True:
            link_a.append(i), link_b.append(j)
            if x < y:
                i += 1
                x = ends_a[i]
            elif y < x:
                j += 1
                y = ends_b[j]
            else:
                break
        i, j = i + 1, j + 1
        group_a.append(i), group_b.append(j)
    on_a, on_b = _spread(runs[0], runs[2]), _spread(runs[1], runs[2])
    columns = [(on_a + 1, group_a), (on_b + 1, group_b), (on_a, link_a), (on_b, link_b)]
    groups_a, groups_b, links_a, links_b = (np.sort(np.concatenate((x, np.array(y, np.int64)))) for x, y in columns)
    return Alignment(groups_a, groups_b, links_a, links_b)


def segments(text: str, most: int) -> Iterator[str]:
    """The text, cut at single spaces (that are left out) into parts of about ``most`` characters."""
    begin = 0
    while len(text) - begin > most:
        found = _CLEAN_CUT.search(text, begin + most)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.end()
    yield text[begin:]


_PAIRS: dict[tuple[str, str], TokenPair] = {}


def _pair(byte_path: str, piece_path: str) -> TokenPair:
    key = (byte_path, piece_path)
    if key not in _PAIRS:
        _PAIRS[key] = TokenPair(*key)
    return _PAIRS[key]


@dataclass
class Document:
    """What a text's alignment says: numbers of tokens, groups and links, the groups' digest, distinct id pairs and their links."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: str = ""
    groups: list[str] | None = None
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    links: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def _merged(keys: list[np.ndarray], links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, slot = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, slot, np.concatenate(links))
    return own, total


def read_document(pair: TokenPair, text: str, coded: tuple[np.ndarray, np.ndarray] | None, with_groups: bool) -> Document:
    """The alignment of one text; ``coded`` are its ids where it is one segment."""
    out, hashed, keys, links, groups = Document(), hashlib.sha256(), [], [], []
    for n, part in enumerate(segments(text, SEGMENT)):
        own = coded if len(text) <= SEGMENT else pair.encode([part])[0]
        if own is None:
            return Document(groups=[] if with_groups else None)
        a, b = own
        aligned = align(np.cumsum(pair.length_a[a]).tolist(), np.cumsum(pair.length_b[b]).tolist())
        listed = pair.groups_text(a, b, aligned)
        hashed.update((";" * (n > 0) + listed).encode())
        if with_groups:
            groups += listed.split(";")
        distinct, count = np.unique(a[aligned.link_a] << 32 | b[aligned.link_b], return_counts=True)
        keys.append(distinct), links.append(count)
        if len(keys) > 16:
            distinct, count = _merged(keys, links)
            keys, links = [distinct], [count]
        out.n_a, out.n_b = out.n_a + len(a), out.n_b + len(b)
        out.n_groups, out.n_links = out.n_groups + len(aligned.group_a), out.n_links + len(aligned.link_a)
    out.keys, out.links = (keys[0], links[0]) if len(keys) == 1 else _merged(keys, links)
    out.digest, out.groups = hashed.hexdigest(), groups if with_groups else None
    return out


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(a.tobytes())


def _unzip(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


_CHUNK = "chunk long, docs binary, distinct binary, slots binary, links binary, pairs binary, sums binary"
_FIXED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _aligner(byte_path: str, piece_path: str, with_groups: bool):
    """Rows (doc_id, text) -> chunks: the documents' columns, their distinct pairs as places in the chunk's, and these with their links."""

    def packed(number: int, ids: list, documents: list[Document]) -> pa.RecordBatch:
        columns = {
            "doc_id": pa.array(ids, pa.int64()), **{c: pa.array([getattr(d, c) for d in documents], pa.int64()) for c in _FIXED[1:5]},
            "groups_sha256": pa.array([d.digest for d in documents], pa.string()),
        }
        if with_groups:
            columns["groups"] = pa.array([d.groups or [] for d in documents], pa.list_(pa.string()))
        rows, sink = pa.table(columns), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd"))) as out:
            out.write_table(rows)
        keys, links = np.concatenate([d.keys for d in documents]), np.concatenate([d.links for d in documents])
        own, slot = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(own), np.int64)
        np.add.at(sums, slot, links)
        values = [[number], [sink.getvalue().to_pybytes()], [_zip(np.array([len(d.keys) for d in documents], np.int64))], [_zip(slot.astype(np.uint32))], [_zip(links)], [_zip(own)], [_zip(sums)]]
        return pa.RecordBatch.from_arrays([pa.array(values[0], pa.int64()), *(pa.array(x, pa.binary()) for x in values[1:])], names=[c.split()[0] for c in _CHUNK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number, held = _pair(byte_path, piece_path), TaskContext.get().partitionId() << 32, 0
        ids: list = []
        documents: list[Document] = []
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                short = [k for k, t in enumerate(texts) if 0 < len(t) <= SEGMENT]
                coded = dict(zip(short, pair.encode([texts[k] for k in short]), strict=True))
                documents += [read_document(pair, t, coded.get(k), with_groups) if t else Document() for k, t in enumerate(texts)]
                ids += piece.column("doc_id").to_pylist()
                held += sum(map(len, texts))
                if held >= CHUNK_BYTES:
                    yield packed(number, ids, documents)
                    number, held, ids, documents = number + 1, 0, [], []
        if documents:
            yield packed(number, ids, documents)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks -> a row for each of their distinct id pairs."""
    for batch in batches:
        for chunk, pairs, sums in zip(batch.column("chunk").to_pylist(), batch.column("pairs").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            own, links = _unzip(pairs, np.int64), _unzip(sums, np.int64)
            for k in range(0, len(own), 1 << 16):
                part = own[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(links[k : k + len(part)])], names=["chunk", "pair", "links"])


def _finisher(names: list[str]):
    """A chunk and the corpus-wide counts of its pairs -> its documents' rows."""

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        (packed,) = left.to_pylist()
        rows = pa.ipc.open_stream(packed["docs"]).read_all()
        pair, count, best = (right.column(c).to_numpy() for c in ("pair", "links", "best"))
        order = np.argsort(pair)
        slots, links, distinct = _unzip(packed["slots"], np.uint32), _unzip(packed["links"], np.int64), _unzip(packed["distinct"], np.int64)
        row = np.repeat(np.arange(len(distinct)), distinct)
        n_best, total = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        np.add.at(n_best, row, links * best[order][slots])
        np.add.at(total, row, links * count[order][slots])
        return rows.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total)).select(names)

    return finish


def align_tokens(documents: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (and groups) of every row of ``documents`` (doc_id, text).

    A is the byte-level tokenizer of ``byte_path``, B the piece model of ``piece_path``.
    """
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = materialize(read.mapInArrow(_aligner(byte_path, piece_path, with_groups), _CHUNK))
    asked = chunks.select("chunk", "pairs", "sums").mapInArrow(_pairs, "chunk long, pair long, links long")
    sums = asked.groupBy("pair").agg(F.sum("links").alias("links")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    sums = materialize(sums)
    highest = sums.groupBy("b").agg(F.max("links").alias("most"))
    known = sums.join(highest, "b").select("pair", "links", F.expr("int(links = most)").alias("best"))
    answers = asked.select("chunk", "pair").join(known, "pair").select("chunk", "pair", "links", "best")
    names = [*_FIXED[:5], "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'array<string>' if c == 'groups' else 'long'}" for c in names)
    return chunks.select("chunk", "docs", "distinct", "slots", "links").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finisher(names), schema)
