"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark.

A chunk of documents hashes all its windows, settles repeats among its own documents and sends
each remaining hash once, packed, with the least document that holds it, to the owner of its hash range; further places of the same window
in that document only refer to it, and rows that repeat a document add nothing. The owner compares documents
across chunks and answers with the windows that start in a document with a smaller id too.
Repeated windows of a document merge into maximal intervals, which are cut out.

Defined results: words are runs of bytes other than ``[\\x20\\x09-\\x0D]``; a null text has no
words; a document with a null doc_id has no order and neither removes nor loses words; rows that
share a doc_id don't remove each other's words. Windows are judged on the input. Windows count as
equal when two hashes of them, by different values of the words, are: 96 bits in all, of which 64 pick the owner's candidates and 32
confirm them (among 10^13 windows fewer than one false match is expected). Tables may be empty and may carry any further columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.frames import dealt, materialize, owner_count, slices, text_bytes, text_volume
from quantloom.llm.words import SPACE, hash_words, mix, roll, run_bounds, runs_in_rows

WINDOW = 50
#: Windows that a task holds and compares at once before it sends them.
CHUNK_WINDOWS = 2_000_000
#: Bytes of text whose windows an owner holds, about.
OWNER_BYTES = 16 << 20

_SENT = "owner int, settled boolean, hashes binary, places binary"
_ANSWER = "bucket int, places binary"
_FOUND = "doc_id long, text_key long, starts binary"


_OTHER = np.uint64(0xA0761D6478BD642F)


def window_hashes(words: np.ndarray, width: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows' 64-bit hashes, and 32 bits of hashes over other values of the words."""
    return roll(words, width)[at], (roll(mix(words ^ _OTHER), width)[at] >> np.uint64(32)).astype(np.uint32)


def _pack(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, fresh: np.ndarray | None = None, refs: np.ndarray | None = None) -> bytes:
    """Document runs and window starts (document by document) in few bytes; whether a window is the first of its hash, and else which hash it has."""
    head = np.concatenate((run_bounds(ids * np.int64(31) ^ keys), [len(ids)]))
    at = head[:-1]
    fresh = np.ones(len(ids), bool) if fresh is None else fresh
    refs = np.empty(0, np.int32) if refs is None else refs.astype(np.int32)
    parts = [np.array([len(at), len(ids)], np.int64), ids[at], keys[at], np.diff(head).astype(np.int64), np.diff(starts, prepend=0).astype(np.int32), np.packbits(fresh), refs]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """Ids, keys and starts of the windows, and the number of each one's hash."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    m, n = np.frombuffer(raw, np.int64, 2).tolist()
    ids, keys, long = (np.frombuffer(raw, np.int64, m, 16 + 8 * m * i) for i in range(3))
    at = 16 + 24 * m
    starts = np.cumsum(np.frombuffer(raw, np.int32, n, at), dtype=np.int64)
    bits = -(-n // 8)
    fresh = np.unpackbits(np.frombuffer(raw, np.uint8, bits, at + 4 * n), count=n).astype(bool)
    number = np.cumsum(fresh) - 1
    number[~fresh] = np.frombuffer(raw[at + 4 * n + bits :], np.int32)
    return np.repeat(ids, long), np.repeat(keys, long), starts, number


def _ordered(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash and check, and where the runs of equal ones begin in it."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    again = np.flatnonzero((h[1:] == h[:-1]) & (c[1:] != c[:-1]))
    if len(again):  # hashes that are equal by chance: rare
        order = order[np.lexsort((c, h))]
        h, c = hashes[order], checks[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return order, np.flatnonzero(fresh)


def _later(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """True where the same window belongs to a smaller id as well."""
    order, bounds = _ordered(hashes, checks)
    out = np.empty(len(ids), bool)
    if len(ids):
        least = np.minimum.reduceat(ids[order], bounds)
        out[order] = ids[order] > np.repeat(least, np.diff(np.append(bounds, len(ids))))
    return out


def _sender(owners: int, window: int, chunk_windows: int):
    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0, *(len(p[3]) for p in parts)])
        hashes, checks, starts = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 5))
        doc = np.concatenate([p[2] + b for p, b in zip(parts, base[:-1].astype(np.int32), strict=True)])
        ids, keys = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
        parts.clear()
        later = _later(hashes, checks, ids[doc])
        rows = []
        if later.any():
            at = np.flatnonzero(later)
            x = doc[at]
            rows.append((int(hashes[0] % np.uint64(owners)), True, b"", _pack(ids[x], keys[x], starts[at])))
        left = np.flatnonzero(~later)
        # Of the windows that are left, equal ones lie in documents of one id: the first stands for all.
        order, bounds = _ordered(hashes[left], checks[left])
        first = np.empty(len(left), np.int64)
        first[order] = np.repeat(order[bounds], np.diff(np.append(bounds, len(left)))) if len(left) else 0
        own = np.arange(len(left))
        again = np.flatnonzero(first != own)
        if len(again):  # rows that repeat a document have the same windows at the same places
            place = np.stack((ids[doc[left]], keys[doc[left]], starts[left].astype(np.int64)))
            same = (place[:, again] == place[:, first[again]]).all(0)
            _, once = np.unique(np.column_stack((first[again], place[:, again].T))[~same], axis=0, return_index=True)
            stay = np.ones(len(left), bool)
            stay[again] = False
            stay[again[np.flatnonzero(~same)[once]]] = True
            keep = np.flatnonzero(stay)
        else:
            keep = own
        owner = ((hashes[left[keep]] >> np.uint64(40)) * np.uint64(owners) >> np.uint64(24)).astype(np.uint32)
        keep = keep[np.argsort(owner, kind="stable")]
        edges = np.append(0, np.cumsum(np.bincount(owner, minlength=owners)))
        number = np.empty(len(left), np.int32)
        for o in range(owners):
            x = keep[edges[o] : edges[o + 1]]
            if len(x):
                fresh = first[x] == x
                sent = left[x[fresh]]
                number[x[fresh]] = np.arange(len(sent))
                at = left[x]
                packed = hashes[sent].tobytes() + checks[sent].tobytes()
                rows.append((o, False, packed, _pack(ids[doc[at]], keys[doc[at]], starts[at], fresh, number[first[x[~fresh]]])))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["owner", "settled", "hashes", "places"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                words, rows = hash_words(*text_bytes(piece.column("text")), SPACE)
                at, row = runs_in_rows(rows, window)
                if len(at):
                    ids, keys = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
                    parts.append((*window_hashes(words, window, at), row.astype(np.int32), ids, keys, (at - rows[row]).astype(np.int32)))
                    held += len(at)
                if held >= chunk_windows:
                    yield from flush(parts)
                    held = 0
        if parts:
            yield from flush(parts)

    return send


def _answerer(buckets: int):
    def answer(group: pa.Table) -> pa.Table:
        """All windows of one hash range -> those that a document with a smaller id has too, dealt by document."""
        done, hashes, checks, open_ = [], [], [], []
        for settled, own, places in zip(*(group.column(c) for c in ("settled", "hashes", "places")), strict=True):
            found = _unpack(places.as_py())
            if settled.as_py():
                done.append(found[:3])
            else:
                raw = own.as_py()
                n = len(raw) // 12
                hashes.append(np.frombuffer(raw, np.uint64, n)), checks.append(np.frombuffer(raw, np.uint32, n, 8 * n))
                open_.append(found)
        if hashes:
            ids, begin = [], 0
            for own_ids, _, _, number in open_:  # each hash's document is that of the first window that has it
                own = np.empty(int(number.max()) + 1, np.int64)
                own[number[::-1]] = own_ids[::-1]
                ids.append(own)
            later = _later(np.concatenate(hashes), np.concatenate(checks), np.concatenate(ids))
            for found, own in zip(open_, ids, strict=True):
                mark = later[begin : begin + len(own)][found[3]]
                begin += len(own)
                done.append(tuple(x[mark] for x in found[:3]))
        ids, keys, starts = (np.concatenate(x) for x in zip(*done, strict=True))
        bucket = (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((starts, keys, ids, bucket))
        edges = np.append(run_bounds(bucket[order]), len(order))
        rows = [(int(bucket[x[0]]), _pack(ids[x], keys[x], starts[x])) for x in (order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)) if len(x)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "places": pa.array([r[1] for r in rows], pa.binary())})

    return answer


def _by_document(group: pa.Table) -> pa.Table:
    """One bucket of documents -> each document's repeated windows from all owners."""
    ids, keys, starts = (np.concatenate(x) for x in zip(*(_unpack(x.as_py())[:3] for x in group.column("places")), strict=True))
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts = ids[order], keys[order], starts[order].astype(np.int32)
    fresh = np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1])) if len(ids) else np.empty(0, bool)
    ids, keys, starts = ids[fresh], keys[fresh], starts[fresh]  # repeated rows tell the same
    edges = np.append(run_bounds(ids * np.int64(31) ^ keys), len(ids))
    cut = [starts[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"doc_id": pa.array(ids[edges[:-1]], pa.int64()), "text_key": pa.array(keys[edges[:-1]], pa.int64()), "starts": pa.array(cut, pa.binary())})


def repeated_windows(documents: DataFrame, window: int = WINDOW, owners: int | None = None, chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """doc_id, text_key and packed 32-bit word starts of the windows that a smaller doc_id has as well."""
    owners = owners or owner_count(text_volume(documents), OWNER_BYTES)
    docs = documents.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sent = docs.mapInArrow(_sender(owners, window, chunk_windows), _SENT)
    answers = dealt(sent, "owner", owners).groupBy("owner").applyInArrow(_answerer(owners), _ANSWER)
    return dealt(answers, "bucket", owners).groupBy("bucket").applyInArrow(_by_document, _FOUND)


def _cutter(window: int, with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digests, kept_texts = [], [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                starts = starts.as_py()
                if starts:
                    s = np.frombuffer(starts, np.int32)
                    edge = np.bincount(s, minlength=len(words) + 1) - np.bincount(s + window, minlength=len(words) + 1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone.append(total[-1] - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())] + [pa.array(kept_texts, pa.string())] * with_text,
                names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text,
            )

    return cut


def remove_repeats(documents: DataFrame, window: int = WINDOW, owners: int | None = None, chunk_windows: int = CHUNK_WINDOWS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row of ``documents`` (doc_id, text)."""
    found = materialize(repeated_windows(documents, window, owners, chunk_windows))
    starts = found.select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "starts")
    docs = documents.select("doc_id", "text")
    joined = docs.join(starts, (F.col("doc_id") == F.col("f_id")) & (F.xxhash64("text") == F.col("f_key")), "left").select("doc_id", "text", "starts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_cutter(window, with_text), schema)
