"""Windows that repeat inside one document, rows that repeat a document, and hashes that are equal by chance."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import substring_dedup as sd
from quantloom.llm.frames import text_bytes
from quantloom.llm.words import SPACE, hash_words


def sent(rows, window=5, owners=3):
    """What one chunk sends: hashes to owners, and windows."""
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([hash(r[1]) for r in rows], pa.int64())], names=["doc_id", "text", "text_key"])
    out = [r for b in sd._sender(owners, window, 10**9)(iter([batch])) for r in b.to_pylist()]
    return sum(len(r["hashes"]) // 12 for r in out), sum(len(sd._unpack(r["places"])[0]) for r in out), sum(len(r["places"]) for r in out), out


def test_a_hash_is_sent_once_for_a_chunk():
    hashes, places, size, out = sent([(7, "same " * 20_000)])
    assert (hashes, places) == (1, 19_996) and size < 2_000
    row = next(r for r in out if r["hashes"])
    ids, _, starts, number = sd._unpack(row["places"])
    assert set(ids.tolist()) == {7} and starts.tolist() == list(range(19_996)) and not number.any()
    hashes, places, *_ = sent([(7, "a b c d e f g h")] * 1000)
    assert (hashes, places) == (4, 4)
    hashes, places, *_ = sent([(7, "a b c d e f g h"), (9, "a b c d e f g h")])
    assert (hashes, places) == (4, 8)


def brute(rows, window):
    seen = {}
    for i, t in rows:
        words = (t or "").split()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            seen[w] = min(seen.get(w, i), i)
    out = []
    for i, t in rows:
        words = (t or "").split()
        gone = {k + j for k in range(len(words) - window + 1) if seen[tuple(words[k : k + window])] < i for j in range(window)}
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [10, 10**6])
def test_repeats_equal_brute_force(spark, chunk):
    rng = random.Random(chunk)
    phrases = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(12)]
    rows = [(rng.randrange(12), " ".join(rng.choice(phrases) for _ in range(rng.randrange(0, 9)))) for _ in range(60)]
    rows += rows[:20] + [(3, "z " * 300), (5, "z " * 200), (5, "z " * 200), (1, ""), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS starts", "1 AS text_key", "2 AS owner").repartition(4)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in sd.remove_repeats(docs, 5, 3, chunk, with_text=True).collect())
    assert got == brute(rows, 5)


def test_equal_hashes_are_told_apart_by_their_checks():
    hashes = np.array([5, 5, 5, 9, 5, 9], np.uint64)
    checks = np.array([1, 2, 1, 7, 2, 7], np.uint32)
    assert sd._later(hashes, checks, np.array([4, 3, 2, 8, 6, 8])).tolist() == [True, False, False, False, True, False]
    words, rows = hash_words(*text_bytes(pa.array(["a b c d e f g", "b c d e f g h"])), SPACE)
    one, two = sd.window_hashes(words, 3, np.arange(len(words) - 2))
    assert (one[1], two[1]) == (one[7], two[7]) and len(set(two.tolist())) == len(set(one.tolist()))
