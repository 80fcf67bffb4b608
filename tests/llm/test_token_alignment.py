import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from quantloom.llm import token_alignment as ta

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def pair():
    return ta.TokenPair(BYTE, PIECE)


def brute(pair, rows):
    """Whole texts through both tokenizers, all pairs of tokens compared by their byte ranges."""
    told, counts = {}, Counter()
    for doc_id, text in rows:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
            told[doc_id] = ([], [], "")
            continue
        places = []
        for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
            end, own = 0, []
            for i in ids:
                own.append((end, end + len(table[i])))
                end = own[-1][1]
            places.append(own)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(places[0]) for j, (t, f) in enumerate(places[1]) if s < f and t < e]
        counts.update(links)
        cuts = sorted({e for _, e in places[0]} & {e for _, e in places[1]})
        groups, i, j = [], 0, 0
        for c in cuts:
            p, q = sum(e <= c for _, e in places[0]), sum(e <= c for _, e in places[1])
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        told[doc_id] = (groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest(), len(a), len(b))
    most: dict[int, int] = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = {}
    for doc_id, (groups, links, digest, *sizes) in told.items():
        out[doc_id] = (*(sizes or (0, 0)), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
    return out


def odd_texts():
    rng = random.Random(3)
    pieces = ["a", " ", "  ", "\n", "\t", "é", "日本", "🙂", "<|endoftext|>", "<s>", "<0x41>", "'s", "don't", "123", "…", "word", "\x1c", "x\u0085y", " ", "zz" * 40]
    return ["", None, " ", "  lead", "trail  ", "a▁b", "plain words here", *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(120))]


def test_equals_brute_force(spark, pair):
    texts = [r["text"][:1500] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()] + odd_texts()
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS chunk", "1 AS pair", "2 AS links").repartition(3)
    found = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in ta.align_tokens(df, BYTE, PIECE).collect()}
    assert found == brute(pair, rows)


def test_repeated_rows_groups_and_empty_tables(spark, pair):
    rows = [(1, "the same text"), (1, "the same text"), (None, "another"), (2, None)]
    out = ta.align_tokens(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, PIECE, with_groups=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"] > 0) for r in out) == [(0, True), (1, True), (1, True), (2, False)]
    for r in out:
        assert r["n_groups"] == len(r["groups"]) and (not r["groups"] or r["groups_sha256"] == hashlib.sha256(";".join(r["groups"]).encode()).hexdigest())
    assert ta.align_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTE, PIECE).count() == 0


def test_runs_are_skipped_and_groups_kept():
    rng = random.Random(4)
    for _ in range(200):
        size = rng.randrange(1, 80)
        sides = [sorted({*rng.sample(range(1, size), rng.randrange(size)), size}) if size > 1 else [1] for _ in range(2)]
        if rng.random() < 0.5:
            sides[1] = sorted({*sides[0], rng.randrange(1, size + 1)})
        aligned = ta.align(*sides)
        assert [sides[0][p - 1] for p in aligned.group_a] == sorted({*sides[0]} & {*sides[1]}) == [sides[1][q - 1] for q in aligned.group_b]
        starts = [[0, *s[:-1]] for s in sides]
        expected = [(i, j) for i, e in enumerate(sides[0]) for j, f in enumerate(sides[1]) if starts[0][i] < f and starts[1][j] < e]
        assert list(zip(aligned.link_a.tolist(), aligned.link_b.tolist(), strict=True)) == expected


def test_long_texts_in_segments(pair, monkeypatch):
    text = " ".join(f"word{k} ,of  a\ntext" for k in range(3000))
    whole = ta.read_document(pair, text, pair.encode([text])[0], True)
    monkeypatch.setattr(ta, "SEGMENT", 500)
    cut = ta.read_document(pair, text, None, True)
    assert (whole.digest, whole.groups, whole.n_links, whole.keys.tolist(), whole.links.tolist()) == (cut.digest, cut.groups, cut.n_links, cut.keys.tolist(), cut.links.tolist())
