"""Kernels without Spark, against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import golomb, packing, toxicity, words
from quantloom.llm.ann import MultiIndex, unit
from quantloom.llm.frames import slices, text_bytes
from quantloom.llm.license_scan import Scanner, SuffixAutomaton
from quantloom.llm.near_dedup import shingle_sets
from quantloom.llm.url_filter import DigestArray, digest_files

TEXTS = ["", " ", "a", "a b", "  a\tb\n\x0bc\x0c\rd ", "é ü\x1cx", None, "x" * 5000, "same same same", "ends with space "]


def test_words_match_bytes_split():
    data, at = text_bytes(pa.array(TEXTS, pa.string()))
    starts, ends, rows = words.split_words(data, at, words.SPACE)
    raw = data.tobytes()
    for i, t in enumerate(TEXTS):
        got = [raw[a:b] for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]], strict=True)]
        assert got == (t or "").encode().split()


def test_word_hashes_depend_on_content_only():
    one = words.hash_words(*text_bytes(pa.array(["b a", "a"])), words.SPACE)[0]
    assert one[1] == one[2] != one[0]


def test_rolling_hash_is_position_free():
    w = np.random.default_rng(0).integers(0, 2**63, 300, dtype=np.uint64)
    w[200:250] = w[20:70]
    h = words.roll(w, 50)
    assert h[200] == h[20] and len(np.unique(h)) == len(h) - 1
    assert len(words.roll(w[:10], 50)) == 0


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 7 + [None, ""])], names=["text"])
    assert sum(s.num_rows for s in slices(batch, "text", 25)) == 9
    assert list(slices(batch.slice(0, 0), "text")) == []


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_golomb_round_trip(n):
    span = 1 << 40
    v = np.unique(np.random.default_rng(n).integers(0, span, n))
    k, q, r = golomb.encode(v, span)
    assert (golomb.decode(len(v), k, q, r) == v).all()
    if n >= 100:
        assert len(q) + len(r) < 0.75 * 8 * n


def test_shingle_sets():
    texts = ["A b c d e f", "a B c d e f", "a b", "", None, "a b c d e " * 4]
    sets, bounds = shingle_sets(*text_bytes(pa.array(texts, pa.string())))
    own = [set(sets[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert own[0] == own[1] and [len(s) for s in own] == [2, 2, 1, 0, 0, 5]


def test_suffix_automaton_statistics_match_brute_force():
    rng = random.Random(4)
    templates = [[rng.randrange(4) for _ in range(30)] for _ in range(3)]
    automaton = SuffixAutomaton(templates)
    text = [rng.randrange(5) for _ in range(200)]
    grams = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for i, (long, state) in enumerate(automaton.statistics(text)):
        want = max((k for k in range(1, min(31, i + 2)) if tuple(text[i + 1 - k : i + 1]) in grams), default=0)
        assert long == want
        for t, end in automaton.where[state] if long else ():
            assert templates[t][end + 1 - long : end + 1] == text[i + 1 - long : i + 1]


def test_interrupted_template_is_chained():
    from quantloom.llm.license_scan import TEMPLATES, tokens

    scanner = Scanner()
    broken = TEMPLATES["bsd"][0].replace("permitted provided", "permitted REALLY provided").replace("met:", "")
    found = {scanner.names[t]: cover for t, _, _, cover in scanner.spans(tokens("before " + broken.lower() + " after").tolist())}
    assert found["bsd"] > 0.8 and all(c < 0.6 for n, c in found.items() if n != "bsd")


def test_best_fit_and_plan_place_every_piece():
    rng = np.random.default_rng(3)
    histogram = dict(Counter(rng.integers(1, 1025, 3000).tolist()))
    runs = packing.plan(histogram)
    used: Counter = Counter()
    loads: Counter = Counter()
    spans: dict[int, list] = {}
    for long, first, n, base, slots, offset in runs:
        assert used[long] == first and n % slots == 0
        used[long] += n
        for s in range(n // slots):
            loads[base + s] += slots * long
            spans.setdefault(base + s, []).append((offset, offset + slots * long))
    assert used == Counter(histogram) and max(loads.values()) <= 1024
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    bound = math.ceil(sum(k * v for k, v in histogram.items()) / 1024)
    assert len(loads) <= bound * 1.03
    assert packing.plan({}) == [] and packing.plan({1024: 3}) == [(1024, 0, 3, 0, 1, 0)]


def test_pricing_is_the_unbounded_knapsack():
    lengths, value = np.array([2, 3, 5]), np.array([0.2, 0.35, 0.5])
    best, choice = packing.price(lengths, value, 10)
    brute = max(0.2 * a + 0.35 * b + 0.5 * c for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= 10)
    assert best[10] == pytest.approx(brute)
    items = packing.configuration(2, lengths.tolist(), choice.tolist(), 10)
    assert 2 in items and sum(lengths[list(items)]) <= 10


def test_word_encoder_equals_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    encoder = packing.WordEncoder(public.path("byte_bpe_50k.json"), memo_words=20)
    texts = ["", " ", "a", " a", "a ", "a  b", "a \n b", "x\n\ny z", "don't 's 12  3", "　wide 　x y", "a\x1c b", "é <|endoftext|> x", "word " * 50]
    for _ in range(2):
        assert encoder.encode(texts) == [np.array(x.ids, np.uint32).tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_clause_grammar():
    a = toxicity.ClauseAutomaton(toxicity.Grammar())
    pay = lambda t: sum(a.clause(c)[0] for c in toxicity._CLAUSE.split(t))
    assert pay("You are an idiot") > pay("what an idiot") > pay("they said idiot there") > pay("not an idiot") > pay("a fine day") == 0
    assert pay("I will kill you") == pay("you I will kill") > 1 > pay("kill the lights")
    assert a.features(None) == a.features("") == (0.0,) * toxicity.N_FEATURES


def test_digest_array_longest_rule_and_collisions(tmp_path):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "b.org", "/")]
    d = DigestArray(*digest_files(rules, str(tmp_path)))
    assert d.judge([("www.example.org", "/es/1"), ("example.org", "/en"), ("borg", "/"), ("a.b.org", "/x"), ("org", ""), ("", "")]) == [
        ("example.org/es/", "block"), ("org/", "allow"), (None, None), ("b.org/", "block"), (None, None), (None, None),
    ]
    d.digests = np.sort(np.full(3, d.digests[0]))  # all digests collide: only equal strings count
    assert d.judge([("nowhere.net", "/")]) == [(None, None)]
    assert DigestArray(*digest_files([], str(tmp_path))).judge([("a", "/")]) == [(None, None)]


def test_walk_visits_cells_by_summed_distance():
    x = unit(np.random.default_rng(0).normal(size=(400, 8)))
    index = MultiIndex(x, 6)
    index.counts = np.bincount(index.cells(x), minlength=len(index.counts))
    one, two = (d[0] for d in index.distances(x[:1]))
    order = [c for c in index.walk(one, two, len(x))]
    cost = [one[c // len(two)] + two[c % len(two)] for c in order]
    assert cost == sorted(cost) and index.counts[order].sum() == len(x)
    assert index.counts[index.walk(one, two, 100)].sum() >= 100


def test_crc_of_piece():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
    assert re.fullmatch(r"\d+", "1")


def test_rules_of_one_place_and_mapped_strings(tmp_path):
    rules = [("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "a.b", "/x\ny"), ("allow", "ü", "")]
    d = DigestArray(*digest_files(rules, str(tmp_path)))
    assert d.judge([("a.b", "/x1"), ("a.b", "/x\nyz"), ("c.ü", "/"), ("b", "/x")]) == [("a.b/x", "block"), ("a.b/x\ny", "allow"), ("ü", "allow"), (None, None)]


def test_memo_of_long_words_stays_small():
    import public_tokenizers as public

    encoder = packing.WordEncoder(public.path("byte_bpe_50k.json"), memo_bytes=20_000)
    rng = random.Random(2)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdefgh+/") for _ in range(rng.choice([5, 3000]))) for _ in range(20)) for _ in range(3)]
        got = encoder.encode(texts)
        assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert not any(len(w) > packing.MEMO_WORD for w in encoder.memo) and sum(map(len, encoder.memo)) < 60_000
