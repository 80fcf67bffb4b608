"""Contexts of the suffix tree are found by what they count, not by their share of the corpus."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quantloom.llm import suffix_tree_lm


def test_well_supported_context_of_a_large_corpus_is_a_state(spark):
    rng = np.random.default_rng(0)
    fill = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, 10_000))) for i in range(40)]
    clear = [(100 + i, "rare sure") for i in range(12)]  # 12 of 400,000 tokens: fewer than one in 2^14
    training = spark.createDataFrame(fill + clear, "doc_id long, text string").repartition(3)
    out = suffix_tree_lm.score(spark.createDataFrame([(1, "w1 rare sure"), (2, "w1 w2 w3")], "doc_id long, text string"), training).collect()
    gain = {r["doc_id"]: r["score"] - r["base_score"] for r in out}
    assert gain[1] > 3 and abs(gain[2]) < 1


def brute_scores(training, texts):
    """The model by dictionaries: log10 probabilities of the texts, kept contexts of each level, and P(x | text so far) as a function."""
    lm = suffix_tree_lm
    tokens = lambda t: [*(t or "").lower().split(), "</s>"]
    train = [tokens(t) for t in training]
    count = Counter(w for ws in train for w in ws)
    n, v = sum(count.values()), len(count)
    levels = []  # per depth: {context: (total, once, {x: n})} of the kept ones

    def context(ws, i, d):
        return tuple(["<s>", *ws][i + 1 - d : i + 1]) if i >= d - 1 else None

    def probability(ws, i, depth):
        p = (count[ws[i]] + 1) / (n + v + 1)
        for d in range(1, depth + 1):
            if context(ws, i, d) not in levels[d - 1]:
                break
            total, once, seen = levels[d - 1][context(ws, i, d)]
            c = seen.get(ws[i], 0)
            p = ((c if c >= 2 else 0) + (lm.KAPPA + once) * p) / (total + lm.KAPPA)
        return p

    candidates = None
    while True:
        d = len(levels) + 1
        seen, suffix = defaultdict(Counter), {}
        for ws in train:
            for i in range(len(ws)):
                s = context(ws, i, d)
                if s is None or d > 1 and (s[1:] not in levels[-1] or s[:-1] not in candidates):
                    continue
                seen[s][ws[i]] += 1
                suffix[s, ws[i]] = probability(ws, i, d - 1)
        candidates = {s: c for s, c in seen.items() if sum(c.values()) >= lm.LEAST_COUNT}
        kept = {}
        for s, c in candidates.items():
            total, once = sum(c.values()), sum(x == 1 for x in c.values())
            gain = 0.0
            for x, k in c.items():
                p = suffix[s, x]
                left = k - 1 if k >= 3 else 0
                again = once + (1 if k == 2 else -1 if k == 1 else 0)
                gain += k * math.log((left + (lm.KAPPA + again) * p) / (total - 1 + lm.KAPPA) / p)
            if gain / total >= lm.LEAST_GAIN:
                kept[s] = (total, once, c)
        if not kept:
            break
        levels.append(kept)
    score = lambda t: sum(math.log10(probability(ws, i, len(levels))) for ws in [tokens(t)] for i in range(len(ws)))
    return [score(t) for t in texts], [len(k) for k in levels], lambda ws, i: probability(ws, i, len(levels)), sorted(count)


def made_texts(seed, number):
    """Words whose successor hangs on one, two or three words before, among others that hang on nothing."""
    rng = random.Random(seed)
    out = []
    for _ in range(number):
        words = []
        for _ in range(rng.randrange(0, 12)):
            a = rng.choice("xyz")
            words += rng.choice([["k", "only"], [a, "m", {"x": "p", "y": "q", "z": "r"}[a]], [a, "s", "t", a.upper()], [f"f{rng.randrange(30)}"] * rng.randrange(1, 3)])
        out.append(" ".join(words))
    return out


def test_scores_equal_brute_force(spark):
    training = [*made_texts(1, 250), None, "", "only once here"]
    texts = [*made_texts(2, 60), None, "", "never seen words", "x m p x m q", "k only " * 3000]
    want, kept, probability, vocabulary = brute_scores(training, texts)
    assert len(kept) >= 3 and kept[0] < len(vocabulary)  # several lengths of contexts, and the test rejects some
    rows = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(rows(texts), rows(training), owners=3).collect()}
    assert len(got) == len(texts) and all(abs(got[i] - w) <= 1e-5 + 1e-6 * abs(w) for i, w in enumerate(want))
    for before in (["x", "m"], ["y", "s", "t"], ["k"], [], ["nowhere"]):
        unknown = probability([*before, "unknown"], len(before))
        assert abs(sum(probability([*before, x], len(before)) for x in vocabulary) + unknown - 1) < 1e-9


def test_split_contexts_and_small_chunks_change_nothing(spark):
    training, texts = made_texts(1, 250), made_texts(2, 40)
    rows = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(3)
    whole = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(rows(texts), rows(training), owners=1).collect()}
    for owners in (3, 9, 40):  # with several owners frequent contexts are split
        split = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(rows(texts), rows(training), owners=owners).collect()}
        assert all(abs(whole[i] - split[i]) < 1e-6 * (1 + abs(whole[i])) for i in whole)


def test_counts_of_over_32_bits():
    lm = suffix_tree_lm
    many = 2_000_000_000
    ask = {"x": np.array([7], np.uint64).tobytes(), "n": lm._zip(np.array([many])), "owner": 0, "contexts": None, "runs": None, "totals": None, "p": None}
    told = lm._answerer(lm.Model(1), 0)(pa.Table.from_pylist([ask | {"chunk": c} for c in "ab"], schema=lm._schema("owner int, chunk string, x binary, n binary, contexts binary, runs binary, totals binary, p binary"))).to_pylist()
    assert [r["n"] for r in told if r["chunk"] is None] == [2 * many]
    assert [lm._unzip(r["counts"], np.int64).tolist() for r in told if r["chunk"]] == [[2 * many]] * 2
    context = np.array([9], np.uint64)
    ask |= {"x": lm._zip(np.array([7], np.uint64)), "contexts": lm._zip(context), "runs": lm._zip(np.array([1])), "totals": lm._zip(np.array([3 * many])), "p": lm._zip(np.array([50]))}
    told = lm._answerer(lm.Model(1, 10**12, 5), 1)(pa.Table.from_pylist([ask | {"chunk": c} for c in "abc"], schema=lm._schema("owner int, chunk string, x binary, n binary, contexts binary, runs binary, totals binary, p binary"))).to_pylist()
    assert [lm._unzip(r["counts"], np.int64).tolist() for r in told if r["chunk"]] == [[3 * many]] * 3 and lm._unzip(told[-1]["kept"], np.bool_).all()


def test_a_states_probabilities_sum_to_one(spark):
    training = made_texts(4, 200)
    _, _, probability, vocabulary = brute_scores(training, [])
    befores = [b.split() for b in ("x m", "y s t", "k", "")]
    words = [*(w for w in vocabulary if w != "</s>"), "unknown"]
    asked = [(k, w, [*b, *([w] if w else [])]) for k, b in enumerate(befores) for w in [None, *words]]
    rows = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(3)
    scored = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(rows([" ".join(ws) for _, _, ws in asked]), rows(training), owners=5).collect()}
    sums = [0.0] * len(befores)
    for i, (k, _, ws) in enumerate(asked):  # what follows ``before`` is a word or the end; the others' factors are taken out
        own, ended = len(befores[k]), [*ws, "</s>"]
        sums[k] += 10 ** (scored[i] - sum(math.log10(probability(ended, j)) for j in range(len(ended)) if j != own))
    assert all(abs(x - 1) < 1e-5 for x in sums)


def test_odd_rows_and_columns(spark):
    rows = [(1, "a b " * 100_000, 1, "x"), (1, "a b " * 100_000, 2, "y"), (None, None, None, None), (2, "", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counted int, chunk string")
    out = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in suffix_tree_lm.held_out_scores(docs).collect())
    assert out == [(0, 1), (1, 200_001), (1, 200_001), (2, 1)]


def test_each_round_removes_what_it_has_read(spark, monkeypatch):
    lm, calls = suffix_tree_lm, []
    write, remove = lm.materialize_parts, lm.discard
    monkeypatch.setattr(lm, "materialize_parts", lambda df, by, parts: calls.append(parts) or write(df, by, parts))
    monkeypatch.setattr(lm, "discard", lambda *tables: calls.append("removed") or remove(*tables))
    rows = spark.createDataFrame(list(enumerate(made_texts(3, 20))), "doc_id long, text string")
    assert lm.score(rows, rows, owners=2 * lm.ROUND_OWNERS, depth=1).count() == 20
    assert calls[1:] == 2 * ([3, "removed"] * 2 + [4, "removed"] * 2 + ["removed"]) and "p" not in lm._STATE
