"""Every occurrence of a license notice has its span."""

import random
import time

import pytest

from quantloom.llm import license_scan
from quantloom.llm.license_scan import TEMPLATES, Scanner, tokens


def test_repeated_notice_has_several_spans():
    scanner = Scanner()
    mit = tokens(TEMPLATES["mit"][0].lower()).tolist()
    between = tokens("some words of another kind " * 20).tolist()
    found = [(first, end) for t, first, end, cover in scanner.spans([*mit, *between, *mit, *between, *mit]) if scanner.names[t] == "mit" and cover > 0.9]
    step = len(mit) + len(between)
    assert sorted(found) == [(i * step, i * step + len(mit)) for i in range(3)]
    once = scanner.spans(mit)
    assert [scanner.names[t] for t, _, _, cover in once if cover > 0.9] == ["mit"]


def test_many_notices_cost_in_proportion():
    scanner = Scanner()
    mit = tokens(TEMPLATES["mit"][0]).tolist()
    began = time.process_time()
    found = scanner.spans(mit * 20_000)
    assert time.process_time() - began < 5  # the search that began anew for each notice would take hours
    assert [(first, end) for t, first, end, cover in found if cover == 1 and t == 0] == [(k * len(mit), (k + 1) * len(mit)) for k in range(20_000)]


def test_chosen_chains_cover_most_without_overlap():
    rng = random.Random(8)
    for _ in range(100):
        chains = [(rng.randrange(1, 9), a := rng.randrange(40), a + rng.randrange(1, 12)) for _ in range(rng.randrange(1, 9))]
        chosen = license_scan.apart(chains)
        assert all(x[2] <= y[1] for x, y in zip(chosen, chosen[1:])) and set(chosen) <= set(chains)
        best = 0
        for mask in range(1 << len(chains)):
            own = sorted((c for i, c in enumerate(chains) if mask >> i & 1), key=lambda c: c[2])
            if all(x[2] <= y[1] for x, y in zip(own, own[1:])):
                best = max(best, sum(c[0] for c in own))
        assert sum(c[0] for c in chosen) == best


def test_runs_are_the_maximal_matches():
    rng = random.Random(2)
    templates = [[rng.randrange(5) for _ in range(30)] for _ in range(3)]
    automaton = license_scan.SuffixAutomaton(templates)
    words = [w for _ in range(12) for w in (rng.choice(templates)[3 : rng.randrange(6, 25)] + [rng.randrange(6)])]
    expected, before = [], (0, 0)
    for i, (long, state) in enumerate([*automaton.statistics(words), (0, 0)]):
        if long <= before[0] and before[0] >= 4:
            expected.append((i - before[0], *before))
        before = (long, state)
    assert automaton.runs(words, 4) == expected


def test_whole_texts_as_templates_and_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    body = [" ".join(rng.choice(["grant", "use", "copy", "work", "the", "of", "terms", "you", "must"]) + str(rng.randrange(300)) for _ in range(3000)) for _ in range(2)]
    (tmp_path / "Long-1.0.txt").write_text(body[0])
    (tmp_path / "Other-2.txt").write_text(body[1])
    templates = license_scan.read_templates(spark, str(tmp_path))
    assert templates == {"Long-1.0": [body[0]], "Other-2": [body[1]]}
    words = body[0].split()
    cut = " ".join(words[:1400] + ["inserted"] * 5 + words[1408:])
    rows = [(1, f"before {body[0]} between {body[1]} after {body[0]}"), (2, cut), (2, cut), (3, None), (4, ""), (None, " ".join(words[:500]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS labels", "1 AS score", "2 AS n_words")
    out = license_scan.scan_licenses(docs, with_spans=True, templates=templates).collect()
    assert sorted((r["doc_id"] or 0, r["labels"], len(r["spans"])) for r in out) == [(0, "", 0), (1, "Long-1.0,Other-2", 3), (2, "Long-1.0", 1), (2, "Long-1.0", 1), (3, "", 0), (4, "", 0)]
    with pytest.raises(ValueError, match="bytes"):
        license_scan.scan_licenses(docs, templates={"big": ["x" * (license_scan.MOST_TEMPLATE_BYTES + 1)]})
    assert license_scan.scan_licenses(docs.limit(0), templates=templates).count() == 0 and license_scan.scan_licenses(docs, templates={}).where("labels <> ''").count() == 0
