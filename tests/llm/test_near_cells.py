"""Cells of mixed buckets: counts of common shingles, spanning links, grids of several cells."""

import random
from collections import Counter

import numpy as np
from test_llm_spark import brute_components

from quantloom.llm import frames, near_dedup


def test_common_shingles_counts_every_pair():
    rng = np.random.default_rng(3)
    for shared in (5, 60, 4000):
        sets = [np.unique(rng.integers(0, shared, rng.integers(0, 50)).astype(np.uint64)) for _ in range(70)]
        rows, columns = np.arange(0, 70, 2), np.arange(70)
        got = near_dedup.common_shingles(sets, rows, columns)
        assert all(got[i // 2, j] == len(np.intersect1d(sets[i], sets[j])) for i in rows for j in columns if i != j)


def test_forest_joins_what_the_links_join():
    root = np.array([1, 1, 2, 3, 4])
    found = near_dedup.forest(root, np.array([0, 1, 3, 2, 0]), np.array([2, 2, 4, 3, 4]))
    assert len(found) == 3 and {x for pair in found for x in pair} == {1, 2, 3, 4}


def test_one_cloud_over_many_cells_equals_brute_force(spark):
    """Far and near copies of one short text: most pairs are candidates, few are links."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(30)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 3)):
            words[rng.choice((0, 1, 2, 12, 28, 29))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_groups(docs, cell_classes=7, cell_shingles=400).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows))


def test_hot_texts_and_leaders(spark, monkeypatch):
    """One text in half of the rows (with null ids too), and one cluster of near copies that all meet one leader."""
    monkeypatch.setattr(near_dedup, "LEADER_ROWS", 16)
    monkeypatch.setattr(frames, "HOT_SHARE", 20)
    base = [f"w{k}" for k in range(200)]
    rows = [(i % 300 if i % 3 else None, "one text that is everywhere in this table") for i in range(900)]
    rows += [(1000 + i, " ".join([*base[:i % 200], f"e{i}", *base[i % 200 + 1 :]])) for i in range(600)]
    rows += [(5000 + i, f"text {i} of its own kind with number {i * 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rows", "2 AS m", "'x' AS cls", "3 AS bucket").repartition(5)
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == len(rows)
    parts = Counter(r["component_id"] for r in got)
    assert parts[1] == 900 and parts[1000] == 600 and len(parts) == 302 and sum(r["kept"] for r in got if r["component_id"] == 1000) == 1
