"""Sketches of shingle sets: what they exclude is no link, and what they and the marks hold back isn't shuffled."""

import random
from collections import Counter

import numpy as np
from test_llm_spark import brute_components

from quantloom.llm import near_dedup


def test_what_a_sketch_excludes_is_no_link():
    rng = np.random.default_rng(5)
    excluded = 0
    for n in (1, 2, 15, 16, 17, 64, 65, 300, 5000):
        base = rng.integers(0, 2**51, n).astype(np.uint64)
        for share in (0.0, 0.1, 0.15, 0.3, 1.0):
            other = np.where(rng.random(n) < share, rng.integers(0, 2**51, n).astype(np.uint64), base)
            a, b = np.unique(base), np.unique(other[: max(1, int(n * rng.uniform(0.6, 1)))])
            common = len(np.intersect1d(a, b))
            linked = 100 * common >= 75 * (len(a) + len(b) - common)
            for x, y in ((a, b), (b, a)):
                may = bool(near_dedup.may_be_linked(near_dedup.sketch(x), len(x), near_dedup.sketch(y)[None], np.array([len(y)]), 75)[0])
                assert may or not linked
                excluded += not may
    assert excluded > 30


def test_possible_links_of_a_cell_are_pairs_or_classes():
    sets = [np.arange(100 * i, 100 * i + 50, dtype=np.uint64) for i in range(5)] + [np.arange(2, 52, dtype=np.uint64)]
    cell = lambda root, sets: near_dedup.possible_links(np.array(root), np.full(len(root), 2), np.array([len(x) for x in sets]), [near_dedup.sketch(x) for x in sets], 75)
    keep, pairs = cell([1, 2, 3, 4, 5, 6], sets)
    assert pairs == [(0, 5)] and keep.tolist() == [True, False, False, False, False, True]
    keep, pairs = cell([1, 2, 3, 4, 5, 1], sets)
    assert not pairs and not keep.any()
    keep, pairs = cell([1, 2, 3, 4, 5, 6], [np.arange(i, 50 + i, dtype=np.uint64) for i in range(6)])
    assert not pairs and keep.all()


def test_unrelated_texts_and_sets_are_not_shuffled(spark):
    """Texts of one kind (equal beginnings, so that they share buckets) and many others, without broadcasts by size."""
    rng = random.Random(8)
    word = lambda: f"{rng.getrandbits(48):012x}"
    head = [word() for _ in range(60)]
    rows = [(i, " ".join([*head, *(word() for _ in range(90))])) for i in range(150)]
    rows += [(1000 + i, " ".join(word() for _ in range(400))) for i in range(450)]
    rows += [(3000 + i, rows[i][1] + " end") for i in range(0, 150, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()
    docs.count()
    stages = spark.sparkContext._jsc.sc().statusStore()

    def written() -> dict[int, int]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = stages.stageList(None, False, False, getattr(stages, "stageList$default$4")(), None)
        return {(found.apply(i).stageId()): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = set(written())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_dedup.near_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = sum(v for k, v in written().items() if k not in before)
    docs.unpersist()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows))
    assert moved < sum(len(text) for _, text in rows)
