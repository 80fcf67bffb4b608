"""Repeated ids, clashing columns."""

import numpy as np

from quantloom.llm import ann


def test_a_repeated_id_is_one_vector(spark):
    rows = [(i % 10, [float(i % 7 + 1), float(i % 3), 1.0], i, "x") for i in range(60)] + [(50 + i, [1.0, float(i), 2.0], i, None) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, entry int, h string").repartition(3)
    out = ann.nearest(table, table.where("vec_id = 0"), k=5, share=1.0).collect()
    least = {}
    for i, v, *_ in rows:
        least[i] = min(least.get(i, v), v)
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = sorted((-round(sum(a * b for a, b in zip(least[0], v, strict=True)) / norm(v) / norm(least[0]), 9), i) for i, v in least.items() if i != 0)[:5]
    assert [(-round(r["score"], 9), r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == want


def test_the_walk_is_short_where_neighbours_are_near():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(100, 16))
    near = ann.unit(np.repeat(centres, 20, axis=0) + 0.05 * rng.normal(size=(2000, 16)))
    near = near[rng.permutation(len(near))]
    far = ann.unit(rng.normal(size=(2000, 16)))
    shares = [ann.MultiIndex(x, 13).needed_share(x, 5) for x in (near, far)]
    assert shares[0] < 0.05 < 0.2 < shares[1] <= 1
