"""Vectors of every length are indexed and answered among their own."""

import numpy as np

from quantloom.llm import ann


def test_two_vector_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(30)] + [(100 + i, rng.normal(size=5).tolist()) for i in range(20)] + [(200, [1.0]), (201, [2.0]), (300, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.nearest(table, table.where("vec_id in (0, 100, 200, 300)"), k=3).collect()
    own = lambda q: {r["vec_id"] for r in out if r["query_id"] == q}
    for q, low, high in ((0, 0, 30), (100, 100, 120)):
        x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if low <= i < high}
        assert own(q) == set(sorted((i for i in x if i != q), key=lambda i: -x[i] @ x[q])[:3])
    assert own(200) == {201} and own(300) == set()


def test_double_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(docs, docs.where("vec_id < 5"), share=1.0).collect())
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = [(q, k + 1, int(v)) for q in range(5) for k, v in enumerate([j for j in np.argsort(-(x[q] @ x.T), kind="stable") if j != q][:5])]
    assert got == want
