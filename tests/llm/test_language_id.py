import numpy as np
from pyspark.sql import functions as F

from quantloom.llm import language_id as li
from quantloom.llm.frames import text_bytes
from quantloom.llm.registry import QUERIES


def test_held_out_accuracy(spark):
    out = QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = out.join(documents.select("doc_id", "lang"), "doc_id").agg(F.count("*").alias("n"), F.avg(F.expr("if(held_out, int(lang = lang_pred), null)")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert joined["n"] == documents.count() and joined["right"] > 0.98 and 0 <= joined["low"] <= joined["high"] <= 1


def test_defined_results(spark):
    rows = [(k, ("the cat and the dog " if k % 2 else "le chat et le chien ") * 3, ("en", "fr")[1 - k % 2], "x") for k in range(60)]
    rows += [(100, None, "en", "x"), (101, "", "fr", None), (102, "123 ... 456", None, "x"), (103, "the dog and " * 30000, None, None), (103, "the dog and " * 30000, None, None), (None, "le chien et", None, "x"), (104, "é", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumn("held_out", F.lit("clash"))
    out = li.held_out_languages(df).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[k]["lang_pred"] == ("en", "fr")[1 - k % 2] for k in range(60))
    assert {by_id[k]["lang_pred"] for k in (100, 101, 102)} == {"und"} and {by_id[k]["score"] for k in (100, 101, 102)} == {0.0}
    assert by_id[103]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "fr" and by_id[104]["lang_pred"] in ("en", "fr")
    assert li.held_out_languages(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in li.held_out_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_windows_cover_every_run_of_bytes():
    import pyarrow as pa

    texts = ["", "a", "b" * li.WINDOW, "c" * (li.WINDOW + 1), "d" * 1000]
    data, at = text_bytes(pa.array(texts))
    begin, row = li.windows_of(data, at)
    for r, text in enumerate(texts):
        own = begin[row == r] - at[r]
        for start in range(max(len(text) - 3, 0)):
            assert ((own <= start) & (start + 4 <= own + li.WINDOW)).any()
        assert bool(text) == bool(len(own))


def test_filters_see_their_width_only():
    rng = np.random.default_rng(1)
    x = rng.integers(97, 122, (120, li.WINDOW)).astype(np.uint8)
    y = np.arange(120) % 2
    for place in (20, 50, 120):
        x[y == 1, place : place + 2] = (0xC3, 0xA9)
    net = li.train(x, y, ["a", "b"])
    assert (net.filters[2 * li.EMBEDDING :, : li.FILTERS] == 0).all()
    assert (net.predict(x).argmax(1) == y).mean() > 0.95
    moved = np.roll(x, 37, axis=1)
    assert (net.predict(moved).argmax(1) == y).mean() > 0.95
