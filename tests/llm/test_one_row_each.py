"""The dropping stages leave one row of a group, whatever its ids."""

from quantloom.llm import exact_dedup, near_dedup

LONG = " ".join(f"w{i}" for i in range(60))


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_exact_stage_leaves_one_row(spark):
    rows = [(1, "alone", "a"), *[(2, "replayed", "b")] * 5, (3, "one two", "c"), (3, "one  two", "c"), *[(None, "nobody", "d")] * 2, (None, None, "e"), (None, "", "e")]
    out = exact_dedup.drop_exact_copies(documents(spark, rows))
    assert out.columns == ["doc_id", "text", "source"]
    found = rows_of(out)
    assert len(found) == 5 and {(1, "alone", "a"), (2, "replayed", "b"), (3, "one  two", "c"), (None, "nobody", "d")} < set(found)


def test_near_stage_leaves_one_row(spark):
    other = " ".join(f"x{i}" for i in range(60))
    rows = [(1, "alone in five different words", "a"), *[(2, LONG, "b")] * 4, (2, LONG + " more", "b"), (2, other, "b"), (None, LONG.upper().replace("W", "n"), "d"), (None, LONG.replace("w", "n"), "d"), (8, "", "e"), (9, "", "e")]
    found = rows_of(near_dedup.drop_near_copies(documents(spark, rows)))
    texts = [t for _, t, _ in found]
    assert len(found) == 6 and LONG + " more" in texts and other in texts and texts.count("") == 2
    assert [i for i, _, _ in found].count(None) == 1
