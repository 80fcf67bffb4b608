"""Further columns of any name stay; repeated rows are drawn together; small and large blocks draw the same."""

from collections import Counter

from quantloom.llm import mixing


def test_clashing_columns(spark):
    names = "weight passes repeats last_at last at block times mix_tokens mix_order row tokens rest edge w_source e_block running before share z n_tokens documents".split()
    rows = [(i, f"some words {i}", "ab"[i % 3 == 0], *range(len(names))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.mix(docs)
    assert out.columns == [c for c in docs.columns if not c.startswith("mix_")] + ["mix_tokens", "mix_weight", "mix_epoch", "mix_order"]
    found = out.collect()
    assert found and all(r["weight"] == 0 and r["z"] == names.index("z") and r["mix_tokens"] == 3 for r in found)


def test_repeated_rows_and_blocks(spark):
    rows = [(i % 50, "w " * (1 + i % 7), "a") for i in range(150)] + [(1000 + i, "w " * 5, "b") for i in range(30)] + [(7, "hot row", "c")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    draws = [Counter((r["doc_id"], r["text"], r["source"], r["mix_epoch"]) for r in mixing.mix(docs, block_bits=b).collect()) for b in (1, 3, 11)]
    assert draws[0] == draws[1] == draws[2]
    repeats = Counter(rows)
    assert all(n == repeats[k[:3]] for k, n in draws[0].items())
