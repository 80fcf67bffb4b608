"""Rows that stages and operators have to bear: nulls, empty and very long texts, repeated rows, no rows, clashing columns."""

import pytest

import corpus_pipeline
from quantloom.llm import url_filter
from quantloom.llm.registry import URL_RULES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["'x' AS kept", "1 AS component", "2 AS owner", "3 AS chunk", "'y' AS piece"]


def odd_documents(spark):
    story = " ".join(f"word{k % 97} of story{k}" for k in range(60))
    rows = [(k, f"{story} told as number {k} of them all {k * k} times", "en", ("web", "book", None)[k % 3], 10) for k in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "web", 0), (52, " \t\n", "en", "web", 3), (53, "lone", "en", "web", 4), (None, "no id at all", "en", "web", 5)]
    rows += [(54, "very long " * 40_000, "en", "book", 400_000)] * 2 + [(55, story, "en", "web", 1)] * 3 + [(56, story, "fr", "web", 1), (57, "you idiot. you worthless idiot, you", "en", "web", 9)]
    return spark.createDataFrame(rows, COLUMNS).selectExpr("*", *CLASHES)


def test_pipeline_stages_bear_odd_rows(spark, small):
    docs = odd_documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns, name
        assert docs.count() > 0, name
        if name == "exact_dedup":
            assert docs.where("doc_id = 54").count() == 1 and docs.where("doc_id in (55, 56)").count() == 1
            assert docs.where("doc_id in (50, 51, 52)").count() == 1  # texts without a visible character are equal
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}


def test_pipeline_stages_bear_empty_tables(spark, small):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns


@pytest.mark.parametrize("bound", [url_filter.MAX_RULE_BYTES, 0])
def test_url_filter_bears_odd_pages(spark, bound):
    long = "https://www.example.org/es/" + "x" * 300_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, None), (3, ""), (None, "http://a.COM/de/q?x"), (4, "no scheme"), (5, "ftp://")], "page_id long, url string")
    pages = pages.selectExpr("*", "'x' AS host", "'y' AS verdict", "1 AS digest", "2 AS r_host")
    rules = spark.createDataFrame([*URL_RULES, ("block", "com", "/de/"), ("allow", "com", "/de/")], "verdict string, host string, path string")
    out = url_filter.filter_urls(pages, rules, max_rule_bytes=bound)
    found = sorted((r["page_id"] or 0, r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in out.collect())
    assert found == [(0, "a.com", 5, "com/de/", "block"), *[(1, "www.example.org", 300_004, "example.org/es/", "block")] * 2, *[(k, "", 0, None, "allow") for k in (2, 3, 4, 5)]]
    assert url_filter.filter_urls(pages.limit(0), rules, max_rule_bytes=bound).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0), default="block", max_rule_bytes=bound).collect()} == {"block"}
