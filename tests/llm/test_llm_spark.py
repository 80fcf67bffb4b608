"""The operators on Spark: brute force on small tables, and rows that are null, empty, repeated or long."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quantloom.llm import ann, components, exact_dedup, license_scan, mixing, near_dedup, packing, substring_dedup, suffix_tree_lm, toxicity, url_filter
from quantloom.llm.registry import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, owner string, chunk int, root long, key long"
LONG = " ".join(f"w{i % 977}" for i in range(3000))
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one "), (5, "one "), (None, "one two three four five six"), (6, LONG), (7, LONG + " tail"), (8, "Ä" * 300), (9, "a b c d e f g"),
    (9, "a b c d e f g h"), (10, "a  b c\x0bd e f g"),
]


def odd_documents(spark):
    rows = [(i, t, None, None if n % 3 else "s", None, "x", 1, 2, 3) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(small, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    wanted = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, df.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, wanted)) or sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, wanted))


def test_exact_groups_of_odd_rows(spark):
    out = exact_dedup.exact_groups(odd_documents(spark), chunk_rows=4).collect()
    assert len(out) == len(ODD)
    clean = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in ODD:
        groups[clean(t)].append((-len(t or ""), i if i is not None else math.inf))
    for r in out:
        match = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        keep = min(match)[1]
        assert r["group_size"] == len(match) and r["keep_id"] == (None if keep == math.inf else keep)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    kept = exact_dedup.drop_exact_copies(odd_documents(spark))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and {r["doc_id"] for r in kept.collect()} == {None, 3, 5, 6, 7, 8, 9, 10}


def brute_repeats(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            if i is not None:
                first[s] = min(first.get(s, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for n, x in enumerate(w) if n not in gone)).hexdigest()))
    return out


def test_substring_removal_equals_brute_force(spark):
    rng = random.Random(5)
    passage = " ".join(rng.choice("abcdefgh") for _ in range(9))
    rows = [*ODD, *((100 + i, " ".join(rng.choice("xyz") for _ in range(rng.randrange(30))) + " " + passage * (i % 3)) for i in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for owners, chunk in ((1, 10**6), (5, 50)):
        out = substring_dedup.remove_repeats(docs, 6, owners, chunk).collect()
        assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, brute_repeats(rows, 6)))
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def brute_components(rows, percent=75):
    sets = []
    for _, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: math.inf)
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(least[g], i if i is not None else math.inf)
    return [(i, len(s), None if least[g] == math.inf else least[g]) for (i, _), s, g in zip(rows, sets, group, strict=True)]


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(9)
    base = [[f"b{k}w{rng.randrange(10**6)}" for _ in range(120)] for k in range(4)]
    rows = list(ODD)
    for i in range(60):  # chains of edits, from near to far copies
        words = list(base[i % 4])
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    common = " ".join(f"c{k}" for k in range(60))
    rows += [(2000 + i, common + " " + " ".join(f"u{i}x{k}" for k in range(25))) for i in range(15)]  # a long passage in unrelated texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = near_dedup.near_groups(docs).collect()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)
    assert got == Counter(brute_components(rows))
    assert near_dedup.near_groups(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    roots = {out.get(i, i) for i in range(41)}
    assert len(out) == 41 and len(roots) == 1 and roots <= set(range(41)) and out.get(100, 100) == out.get(101, 101)
    assert components.connected_components(edges.limit(0)).count() == 0


def mixed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs, mixing.mix(docs, **options)


def test_mixture_keeps_its_budgets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 40))), s) for i, s in enumerate(["a"] * 300 + ["b"] * 90 + [None] * 60 + ["c"] * 5)]
    docs, out = mixed(spark, rows, repetition_limit=2.0, block_bits=2)
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len(t.split())
    total, found = sum(tokens.values()), out.collect()
    weights = {r["source"]: r["mix_weight"] for r in found}
    assert sum(weights.values()) == pytest.approx(1)
    drawn = defaultdict(int)
    for r in found:
        drawn[r["source"]] += r["mix_tokens"]
    longest = 40
    for s, w in weights.items():
        assert w * total - longest <= drawn[s] <= w * total + 1e-6
        assert w * total / tokens[s] <= 2.0 + 1e-6
        copies = Counter(r["doc_id"] for r in found if r["source"] == s)
        whole = math.floor(w * total / tokens[s])
        assert set(copies.values()) <= {whole, whole + 1} and (whole == 0 or len(copies) == sum(x[2] == s for x in rows))
    exponent = math.log(weights["a"] / weights["b"]) / math.log(tokens["a"] / tokens["b"])
    for s, w in weights.items():
        assert w == pytest.approx(tokens[s] ** exponent / sum(v**exponent for v in tokens.values()), rel=1e-6)
    assert 0 <= min(r["mix_order"] for r in found) and max(r["mix_order"] for r in found) <= 1 + 1e-9
    head = [r for r in sorted(found, key=lambda r: r["mix_order"])[: len(found) // 4]]
    assert sum(r["mix_tokens"] for r in head if r["source"] == "a") / sum(r["mix_tokens"] for r in head) == pytest.approx(weights["a"], abs=0.12)


def test_mixture_by_entropy_and_odd_rows(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 80 + ["b"] * 20)]
    target = 0.62
    _, out = mixed(spark, rows, target_entropy=target, repetition_limit=None)
    assert mixing.entropy_of(list({r["source"]: r["mix_weight"] for r in out.collect()}.values())) == pytest.approx(target, abs=1e-6)
    assert mixing.mix(empty(spark)).count() == 0
    out = mixing.mix(odd_documents(spark))
    assert set(SCHEMA.replace(",", "").split()[::2]) < set(out.columns) and out.count() > 0


def test_mixture_is_native(spark, small):
    plan = QUERIES["op6_mixing"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def check_packing(rows, documents, encode):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, t in documents.items():
        ids = [*encode(t or ""), 2]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own]).tolist()[:-1]] and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_packing_is_an_exact_cover(spark, small):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    encode = packing.WordEncoder(path).tokenizer
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = QUERIES["op5_packing"](spark, small).collect()
    n = check_packing(rows, texts, lambda t: encode.encode(t, add_special_tokens=False).ids)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 1024 * 1.02) + 1
    odd = {i: t for i, t in ODD if i not in (5, 9, None)}
    few = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    check_packing(packing.pack(few, path).collect(), odd, lambda t: encode.encode(t, add_special_tokens=False).ids)
    assert packing.pack(empty(spark), path).count() == 0 and packing.pack(odd_documents(spark), path).count() >= len(ODD)


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:200] = x[100]
    x[200] = 2 * x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [math.nan] * 16), (9004, [1.0] * 3), (9005, [None] * 16), (9006, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    out = ann.nearest(table, table.where("vec_id % 50 = 0")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = total = 0
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r)
    assert set(by) == set(range(0, 3000, 50))
    for q, own in by.items():
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(s[r["vec_id"]] - r["score"]) < 1e-12 for r in own)
        hit, total = hit + len({r["vec_id"] for r in own} & set(best.tolist())), total + 5
    assert hit / total >= 0.9
    assert [r["vec_id"] for r in by[150]] == [100, 101, 102, 103, 104]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_license_scan_of_odd_rows(spark):
    rows = [*ODD, (50, "x Released UNDER the MIT-License. Apache license version 2; cc by-nc under the mit license"), (51, " ".join(license_scan.TEMPLATES["mit"][0].split()))]
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), with_spans=True).collect()}
    assert (out[50]["n_base"], out[50]["first_word"], out[50]["last_word"], out[50]["base_labels"]) == (4, 2, 13, "apache-2,cc-by-nc,mit")
    assert out[51]["labels"] == "mit" and out[51]["base_labels"] == "" and out[51]["score"] == 1.0 and out[51]["spans"][0]["first_word"] == 0
    assert (out[1]["n_words"], out[1]["labels"], out[1]["first_word"], out[1]["score"]) == (0, "", None, 0.0)
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_url_filter_both_ways(spark):
    urls = [None, "", "nourl", "http://", "http://A.Example.ORG/es/x?y", "https://org/", "ftp://example.org", "http://x.com/fr/#a", "http://com/de/", "http://a.org?b/c", "http://EXAMPLE.org/en/12"]
    pages = spark.createDataFrame([(i, u, "h", "p", "d") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, html string, rule string, digest string")
    from quantloom.llm.registry import URL_RULES

    one = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    two = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules, max_rule_bytes=0).collect()}
    assert one == two
    got = {i: (h, p, r, v) for i, h, p, r, v in one}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow") and got[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[6] == ("example.org", "", None, "allow") and got[10][2:] == ("example.org/en/1", "block") and got[7][2:] == ("com/fr/", "allow")


def test_toxicity_learns_and_holds_out(spark, small):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}" for _ in range(60)]
        toxic = i % 5 == 0
        for _ in range(5 * toxic):
            words[rng.randrange(60)] = f"grumpf{rng.choice('abcdef')}"
        rows.append((i, " ".join(words)))
        labels.append((i, toxic * 1))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    out = toxicity.toxicity(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")).collect()
    assert len(out) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    known = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 50 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)
    assert np.mean([known[r["doc_id"]] == r["predicted"] for r in held]) > 0.97
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == 403
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_suffix_tree_is_a_distribution_and_counts_exactly(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a b", "a c", "d", "B e"]) for _ in range(rng.randrange(0, 20)))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, "zz unseen"), (502, "zz unseen"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix_tree_lm.held_out_scores(docs).collect()
    assert len(out) == len(rows)
    tokens = [(i, (t or "").lower().encode().split() + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    gain = [r["score"] - r["base_score"] for r in out if r["held_out"] and r["n_tokens"] > 5]
    assert sum(gain) > 0
    # no word can be followed by more than a whole: P(w, end | a) over all known words and an unknown one, and P(end | a)
    vocabulary = sorted(w.decode() for w in counts if w)
    probes = [(i, f"a {w}") for i, w in enumerate([*vocabulary, "unknown"])] + [(10_000, "a")]
    both = suffix_tree_lm.score(spark.createDataFrame(probes, "doc_id long, text string"), docs.where("doc_id < 300")).collect()
    assert len(both) == len(probes) and 0 < sum(10 ** r["score"] for r in both) < 1
    assert suffix_tree_lm.held_out_scores(empty(spark)).count() == 0


def test_pipeline_equals_its_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns, name
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if name == "near_dedup":
            assert all(c == i for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in rows} == ids
    again = corpus_pipeline.run(spark, small).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again)
