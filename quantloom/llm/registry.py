"""The subpackage's queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.ann import nearest
from quantloom.llm.conversation_repair import repaired_digests
from quantloom.llm.exact_dedup import exact_groups
from quantloom.llm.frames import table
from quantloom.llm.language_id import held_out_languages
from quantloom.llm.license_scan import scan_licenses
from quantloom.llm.mixing import mix
from quantloom.llm.near_dedup import near_groups
from quantloom.llm.packing import pack
from quantloom.llm.substring_dedup import remove_repeats
from quantloom.llm.suffix_tree_lm import held_out_scores
from quantloom.llm.token_alignment import align_tokens
from quantloom.llm.toxicity import toxicity
from quantloom.llm.url_filter import filter_urls


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return nearest(embeddings, embeddings.where("vec_id % 50 = 0"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def license_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the license scan that SQL can express."""
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epoch", "mix_order")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(table(spark, sf_dir, "documents"))


#: (verdict, host, path prefix) of the production list.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_multi_index, op3_exact_dedup, op4_license_scan, op5_packing, op6_mixing, op7_near_dedup, op8_suffix_tree_lm, op9_url_filter, op10_substring_dedup, op11_conversation_repair, op12_language_id, op13_token_alignment, license_base_phrases)}

ORACLE_SQL = {
    "license_base_phrases": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w : w <> '') AS w FROM documents
        ), f AS (
            SELECT doc_id, len(w)::BIGINT AS n_words,
                list_filter(range(1, len(w) + 1), lambda i : w[i : i + 3] = ['under', 'the', 'mit', 'license']) AS mit,
                list_filter(range(1, len(w) + 1), lambda i : w[i : i + 3] = ['apache', 'license', 'version', '2']) AS apache,
                list_filter(range(1, len(w) + 1), lambda i : w[i : i + 2] = ['cc', 'by', 'nc']) AS cc
            FROM d
        ), p AS (SELECT *, mit || apache || cc AS places FROM f)
        SELECT doc_id, n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
            concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache-2' END, CASE WHEN len(cc) > 0 THEN 'cc-by-nc' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
        FROM p""",
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
        ), r AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op7_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1 : i + 5], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "op9_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        f AS (
            SELECT page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC, length(h) DESC) AS n
            FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.n = 1""",
    "op10_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w FROM documents
        ), x AS (
            SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d)
        ), m AS (SELECT h, min(doc_id) AS first_id FROM x GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, i + j AS p FROM x JOIN m USING (h) CROSS JOIN (SELECT unnest(range(0, 50)) AS j) WHERE x.doc_id > m.first_id),
        word AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE table_of(t) AS (
            SELECT list_transform(range(256), lambda i : list_reduce(list_prepend(i, range(8)), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))
        ), d AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c : ascii(c)::BIGINT)),
                    lambda c, b : xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
            FROM conversations, table_of
        ), e AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM d WHERE fate <> 0
        ), r AS (
            SELECT *, left(role, 1) AS kind, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS kind_before
            FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
        ), f AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM r
        ), asked(state, role, next) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
        keeps(state, kind, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        once AS (SELECT state, next AS mid, 5 AS cost, 'I' AS edits, chr(10) || role || ':' AS lines FROM asked),
        added AS (
            SELECT state, state AS mid, 0 AS cost, '' AS edits, '' AS lines FROM asked UNION ALL SELECT * FROM once
            UNION ALL SELECT a.state, b.mid, a.cost + b.cost, a.edits || b.edits, a.lines || b.lines FROM once a JOIN once b ON a.mid = b.state
        ), steps AS (
            SELECT state, NULL::VARCHAR AS kind, mid AS next, cost + 2 AS cost, edits || 'D' AS edits, lines, NULL::VARCHAR AS role FROM added
            UNION ALL SELECT a.state, NULL, k.next, a.cost + 1, a.edits || 'R', a.lines, k.role FROM added a JOIN asked k ON a.mid = k.state
            UNION ALL SELECT a.state, k.kind, k.next, a.cost, a.edits || 'K', a.lines, '' FROM added a JOIN keeps k ON a.mid = k.state
        ), dp AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM (SELECT DISTINCT conv_id FROM f)
            UNION ALL
            SELECT p.conv_id, f.i, s.next, p.cost + s.cost + CASE WHEN f.fault = 'truncated' AND s.role IS NOT NULL THEN 5 ELSE 0 END, p.audit || s.edits,
                p.lines || s.lines || CASE WHEN s.role IS NULL THEN '' WHEN s.role = '' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || s.role || ':' || f.text END
            FROM dp p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1 JOIN steps s ON s.state = p.state AND (s.kind IS NULL OR s.kind = f.kind)
            WHERE s.role IS NULL OR f.fault NOT IN ('blank', 'duplicate')
            QUALIFY row_number() OVER (PARTITION BY p.conv_id, s.next ORDER BY p.cost + s.cost + CASE WHEN f.fault = 'truncated' AND s.role IS NOT NULL THEN 5 ELSE 0 END, p.audit || s.edits) = 1
        ), ends AS (
            SELECT p.conv_id, p.cost + a.cost AS cost, p.audit || a.edits AS audit, p.lines || a.lines AS lines
            FROM dp p JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id) m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.i = m.n JOIN added a ON a.state = p.state AND a.mid IN (0, 3)
            QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + a.cost, p.audit || a.edits) = 1
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND kind_before || kind NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
            coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(substr(coalesce(lines, ''), 2)) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts k ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id""",
}
