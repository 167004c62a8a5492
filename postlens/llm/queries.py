"""Thin queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import tables

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup as op

    return op.digests(tables(spark, sf_dir, "documents"))


def op2_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import code_search as op

    rows = tables(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), op.sign_code(F.col("embedding")).alias("code"))
    found = op.top_k(rows, rows.where(F.col("id") % 20 == 0), k=10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("neighbour_id"), F.col("distance").cast("long").alias("distance"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe as op

    return op.digests(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter as op

    return op.judged(tables(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan as op

    return op.scan(tables(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as op

    found = op.judge(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))
    return found.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.lines.again").alias("n_dup_lines"), "m.n_repeat_words", "base_failed", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as op

    docs = tables(spark, sf_dir, "documents")
    found = op.scored(docs, op.fit(docs, tables(spark, sf_dir, "labels")))
    return found.select("doc_id", op.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages", "best_start", "best_end")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii as op

    found = op.found(tables(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("kinds").cast("long").alias("n_found"), F.array_join(F.array_sort("kinds"), ",").alias("kinds"), "text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing as op

    return op.selected(tables(spark, sf_dir, "documents")).select("doc_id", *op.LEAF, "tokens", "copies")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join as op

    return op.joined(tables(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import trie as op

    return op.nodes(*op.shared_openings(op.hashed(op.turns(tables(spark, sf_dir, "conversations"))))).drop("start", "stop")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_classifier as op

    docs = tables(spark, sf_dir, "documents")
    found = op.scored(docs, op.fit(docs, tables(spark, sf_dir, "labels")))
    return found.select("doc_id", op.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair as op

    conversations = tables(spark, sf_dir, "conversations")
    return op.audited(conversations, op.ready(op.damaged(conversations)))


def _quality_sql() -> str:
    """The grid of cutoffs comes from the operator's parameter; the bound is the binomial tail written out."""
    from .quality_rules import RULES

    grid = ", ".join(f"('{rule}', {cut})" for rule, cuts in RULES.items() for cut in cuts)
    return rf"""
        WITH texts AS (
            SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), grams AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)
        ), repeated AS (
            SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM grams, (VALUES (0), (1), (2)) o(j) WHERE n > 1 GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ), counted AS (
            SELECT x.doc_id, lang, t, len(w) AS n_words, coalesce(list_sum([length(a) FOR a IN w]), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]]) AS n_same
            FROM texts x LEFT JOIN repeated r ON x.doc_id = r.doc_id LEFT JOIN lines l ON x.doc_id = l.doc_id
        ), judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeated_words,
                CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS repeated_lines, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_case, CASE WHEN n_words > 0 THEN n_same / n_words ELSE 0 END AS same_as_previous
            FROM counted
        ), ratios AS (
            UNPIVOT (SELECT doc_id, lang, t, base_failed, symbols_per_word, repeated_words, repeated_lines, upper_case, same_as_previous FROM judged)
            ON symbols_per_word, repeated_words, repeated_lines, upper_case, same_as_previous INTO NAME rule VALUE ratio
        ), trials AS (
            SELECT DISTINCT lang, t, rule, ratio FROM ratios WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
        ), tested AS (
            SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (ratio > cutoff) AS k FROM trials JOIN (VALUES {grid}) g(rule, cutoff) USING (rule) GROUP BY lang, rule, cutoff
        ), bounded AS (
            SELECT *, 0.05 / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM trials)) * {sum(map(len, RULES.values()))}) AS level,
                list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({0.05 / len(RULES)}) + (n - j) * ln(1 - {0.05 / len(RULES)})) FOR j IN range(0, k + 1)]) AS tail FROM tested
        ), cuts AS (
            SELECT lang, rule, min(cutoff) AS cutoff FROM bounded WHERE k < n * {0.05 / len(RULES)} AND tail <= level GROUP BY lang, rule
        ), broken AS (
            SELECT DISTINCT doc_id FROM ratios r JOIN cuts c ON r.rule = c.rule AND r.lang IS NOT DISTINCT FROM c.lang WHERE ratio > cutoff
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept FROM judged
    """


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_dedup, op2_code_search, op3_byte_bpe, op4_url_filter, op5_license_scan, op6_quality_rules, op7_toxicity, op8_pii, op9_mixing, op10_ngram_join, op11_prefix_trie, op12_quality_classifier, op13_conversation_repair)}

SQL: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH docs AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), places AS (
            SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM docs WHERE length(h) >= 200
        ), told AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM places)
        ), edges AS (
            SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS opens FROM told WHERE n > 1
        ), numbered AS (
            SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges
        ), runs AS (
            SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run
        ), gaps AS (
            SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
        ), cut AS (
            SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
            FROM gaps g JOIN docs d ON g.doc_id = d.doc_id GROUP BY g.doc_id
        )
        SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM docs d LEFT JOIN cut c ON d.doc_id = c.doc_id
    """,
    "op2_code_search": """
        WITH codes AS (
            SELECT vec_id, list_sum([CASE WHEN embedding[i + 1] > 0 AND NOT isnan(embedding[i + 1]) THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END FOR i IN range(64)])::HUGEINT AS code FROM embeddings
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, bit_count(xor(q.code, c.code))::BIGINT AS distance
            FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, rank, neighbour_id, distance FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs
        ) WHERE rank <= 10
    """,
    "op4_url_filter": """
        WITH parsed AS (
            SELECT page_id,
                coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), ruled AS (
            SELECT *, CASE
                WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
            FROM parsed
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|\\.)(casino-win|free-bets|ads-track|cheap-pills|spam-farm|adult-x|click-bait|fake-news|win-prize|pirate-films)\\.example\\.(com|net|org)$') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op6_quality_rules": _quality_sql(),
    "op10_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM words
        ), each AS (
            SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets
        ), met AS (
            SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS common
            FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
        ), linked AS (
            SELECT a, b FROM met WHERE 100 * common >= 75 * (an + bn - common)
        ), either_way AS (
            SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
        ), reach AS (
            SELECT doc_id, doc_id AS r FROM documents
            UNION SELECT reach.doc_id, either_way.b FROM reach JOIN either_way ON reach.r = either_way.a
        )
        SELECT sets.doc_id, len(g)::BIGINT AS n_shingles, min(r) AS component_id FROM sets JOIN reach ON sets.doc_id = reach.doc_id GROUP BY sets.doc_id, len(g)
    """,
    "op11_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT conv_id, xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')],
                lambda c, b: list_reduce([xor(c, b)] || range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM own)
        ), rebuilt AS (
            SELECT o.conv_id, 1 AS part, n, role, text FROM own o JOIN ids i ON o.conv_id = i.conv_id WHERE n > h
            UNION ALL SELECT i.conv_id, 0, n, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 20 AND n <= h
        ), paths AS (
            SELECT conv_id, row_number() OVER o AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, md5(string_agg(md5(md5(role) || md5(text)), '') OVER o) AS p FROM rebuilt WINDOW o AS (PARTITION BY conv_id ORDER BY part, n)
        ), members AS (
            SELECT conv_id, 0 AS depth, 0 AS words, '' AS p, NULL AS above FROM ids
            UNION ALL SELECT conv_id, depth, words, p, coalesce(lag(p) OVER (PARTITION BY conv_id ORDER BY depth), '') FROM paths
        ), nodes AS (
            SELECT p, any_value(depth) AS depth, any_value(words) AS words, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs FROM members GROUP BY p
        ), children AS (
            SELECT above, count(*) AS n_children FROM nodes GROUP BY above
        ), below AS (
            SELECT m.p, count(*) FILTER (c.above IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens
            FROM nodes x JOIN members m ON m.conv_id = x.conv_id AND m.depth <= x.depth LEFT JOIN children c ON c.above = x.p GROUP BY m.p
        ), ends AS (
            SELECT p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(p, depth) AS p FROM members GROUP BY conv_id) GROUP BY p
        )
        SELECT x.conv_id, x.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM nodes x JOIN below b ON x.p = b.p LEFT JOIN nodes u ON u.p = x.above LEFT JOIN children c ON c.above = x.p LEFT JOIN ends e ON e.p = x.p
    """,
}
