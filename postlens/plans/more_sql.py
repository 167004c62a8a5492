"""SQL of :mod:`.more`, written from the rules and not from the plans."""

from __future__ import annotations

from .ranking_sql import _PAIRS, _PARTS, _RANKED, _REASONS

_CV = """
    c AS (SELECT c_custkey AS k, 2009 + c_custkey % 3 AS s2, 2008 + c_custkey % 4 AS e1 FROM customer),
    w AS (SELECT k, s2, e1, CASE WHEN 2012 - e1 <= 1.5 THEN 1.0::DOUBLE ELSE greatest(0.25::DOUBLE, pow(0.5::DOUBLE, (2012 - e1 - 1.5::DOUBLE) / 2)) END AS old FROM c)
"""
_YEARS = "round(CASE WHEN s2 <= e1 THEN 7 ELSE e1 - 2005 + 2012 - s2 END, 1)::DOUBLE"
_EVENTS = "e AS (SELECT *, 'u' || user_id AS url FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00')"
_LEDGER = "ledger AS (SELECT event_type AS board, floor(epoch(ts)) AS stamp, CASE WHEN event_id % 97 = 0 THEN 403 ELSE 200 END AS status FROM e)"
_NOW = "epoch(TIMESTAMP '2024-01-15 12:00:00')"
_USED = f"""used AS (SELECT board, count(*) FILTER (stamp > {_NOW} - 3600) AS used, max(stamp) FILTER (status = 403) AS blocked FROM ledger GROUP BY board)"""
_REQUESTS = f"""
    urls AS (SELECT DISTINCT event_type AS board, url, CASE WHEN user_id % 3 = 0 THEN 'detail' ELSE 'list' END AS kind, user_id % 4 AS page, user_id % 7 AS query FROM e),
    cached AS (SELECT url, max(floor(epoch(ts))) AS stamp FROM e WHERE value > 40 GROUP BY url),
    wanted AS (SELECT u.*, c.stamp IS NULL OR {_NOW} - c.stamp > CASE kind WHEN 'list' THEN 12 ELSE 336 END * 3600 AS due FROM urls u LEFT JOIN cached c ON u.url = c.url),
    placed AS (SELECT w.*, row_number() OVER (PARTITION BY w.board, due ORDER BY kind = 'detail', page, query, url) AS place, CASE WHEN {_NOW} - blocked < 6 * 3600 THEN 0 ELSE greatest(0, least(24 - used, 16)) END AS free FROM wanted w LEFT JOIN used s ON w.board = s.board),
    requests AS (SELECT *, CASE WHEN NOT due THEN 'cache' WHEN place <= CASE WHEN kind = 'detail' THEN free ELSE greatest(0, free - 6) END THEN 'network' ELSE 'later' END AS origin FROM placed)
"""
_STREAM = "s AS (SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) AS run_id, 'u:' || user_id || ':' || event_type AS uid FROM events)"

ORACLE: dict[str, str] = {
    "cv_lines": f"""
        WITH {_CV} SELECT k AS c_custkey, n AS line_no, CASE WHEN n < 2 THEN 'top' WHEN n < 7 THEN 'experience' WHEN n < 9 THEN 'education' ELSE 'skills' END AS section,
            CASE WHEN n IN (2, 7, 9) THEN 'heading' WHEN n = 10 THEN 'skill' WHEN n < 2 THEN 'undated' ELSE 'dated' END AS kind,
            round(CASE WHEN n IN (5, 6) THEN old WHEN n = 8 THEN 0.25 ELSE 1.0 END, 6) AS weight, CASE n WHEN 3 THEN s2 WHEN 5 THEN 2005 WHEN 8 THEN 2000 END::DOUBLE AS start, CASE n WHEN 3 THEN 2012 WHEN 5 THEN e1 WHEN 8 THEN 2004 END::DOUBLE AS "end"
        FROM w, range(11) r(n)""",
    "cv_skills": f"""
        WITH {_CV}, found AS (SELECT k, canonical, CASE canonical WHEN 'Spark' THEN round(2.0::DOUBLE / 6 + 0.35, 3) WHEN 'Kafka' THEN round(1.0::DOUBLE / 6, 3) WHEN 'Python' THEN round(1.0::DOUBLE / 6 + 0.35, 3) ELSE round((0.5 + 0.5 * old) / 6, 3) END AS evidence,
            CASE canonical WHEN 'Python' THEN NULL WHEN 'SQL' THEN old WHEN 'Excel' THEN old ELSE 1.0 END AS recency FROM w, (VALUES ('Spark'), ('Kafka'), ('Python'), ('SQL'), ('Excel')) v(canonical))
        SELECT k AS c_custkey, canonical, round(CASE WHEN evidence >= 0.45 THEN evidence ELSE evidence / 2 END, 4) AS weight, CASE WHEN evidence >= 0.45 THEN 'strong' ELSE 'weak' END AS strength, round(recency, 6) AS recency FROM found""",
    "cv_experience": f"WITH {_CV} SELECT k AS c_custkey, {_YEARS} AS years FROM w",
    "cv_periods": "SELECT c_custkey, round((CASE c_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 2 ELSE 3 END + 2) / 12.0::DOUBLE, 1)::DOUBLE AS years FROM customer",
    "cv_level": f"""WITH {_CV} SELECT k AS c_custkey, CASE k % 4 WHEN 3 THEN 'staff' WHEN 0 THEN 'senior' ELSE CASE WHEN {_YEARS} >= 6 THEN 'senior' WHEN {_YEARS} >= 2.5 THEN 'mid' ELSE 'junior' END END AS level, k % 4 = 1 AS practitioner FROM w""",
    "cv_families": "SELECT c_custkey, 'data' AS family, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS recency, 1::BIGINT AS rank FROM customer",
    "cv_profiles": f"""
        WITH {_CV}, l AS (SELECT k, {_YEARS} AS years, CASE k % 4 WHEN 3 THEN 'staff' WHEN 0 THEN 'senior' ELSE CASE WHEN {_YEARS} >= 6 THEN 'senior' WHEN {_YEARS} >= 2.5 THEN 'mid' ELSE 'junior' END END AS level FROM w)
        SELECT k AS c_custkey, CASE level WHEN 'junior' THEN 'mid' WHEN 'mid' THEN 'senior' ELSE 'staff' END AS max_level, ceil(years + 2)::INT AS max_years, k % 4 = 1 AS is_practitioner, CASE level WHEN 'staff' THEN 10 ELSE 11 END::BIGINT AS n_forbidden, 'data' AS families,
            'Excel,Kafka,Python,SQL,Spark' AS skills, round(round(2.0::DOUBLE / 6 + 0.35, 3), 4) AS spark FROM l""",
    "cv_sentences": """
        SELECT c_custkey, 'Senior ' || CASE c_custkey % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'sales' ELSE 'health' END || ' with experience in Spark, SQL' AS own,
            'Work of ' || CASE c_custkey % 3 WHEN 0 THEN 'nurses and physicians, recruiters, sales representatives, accountants, mechanical engineers' WHEN 1 THEN 'nurses and physicians, accountants, mechanical engineers, software developers'
                ELSE 'recruiters, sales representatives, accountants, mechanical engineers, software developers' END AS other, CASE c_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 7 ELSE 9 END::BIGINT AS n_forbidden FROM customer""",
    "text_fields": """
        WITH x AS (SELECT *, c_custkey AS k, TIMESTAMP '2024-03-01 10:00:00' + to_days((c_custkey % 28)::INT) - to_hours(CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 3 END) AS stamp FROM customer)
        SELECT c_custkey, c_mktsegment || ', ' || c_name AS listed, c_name AS first, c_name || chr(10) || 'Ops' || chr(10) || c_mktsegment || ' x' || chr(10) || 'text' AS combined,
            CASE k % 8 WHEN 7 THEN 0 ELSE (k % 40) * [0, 1, 7, 30, 365, 1, 7][k % 8 + 1] END::INT AS days, 'a ' || c_mktsegment || ' z' AS squeezed, epoch(stamp)::BIGINT AS local,
            round(greatest(0, (epoch(TIMESTAMP '2024-03-20') - epoch(stamp)) / 86400), 4)::DOUBLE AS age, floor((epoch(TIMESTAMP '2024-03-20 00:30:00') - epoch(stamp)) / 3600)::BIGINT AS hours,
            array_to_string(list_filter(regexp_split_to_array(lower(c_mktsegment || ' a the ' || c_name), '[^a-z0-9+#]+'), lambda t: t NOT IN ('the', 'a', '')), ' ') AS tokens,
            CASE k % 3 WHEN 0 THEN ' · İstanbul' WHEN 1 THEN ' · İzmir' ELSE '' END AS city FROM x""",
    "url_join": r"""
        SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://other.test/a%20b' WHEN 1 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/root%20x' WHEN 3 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.test/y'
            ELSE CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]+/') THEN regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/[^/]*$', '/') ELSE regexp_extract(url, '^([^?#]*)', 1) || '/' END || 'next?p=2' END AS joined FROM pages""",
    "terminal_lines": f"""
        WITH {_PARTS}, {_PAIRS}, {_RANKED}, lines AS (SELECT profile_id, rank, lpad(rank::VARCHAR, 3, ' ') || ' ' || lpad(printf('%.1f', final), 6, ' ') || ' ' || rpad(CASE WHEN risk >= 0.70 THEN 'ghost' WHEN risk >= 0.45 THEN 'doubtful' WHEN risk >= 0.20 THEN 'normal' ELSE 'fresh' END, 8, ' ') || ' '
            || rpad(CASE WHEN length(title) > 20 THEN title[:19] || '…' ELSE title END, 20, ' ') || ' ' || company AS line FROM ranked WHERE rank <= 10) SELECT profile_id, rank, rtrim(line) AS line FROM lines""",
    "shortlist_quality": f"""
        WITH {_PARTS}, {_PAIRS}, {_RANKED} SELECT profile_id, count(*) AS filled, count(*) FILTER (len(known) = 0) AS without_skill, count(*) FILTER (practitioner) AS practitioners, count(*) FILTER (rank <= 5 AND list_has_any(title_skills, known)) AS hits, count(*) FILTER (NOT ok) AS misplaced
        FROM ranked WHERE rank <= 10 GROUP BY profile_id""",
    "masked_mean": """
        WITH t AS (SELECT vec_id, n, list_sum([x::DOUBLE FOR x IN embedding[1:8]]) * (n + 1) AS s FROM embeddings, range(4) r(n) WHERE (vec_id + n) % 3 <> 0)
        SELECT vec_id, round(sum(s) / count(*), 5) AS sum_of_mean FROM t GROUP BY vec_id""",
    "document_fit": """
        WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e, [x::DOUBLE FOR x IN list_reverse(embedding)] AS b FROM embeddings), d AS (SELECT *, [e[i] * 0.6::DOUBLE + b[i] * 0.4::DOUBLE FOR i IN range(1, len(e) + 1)] AS doc FROM v)
        SELECT vec_id, round(list_cosine_similarity(doc, e) - list_cosine_similarity(doc, b), 6) AS fit FROM d""",
    "cache_due": f"""
        WITH {_EVENTS}, cached AS (SELECT url, max(floor(epoch(ts))) AS stamp FROM e WHERE value > 20 GROUP BY url), urls AS (SELECT DISTINCT url, CASE user_id % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'detail' ELSE 'robots' END AS kind FROM e)
        SELECT u.url, kind FROM urls u LEFT JOIN cached c ON u.url = c.url WHERE c.stamp IS NULL OR {_NOW} - c.stamp > CASE kind WHEN 'list' THEN 12 WHEN 'detail' THEN 336 ELSE 24 END * 3600""",
    "cache_served": f"""
        WITH {_EVENTS}, cached AS (SELECT url, max(floor(epoch(ts))) AS stamp, 'copy ' || arg_max(event_id, ts) AS body FROM e WHERE value > 60 GROUP BY url)
        SELECT u.url, CASE WHEN u.id % 2 = 0 THEN 'network' WHEN {_NOW} - stamp <= 72 * 3600 THEN 'stale' ELSE 'failed' END AS origin, CASE WHEN u.id % 2 = 0 THEN 'fresh' WHEN {_NOW} - stamp <= 72 * 3600 THEN body END AS body
        FROM (SELECT DISTINCT url, user_id AS id FROM e) u LEFT JOIN cached c ON u.url = c.url""",
    "cache_evicted": f"WITH {_EVENTS} SELECT event_type, count(*) AS n FROM e WHERE ts >= TIMESTAMP '2024-01-13 12:00:00' GROUP BY 1",
    "board_allowance": f"WITH {_EVENTS}, {_LEDGER}, {_USED} SELECT board, CASE WHEN {_NOW} - blocked < 6 * 3600 THEN 0 ELSE greatest(0, least(24 - used, 16) - 6) END AS \"left\" FROM used",
    "board_requests": f"WITH {_EVENTS}, {_LEDGER}, {_USED}, {_REQUESTS} SELECT board, url, kind, origin FROM requests",
    "board_status": f"""
        WITH {_EVENTS}, {_LEDGER}, {_USED}, {_REQUESTS}, posts AS (SELECT event_type AS board, count(*) FILTER (user_id % 5 <> 0) AS postings, count(*) FILTER (user_id % 5 = 0) AS carried FROM e GROUP BY 1)
        SELECT r.board, count(*) FILTER (origin = 'network') AS network, count(*) FILTER (origin = 'cache') AS cache, count(*) FILTER (origin = 'later') AS later, any_value(postings) AS postings, any_value(carried) AS carried,
            any_value(round(coalesce(greatest(0, 6 - ({_NOW} - blocked) / 3600), 0), 2))::DOUBLE AS blocked_hours, any_value(CASE WHEN {_NOW} - blocked < 6 * 3600 THEN 0 ELSE greatest(0, least(24 - used, 16) - 6) END) AS "left"
        FROM requests r JOIN posts p ON r.board = p.board JOIN used u ON r.board = u.board GROUP BY r.board""",
    "source_history": f"WITH {_EVENTS} SELECT url AS uid, count(*) AS seen FROM e WHERE event_type = 'click' GROUP BY url HAVING max(ts) >= TIMESTAMP '2024-01-10'",
    "carried_pool": f"WITH {_EVENTS} SELECT url AS uid FROM e GROUP BY url HAVING length(url) <> 3 AND max(value) <= 95 AND max(ts) >= TIMESTAMP '2024-01-12 12:00:00'",
    "connector_check": f"""WITH {_PARTS} SELECT seq::VARCHAR AS native_id, array_to_string(list_filter([CASE WHEN trim(body) = '' THEN 'text' END, CASE WHEN len(places) = 0 THEN 'place' END, CASE WHEN age IS NULL THEN 'date' END], lambda x: x IS NOT NULL), ',') AS wrong FROM posts ORDER BY seq LIMIT 6""",
    "sitemap_fallback": "SELECT DISTINCT '/' || p_name AS path FROM part WHERE p_size % 3 IN (0, 1)",
    "page_interleave": "SELECT * FROM (SELECT DISTINCT user_id AS query, event_id % 5 AS page FROM events) ORDER BY page, query LIMIT 40",
    "path_choice": r"""
        WITH names AS (SELECT DISTINCT p_name, CASE WHEN p_type <> 'STANDARD' THEN lower(p_type) END AS city FROM part), q AS (SELECT DISTINCT p_name AS q, list_distinct(string_split(p_name, ' ')) AS a FROM names),
        p AS (SELECT DISTINCT concat_ws(' ', p_name, city, 'jobs') AS p, city, list_distinct(string_split(concat_ws(' ', p_name, city, 'jobs'), ' ')) AS b FROM names),
        s AS (SELECT q, p, city, round(round(len(list_intersect(a, b))::DOUBLE / len(a) - 0.04::DOUBLE * (len(b) - len(list_intersect(a, b))), 4) + CASE WHEN city IS NOT NULL THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN city = 'promo' THEN 0.5::DOUBLE ELSE 0 END, 4) AS score
            FROM q, p WHERE len(list_intersect(a, b)) > 0),
        near AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM s) WHERE score >= 0.72::DOUBLE * best), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, city ORDER BY score DESC, p) AS n FROM near) WHERE n = 1)
        SELECT q, rank, p, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY city IS NOT NULL, score DESC, p) AS rank FROM one) WHERE rank <= 4""",
    "position_coverage": "SELECT round(avg((p_size % 5 < 2)::INT), 6) AS simple, round(sum(p_retailprice) FILTER (p_size % 5 < 2) / sum(p_retailprice), 6) AS weighted FROM part",
    "ordered_distinct": """
        WITH f AS (SELECT o_custkey, o_orderstatus || o_orderpriority AS x, min(o_orderkey) AS k FROM orders GROUP BY 1, 2 UNION ALL SELECT DISTINCT o_custkey, 'last', 999999999999 FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS r FROM f)
        SELECT o_custkey, string_agg(x, ',' ORDER BY k) AS items FROM n WHERE r <= 8 GROUP BY 1""",
    "weight_cut": """
        WITH r AS (SELECT l_orderkey, l_quantity::DOUBLE AS w, l_discount > 0.05 AS fresh, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best FROM lineitem), n AS (SELECT *, max(fresh::INT) OVER (PARTITION BY l_orderkey) AS any_fresh FROM r WHERE w >= 0.7::DOUBLE * best)
        SELECT l_orderkey, count(*) AS n, min(w) AS least FROM n WHERE fresh OR any_fresh = 0 GROUP BY 1""",
    "query_slots": """
        WITH RECURSIVE n AS (SELECT list(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 4 IN (0, 1)) AS a, list(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 4 IN (1, 2)) AS b, list(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 4 IN (2, 3)) AS c, list(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 8 = 7) AS e FROM nation),
        f AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN e[1:6] ELSE [] END AS first, i, (c_custkey * (2 * i + 3) % 61 + 40) / 100 AS w, c_custkey * (i + 1) % 5 >= 3 AS fresh, CASE i WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE e END AS q FROM customer, n, range(4) r(i)),
        g AS (SELECT *, max(fresh) OVER (PARTITION BY c_custkey) AS any_fresh FROM f), h AS (SELECT *, max(w) OVER (PARTITION BY c_custkey) AS best FROM g WHERE fresh OR NOT any_fresh),
        p AS (SELECT c_custkey, first, list(w ORDER BY i) AS ws, list(q ORDER BY i) AS qs FROM h WHERE w >= 0.7::DOUBLE * best GROUP BY ALL),
        s AS (SELECT c_custkey, ws, qs, first AS taken, list_transform(ws, lambda x: 0) AS held, list_transform(ws, lambda x: 0) AS cur, 0 AS step FROM p
            UNION ALL SELECT c_custkey, ws, qs, CASE WHEN new THEN list_append(taken, item) ELSE taken END, list_transform(held, lambda x, j: CASE WHEN j = k AND new THEN x + 1 ELSE x END), list_transform(cur, lambda x, j: CASE WHEN j = k THEN x + 1 ELSE x END), step + 1
            FROM (SELECT *, NOT list_contains(taken, item) AS new FROM (SELECT *, qs[k][cur[k] + 1] AS item FROM (SELECT *, list_position(quot, list_max(quot)) AS k FROM (SELECT *, list_transform(ws, lambda x, j: CASE WHEN cur[j] < len(qs[j]) THEN x ** 3 / (held[j] + 1) END) AS quot FROM s WHERE len(taken) < 6) WHERE list_max(quot) IS NOT NULL))))
        SELECT c_custkey, array_to_string(arg_max(taken, step), ',') AS queries FROM s GROUP BY c_custkey""",
    "model_cap": "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 400 GROUP BY 1",
    "detail_candidates": "SELECT doc_id AS seq, (doc_id * 7919 % 1000)::DOUBLE AS total FROM documents WHERE doc_id % 2 = 0 AND doc_id % 23 = 0 ORDER BY total DESC, seq LIMIT 30",
    "result_rows": f"""
        WITH {_PARTS}, {_PAIRS}, {_RANKED} SELECT profile_id, rank, 'docs:' || company || ':' || winner AS uid, CASE WHEN remote OR list_contains(places, 'Remote - Germany') OR list_contains(places, 'Remote, EMEA') THEN 'remote'
            WHEN regexp_matches(lower(body), '(^|[^\\p{{L}}\\p{{N}}_])(hybrid|hibrit)($|[^\\p{{L}}\\p{{N}}_])') THEN 'hybrid' WHEN regexp_matches(lower(body), '(^|[^\\p{{L}}\\p{{N}}_])(remote|uzaktan|evden)($|[^\\p{{L}}\\p{{N}}_])') THEN 'remote' WHEN len(places) > 0 THEN 'office'
            WHEN regexp_matches(lower(body), '(^|[^\\p{{L}}\\p{{N}}_])(on-?site|in office|office|ofis)($|[^\\p{{L}}\\p{{N}}_])') THEN 'office' ELSE 'unknown' END AS work_mode,
            'unknown' AS employment, age * 24 AS hours_ago, array_to_string(list_filter(title_skills, lambda s: weights[s] IS NULL), ',') AS missing, status AS place, final, array_to_string(places, '|') AS locations FROM ranked WHERE rank <= 25""",
    "report_header": f"WITH {_PARTS}, {_PAIRS} SELECT '2024-06-01T00:00:00Z' AS made_at, '1' AS version, (SELECT count(*) FROM verdicts) AS pairs, verdict, count(*) AS n FROM verdicts GROUP BY verdict",
    "markdown_report": f"""
        WITH {_PARTS}, {_PAIRS}, {_RANKED} SELECT profile_id, '# Shortlist of ' || profile_id || chr(10) || chr(10) || string_agg(rank || '. [' || title || '](https://jobs.example/' || winner || ') - ' || company || ' (' || printf('%.1f', final) || ')'
            || CASE WHEN {_REASONS} = '' THEN '' ELSE chr(10) || '   - ' || replace({_REASONS}, '; ', chr(10) || '   - ') END, chr(10) ORDER BY rank) || chr(10) AS report FROM ranked WHERE rank <= 25 GROUP BY profile_id""",
    "profile_summary": f"""
        WITH {_CV}, found AS (SELECT k, canonical, CASE canonical WHEN 'Spark' THEN round(2.0::DOUBLE / 6 + 0.35, 3) WHEN 'Kafka' THEN round(1.0::DOUBLE / 6, 3) WHEN 'Python' THEN round(1.0::DOUBLE / 6 + 0.35, 3) ELSE round((0.5 + 0.5 * old) / 6, 3) END AS evidence,
            CASE canonical WHEN 'Python' THEN NULL WHEN 'SQL' THEN old WHEN 'Excel' THEN old ELSE 1.0 END AS recency FROM w, (VALUES ('Spark'), ('Kafka'), ('Python'), ('SQL'), ('Excel')) v(canonical)),
            l AS (SELECT k, {_YEARS} AS years, CASE k % 4 WHEN 3 THEN 'staff' WHEN 0 THEN 'senior' ELSE CASE WHEN {_YEARS} >= 6 THEN 'senior' WHEN {_YEARS} >= 2.5 THEN 'mid' ELSE 'junior' END END AS level FROM w),
        t AS (SELECT k, count(*) AS n, array_to_string(list(canonical ORDER BY round(CASE WHEN evidence >= 0.45 THEN evidence ELSE evidence / 2 END, 4) DESC, canonical)[1:5], ', ') AS top FROM found GROUP BY k)
        SELECT k::VARCHAR AS profile_id, 'data' AS families, n AS n_skills, top AS top_skills, CASE level WHEN 'junior' THEN 'mid' WHEN 'mid' THEN 'senior' ELSE 'staff' END AS max_level, ceil(years + 2)::INT AS max_years, 'turkey' AS permits FROM l JOIN t USING (k)""",
    "run_report": """
        WITH d AS (SELECT source, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) > 1 AS dup, n_chars < 200 AS gone, doc_id % 9 = 0 AS ghost FROM documents)
        SELECT source, count(*) AS fetched, count(*) FILTER (dup) AS duplicates, count(*) FILTER (gone AND NOT dup) AS eliminated, count(*) FILTER (ghost AND NOT gone AND NOT dup) AS ghosted, count(*) FILTER (NOT gone AND NOT dup AND NOT ghost) AS kept FROM d GROUP BY source""",
    "stream_dedup": f"WITH {_STREAM} SELECT DISTINCT uid FROM s",
    "stream_budget": "SELECT event_type, w AS start, count(*) AS used FROM (SELECT event_type, unnest([floor(epoch(ts) / 1800)::BIGINT * 1800, floor(epoch(ts) / 1800)::BIGINT * 1800 - 1800]) AS w FROM events) GROUP BY 1, 2",
    "stream_log": f"WITH {_STREAM} SELECT run_id, event_type AS board_token, count(DISTINCT uid) AS sightings FROM s GROUP BY 1, 2",
    "stream_closed": f"""
        WITH {_STREAM}, one AS (SELECT DISTINCT run_id, uid, event_type FROM s), m AS (SELECT max(run_id) AS run FROM one), scanned AS (SELECT DISTINCT event_type FROM one, m WHERE run_id = run)
        SELECT uid, count(*) AS seen, max(run_id) AS last_run, any_value(event_type) IN (SELECT event_type FROM scanned) AND max(run_id) < (SELECT run FROM m) AS closed FROM one GROUP BY uid""",
    "stream_cooloff": """
        SELECT event_id, coalesce(ts >= max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 6 HOURS, true) AS allowed FROM events""",
}

#: What the window over the log tells, the state tells too.
ORACLE["stream_cooloff_state"] = ORACLE["stream_cooloff"]
