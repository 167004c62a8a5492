"""SQL for each query of the catalogue that SQL can express, written on its own and not derived from the plans."""

_MATCHES = r"""
    matches AS (SELECT DISTINCT doc_id, canonical FROM (SELECT doc_id, unnest([
        CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])license[\p{L}\p{M}\p{N}\p{Pc}]{0,7}([^\p{L}\p{M}\p{N}\p{Pc}]|$)') AND regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])licensed?[\p{L}\p{M}\p{N}\p{Pc}]{0,6}([^\p{L}\p{M}\p{N}\p{Pc}]|$)') THEN 'license' END,
        CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])terms([^\p{L}\p{M}\p{N}\p{Pc}]|$)') THEN 'terms' END,
        CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])general\s+public[\p{L}\p{M}\p{N}\p{Pc}]{0,6}([^\p{L}\p{M}\p{N}\p{Pc}]|$)') THEN 'general public' END,
        CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])version[\p{L}\p{M}\p{N}\p{Pc}]{0,6}([^\p{L}\p{M}\p{N}\p{Pc}]|$)') THEN 'version' END,
        CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])released[\p{L}\p{M}\p{N}\p{Pc}]{0,6}([^\p{L}\p{M}\p{N}\p{Pc}]|$)') THEN 'released' END,
        CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}+#&])(the|les|der|los)([^\p{L}\p{M}\p{N}\p{Pc}+#&]|$)') THEN 'article' END]) AS canonical FROM documents) WHERE canonical IS NOT NULL),
    weights(canonical, w) AS (VALUES ('license', 1.0::DOUBLE), ('terms', 0.6), ('general public', 1.5), ('version', 0.4), ('released', 0.8), ('article', 0.2)),
    skill AS (SELECT doc_id, count(*) AS n_matched, round(least(sum(w) / 8, 1.0) * 45, 4) AS score FROM matches JOIN weights USING (canonical) GROUP BY doc_id)
"""
_GHOST = r"""
    base AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE date_diff('day', o_orderdate::DATE, DATE '2001-08-01') END AS age,
        o_orderpriority = '5-LOW' AS pool, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS same,
        count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) - (o_orderstatus = 'F')::INT AS again FROM orders),
    ghost AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN age IS NULL THEN 0.25::DOUBLE WHEN age > 1095 THEN 0.85::DOUBLE WHEN age > 730 THEN 0.70::DOUBLE WHEN age > 365 THEN 0.50::DOUBLE
        WHEN age > 180 THEN 0.35::DOUBLE WHEN age > 120 THEN 0.20::DOUBLE WHEN age <= 14 THEN -0.10::DOUBLE ELSE 0::DOUBLE END
        + CASE WHEN pool THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN same >= 3 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN again > 6 THEN 0.15::DOUBLE ELSE 0 END)), 4) AS risk FROM base)
"""
_CONTRAST = r"""
    dims AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    own AS (SELECT i, avg(x) AS m FROM dims WHERE label = 0 GROUP BY i), other AS (SELECT i, avg(x) AS m FROM dims WHERE label <> 0 GROUP BY i),
    fits AS (SELECT vec_id, round(sum(x * own.m) / (sqrt(sum(x * x)) * sqrt(sum(own.m * own.m))) - sum(x * other.m) / (sqrt(sum(x * x)) * sqrt(sum(other.m * other.m))), 6) AS fit
        FROM dims JOIN own USING (i) JOIN other USING (i) GROUP BY vec_id)
"""
_SIGHTINGS = r"""
    s AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS run_id, 'u:' || user_id || ':' || event_type AS uid, event_type AS token, ts, md5(props) AS content_hash,
        CASE WHEN value > 20 THEN props ELSE '' END AS description, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts DESC, event_id DESC) AS n FROM events),
    one AS (SELECT * FROM s WHERE n = 1)
"""
_FOLD_CASE = "CASE WHEN j.len > 1.2 * v.len THEN j WHEN v.len > 1.2 * j.len THEN v WHEN j.fresh > v.fresh THEN j WHEN j.fresh < v.fresh THEN v WHEN j.places > v.places THEN j ELSE v END"

ORACLE: dict[str, str] = {
    "posting_keys": r"""
        SELECT doc_id, 'docs:' || source || ':' || doc_id AS uid,
            source || '|' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[^a-z0-9+#]+', ' ', 'g'),
                '\b(remote|hybrid|onsite|fmd|mfd|w)\b', ' ', 'g'), '\s+', ' ', 'g')) AS title_key,
            left(sha256(split_part(text, chr(10), 1) || '|' || array_to_string(list_sort([lang, source]), '|') || '|' || text), 16) AS content_hash FROM documents""",
    "html_to_text": r"""
        WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS t FROM pages),
        b AS (SELECT page_id, regexp_replace(t, '(?i)<br[^>]*>|</(p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|section|article)>', chr(10), 'g') AS t FROM a),
        c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<li[^>]*>', '- ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM b),
        d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&') AS t FROM c),
        e AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM d)
        SELECT page_id, trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM e""",
    "url_slug": r"""
        SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
            replace(trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '[/._-]', ' ', 'g')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' ', '+') AS slug FROM pages""",
    "multi_format_dates": "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE floor(epoch_us(ts) / 1000000)::BIGINT END AS seconds FROM events",
    "age_bands": """
        SELECT CASE WHEN age > 1095 THEN 'over 3 years' WHEN age > 365 THEN 'over a year' WHEN age > 120 THEN 'stale' WHEN age <= 14 THEN 'new' ELSE 'open' END AS age_band, count(*) AS n, min(o_orderkey) AS first_key
        FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2001-08-01') AS age FROM orders) GROUP BY 1""",
    "ghost_risk": f"""
        WITH {_GHOST} SELECT o_orderkey, risk, CASE WHEN risk >= 0.70 THEN 'ghost' WHEN risk >= 0.45 THEN 'doubtful' WHEN risk >= 0.20 THEN 'normal' ELSE 'fresh' END AS band,
            CASE WHEN again > 6 THEN 'strong' WHEN same > 1 THEN 'medium' ELSE 'weak' END AS evidence FROM ghost""",
    "elimination_reason": """
        WITH l AS (SELECT l_orderkey, sum(l_quantity) AS qty, max(l_discount) AS disc FROM lineitem GROUP BY 1)
        SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'priority' WHEN o_totalprice > 450000 THEN 'price' WHEN qty > 200 THEN 'quantity' WHEN disc >= 0.1 THEN 'discount' END AS reason
            FROM orders LEFT JOIN l ON l_orderkey = o_orderkey) WHERE reason IS NOT NULL GROUP BY reason""",
    "dedup_fold": f"""
        WITH g AS (SELECT source, lang, list({{'seq': doc_id, 'len': length(text), 'fresh': n_chars, 'places': length(regexp_replace(text, '[^,]', '', 'g'))}} ORDER BY doc_id) AS l FROM documents GROUP BY source, lang)
        SELECT source, lang, list_reduce(l, lambda v, j: {_FOLD_CASE}).seq AS winner, l[1].seq AS rank, len(l) AS size FROM g""",
    "dedup_distinct_first": "SELECT min(page_id) AS page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages GROUP BY 2",
    "idf_weights": f"""
        WITH {_MATCHES}, t AS (SELECT count(*)::DOUBLE AS n FROM documents)
        SELECT canonical, count(*) AS df, round(least(4.0, greatest(0.3, ln(1 / greatest(count(*) / any_value(n), 1 / (4 * any_value(n)))))), 2) AS idf FROM matches, t GROUP BY canonical""",
    "dict_match_score": f"WITH {_MATCHES} SELECT doc_id, n_matched, score FROM skill",
    "weighted_mentions": r"""
        WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}+#&]+'), lambda x: x <> '')) AS word FROM conversations),
        m AS (SELECT conv_id, word, round(least(sum(0.5 + 0.5 * greatest(0.25, 1 - turn::DOUBLE / 8)), 6.0) / 6, 6) AS evidence, count(*) AS mentions FROM w
            WHERE word IN ('the', 'and', 'der', 'und', 'les', 'des', 'los', 'que') GROUP BY 1, 2)
        SELECT conv_id, word, evidence, mentions, CASE WHEN evidence >= 0.45 THEN 'strong' ELSE 'weak' END AS strength FROM m""",
    "seniority_case": """
        SELECT p_partkey, level, CASE level WHEN 'junior' THEN 0 WHEN 'mid' THEN 1 WHEN 'senior' THEN 2 ELSE 3 END AS rank FROM (
            SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'staff' WHEN regexp_matches(p_name, '^(small|red) ') THEN 'junior' WHEN p_size > 35 THEN 'senior' ELSE 'mid' END AS level FROM part)""",
    "work_mode_case": r"""
        SELECT lang, source, CASE WHEN lang = 'de' THEN 'hybrid' WHEN source = 'src3' THEN 'remote' WHEN regexp_matches(text, '(?i)\b(hybrid|hibrit)\b') THEN 'hybrid'
            WHEN regexp_matches(text, '(?i)\b(remote|uzaktan|work from home|evden)\b') THEN 'remote' WHEN regexp_matches(text, '(?i)\b(on-?site|in office|office|ofis)\b') THEN 'office' ELSE 'unknown' END AS mode, count(*) AS n
        FROM documents GROUP BY 1, 2, 3""",
    "geo_resolve": """
        SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN lower(r_name) ELSE lower(n_name) END AS countries
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment <> 'MACHINERY'""",
    "permit_semi": "SELECT c_nationkey, count(*) AS n, sum(c_acctbal::DECIMAL(18, 2))::DOUBLE AS balance FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)) GROUP BY 1",
    "closed_anti": """
        SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) < 2000 AND o_orderstatus IN (SELECT o_orderstatus FROM orders WHERE year(o_orderdate) >= 2000)
            AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) >= 2000)""",
    "repost_self": """
        SELECT a.o_orderkey, count(b.o_orderkey) AS reposts FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey AND b.o_orderstatus = 'F' GROUP BY 1""",
    "trigger_activation": """
        WITH t(family, event_type, strong, least) AS (VALUES ('buyer', 'purchase', true, 2), ('buyer', 'click', false, 2), ('fragile', 'error', false, 2), ('fragile', 'signup', false, 2), ('reader', 'view', false, 3), ('reader', 'click', false, 3), ('reader', 'signup', false, 3)),
        h AS (SELECT DISTINCT user_id, event_type FROM events)
        SELECT user_id, family, count(*) FILTER (strong) AS n_strong, count(*) FILTER (NOT strong) AS n_support FROM h JOIN t USING (event_type) GROUP BY 1, 2
        HAVING count(*) FILTER (strong) >= 1 OR count(*) FILTER (NOT strong) >= max(least)""",
    "profile_cross_score": """
        SELECT * FROM (SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY points DESC, p_partkey) AS rank, p_partkey, points FROM (
            SELECT n_nationkey, p_partkey, greatest(0, 45 - abs(p_size - (n_nationkey * 2 + 1))) + CASE WHEN p_type = 'PROMO' THEN 15 ELSE 0 END AS points FROM part, nation)) WHERE rank <= 10""",
    "overlap_join": r"""
        WITH q AS (SELECT DISTINCT p_name AS q, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9+#]+'), lambda x: x <> '')) AS a FROM part),
        p AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS p, list_distinct(list_filter(regexp_split_to_array(lower(p_type || ' ' || p_name), '[^a-z0-9+#]+'), lambda x: x <> '')) AS b FROM part)
        SELECT q, p, len(list_intersect(a, b)) AS common, round(len(list_intersect(a, b))::DOUBLE / len(a) - 0.04::DOUBLE * (len(b) - len(list_intersect(a, b))), 4) AS score FROM q, p WHERE len(list_intersect(a, b)) > 0""",
    "prefix_sector": r"""
        WITH paths AS (SELECT replace(lower(p_name || ' ' || p_type), ' ', '+') AS path FROM part UNION SELECT replace(lower(p_name), ' ', '+') FROM part)
        SELECT a.path, count(*) AS n FROM paths a JOIN paths b ON starts_with(b.path, a.path || '+') GROUP BY 1 HAVING count(*) >= 3""",
    "topk_per_group": "SELECT * FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, o_totalprice FROM orders) WHERE rank <= 3",
    "history_lag": """
        SELECT event_id, row_number() OVER w AS nth, coalesce(lag(event_type) OVER w = event_type AND lag(date_trunc('hour', ts)) OVER w <> date_trunc('hour', ts), false) AS fake_refresh, epoch_us(min(ts) OVER (PARTITION BY user_id)) AS first_micros
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "seen_counts_snapshot": f"""
        WITH {_SIGHTINGS}, m AS (SELECT max(run_id) AS run FROM one), scanned AS (SELECT DISTINCT token FROM one, m WHERE run_id = run)
        SELECT uid, count(*) AS seen, max(token) IN (SELECT token FROM scanned) AND max(run_id) < (SELECT run FROM m) AS closed, max(run_id) AS last_run, arg_max(content_hash, run_id) AS content_hash,
            arg_max(description, run_id) FILTER (description <> '') AS description, epoch_us(min(ts)) AS first_micros FROM one GROUP BY uid""",
    "carry_forward": """
        WITH s AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sec FROM events)
        SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, sec ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM s""",
    "neighbour_window": """
        WITH n AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) OVER w AS r, sum(l_quantity) OVER w AS q FROM lineitem
            WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING))
        SELECT l_orderkey, sum(r)::BIGINT AS near_returns, max(q) AS most_qty, min(q) AS least_qty FROM n GROUP BY 1""",
    "interval_union": """
        WITH r AS (SELECT o_custkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + 30 + o_orderkey % 200 AS e FROM orders),
        a AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS new FROM r),
        b AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM a),
        c AS (SELECT o_custkey, i, max(e) - min(s) AS l FROM b GROUP BY 1, 2)
        SELECT o_custkey, sum(l)::BIGINT AS length, count(*) AS islands FROM c GROUP BY 1""",
    "half_life_decay": """
        SELECT o_custkey, round(sum(CASE WHEN y <= 1.5 THEN 1.0::DOUBLE ELSE greatest(0.25::DOUBLE, pow(0.5::DOUBLE, (y - 1.5) / 2)) END), 4) AS decayed
        FROM (SELECT o_custkey, date_diff('day', o_orderdate::DATE, DATE '2001-08-01') / 365.25::DOUBLE AS y FROM orders) GROUP BY 1""",
    "dhondt_seats": """
        WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), q AS (SELECT c_nationkey, s, pow(n::DOUBLE, 3) / s AS q FROM n, range(1, 41) t(s)),
        w AS (SELECT * FROM q ORDER BY q DESC, c_nationkey, s LIMIT 40)
        SELECT c_nationkey, count(*) AS seats FROM w GROUP BY 1""",
    "round_robin": """
        WITH l AS (SELECT 0 AS owner, row_number() OVER (ORDER BY n_nationkey) AS place, n_regionkey::VARCHAR AS value FROM nation
            UNION ALL SELECT s_nationkey % 3 + 1, row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_suppkey), s_nationkey || '-' || floor(s_acctbal / 2500)::BIGINT FROM supplier),
        o AS (SELECT value, min({'place': place, 'owner': owner}) AS pick FROM l GROUP BY value)
        SELECT row_number() OVER (ORDER BY pick.place, pick.owner) AS slot, pick.owner AS owner, pick.place AS place, value FROM o ORDER BY slot LIMIT 24""",
    "best_relative": "SELECT p_partkey, p_brand, best FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS best FROM part) WHERE p_retailprice >= 0.95 * best",
    "systematic_sample": """
        WITH t AS (SELECT greatest(1, count(*) // 1500) AS s FROM orders) SELECT o_orderkey, o_custkey FROM orders, t WHERE o_orderkey % s = 0 AND o_orderkey // s < 1500""",
    "rolling_budget": """
        SELECT event_id, used, greatest(0, least(6 - used, 4)) AS "left" FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch_us(ts) / 1000000)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS used FROM events)""",
    "cooloff": """
        SELECT event_id, b IS NULL OR ts >= b + INTERVAL 6 HOURS AS allowed FROM (SELECT event_id, ts, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)""",
    "ttl_cache": """
        WITH e AS (SELECT event_id, event_type, (epoch_us(ts) - max(CASE WHEN event_type <> 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 3600000000.0 AS h FROM events)
        SELECT event_id, CASE WHEN h < 12 THEN 'cached' WHEN event_type = 'error' AND h < 72 THEN 'stale' WHEN event_type = 'error' THEN 'failed' ELSE 'fetched' END AS state FROM e""",
    "union_pool": "SELECT 'customers' AS pool, c_nationkey AS nation, count(*) AS n, max(c_custkey) AS last_seq FROM customer GROUP BY 2 UNION ALL SELECT 'suppliers', s_nationkey, count(*), max(s_suppkey) FROM supplier GROUP BY 2",
    "version_diff": """
        WITH l AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderdate < TIMESTAMP '1998-07-01') AS a, list(DISTINCT o_orderpriority) FILTER (o_orderdate >= TIMESTAMP '1998-07-01') AS b FROM orders GROUP BY 1)
        SELECT o_custkey, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS entered, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS left_ FROM l WHERE a IS NOT NULL AND b IS NOT NULL""",
    "role_argmax": """
        WITH f(ord, family, pattern, weight) AS (VALUES (0, 'metal', 'bolt|gear|widget', 0.8::DOUBLE), (1, 'shape', 'ring|bolt', 0.9), (2, 'colour', '^(red|blue|green) ', 0.9), (3, 'size', '^(small|large) ', 0.5))
        SELECT p_partkey, family, weight FROM (SELECT p_partkey, family, weight, row_number() OVER (PARTITION BY p_partkey ORDER BY weight DESC, ord) AS n FROM part JOIN f ON regexp_matches(p_name, pattern)) WHERE n = 1""",
    "family_weight": """
        WITH r AS (SELECT p_type, p_brand, count(*) AS t, max(year(l_shipdate)) AS y, max((l_returnflag = 'R')::INT) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
        SELECT p_type, p_brand, round(least(1.0::DOUBLE, CASE WHEN r = 1 THEN 0.55::DOUBLE ELSE 0.40::DOUBLE END + 0.45::DOUBLE * t / max(t) OVER (PARTITION BY p_type)) * (0.55::DOUBLE + 0.45::DOUBLE * CASE WHEN y >= 2001 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END), 2) AS weight FROM r""",
    "late_materialise": """
        WITH b AS (SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY n_chars DESC, doc_id LIMIT 30)
        SELECT doc_id, md5(text) AS digest, length(text) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM b)""",
    "contrast_cosine": f"WITH {_CONTRAST} SELECT vec_id, fit FROM fits",
    "fit_band_score": f"""
        WITH {_CONTRAST} SELECT vec_id, round((n_chars % 100) * (1 - 0.75::DOUBLE * (vec_id % 4) / 4) * CASE WHEN vec_id % 7 <> 0 THEN greatest(0.82::DOUBLE, least(1.18::DOUBLE, 1 + 4.5::DOUBLE * fit)) ELSE 1 END, 1) AS final FROM fits JOIN documents ON vec_id = doc_id""",
    "stable_sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "store_stats": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
    "json_sidecar": """
        SELECT event_id, (props->>'$.k')::INT AS k, '{"kind":"' || event_type || '","k":' || (props->>'$.k') || '}' AS sidecar FROM events""",
    "coverage_ratio": """
        SELECT p_type, round(avg(regexp_matches(p_name, 'bolt|ring|gear')::INT), 6) AS simple, round(sum(CASE WHEN regexp_matches(p_name, 'bolt|ring|gear') THEN p_size ELSE 0 END)::DOUBLE / sum(p_size), 6) AS weighted FROM part GROUP BY 1""",
    "topn_quality": """
        WITH t AS (SELECT source, toxic, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id))
        SELECT source, count(*) AS filled, count(*) FILTER (toxic = 1) AS leaked, count(*) FILTER (r <= 5 AND quality = 1) AS hits FROM t WHERE r <= 10 GROUP BY 1""",
    "conversation_context": """
        SELECT conv_id, turn, array_to_string(list(role) OVER w, '>') AS context, sum(length(text)) OVER w::BIGINT AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    "stream_sightings": "SELECT user_id || ':' || event_type AS uid, count(*) AS seen, epoch_us(min(ts)) AS first_micros, epoch_us(max(ts)) AS last_micros FROM events GROUP BY 1",
    "flagship_shortlist": f"""
        WITH {_MATCHES},
        r AS (SELECT d.doc_id, source, n_chars, quality, toxic, coalesce(score, 0.0) AS score, d.doc_id * 37 % 900 AS age FROM documents d LEFT JOIN skill USING (doc_id) LEFT JOIN labels USING (doc_id)),
        k AS (SELECT *, round(greatest(0::DOUBLE, CASE WHEN age > 730 THEN 0.70::DOUBLE WHEN age > 365 THEN 0.50::DOUBLE WHEN age > 180 THEN 0.35::DOUBLE WHEN age > 120 THEN 0.20::DOUBLE WHEN age <= 14 THEN -0.10::DOUBLE ELSE 0::DOUBLE END), 4) AS risk
            FROM r WHERE coalesce(quality, 1) <> 0 AND coalesce(toxic, 0) <> 1 AND n_chars >= 200),
        f AS (SELECT *, round(score * (1 - 0.75::DOUBLE * risk), 3) AS final FROM k WHERE risk < 0.7)
        SELECT * FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY final DESC, doc_id) AS rank, doc_id, final, risk,
            CASE WHEN risk >= 0.70 THEN 'ghost' WHEN risk >= 0.45 THEN 'doubtful' WHEN risk >= 0.20 THEN 'normal' ELSE 'fresh' END AS band FROM f) WHERE rank <= 3""",
}

#: Text of markup doesn't change when the markup is escaped once more.
ORACLE["escaped_html_to_text"] = ORACLE["html_to_text"]
