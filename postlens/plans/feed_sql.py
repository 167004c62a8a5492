"""SQL of what each feed's parser must give for the stand-in payloads, written from the feeds' fields and not from the parsers."""

from __future__ import annotations

_BASE = """
    docs AS (SELECT doc_id AS i, source, upper(source) AS firm, lang, doc_id::VARCHAR AS id, 'Role ' || doc_id AS title, 'https://jobs.example/' || doc_id AS url, 1700000000 + doc_id * 1000 AS stamp,
        'Work on ' || source || ' & ' || lang || '.' || chr(10) || '- one' || chr(10) || '- two' AS body FROM documents)
"""


def _posting(where: str = "true", **given: str) -> str:
    columns = {"company": "firm", "board_token": "source", "native_id": "id", "title": "title", "url": "url", "locations": "''", "description": "body", "department": "''", "employment_type": "''", "remote_flag": "NULL::BOOLEAN", "posted": "stamp", "sidecar": "''"} | given
    return f"WITH {_BASE} SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM docs WHERE {where}"


ORACLE: dict[str, str] = {
    "feed_greenhouse": _posting(locations="CASE WHEN i % 2 = 0 THEN 'Berlin|Paris' ELSE 'Oslo|Rome|Berlin' END || '|' || lang", department="'Data, ' || source", posted="CASE WHEN i % 3 <> 0 THEN stamp END"),
    "feed_lever": _posting(url="CASE WHEN i % 2 = 0 THEN url ELSE url || '/apply' END", locations="'Oslo|' || lang", description="CASE WHEN i % 2 = 0 THEN 'Plain text.' ELSE body END || CASE WHEN i % 5 = 0 THEN chr(10) || 'More.' ELSE '' END",
        department="CASE WHEN i % 3 = 0 THEN 'Team' ELSE 'Data' END", employment_type="'Full-time'", remote_flag="CASE i % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END", sidecar="['remote', 'hybrid', 'on-site', 'unspecified'][i % 4 + 1]"),
    "feed_ashby": _posting("i % 7 <> 0", locations="'Rome|Milan|' || lang", description="CASE WHEN i % 2 = 0 THEN 'Plain.' ELSE body END", department="source", employment_type="'FullTime'", remote_flag="CASE WHEN i % 2 = 1 THEN i % 3 = 0 WHEN i % 4 = 0 THEN true END", sidecar="CASE WHEN i % 4 = 0 THEN 'Remote' ELSE 'OnSite' END"),
    "feed_workable": _posting(native_id="CASE WHEN i % 2 = 0 THEN 'S' || i ELSE id END", locations="CASE WHEN i % 3 = 0 THEN 'Izmir, Turkey' ELSE 'Lyon, ARA, France' END", department="CASE WHEN i % 2 = 0 THEN 'A, B' ELSE 'C' END", employment_type="'full'", remote_flag="CASE WHEN i % 4 <> 0 THEN i % 4 = 1 WHEN i % 8 = 0 THEN true END"),
    "feed_smartrecruiters": _posting(locations="'Bonn, NRW, ' || lang", description="'Plain ad.'", department="'Ops'", employment_type="'Permanent'", remote_flag="i % 2 = 0"),
    "feed_remotive": _posting(company="source", board_token="'remotive:' || source", locations="CASE WHEN i % 2 = 0 THEN 'USA|Canada' ELSE 'Remote' END", department="'Data'", employment_type="'contract'", remote_flag="true", sidecar="'$1;a,' || lang"),
    "feed_remoteok": _posting("i % 6 <> 0", company="source", board_token="'remoteok'", locations="'Rome|Milan'", description="body || chr(10) || 'a, ' || lang", remote_flag="true", sidecar="CASE WHEN i % 2 = 0 THEN '10-20;' ELSE '' END || 'a,' || lang"),
    "feed_arbeitnow": _posting(company="source", board_token="'arbeitnow'", native_id="'s-' || i", locations="'Munich'", employment_type="'full, part'", remote_flag="i % 2 = 0", sidecar="lang"),
    "feed_themuse": _posting(company="source", board_token="'themuse'", locations="CASE WHEN i % 2 = 0 THEN 'Flexible / Remote' ELSE 'Rome' END", department="'Data'", remote_flag="CASE WHEN i % 2 = 0 THEN true END", sidecar="'Senior'"),
    "feed_himalayas": _posting(company="source", board_token="'himalayas'", native_id="'g' || i", locations="'Spain|' || lang", department="'x, y'", employment_type="'Full Time'", remote_flag="true", sidecar="CASE WHEN i % 2 = 0 THEN '5-9 EUR;' ELSE '' END || '1800000000'"),
    "feed_jobicy": _posting(company="source", board_token="'jobicy'", locations="'USA|Canada'", department="'i'", employment_type="'full, part'", remote_flag="true", sidecar="'Mid'"),
    "feed_weworkremotely": _posting(company="CASE WHEN i % 5 = 0 THEN '' ELSE source END", board_token="'weworkremotely'", native_id="url", title="CASE WHEN i % 5 = 0 THEN source ELSE title END", locations="'Anywhere'", description="'Work on ' || source || '.'", department="'Code'", remote_flag="true"),
    "feed_board_cards": f"""WITH {_BASE}, first AS (SELECT source, i // 400 AS page, i % 700 AS n, min(i) AS i FROM docs GROUP BY 1, 2, 3)
        SELECT source AS company, source || '-' || page AS board_token, '/is-ilani/' || n AS native_id, 'Role ' || n AS title, 'Izmir|Ankara' AS locations, 'Tam Zamanlı' AS employment_type, CASE i % 3 WHEN 0 THEN true WHEN 1 THEN false END AS remote_flag,
            epoch(TIMESTAMP '2024-06-01')::BIGINT - 86400 * CASE i % 4 WHEN 0 THEN 14 WHEN 1 THEN 3 WHEN 2 THEN 0 END AS posted, ['Uzaktan', 'Hibrit', ''][i % 3 + 1] AS sidecar FROM first""",
    "feed_job_posting_ld": _posting(company="source", board_token="'eleman'", locations="''", employment_type="'FULL_TIME'", posted="epoch(TIMESTAMP '2024-01-05')::BIGINT", sidecar="'100;2024-03-05'"),
    "feed_list_links": "SELECT source || '-' || page AS token, '/job/' || n AS path, 'Title ' || min(doc_id) AS title FROM (SELECT doc_id, source, doc_id // 400 AS page, doc_id % 10 AS n FROM documents) GROUP BY source, page, n",
    "feed_board_detail": "SELECT doc_id::VARCHAR AS token, 'About ' || source || chr(10) || 'in ' || lang || chr(10) || 'Level: ' || doc_id AS text FROM documents",
    "sitemap_paths": r"SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages WHERE contains(url, 'example') AND regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) <> ''",
    "firm_paths": "SELECT path FROM (SELECT '/firma/' || replace(lower(p_name), ' ', '+') || '-' || p_partkey AS path FROM part) WHERE contains(path, 'red') ORDER BY length(path), path LIMIT 2",
    "feed_pool": f"""WITH {_BASE}, rows AS (SELECT 0 AS r, 'lever' AS feed, source AS token, id FROM docs UNION ALL SELECT 1, 'remoteok', 'remoteok', id FROM docs WHERE i % 6 <> 0)
        SELECT row_number() OVER (ORDER BY r, token, id) AS seq, feed AS source, token AS board_token, id AS native_id FROM rows""",
}
