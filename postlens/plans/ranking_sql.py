"""SQL of the ranking queries over the stand-in postings, written from the rules and not from the plans."""

from __future__ import annotations

import re

from ..catalog import SKILLS

_PARTS = r"""
    src AS (SELECT doc_id AS seq, source AS company, text,
        ['Senior', 'Junior', 'Lead', '', 'Mid/Senior', 'Principal'][doc_id % 6 + 1] AS word,
        ['Data Engineer', 'Backend Developer', 'DevOps Engineer', 'Nurse', 'Recruiter', 'Machine Operator', 'Accountant', 'Java Data Analyst'][doc_id // 2 % 8 + 1] AS role,
        ['', ' | Germany | Remote', ' (Berlin)', ' - Hybrid', ' | Canada'][doc_id // 3 % 5 + 1] AS suffix,
        [['Remote - Germany'], ['Istanbul, Turkey'], ['Tel Aviv-Yafo'], ['United States & Canada'], ['Mars'], [], ['Remote, EMEA']][doc_id % 7 + 1] AS places,
        ['At least 5 years of experience with Python, Spark and Kafka.', 'We have 15 years of experience in logistics.', '3-6 years experience required. Docker, Kubernetes and AWS.', 'There is no visa sponsorship.',
            'Fluent German required; SQL and Excel.', 'This is for future openings.', '', '12 years of experience. Java, SQL and Airflow.', 'Patient care and amazon web services.'][doc_id % 9 + 1] AS intro,
        ['Engineering', '', 'Data Engineer guild'][doc_id // 5 % 3 + 1] AS department,
        CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS remote,
        CASE WHEN doc_id % 11 <> 0 THEN doc_id * 37 % 1200 END AS age FROM documents),
    posts AS (SELECT *, trim(word || ' ' || role) AS base, trim(word || ' ' || role) || suffix AS title, CASE WHEN seq % 23 = 0 THEN '' ELSE concat_ws(chr(10), intro, text) END AS body FROM src),
    grouped AS (SELECT list({'seq': seq, 'len': length(body), 'fresh': CASE WHEN age IS NULL THEN 0 ELSE 100000 - age END, 'places': len(places)} ORDER BY seq) AS l FROM posts GROUP BY company, lower(base)),
    winners AS (SELECT list_reduce(l, lambda v, j: CASE WHEN j.len > 1.2 * v.len THEN j WHEN v.len > 1.2 * j.len THEN v WHEN j.fresh > v.fresh THEN j WHEN j.fresh < v.fresh THEN v WHEN j.places > v.places THEN j ELSE v END).seq AS winner,
        l[1].seq AS rank, len(l) AS variants FROM grouped),
    folded AS MATERIALIZED (SELECT p.* EXCLUDE (seq), winner, rank AS seq, variants FROM posts p JOIN winners w ON p.seq = w.winner),
    whole AS MATERIALIZED (SELECT seq, title || chr(10) || body AS t, lower(title || chr(10) || body) AS low FROM folded),
    has_skill AS MATERIALIZED (SELECT DISTINCT seq, canonical FROM (SELECT seq, unnest([@TERMS]) AS canonical FROM whole) WHERE canonical IS NOT NULL),
    skills AS (SELECT seq, list(canonical ORDER BY canonical) AS skills FROM has_skill GROUP BY seq),
    idf AS MATERIALIZED (SELECT canonical, round(least(4.0, greatest(0.3, ln(1 / greatest(count(*)::DOUBLE / (SELECT count(*) FROM folded), 1 / (4 * (SELECT count(*) FROM folded)::DOUBLE))))), 2)::DOUBLE AS idf FROM has_skill GROUP BY canonical),
    keyed AS (SELECT *, company || '|' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[^a-z0-9+#]+', ' ', 'g'), '\b(remote|hybrid|onsite|fmd|mfd|w)\b', ' ', 'g'), '\s+', ' ', 'g')) AS title_key FROM folded),
    facts AS MATERIALIZED (SELECT k.*, coalesce(skills, []::VARCHAR[]) AS skills, count(*) OVER (PARTITION BY title_key) AS same_title,
        CASE word WHEN 'Senior' THEN 'senior' WHEN 'Junior' THEN 'junior' WHEN 'Lead' THEN 'senior' WHEN 'Mid/Senior' THEN 'mid' WHEN 'Principal' THEN 'staff'
            ELSE CASE WHEN regexp_matches(lower(body[:1500]), '(^|[^\p{L}\p{N}_])(intern|internship|junior|jr|entry level|entry-level|graduate|stajyer)($|[^\p{L}\p{N}_])') THEN 'junior'
                WHEN regexp_matches(lower(body[:1500]), '(^|[^\p{L}\p{N}_])(staff|principal|head of|director|vp|chief|lead architect)($|[^\p{L}\p{N}_])') THEN 'staff'
                WHEN regexp_matches(lower(body[:1500]), '(^|[^\p{L}\p{N}_])(senior|sr|lead|kıdemli)($|[^\p{L}\p{N}_])') THEN 'senior' ELSE 'mid' END END AS level,
        CASE WHEN body = '' THEN NULL WHEN intro LIKE 'At least 5%' THEN 5 WHEN intro LIKE '3-6%' THEN 3 WHEN intro LIKE '12 %' THEN 12 END AS years,
        role = 'Machine Operator' AS practitioner,
        CASE role WHEN 'Data Engineer' THEN 'data' WHEN 'Java Data Analyst' THEN 'data' WHEN 'Backend Developer' THEN 'software' WHEN 'DevOps Engineer' THEN 'cloud' WHEN 'Nurse' THEN 'health' WHEN 'Recruiter' THEN 'people' WHEN 'Accountant' THEN 'finance' END AS title_family,
        CASE WHEN department = 'Data Engineer guild' THEN 'data' END AS text_family,
        CASE WHEN role = 'Java Data Analyst' THEN ['Java'] ELSE []::VARCHAR[] END AS title_skills,
        CASE places[1] WHEN 'Remote - Germany' THEN ['germany'] WHEN 'Istanbul, Turkey' THEN ['turkey'] WHEN 'Tel Aviv-Yafo' THEN ['israel'] WHEN 'United States & Canada' THEN ['canada', 'usa'] WHEN 'Remote, EMEA' THEN ['france', 'germany', 'israel', 'netherlands', 'poland', 'spain', 'turkey', 'uk'] END AS countries,
        body <> '' AND intro = 'This is for future openings.' AS pool_text,
        regexp_matches(lower(body[:3000]), '(^|[^\p{L}\p{N}_])(emea|europe, middle east|cet)($|[^\p{L}\p{N}_])') AS says_emea FROM keyed k LEFT JOIN skills s ON k.seq = s.seq),
    risks AS MATERIALIZED (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN age IS NULL THEN 0.25::DOUBLE WHEN age > 1095 THEN 0.85::DOUBLE WHEN age > 730 THEN 0.70::DOUBLE WHEN age > 365 THEN 0.50::DOUBLE WHEN age > 180 THEN 0.35::DOUBLE WHEN age > 120 THEN 0.20::DOUBLE
        WHEN age <= 14 THEN -0.10::DOUBLE ELSE 0::DOUBLE END + CASE WHEN pool_text THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN same_title >= 3 THEN 0.10::DOUBLE ELSE 0 END)), 4) AS risk FROM facts)
"""
#: The dictionary is a parameter of the queries, so it is one of the SQL too.
#: Letters of the languages that the tables are in; classes of all scripts take seconds to compile for each of some two hundred terms.
_LETTER = r"0-9A-Za-z_\x{AA}\x{B5}\x{BA}\x{C0}-\x{24F}"


def _pattern(term: str, case_sensitive: bool) -> str:
    """A term between two characters that are no letters; long ones and those of several words may take an ending."""
    ending = f"[{_LETTER}]{{0,6}}" if " " in term or len(term) >= 7 else ""
    no_letter = f"[^{_LETTER}{'+#&' if len(term) <= 3 else ''}]"
    body = r"\s+".join(re.sub(r"([^\w])", r"\\\1", x) for x in term.split())
    return f"{'' if case_sensitive else '(?i)'}(^|{no_letter}){body}{ending}({no_letter}|$)"


# each pattern is a constant of the statement, so that it is compiled once
_PARTS = _PARTS.replace("@TERMS", ", ".join(f"CASE WHEN contains(low, '{term.split()[0].lower()}') AND regexp_matches(t, '{_pattern(term, cs)}') THEN '{name}' END" for _, name, terms, cs in SKILLS for term in terms))
#: Sums are rounded as decimals of their shortest spelling, so that 9.5 * 0.7, a little under 6.65, is 6.6 and not 6.7.
_PAIRS = r"""
    people(profile_id, permits, max_rank, max_years, forbidden, sponsor, languages, trade, shows, fam1, w1, fam2, w2, weights, remote_bonus, sec1, s1, sec2, s2) AS (VALUES
        ('anna', ['germany', 'remote_emea'], 2, 8, 'principal', false, ['english', 'german'], false, false, 'data', 1.0::DOUBLE, 'software', 0.6::DOUBLE, MAP {'Python': 1.0::DOUBLE, 'Spark': 1.5, 'Kafka': 0.8, 'SQL': 1.0, 'Airflow': 0.7, 'Excel': 0.2}, 0.4::DOUBLE, 'license', 0.5::DOUBLE, NULL, NULL::DOUBLE),
        ('bora', ['turkey', 'israel', 'canada', 'usa'], 3, 0, NULL, true, ['english'], false, true, 'cloud', 0.9, 'data', 0.9, MAP {'AWS': 1.2::DOUBLE, 'Docker': 1.0, 'Kubernetes': 1.4, 'SQL': 0.5, 'Java': 0.9}, 0.0, NULL, NULL, NULL, NULL),
        ('carl', ['turkey', 'germany', 'canada', 'israel', 'usa', 'remote_emea'], 1, 4, 'recruiter|nurse', false, ['english'], true, true, 'health', 0.8, 'people', 0.7, MAP {'Patient care': 1.0::DOUBLE, 'Recruitment': 0.5}, 1.2, 'the', 0.3, 'license', 0.9)),
    known AS (SELECT r.*, p.*, list_filter(skills, lambda s: coalesce(weights[s], 0) > 0) AS known,
        CASE WHEN title_family = fam1 THEN w1 WHEN title_family = fam2 THEN w2 END AS by_title, CASE WHEN text_family = fam1 THEN w1 WHEN text_family = fam2 THEN w2 END AS by_text,
        CASE WHEN contains(lower(concat_ws(chr(10), title, department, array_to_string(places, ' '), body)), sec1) THEN s1 WHEN contains(lower(concat_ws(chr(10), title, department, array_to_string(places, ' '), body)), sec2) THEN s2 END AS sector,
        len(list_filter(title_skills, lambda s: weights[s] IS NULL)) AS missing FROM risks r, people p),
    worth AS (SELECT k.seq, k.profile_id, sum(weights[canonical] * idf) AS worth, count(*) FILTER (idf >= 1.5) AS informative FROM (SELECT seq, profile_id, weights, unnest(known) AS canonical FROM known) k JOIN idf USING (canonical) GROUP BY k.seq, k.profile_id),
    parts AS (SELECT k.*, coalesce(informative, 0) AS informative, CASE WHEN by_title IS NOT NULL THEN by_title * 40 WHEN by_text IS NOT NULL THEN by_text * 20 ELSE 0 END AS role_score,
        CASE WHEN trim(body) = '' THEN least(len(title_skills) - missing, 3)::DOUBLE ELSE least(coalesce(worth, 0) / 8, 1.0::DOUBLE) * 45 END AS skill_score,
        least(CASE WHEN remote THEN remote_bonus ELSE 0 END + coalesce(sector, 0), 1.0::DOUBLE) * 15 AS bonus, by_title IS NULL AS off_domain FROM known k LEFT JOIN worth w ON k.seq = w.seq AND k.profile_id = w.profile_id),
    summed AS (SELECT *, round((role_score + skill_score + bonus)::VARCHAR::DECIMAL(30, 18), 1)::DOUBLE AS t0 FROM parts),
    totals AS (SELECT *, CASE WHEN missing >= 2 THEN round((t1 * 0.5::DOUBLE)::VARCHAR::DECIMAL(30, 18), 1)::DOUBLE WHEN missing = 1 THEN round((t1 * 0.7::DOUBLE)::VARCHAR::DECIMAL(30, 18), 1)::DOUBLE ELSE t1 END AS total FROM (SELECT *, CASE WHEN off_domain THEN round((t0 * 0.55::DOUBLE)::VARCHAR::DECIMAL(30, 18), 1)::DOUBLE ELSE t0 END AS t1 FROM summed)),
    placed AS (SELECT *, CASE WHEN places[1] = 'Istanbul, Turkey' THEN 'home' WHEN places[1] = 'Remote, EMEA' THEN 'emea'
            WHEN countries IS NOT NULL THEN CASE WHEN remote THEN 'remote, ' ELSE '' END || CASE places[1] WHEN 'Remote - Germany' THEN 'Germany' WHEN 'Tel Aviv-Yafo' THEN 'Israel' ELSE 'Canada/United States' END || CASE WHEN list_has_any(countries, permits) THEN '' ELSE ' - no permit' END
            WHEN remote AND says_emea THEN 'remote, emea' WHEN remote THEN 'remote, unclear' WHEN len(places) > 0 THEN 'office: ' || array_to_string(places, ', ') ELSE 'no location' END AS status,
        CASE WHEN places[1] = 'Istanbul, Turkey' THEN list_contains(permits, 'turkey') WHEN places[1] = 'Remote, EMEA' THEN list_contains(permits, 'remote_emea') WHEN countries IS NOT NULL THEN list_has_any(countries, permits)
            WHEN remote AND says_emea THEN list_contains(permits, 'remote_emea') ELSE false END AS ok FROM totals),
    reasons AS (SELECT *, CASE
            WHEN regexp_matches(lower(title), '\b(' || forbidden || ')\b') THEN 'forbidden title (' || CASE profile_id WHEN 'anna' THEN 'Principal' ELSE role END || ')'
            WHEN practitioner AND NOT trade AND word NOT IN ('Senior', 'Lead', 'Mid/Senior', 'Principal') THEN 'practitioner posting'
            WHEN trade AND NOT practitioner AND role IN ('Data Engineer', 'DevOps Engineer', 'Java Data Analyst') THEN 'office posting'
            WHEN CASE level WHEN 'junior' THEN 0 WHEN 'mid' THEN 1 WHEN 'senior' THEN 2 ELSE 3 END > max_rank THEN 'seniority (' || level || ')'
            WHEN years > nullif(max_years, 0) THEN 'years asked (' || years || ')'
            WHEN NOT ok THEN 'location (' || status || ')'
            WHEN sponsor AND body <> '' AND intro = 'There is no visa sponsorship.' THEN 'no sponsorship'
            WHEN body <> '' AND intro LIKE 'Fluent German%' AND NOT list_contains(languages, 'german') THEN 'language (german)'
            WHEN off_domain AND title_family IS NOT NULL AND NOT shows THEN 'other profession'
            WHEN off_domain AND NOT shows THEN 'off domain'
            WHEN off_domain AND informative < 2 THEN 'off domain, few skills'
            WHEN by_title IS NOT NULL AND title_family IN ('data', 'software', 'cloud') AND length(body) >= 400 AND len(known) = 0
                AND NOT list_has_any(skills, CASE title_family WHEN 'data' THEN ['Spark', 'Airflow'] WHEN 'software' THEN ['C++', 'Java', 'Go'] ELSE ['Kubernetes', 'AWS'] END) THEN 'accidental title'
        END AS reason FROM placed),
    verdicts AS (SELECT *, round((total * (1 - 0.75::DOUBLE * risk))::VARCHAR::DECIMAL(30, 18), 1)::DOUBLE AS final, coalesce(trim(split_part(reason, '(', 1)), CASE WHEN risk >= 0.70 THEN 'ghost' WHEN round((total * (1 - 0.75::DOUBLE * risk))::VARCHAR::DECIMAL(30, 18), 1)::DOUBLE < 25 THEN 'low score' ELSE 'kept' END) AS verdict FROM reasons)
"""
_RANKED = """
    few AS (SELECT *, row_number() OVER (PARTITION BY profile_id, company ORDER BY final DESC, seq) AS c FROM verdicts WHERE verdict = 'kept'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY final DESC, seq) AS rank FROM few WHERE c <= 3)
"""
_BAND = "CASE WHEN risk >= 0.70 THEN 'ghost' WHEN risk >= 0.45 THEN 'doubtful' WHEN risk >= 0.20 THEN 'normal' ELSE 'fresh' END"
_REASONS = "array_to_string(list_filter([CASE WHEN age IS NULL THEN '+no date' WHEN age > 120 THEN '+open for ' || age || ' days' WHEN age <= 14 THEN '-new' END, CASE WHEN pool_text THEN '+pool text' END, CASE WHEN same_title >= 3 THEN '+same title' END], lambda x: x IS NOT NULL), '; ')"

_FIT = r"""
    kept AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY seq) AS place FROM verdicts WHERE verdict = 'kept'),
    said AS (SELECT seq, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title || chr(10) || body), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS tok FROM folded),
    sign AS (SELECT seq, i, ((instr('0123456789abcdef', substr(md5(seq::VARCHAR), i // 4 + 1, 1)) - 1) >> (3 - i % 4)) % 2 * 2 - 1 AS s FROM folded, range(64) t(i)),
    dfs AS (SELECT tok, ln(1 + (SELECT count(*) FROM folded)::DOUBLE / count(*)) AS w FROM said GROUP BY tok HAVING count(*) >= 2),
    raw AS (SELECT tok, i, sum(s)::DOUBLE AS x FROM said JOIN dfs USING (tok) JOIN sign USING (seq) GROUP BY tok, i),
    model AS MATERIALIZED (SELECT tok, i, w * x / sqrt(sum(x * x) OVER (PARTITION BY tok)) AS x FROM raw JOIN dfs USING (tok)),
    sentences(profile_id, own, other) AS (VALUES ('anna', 'Work in data, software with Airflow, Excel, Kafka, Python, SQL, Spark', 'Work of nurses and physicians, recruiters, sales representatives, accountants, mechanical engineers'),
        ('bora', 'Work in cloud, data with AWS, Docker, Java, Kubernetes, SQL', 'Work of nurses and physicians, recruiters, sales representatives, accountants, mechanical engineers'),
        ('carl', 'Work in health, people with Patient care, Recruitment', 'Work of sales representatives, accountants, mechanical engineers, software developers')),
    asked AS (SELECT DISTINCT t FROM (SELECT unnest([title, CASE WHEN body IS NULL THEN title ELSE title || chr(10) || body END]) AS t FROM kept WHERE place <= 400 UNION ALL SELECT unnest([own, other]) FROM sentences)),
    cut AS (SELECT t, unnest(list_distinct(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS tok FROM asked),
    summed_up AS (SELECT t, i, sum(x) AS x FROM cut JOIN model USING (tok) GROUP BY t, i),
    vec AS MATERIALIZED (SELECT t, list(x ORDER BY i) AS v FROM (SELECT t, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY t)), 1e-12) AS x FROM summed_up) GROUP BY t),
    docs AS (SELECT k.*, list_transform(range(1, 65), lambda i: 0.6::DOUBLE * coalesce(a.v[i], 0) + 0.4::DOUBLE * coalesce(b.v[i], 0)) AS dv, o.v AS ov, h.v AS hv
        FROM kept k JOIN sentences s USING (profile_id) LEFT JOIN vec a ON a.t = k.title LEFT JOIN vec b ON b.t = k.title || chr(10) || k.body LEFT JOIN vec o ON o.t = s.own LEFT JOIN vec h ON h.t = s.other),
    fitted AS (SELECT * EXCLUDE (final), CASE WHEN place <= 400 THEN round(CASE WHEN list_sum([x * x FOR x IN dv]) > 0 THEN coalesce(list_cosine_similarity(dv, ov), 0) - coalesce(list_cosine_similarity(dv, hv), 0) ELSE 0 END, 6) END AS fit FROM docs),
    refined AS (SELECT *, round((total * (1 - 0.75::DOUBLE * risk) * coalesce(greatest(0.82::DOUBLE, least(1.18::DOUBLE, 1 + 4.5::DOUBLE * fit)), 1))::VARCHAR::DECIMAL(30, 18), 1)::DOUBLE AS final FROM fitted),
    few AS (SELECT *, row_number() OVER (PARTITION BY profile_id, company ORDER BY final DESC, seq) AS c FROM refined),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY final DESC, seq) AS rank FROM few WHERE c <= 3)
"""

ORACLE: dict[str, str] = {
    "years_required": rf"""WITH {_PARTS}, said AS (SELECT seq, unnest(range(1, 1 + len(ss))) AS i, unnest(ss) AS s FROM (SELECT seq, regexp_split_to_array(CASE WHEN seq % 10 = 3 THEN 'Up to 40 years of experience are fine! ' || body || '. At least 2+ years of experience.' ELSE body END, '[.;!?\n]+') AS ss FROM posts)),
        spans AS (SELECT seq, i, regexp_extract(s, '(?i)(?:^|[^\w.,])([0-9]{{1,2}})\s?\+?(?:\s?(?:-|–|to)\s?[0-9]{{1,2}})?\s?\+?\s(?:full\s)?(?:years?|yrs?|yıl)\b', 1)::VARCHAR AS n FROM said WHERE regexp_matches(s, '(?i)\bexperience\b') AND NOT regexp_matches(s, '(?i)\b(we|our|us|company|founded|biz)\b'))
        SELECT p.seq, arg_min(nullif(n, '')::INT, i) FILTER (n <> '' AND nullif(n, '')::INT <= 20) AS years FROM posts p LEFT JOIN spans x ON p.seq = x.seq GROUP BY p.seq""",
    "work_mode_full": f"""WITH {_PARTS} SELECT seq, CASE WHEN seq % 9 = 0 THEN 'hybrid' WHEN remote THEN 'remote' WHEN list_contains(places, 'Remote - Germany') OR list_contains(places, 'Remote, EMEA') THEN 'remote'
            WHEN regexp_matches(lower(body), '(^|[^\\p{{L}}\\p{{N}}_])(hybrid|hibrit)($|[^\\p{{L}}\\p{{N}}_])') THEN 'hybrid' WHEN regexp_matches(lower(body), '(^|[^\\p{{L}}\\p{{N}}_])(remote|uzaktan|work from home|evden)($|[^\\p{{L}}\\p{{N}}_])') THEN 'remote'
            WHEN regexp_matches(lower(body), '(^|[^\\p{{L}}\\p{{N}}_])(on-?site|in office|office|ofis)($|[^\\p{{L}}\\p{{N}}_])') THEN 'office' WHEN len(places) > 0 THEN 'office' ELSE 'unknown' END AS mode,
        CASE WHEN seq % 5 = 0 THEN 'full' WHEN seq % 3 = 0 THEN 'intern' ELSE 'unknown' END AS employment FROM posts""",
    "variants_folded": f"WITH {_PARTS} SELECT seq, winner, variants, title_key FROM keyed",
    "posting_facts": f"""WITH {_PARTS} SELECT seq, level, years, practitioner, coalesce(title_family, '') AS title_families, array_to_string(skills, ',') AS skills, array_to_string(title_skills, ',') AS title_skills, array_to_string(countries, '/') AS countries, same_title FROM risks""",
    "posting_risk": f"WITH {_PARTS} SELECT seq, risk, {_BAND} AS band, {_REASONS} AS reasons FROM risks",
    "skill_rarity": f"WITH {_PARTS} SELECT canonical, idf FROM idf",
    "location_decision": f"WITH {_PARTS}, {_PAIRS} SELECT profile_id, seq, status, ok FROM placed",
    "elimination_full": f"WITH {_PARTS}, {_PAIRS} SELECT profile_id, seq, reason FROM reasons",
    "elimination_histogram": f"WITH {_PARTS}, {_PAIRS} SELECT profile_id, verdict, count(*) AS n FROM verdicts GROUP BY 1, 2",
    "total_score": f"WITH {_PARTS}, {_PAIRS} SELECT profile_id, seq, role_score AS role, round(skill_score, 6) AS skill, bonus, missing, off_domain, total FROM totals",
    "final_score": f"WITH {_PARTS}, {_PAIRS} SELECT profile_id, seq, risk, total, final, verdict FROM verdicts",
    "kept_candidates": f"WITH {_PARTS}, {_PAIRS} SELECT profile_id, seq, risk, total, final FROM verdicts WHERE verdict = 'kept'",
    "shortlist_with_fit": f"WITH {_PARTS}, {_PAIRS}, {_FIT} SELECT profile_id, rank, seq, fit, final FROM ranked WHERE rank <= 25",
    "flagship_shortlist": f"WITH {_PARTS}, {_PAIRS}, {_RANKED} SELECT profile_id, rank, seq, title, company, final, {_BAND} AS band, {_REASONS} AS reasons, array_to_string(known, ',') AS known FROM ranked WHERE rank <= 25",
}
