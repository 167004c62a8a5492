import json

from pyspark.sql import functions as F

from postlens.sources import feeds, fetch


def payload(spark, value, token="acme", company="Acme"):
    return spark.createDataFrame([(token, company, value if isinstance(value, str) else json.dumps(value))], "token string, company string, payload string")


def test_greenhouse(spark):
    row = feeds.greenhouse(payload(spark, {"jobs": [{"id": 7, "title": "Data Engineer", "absolute_url": "u", "content": "<p>a &amp; b</p>", "updated_at": "2026-01-02T00:00:00Z", "location": {"name": "Berlin; Paris"}, "offices": [{"name": "Berlin"}], "departments": [{"name": "Data"}]}]})).first()
    assert row.locations == ["Berlin", "Paris"] and row.description == "a & b" and row.native_id == "7" and row.posted_at is None and row.department == "Data"


def test_lever_remote_is_three_valued(spark):
    jobs = [{"id": str(i), "text": "t", "workplaceType": w, "createdAt": 1700000000000, "categories": {"location": "Oslo", "allLocations": ["Oslo", "Bergen"]}} for i, w in enumerate(("remote", "hybrid", "unspecified"))]
    rows = feeds.lever(payload(spark, jobs)).orderBy("native_id").collect()
    assert [r.remote_flag for r in rows] == [True, False, None] and rows[0].locations == ["Oslo", "Bergen"]


def test_ashby_unlisted_and_mixed_locations(spark):
    jobs = {"jobs": [{"id": "1", "title": "a", "isListed": False}, {"id": "2", "title": "b", "location": "Rome", "secondaryLocations": [{"location": "Milan"}], "workplaceType": "Remote"}]}
    rows = feeds.ashby(payload(spark, jobs)).collect()
    assert len(rows) == 1 and rows[0].locations == ["Rome", "Milan"] and rows[0].remote_flag is True


def test_remoteok_skips_notice_and_muse_keeps_unknown(spark):
    assert feeds.remoteok(payload(spark, [{"legal": "x"}, {"id": "1", "position": "Dev", "company": "C", "description": "d", "tags": ["go"]}])).count() == 1
    muse = feeds.themuse(payload(spark, {"results": [{"id": 1, "name": "n", "locations": [{"name": "Flexible / Remote"}]}, {"id": 2, "name": "m", "locations": [{"name": "Rome"}]}]})).orderBy("native_id").collect()
    assert [r.remote_flag for r in muse] == [True, None]


def test_rss_and_json_ld(spark):
    row = feeds.weworkremotely(payload(spark, "<item><title><![CDATA[Acme: Go Dev]]></title><link>l</link><region>Anywhere</region><description>d</description><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate></item>")).first()
    assert (row.company, row.title, row.locations) == ("Acme", "Go Dev", ["Anywhere"]) and row.posted_at is not None
    page = '<script type="application/ld+json">{"@type": "Other"}</script><script type="application/ld+json">{"@type": "JobPosting", "title": "Welder", "jobLocation": [{"address": {"addressLocality": "Izmir"}}], "datePosted": "2026-01-05"}</script>'
    row = feeds.job_posting_ld(payload(spark, page)).first()
    assert row.title == "Welder" and row.locations == ["Izmir"]


def test_pool_has_an_order(spark):
    both = feeds.pool(spark, {"lever": payload(spark, [{"id": "b", "text": "t"}, {"id": "a", "text": "t"}]), "remoteok": payload(spark, [{"id": "1", "position": "p"}])})
    assert {(r.source, r.native_id, r.seq) for r in both.collect()} == {("lever", "a", 1), ("lever", "b", 2), ("remoteok", "1", 3)}


def test_retries():
    waits, answers = [], [(500, "", None), (429, "", 9.0), (200, "ok", None)]
    assert fetch.with_retries(lambda: answers.pop(0), waits.append) == "ok" and waits == [1.5, 5.0]
    try:
        fetch.with_retries(lambda: (404, "", None), waits.append)
        raise AssertionError
    except fetch.Permanent:
        pass


def test_cache_and_budget(spark):
    now = F.to_timestamp(F.lit("2026-01-02 00:00:00"))
    cache = spark.sql("SELECT 'a' url, timestamp'2026-01-01 18:00:00' fetched_at, 'A' body UNION ALL SELECT 'b', timestamp'2025-12-31 00:00:00', 'B'")
    urls = spark.createDataFrame([("a", "list"), ("b", "list"), ("c", "list")], "url string, kind string")
    assert sorted(r.url for r in fetch.due(urls, cache, now).collect()) == ["b", "c"]
    got = {r.url: r.origin for r in fetch.served(spark.createDataFrame([("a", None), ("b", "new"), ("c", None)], "url string, body string"), cache, now).collect()}
    assert got == {"a": "stale", "b": "network", "c": "failed"}
    ledger = spark.sql("SELECT 'x' board, timestamp'2026-01-01 23:30:00' at, 200 status UNION ALL SELECT 'y', timestamp'2026-01-01 20:00:00', 403")
    assert {r.board: r.left for r in fetch.allowance(ledger, now).collect()} == {"x": 10, "y": 0}
