import json

import pytest
from pyspark.sql import functions as F

from postlens.operators import fit
from postlens.sources import boards, fetch, sinks

PAGES = {"acme": ["p0", "p1", "p2"], "globex": ["q0"]}


def by_number(token, page):
    found = PAGES[token][page] if page < len(PAGES[token]) else ""
    return found, 5 if found and page + 1 < len(PAGES[token]) else 2


def by_cursor(token, cursor):
    page = int(cursor or 0)
    return PAGES[token][page], str(page + 1) if page + 1 < len(PAGES[token]) else None


def by_offset(token, offset):
    return PAGES[token][offset // 100], 100 * len(PAGES[token])


@pytest.mark.parametrize("paging,fetcher,full", [("number", "by_number", 5), ("cursor", "by_cursor", 0), ("offset", "by_offset", 100)])
def test_feed_source_pages(spark, paging, fetcher, full):
    """Each way of paging gives all pages of each company, one partition a company."""

    spark.dataSource.register(fetch.FeedSource)
    rows = spark.read.format("feed").options(plan=json.dumps([("acme", "Acme"), ("globex", "Globex")]), fetcher=f"tests.test_sources.{fetcher}", pages="9", fullpage=str(full), paging=paging).load()
    assert sorted((r.token, r.page, r.payload) for r in rows.collect()) == [("acme", 0, "p0"), ("acme", 1, "p1"), ("acme", 2, "p2"), ("globex", 0, "q0")]
    assert rows.rdd.getNumPartitions() == 2


def test_cache_keeps_text(spark):
    rows = spark.createDataFrame([("a", "text ü"), ("b", None)], "url string, body string").withColumn("kept", boards.packed("body"))
    got = {r.url: r.back for r in rows.select("url", boards.unpacked("kept").alias("back")).collect()}
    assert got == {"a": "text ü", "b": None}
    assert spark.createDataFrame([(b"broken",)], "b binary").select(boards.unpacked("b").alias("x")).first().x is None


def test_record_and_replay(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "one"), ("u2", "two")], "url string, payload string")
    fetch.record(pages, f"{tmp_path}/pages")
    fetch.record(pages.where("url = 'u1'"), f"{tmp_path}/pages")
    assert sorted(map(tuple, fetch.replayed(spark, f"{tmp_path}/pages").collect())) == [("u1", "one"), ("u2", "two")]


def test_robots_and_sinks(spark, tmp_path):
    assert not fetch.allowed_by_robots("User-agent: *\nDisallow: /private", "/private/x") and fetch.allowed_by_robots("", "/x")
    rows = spark.createDataFrame([(1, "d" * 20_000)], "id int, description string")
    header = spark.createDataFrame([("2024", 3)], "made_at string, pairs int")
    sinks.json_rows(rows, f"{tmp_path}/out", header)
    assert len(spark.read.json(f"{tmp_path}/out/rows").first().description) == sinks.DESCRIPTION and spark.read.json(f"{tmp_path}/out/header").first().pairs == 3
    assert "Ünal" in sinks.profile_yaml({"name": "Ünal", "max_years": 3})


def test_text_to_vector(spark):
    rows = spark.createDataFrame([(1, "data engineer"), (2, "Engineer DATA"), (3, None), (4, ""), (5, "welder")], "id int, t string")
    got = {r.id: r.v for r in rows.select("id", fit.text_to_vector()(F.col("t")).alias("v")).collect()}
    assert got[1] == got[2] != got[5] and got[3] is None and sum(got[4]) == 0 and abs(sum(x * x for x in got[1]) - 1) < 1e-5


def test_registry(spark):
    from postlens.sources import feeds

    kinds = feeds.registered(spark)
    assert set(kinds) == set(feeds.PARSERS) and kinds["workable"] == "company" and kinds["remotive"] == "query"
    given = feeds.options("workable", [("acme", "Acme")], "tests.test_sources.by_cursor")
    assert [r.payload for r in spark.read.format("feed").options(**given).load().orderBy("page").collect()] == PAGES["acme"]
