from pyspark.sql import functions as F

from postlens.sources import board_run, boards

START = "2024-05-01 10:00:00"


def page_of(board, url):
    if board == "gone":
        raise OSError
    if url.endswith("7"):
        return 403, ""
    return 200, f"text of {url}"


def at(hours):
    return F.to_timestamp(F.lit(START)) + F.make_interval(hours=F.lit(hours))


def urls(spark, *boards_, n=9):
    return spark.createDataFrame([(b, f"{b}/{i}", i, 0) for b in boards_ for i in range(n)], "board string, url string, page int, query int")


def test_a_run_and_the_next(spark, tmp_path):
    """Lists, then details; the second run has its lists from the cache, and its counts are those of the board's status."""
    path = str(tmp_path / "cache")
    lists = urls(spark, "a", n=2)
    recorded = spark.createDataFrame([("a/0", 200, "i1 i2 i3"), ("a/1", 200, "i2 i4"), ("i1", 200, "one"), ("i2", 500, None), ("i3", 200, "three ü")], "url string, status int, body string")
    details = lambda got: got.select("board", "page", "query", F.explode(F.split("body", " ")).alias("url"))
    one = {r.url: (r.origin, r.body) for r in board_run.run(lists, details, path, at(0), recorded).collect()}
    assert one == {"a/0": ("network", "i1 i2 i3"), "a/1": ("network", "i2 i4"), "i1": ("network", "one"), "i2": ("failed", None), "i3": ("network", "three ü"), "i4": ("failed", None)}
    before = board_run.kept(spark, path)
    recorded = recorded.where("url <> 'i2'").unionByName(spark.createDataFrame([("i2", 200, "two")], recorded.schema))
    two = board_run.run(lists, details, path, at(2), recorded)
    assert {r.url: r.origin for r in two.collect()} == {"a/0": "cache", "a/1": "cache", "i1": "cache", "i2": "network", "i3": "cache", "i4": "failed"}
    assert before.count() == 6 and board_run.kept(spark, path).count() == 8  # a frame made before doesn't see the next run
    first = spark.read.format("board").options(path=path, upto=board_run.commits(path)[1]).load()
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, before.collect()))
    ledger = board_run.kept(spark, path).select("board", F.col("fetched_at").alias("at"), "status")
    told = boards.status(two, ledger, spark.createDataFrame([], "board string, carried boolean"), at(2)).first()
    assert (told.network, told.cache, told.failed, told.stale, told.later) == (1, 4, 1, 0, 0)


def test_blocks_lost_connections_and_stale_copies(spark, tmp_path):
    """A block ends a board's part and keeps it silent; three lost connections end it too; old copies stand in for up to three days."""
    path = str(tmp_path / "cache")
    rows = urls(spark, "a", "gone").withColumn("kind", F.lit("detail"))
    given = {"fetcher": "tests.test_board_run.page_of", "gap": 0.0}
    now = F.to_timestamp(F.lit(str(spark.sql("SELECT current_timestamp()").first()[0])))
    got = {r.url: r.origin for r in board_run.fetched(rows, path, now, now, **given).collect()}
    assert [got[f"a/{i}"] for i in range(9)] == ["network"] * 7 + ["failed", "later"]
    assert [got[f"gone/{i}"] for i in range(9)] == ["failed"] * 3 + ["later"] * 6
    lists = rows.withColumn("kind", F.lit("list"))
    for hours, origin in ((5, "cache"), (13, "stale"), (80, "later")):
        later = now + F.make_interval(hours=F.lit(hours))
        blocked = spark.createDataFrame([], "url string, status int, body string") if hours > 6 else None
        if blocked is None:
            got = {r.url: r.origin for r in board_run.fetched(lists, path, later, later, **given).collect()}
        else:
            got = {r.url: r.origin for r in board_run.fetched(lists.where("page < 2 AND board = 'a'"), path, later, later, blocked).collect()}
        assert got["a/0"] == ("failed" if origin == "later" else origin)


def test_robots_repeats_and_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = urls(spark, "a", n=3).withColumn("kind", F.lit("list"))
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /1")], "board string, body string")
    paths = rows.withColumn("url", F.concat(F.lit("https://a.test/"), F.col("page").cast("string")))
    recorded = spark.createDataFrame([(f"https://a.test/{i}", 200, "x") for i in range(3)], "url string, status int, body string")
    got = board_run.fetched(paths.unionAll(paths), path, at(0), at(0), recorded, robots=robots).collect()
    assert sorted((r.page, r.origin, r.body) for r in got) == [(0, "network", "x"), (1, "forbidden", None), (2, "network", "x")]
    assert board_run.fetched(paths.limit(0), path, at(1), at(1), recorded).count() == 0


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.dataSource.register(board_run.BoardSource)
    rows = spark.createDataFrame([("a", "u", "list", 1)], "board string, url string, kind string, place int")
    try:
        rows.write.format("board").options(path=path, fetcher="tests.test_board_run.nothing_here").mode("append").save()
        raise AssertionError
    except Exception as e:
        assert "nothing_here" in str(e)
    assert board_run.commits(path) == [] and board_run.kept(spark, path).count() == 0
