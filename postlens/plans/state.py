"""Queries of kept state: history by increments, its log, and postings that close in a stream; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, increments
from ..sources import board_run as board
from ..streaming import closing
from ..streaming import sightings as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Days of a run, and buckets of the state.
RUN_DAYS, BUCKETS = 4, 8
#: Customers of a list page, over all boards.
LISTED = 200


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as sightings; a run takes RUN_DAYS."""
    events = spark.read.parquet(f"{d}/events.parquet")
    run = F.floor(F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))) / RUN_DAYS).cast("long")
    seen = F.col("ts").cast("timestamp")
    return events.select(run.alias("run_id"), F.concat_ws(":", F.lit("u"), F.col("user_id").cast("string"), "event_type").alias("uid"), F.col("event_type").alias("board_token"), F.lit("t").alias("title_key"), F.md5(F.floor(F.col("value") / 40).cast("string")).alias("content_hash"), seen.alias("updated_at"), F.when(F.col("value") > 20, F.col("props")).otherwise("").alias("description"), seen.alias("seen_at"))


@query
def history_increments(spark, d):
    """The state after all runs, each merged into the one before it."""
    out = increments.replayed(spark, streams.folder(spark), _log(spark, d), 0, BUCKETS)
    return out.select("uid", "board_token", "content_hash", "description", "seen", "last_run", "refreshes", "closed", F.unix_micros("first_seen").alias("first_micros"), F.unix_micros("last_seen").alias("last_micros"))


@query
def history_compacted(spark, d):
    """Sightings of each run, from a log of which the earlier half is in the archive."""
    at = streams.folder(spark)
    history.appended(_log(spark, d), f"{at}/log")
    increments.compacted(spark, f"{at}/log", f"{at}/archive", 4, 3)
    log = increments.read_log(spark, f"{at}/log", f"{at}/archive")
    return log.groupBy("run_id").agg(F.count(F.lit(1)).alias("sightings"), F.countDistinct("uid").alias("uids"))


@query
def stream_closed_state(spark, d):
    """Which postings are closed by the last run that the stream has seen the end of, told by state and timers."""
    rows = streams.stream_of(spark, f"{d}/events.parquet")
    run = F.datediff(F.to_date("ts"), F.to_date(F.lit("1970-01-01"))).cast("long")
    rows = rows.select(run.alias("run_id"), F.concat_ws(":", F.lit("u"), F.col("user_id").cast("string"), "event_type").alias("uid"), F.col("event_type").alias("board_token"), F.col("ts").cast("timestamp").alias("at"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, closing.PROVIDER)
    try:
        log = streams.drained(closing.changes(rows), "append")
    finally:
        spark.conf.set(key, before)
    return closing.latest(log).select("uid", "board_token", "closed", F.when(F.col("closed"), F.col("run")).alias("closed_by"))


@query
def board_run(spark, d):
    """Two runs of every board, two hours apart: pages by run, board, kind and origin. A nation is a board, its customers the details; lists of them are pages."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    name = F.concat(F.lit("b"), F.col("c_nationkey").cast("string"))
    at = F.concat(name, F.lit("/i/"), F.col("c_custkey").cast("string"))
    status = F.when(F.col("c_custkey") % 17 == 0, 403).when(F.col("c_custkey") % 5 == 0, 500).otherwise(200)
    items = c.select(name.alias("board"), at.alias("url"), F.floor(F.col("c_custkey") / LISTED).alias("page"), status.alias("status"), F.col("c_name").alias("body"))
    shown = F.array_join(F.collect_list(F.concat(F.lit('<a href="'), "url", F.lit('">'))), "\n")
    pages = items.groupBy("board", "page").agg(shown.alias("body")).select("board", "page", F.concat_ws("/", "board", F.lit("l"), F.col("page").cast("string")).alias("url"), F.lit(200).alias("status"), "body")
    recorded = pages.select("url", "status", "body").unionByName(items.select("url", "status", "body"))
    lists = pages.select("board", "url", "page", F.lit(0).alias("query"))
    named = lambda got: got.select("board", "page", "query", F.explode(F.regexp_extract_all("body", F.lit('href="([^"]+)"'))).alias("url"))
    path, out = streams.folder(spark), None
    for n, hour in ((1, "10"), (2, "12")):
        told = board.run(lists, named, path, F.to_timestamp(F.lit(f"2024-05-01 {hour}:00:00")), recorded).groupBy(F.lit(n).alias("run"), "board", "kind", "origin").agg(F.count(F.lit(1)).alias("n"))
        out = told if out is None else out.unionByName(told)
    return out


ORACLE: dict[str, str] = {
    "board_run": f"""
        WITH d AS (SELECT 'b' || c_nationkey AS board, c_custkey // {LISTED} AS page, 'b' || c_nationkey || '/i/' || c_custkey AS url, CASE WHEN c_custkey % 17 = 0 THEN 403 WHEN c_custkey % 5 = 0 THEN 500 ELSE 200 END AS status FROM customer),
        l AS (SELECT board, page, row_number() OVER (PARTITION BY board ORDER BY page) AS n FROM (SELECT DISTINCT board, page FROM d)),
        a AS (SELECT d.*, row_number() OVER (PARTITION BY board ORDER BY page, url) <= 16 - (SELECT count(*) FROM l x WHERE x.board = d.board AND x.n <= 10) AS may, row_number() OVER (PARTITION BY board ORDER BY page, url) AS p FROM d JOIN l USING (board, page) WHERE n <= 10),
        b AS (SELECT *, may AND coalesce(p <= min(p) FILTER (may AND status = 403) OVER (PARTITION BY board), true) AS tried FROM a),
        blocked AS (SELECT DISTINCT board FROM b WHERE tried AND status = 403),
        more AS (SELECT l.board, CASE WHEN board IN (FROM blocked) THEN 0 ELSE count(*) FILTER (n BETWEEN 11 AND 20) END AS k FROM l GROUP BY l.board),
        e AS (SELECT d.*, k, d.url IN (SELECT url FROM b WHERE tried AND status = 200) AS had FROM d JOIN l USING (board, page) JOIN more USING (board) WHERE n <= 10 + k),
        f AS (SELECT *, row_number() OVER (PARTITION BY board, had ORDER BY page, url) AS p FROM e),
        g AS (SELECT *, NOT had AND p <= 16 - k AND board NOT IN (FROM blocked) AS may FROM f),
        h AS (SELECT *, may AND coalesce(p <= min(p) FILTER (may AND status = 403) OVER (PARTITION BY board), true) AS tried FROM g),
        o AS (SELECT 1 AS run, board, 'list' AS kind, CASE WHEN n <= 10 THEN 'network' ELSE 'later' END AS origin FROM l
            UNION ALL SELECT 1, board, 'detail', CASE WHEN NOT tried THEN 'later' WHEN status = 200 THEN 'network' ELSE 'failed' END FROM b
            UNION ALL SELECT 2, board, 'list', CASE WHEN n <= 10 THEN 'cache' WHEN n <= 10 + k THEN 'network' ELSE 'later' END FROM l JOIN more USING (board)
            UNION ALL SELECT 2, board, 'detail', CASE WHEN had THEN 'cache' WHEN NOT tried THEN 'later' WHEN status = 200 THEN 'network' ELSE 'failed' END FROM h)
        SELECT run, board, kind, origin, count(*) AS n FROM o GROUP BY ALL""",
    "history_increments": f"""
        WITH s AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) // {RUN_DAYS} AS run_id, 'u:' || user_id || ':' || event_type AS uid, event_type AS token, md5(floor(value / 40)::BIGINT::VARCHAR) AS h, ts, CASE WHEN value > 20 THEN props ELSE '' END AS description FROM events),
        runs AS (SELECT uid, run_id, arg_max(token, (ts, h)) AS token, arg_max(h, (ts, h)) AS h, arg_max(description, (ts, h)) FILTER (description <> '') AS description, min(ts) AS a, max(ts) AS z FROM s GROUP BY uid, run_id),
        moved AS (SELECT *, coalesce(lag(h) OVER w = h AND lag(z) OVER w <> z, false) AS refreshed FROM runs WINDOW w AS (PARTITION BY uid ORDER BY run_id)),
        m AS (SELECT max(run_id) AS run FROM s), scanned AS (SELECT DISTINCT token FROM s, m WHERE run_id = run)
        SELECT uid, arg_max(token, run_id) AS board_token, arg_max(h, run_id) AS content_hash, arg_max(description, run_id) FILTER (description IS NOT NULL) AS description, count(*) AS seen, max(run_id) AS last_run, count(*) FILTER (refreshed) AS refreshes,
            max(run_id) < (SELECT run FROM m) AND arg_max(token, run_id) IN (SELECT token FROM scanned) AS closed, epoch_us(min(a)) AS first_micros, epoch_us(max(z)) AS last_micros FROM moved GROUP BY uid""",
    "history_compacted": f"""
        SELECT date_diff('day', DATE '2024-01-01', ts::DATE) // {RUN_DAYS} AS run_id, count(*) AS sightings, count(DISTINCT user_id || ':' || event_type) AS uids FROM events GROUP BY 1""",
    "stream_closed_state": """
        WITH s AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS run, 'u:' || user_id || ':' || event_type AS uid, event_type AS token FROM events),
        done AS (SELECT DISTINCT token, run FROM s WHERE epoch_us(TIMESTAMP '1970-01-01') + (run + 1) * 86400000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)),
        last AS (SELECT uid, any_value(token) AS token, max(run) AS run FROM s GROUP BY uid)
        SELECT uid, l.token AS board_token, count(d.run) > 0 AS closed, min(d.run) AS closed_by FROM last l LEFT JOIN done d ON l.token = d.token AND d.run > l.run GROUP BY uid, l.token""",
}
