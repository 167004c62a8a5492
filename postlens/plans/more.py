"""More named queries: CV to profile, cache and budget, reports, paths, and streams. Each has its SQL in :mod:`.more_sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import catalog
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import cv, fit, geo, history, intervals, paths, shortlist
from ..sources import boards, fetch, sinks
from ..streaming import sightings as streams
from . import profiles, ranking, standin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CV_DAY, RUN_DAY = "2012-01-01", "2024-01-15 12:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def at(text: str):
    return F.to_timestamp(F.lit(text))


# CV to profile


def _cvs(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    title = F.get(F.array(*[F.lit(x) for x in ("Senior Data Engineer", "Welder", "Backend Developer", "Head of Nursing")]), (k % 4).cast("int"))
    now = F.concat(F.lit("Engineer, Acme    Jan "), (2009 + k % 3).cast("string"), F.lit(" – Present"))
    then = F.concat(F.lit("Analyst, Globex    2005 - "), (2008 + k % 4).cast("string"))
    lines = [F.concat(F.lit("Name "), k.cast("string")), title, F.lit("E X P E R I E N C E"), now, F.lit("- built with Spark and Kafka"), then, F.lit("- reports in SQL and Excel"), F.lit("Education"), F.lit("BSc, University 2000 - 2004"), F.lit("Skills"), F.lit("Python, Spark")]
    return read(spark, d, "customer").select(k, F.concat_ws("\n", *lines).alias("text"))


def _cv_lines(spark, d) -> DataFrame:
    return cv.lines(_cvs(spark, d), "c_custkey", "text", F.to_date(F.lit(CV_DAY)))


@query
def cv_lines(spark, d):
    return _cv_lines(spark, d).select("c_custkey", "line_no", "section", "kind", F.round("weight", 6).alias("weight"), "start", "end")


@query
def cv_skills(spark, d):
    found = cv.skills(_cv_lines(spark, d), "c_custkey", catalog.skills(spark))
    return found.select("c_custkey", "canonical", F.round("weight", 4).alias("weight"), "strength", F.round("recency", 6).alias("recency"))


def _cv_years(spark, d) -> DataFrame:
    return cv.experience(_cvs(spark, d), _cv_lines(spark, d), "c_custkey", "text")


@query
def cv_experience(spark, d):
    return _cv_years(spark, d).select("c_custkey", "years")


@query
def cv_periods(spark, d):
    """Years of CVs whose periods have one year only: months of a year, a season, and two plain words with a dash, which are no period."""
    k = F.col("c_custkey")
    months = F.get(F.array(*[F.lit(x) for x in ("Feb. – Nov.", "June - July", "Ekim – Aralık")]), (k % 3).cast("int"))
    lines = [F.lit("Experience"), F.concat(F.lit("Intern, Acme    "), months, F.lit(" "), (2005 + k % 4).cast("string")), F.concat(F.lit("Trainee, Globex    Summer "), (2001 + k % 2).cast("string")), F.lit("Control - Automation 2003")]
    docs = read(spark, d, "customer").select(k, F.concat_ws("\n", *lines).alias("text"))
    return cv.experience(docs, cv.lines(docs, "c_custkey", "text", F.to_date(F.lit(CV_DAY))), "c_custkey", "text")


@query
def cv_level(spark, d):
    rows = _cvs(spark, d).join(_cv_years(spark, d), "c_custkey")
    return rows.select("c_custkey", cv.seniority(F.col("text"), F.col("years")).alias("level"), cv.practitioner(F.col("text")).alias("practitioner"))


@query
def cv_families(spark, d):
    skills = cv.skills(_cv_lines(spark, d), "c_custkey", catalog.skills(spark))
    return cv.families(skills, catalog.families(spark), "c_custkey").select("c_custkey", "family", "weight", "recency", F.col("rank").cast("long").alias("rank"))


def _cv_profiles(spark, d) -> DataFrame:
    return profiles.from_cvs(_cvs(spark, d), "c_custkey", "text", F.to_date(F.lit(CV_DAY)), F.array(F.lit("turkey")))


@query
def cv_profiles(spark, d):
    """Profiles of CVs as the ranking reads them."""
    rows = _cv_profiles(spark, d)
    return rows.select(F.col("profile_id").cast("long").alias("c_custkey"), "max_level", "max_years", "is_practitioner", F.size("forbidden").cast("long").alias("n_forbidden"), F.array_join(F.transform("families", lambda f: f["name"]), ",").alias("families"), F.array_join(F.array_sort(F.map_keys("weights")), ",").alias("skills"), F.round(F.try_element_at("weights", F.lit("Spark")), 4).alias("spark"))


@query
def cv_sentences(spark, d):
    """Sentences for the vector contrast, and the patterns of titles that are no option."""
    families = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("data"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("sales"), F.lit("people"))).otherwise(F.array(F.lit("health")))
    rows = read(spark, d, "customer").select("c_custkey", families.alias("families"))
    forbidden = cv.forbidden(rows.select("c_custkey", F.explode("families").alias("family")), "c_custkey").select("c_custkey", F.size("forbidden").cast("long").alias("n_forbidden"))
    own = cv.self_sentence(F.get("families", F.lit(0)), F.lit("senior"), F.array(F.lit("Spark"), F.lit("SQL")))
    return rows.join(forbidden, "c_custkey").select("c_custkey", own.alias("own"), fit.other_sentence(F.col("families")).alias("other"), "n_forbidden")


# text


@query
def text_fields(spark, d):
    k = F.col("c_custkey")
    unit = F.get(F.array(*[F.lit(x) for x in ("saat önce", "gün önce", "hafta önce", "ay önce", "yıl önce", "days ago", "weeks ago", "bugün")]), (k % 8).cast("int"))
    iso = F.concat(F.lit("2024-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00"), F.when(k % 2 == 0, "Z").otherwise(""))
    return read(spark, d, "customer").select(
        k, tx.listed_text(F.array("c_mktsegment", F.lit(None), F.lit(""), "c_name")).alias("listed"), tx.or_else(F.when(k % 3 == 0, ""), F.col("c_name")).alias("first"),
        tx.combined_text(F.col("c_name"), F.lit("Ops"), F.array("c_mktsegment", F.lit("x")), F.lit("text")).alias("combined"), tx.relative_days(F.concat((k % 40).cast("string"), F.lit(" "), unit)).alias("days"),
        tx.squeezed(F.concat(F.lit("<b> a</b>\n  "), "c_mktsegment", F.lit(" <i>z</i> "))).alias("squeezed"), F.unix_seconds(tx.local_date(iso)).alias("local"),
        F.round(tx.age_days(F.lit(None).cast("timestamp"), tx.local_date(iso), at("2024-03-20 00:00:00")), 4).alias("age"), tx.hours_ago(tx.local_date(iso), at("2024-03-20 00:30:00")).alias("hours"),
        F.array_join(tx.token_set(F.concat("c_mktsegment", F.lit(" a the "), "c_name"), ("the", "a")), " ").alias("tokens"),
        geo.city_suffix(F.array(F.when(k % 2 == 0, "Berlin").otherwise("Remote"), F.when(k % 3 == 0, "İstanbul / Turkey").when(k % 3 == 1, "Izmir, Türkiye").otherwise("Turkey")), {"istanbul": "İstanbul", "izmir": "İzmir"}).alias("city"),
    )


@query
def url_join(spark, d):
    path = F.when(F.col("page_id") % 4 == 0, "https://other.test/a b").when(F.col("page_id") % 4 == 1, "/root x").when(F.col("page_id") % 4 == 2, "next?p=2").otherwise("//cdn.test/y")
    return read(spark, d, "pages").select("page_id", tx.url_joined(F.col("url"), path).alias("joined"))


# vectors


@query
def masked_mean(spark, d):
    rows = read(spark, d, "embeddings")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * (t + 1)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.when((F.col("vec_id") + t) % 3 == 0, 0).otherwise(1))
    return rows.select("vec_id", F.round(F.aggregate(vec.masked_mean(tokens, mask), F.lit(0.0), lambda a, x: a + x), 5).alias("sum_of_mean"))


@query
def document_fit(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    back = F.reverse("e")
    doc = fit.document_vector(F.col("e"), back)
    return rows.select("vec_id", F.round(fit.contrast(doc, F.col("e"), back), 6).alias("fit"))


# cache, budget, boards


def _events(spark, d) -> DataFrame:
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") <= at(RUN_DAY))


@query
def cache_due(spark, d):
    events = _events(spark, d)
    kind = F.when(F.col("user_id") % 3 == 0, "list").when(F.col("user_id") % 3 == 1, "detail").otherwise("robots")
    urls = events.select(F.concat(F.lit("u"), "user_id").alias("url"), kind.alias("kind")).distinct()
    cache = events.where("value > 20").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("ts").alias("fetched_at"))
    return fetch.due(urls, cache, at(RUN_DAY))


@query
def cache_served(spark, d):
    events = _events(spark, d)
    url = F.concat(F.lit("u"), "user_id")
    fetched = events.select(url.alias("url"), F.when(F.col("user_id") % 2 == 0, "fresh").alias("body")).distinct()
    cache = events.where("value > 60").select(url.alias("url"), F.col("ts").alias("fetched_at"), F.concat(F.lit("copy "), F.col("event_id").cast("string")).alias("body"))
    return fetch.served(fetched, cache, at(RUN_DAY)).select("url", "origin", "body")


@query
def cache_evicted(spark, d):
    return fetch.evicted(_events(spark, d), "ts", at(RUN_DAY), 2).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _ledger(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("board"), F.col("ts").alias("at"), F.when(F.col("event_id") % 97 == 0, 403).otherwise(200).alias("status"))


@query
def board_allowance(spark, d):
    return fetch.allowance(_ledger(_events(spark, d)), at(RUN_DAY))


def _requests(spark, d) -> DataFrame:
    events = _events(spark, d)
    u = F.col("user_id")
    urls = events.select(F.col("event_type").alias("board"), F.concat(F.lit("u"), u).alias("url"), F.when(u % 3 == 0, "detail").otherwise("list").alias("kind"), (u % 4).alias("page"), (u % 7).alias("query")).distinct()
    cache = events.where("value > 40").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("ts").alias("fetched_at"))
    return boards.requests(urls, cache, _ledger(events), at(RUN_DAY))


@query
def board_requests(spark, d):
    return _requests(spark, d).select("board", "url", "kind", "origin")


@query
def board_status(spark, d):
    events = _events(spark, d)
    posts = events.select(F.col("event_type").alias("board"), (F.col("user_id") % 5 == 0).alias("carried"))
    return boards.status(_requests(spark, d), _ledger(events), posts, at(RUN_DAY)).select("board", "network", "cache", "later", "postings", "carried", "blocked_hours", "left")


@query
def source_history(spark, d):
    state = _events(spark, d).groupBy(F.col("event_type").alias("source"), F.concat(F.lit("u"), "user_id").alias("uid")).agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("seen"))
    return history.of_source(state, "click", at("2024-01-10 00:00:00")).select("uid", "seen")


@query
def carried_pool(spark, d):
    state = _events(spark, d).groupBy(F.concat(F.lit("u"), "user_id").alias("uid")).agg(F.max("ts").alias("last_seen"), F.bool_or(F.col("value") > 95).alias("closed"))
    fetched = state.where(F.length("uid") == 3).select("uid")
    return history.carried_over(state, fetched, "uid", "last_seen", at(RUN_DAY)).select("uid")


@query
def connector_check(spark, d):
    posts = standin.postings(read(spark, d, "documents")).orderBy("seq")
    return boards.validated(posts).select("native_id", "wrong")


@query
def sitemap_fallback(spark, d):
    fresh, old = (read(spark, d, "part").where(f"p_size % 3 = {n}").select(F.concat(F.lit("/"), "p_name").alias("path")) for n in (0, 1))
    return boards.paths_or_old(fresh, old, complete=False)


# allocation, paths


@query
def page_interleave(spark, d):
    return paths.interleaved(read(spark, d, "events").select(F.col("user_id").alias("query"), (F.col("event_id") % 5).alias("page")).distinct(), "query", "page", 40)


@query
def path_choice(spark, d):
    names = read(spark, d, "part").select("p_name", "p_brand", "p_type").distinct()
    queries = names.select(F.col("p_name").alias("q"), F.lit("promo").alias("wanted_city")).distinct().withColumn("tokens", tx.token_set(F.col("q")))
    made = names.select(F.concat_ws(" ", "p_name", F.when(F.col("p_type") != "STANDARD", F.lower("p_type")), F.lit("jobs")).alias("p"), F.when(F.col("p_type") != "STANDARD", F.lower("p_type")).alias("city")).distinct()
    scores = paths.scored(queries, made.withColumn("tokens", tx.token_set(F.col("p"))), ("jobs",), share=0.72)
    return paths.chosen(scores, 0.72, 4).select("q", F.col("rank").cast("long").alias("rank"), "p", "score")


@query
def position_coverage(spark, d):
    positions = read(spark, d, "part").select(F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 5 == 0, "nurse").when(F.col("p_size") % 5 == 1, "Data Analyst")).alias("name"), F.col("p_retailprice").alias("weight"))
    share = paths.coverage(positions, [p for _, _, patterns, *_ in catalog.FAMILIES for p in patterns])
    return share.select(F.round("simple", 6).alias("simple"), F.round("weighted", 6).alias("weighted"))


@query
def ordered_distinct(spark, d):
    lists = read(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))), lambda x: F.concat(x["o_orderstatus"], x["o_orderpriority"])).alias("a"))
    return lists.select("o_custkey", F.array_join(shortlist.distinct_capped(F.col("a"), F.array(F.lit("last"))), ",").alias("items"))


@query
def weight_cut(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("weight"), F.when(F.col("l_discount") > 0.05, 0.9).otherwise(0.5).alias("recency"))
    return shortlist.cut_by_weight(rows, "l_orderkey", "weight", "recency").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least"))


@query
def query_slots(spark, d):
    """Six search queries for each customer: four families of arithmetic weight and age, whose titles are names of nations; the last one is named after a level for every third customer."""
    groups = {f"f{f}": F.pmod("n_nationkey", F.lit(4)).isin(f, (f + 1) % 4) if f < 3 else F.pmod("n_nationkey", F.lit(8)) == 7 for f in range(4)}
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("n_nationkey", "n_name")))), lambda x: x["n_name"])
    titles = read(spark, d, "nation").agg(*[names(c).alias(f) for f, c in groups.items()])
    key = F.col("c_custkey")
    family = lambda f: F.struct(F.when((key % 3 == 0) & F.lit(f == 3), "level").otherwise(f"f{f}").alias("name"), ((F.pmod(key * (2 * f + 3), F.lit(61)) + 40) / 100).alias("weight"), (F.pmod(key * (f + 1), F.lit(5)) / 4).alias("recency"))
    rows = read(spark, d, "customer").select("c_custkey", F.array(*[family(f) for f in range(4)]).alias("families"))
    found = titles.first().asDict()
    out = profiles.searches(rows, found | {"level": found["f3"]}, ("level",))
    return out.select("c_custkey", F.array_join("queries", ",").alias("queries"))


@query
def model_cap(spark, d):
    return shortlist.scored_by_model(read(spark, d, "orders"), "o_orderstatus", "o_orderkey", 400).where("for_model").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


@query
def detail_candidates(spark, d):
    posts = standin.postings(read(spark, d, "documents")).withColumn("source", F.when(F.col("seq") % 2 == 0, "board").otherwise("feed")).withColumn("total", (F.col("seq") * 7919 % 1000).cast("double"))
    return shortlist.detail_candidates(posts, ["board"], "total", "seq").select("seq", "total")


# reports


def _ranked(spark, d) -> DataFrame:
    rows = ranking.with_risk(ranking.facts(ranking.variants_folded(standin.postings(read(spark, d, "documents"))), at(standin.AS_OF)))
    return ranking.decided(ranking.scored(rows, standin.profiles(spark)))


@query
def result_rows(spark, d):
    shown = sinks.result_rows(ranking.ranked(_ranked(spark, d)), at(standin.AS_OF))
    # the rows themselves have arrays and times; these columns stand for them
    return shown.select("profile_id", "rank", "uid", "work_mode", "employment", F.col("hours_ago").cast("long").alias("hours_ago"), F.array_join("missing", ",").alias("missing"), "place", "final", F.array_join("locations", "|").alias("locations"))


@query
def report_header(spark, d):
    made = sinks.report_header(_ranked(spark, d), at(standin.AS_OF), "1").select("made_at", "version", "pairs", F.explode("verdicts").alias("verdict", "n"))
    return made


@query
def markdown_report(spark, d):
    return sinks.markdown_report(ranking.ranked(_ranked(spark, d)))


@query
def terminal_lines(spark, d):
    return sinks.terminal_lines(ranking.ranked(_ranked(spark, d), 3, 10), 20)


@query
def shortlist_quality(spark, d):
    """Of each profile's best ten: how many there are, how many without a known skill, of how many trades, and how many of the first five name a known skill in their title."""
    best = ranking.ranked(_ranked(spark, d), 3, 10)
    named = F.exists("title_skills", lambda s: F.array_contains("known", s))
    return best.groupBy("profile_id").agg(F.count(F.lit(1)).alias("filled"), F.count_if(F.size("known") == 0).alias("without_skill"), F.count_if("practitioner").alias("practitioners"), F.count_if(named & (F.col("rank") <= 5)).alias("hits"), F.count_if(~F.col("place.ok")).alias("misplaced"))


@query
def profile_summary(spark, d):
    """What a reader sees of the profile of each customer's CV."""
    return sinks.profile_summary(_cv_profiles(spark, d))


@query
def run_report(spark, d):
    docs = read(spark, d, "documents")
    once = F.row_number().over(Window.partitionBy("source", F.md5("text")).orderBy("doc_id")) > 1
    rows = docs.withColumns({"duplicate": once, "reason": F.when(F.col("n_chars") < 200, "short"), "ghosted": F.col("doc_id") % 9 == 0})
    return sinks.run_report(rows, "source", "reason", "duplicate", "ghosted")


# streams


def _stream(spark, d) -> DataFrame:
    rows = streams.stream_of(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("long")
    return rows.withColumns({"run_id": day, "uid": F.concat_ws(":", F.lit("u"), F.col("user_id").cast("string"), "event_type")})


@query
def stream_dedup(spark, d):
    return streams.drained(streams.deduplicated(_stream(spark, d).select("uid", "ts"), ["uid"], "ts"), "append").select("uid")


@query
def stream_budget(spark, d):
    used = streams.budget(_stream(spark, d), "event_type", "ts", "1 hour", "30 minutes")
    return streams.drained(used).select("event_type", F.unix_seconds("window.start").alias("start"), "used")


@query
def stream_log(spark, d):
    log = streams.logged(_stream(spark, d).select("run_id", "uid", F.col("event_type").alias("board_token")))
    return log.groupBy("run_id", "board_token").agg(F.count(F.lit(1)).alias("sightings"))


@query
def stream_closed(spark, d):
    """State of each posting from the streamed log: how often seen, in which run last, closed or not."""
    rows = _stream(spark, d).select("run_id", "uid", F.col("event_type").alias("board_token"), F.lit("").alias("title_key"), F.lit("").alias("content_hash"), F.lit("").alias("description"), F.col("ts").alias("seen_at"))
    return history.snapshot(streams.logged(rows)).select("uid", "seen", "last_run", "closed")


@query
def stream_cooloff(spark, d):
    """Whether each request of the streamed log lies outside a block's silence."""
    log = streams.logged(_stream(spark, d).select("run_id", F.concat_ws("/", "uid", F.col("event_id").cast("string")).alias("uid"), "event_id", "event_type", "user_id", "ts"))
    return intervals.cooled_off(log, ["user_id"], "ts", F.col("event_type") == "error", 6).select("event_id", "allowed")


@query
def stream_cooloff_state(spark, d):
    """The same by the state of each key and its timer, without a log."""
    rows = _stream(spark, d).select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("blocked"))
    return streams.drained(streams.cooled_off(rows, "user_id", "ts", "blocked"), "append").select("event_id", "allowed")
