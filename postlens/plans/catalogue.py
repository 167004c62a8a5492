"""Named queries of the engine over the driver's tables. The SQL that must give the same rows is in :mod:`.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import catalog
from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import dedup, fit, geo, ghost, history, intervals, matching, score, shortlist
from ..sources import feeds
from . import feed_sql, feed_standin, more, more_sql, ranking, ranking_sql, standin, state
from .oracle import ORACLE

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}

AS_OF = "2001-08-01"
#: Dictionary of the queries: tokens of the synthetic prose and licence lines. (canonical, term, weight)
TERMS = (("license", "license", 1.0), ("license", "licensed", 1.0), ("terms", "terms", 0.6), ("general public", "general public", 1.5), ("version", "version", 0.4), ("released", "released", 0.8), ("article", "the", 0.2), ("article", "les", 0.2), ("article", "der", 0.2), ("article", "los", 0.2))


def query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def _first_line(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t, False) for c, t, _ in TERMS], "canonical string, term string, case_sensitive boolean")


def _doc_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.token_matches(read(spark, sf_dir, "documents"), ["doc_id"], "text", _terms(spark))


@query
def posting_keys(spark, d):
    docs = read(spark, d, "documents")
    title = _first_line(F.col("text"))
    return docs.select("doc_id", tx.uid(F.lit("docs"), F.col("source"), F.col("doc_id").cast("string")).alias("uid"), tx.title_key(F.col("source"), title).alias("title_key"), tx.content_hash(title, F.array(F.col("lang"), F.col("source")), F.col("text")).alias("content_hash"))


@query
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


@query
def url_slug(spark, d):
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), tx.slug(F.regexp_replace(F.regexp_extract(url, "^[a-z]+://[^/?#]+/([^?#]*)", 1), "[/._-]", " ")).alias("slug"))


@query
def multi_format_dates(spark, d):
    ts = F.col("ts")
    raw = F.when(F.col("event_type") == "click", F.unix_millis(ts.cast("timestamp")).cast("string")).when(F.col("event_type") == "view", F.unix_seconds(ts.cast("timestamp")).cast("string")).when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return read(spark, d, "events").select("event_id", F.unix_seconds(tx.any_date(raw)).alias("seconds"))


@query
def age_bands(spark, d):
    age = days_between(F.to_date(F.lit(AS_OF)), F.col("o_orderdate"))
    banded = read(spark, d, "orders").select(F.when(age > 1095, "over 3 years").when(age > 365, "over a year").when(age > 120, "stale").when(age <= 14, "new").otherwise("open").alias("age_band"), "o_orderkey")
    return banded.groupBy("age_band").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


def _ghosts(spark, d) -> DataFrame:
    orders = read(spark, d, "orders")
    same = F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderpriority"))
    closed = F.sum((F.col("o_orderstatus") == "F").cast("long")).over(Window.partitionBy("o_custkey")) - (F.col("o_orderstatus") == "F").cast("long")
    age = days_between(F.to_date(F.lit(AS_OF)), F.col("o_orderdate")).cast("double")
    rows = orders.select("o_orderkey", "o_custkey", "o_totalprice", F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None)).otherwise(age).alias("age"), (F.col("o_orderpriority") == "5-LOW").alias("pool"), same.alias("same"), closed.alias("again"))
    none = F.lit(False)
    return rows.withColumn("risk", F.round(ghost.risk(F.col("age"), F.col("pool"), none, F.lit(0), F.col("same"), none, F.when(F.col("again") > 6, 1).otherwise(0)), 4))


@query
def ghost_risk(spark, d):
    return _ghosts(spark, d).select("o_orderkey", "risk", ghost.band(F.col("risk")).alias("band"), ghost.evidence(F.col("same"), F.lit(False), F.when(F.col("again") > 6, 1).otherwise(0)).alias("evidence"))


def _reasons(spark, d) -> DataFrame:
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("disc"))
    rows = read(spark, d, "orders").join(lines, "o_orderkey", "left")
    reason = score.first_reason([(F.col("o_orderpriority") == "5-LOW", F.lit("priority (low)")), (F.col("o_totalprice") > 450000, F.concat(F.lit("price ("), F.col("o_orderstatus"), F.lit(")"))), (F.col("qty") > 200, F.lit("quantity")), (F.col("disc") >= 0.1, F.lit("discount (tenth)"))])
    return rows.withColumn("reason", reason)


@query
def elimination_reason(spark, d):
    return score.histogram(_reasons(spark, d), "reason")


@query
def dedup_fold(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").alias("len"), F.col("n_chars").alias("fresh"), F.length(F.regexp_replace("text", "[^,]", "")).alias("places"))
    return dedup.fold(docs, ["source", "lang"], "doc_id", "len", "fresh", "places")


@query
def dedup_distinct_first(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    return dedup.first_of_each(pages, ["host"], "page_id")


@query
def idf_weights(spark, d):
    total = read(spark, d, "documents").agg(F.count(F.lit(1)).cast("double").alias("total"))
    matches = _doc_matches(spark, d)
    return matching.idf(matches.join(F.broadcast(total)).withColumn("canonical", F.struct("canonical", "total")), "canonical", F.col("canonical.total")).select(F.col("canonical.canonical").alias("canonical"), "df", "idf")


@query
def dict_match_score(spark, d):
    weights = spark.createDataFrame(list({c: w for c, _, w in TERMS}.items()), "canonical string, w double")
    return matching.skill_score(_doc_matches(spark, d), ["doc_id"], weights)


@query
def weighted_mentions(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.explode(matching.words(F.lower("text"))).alias("word")).where(F.col("word").isin("the", "and", "der", "und", "les", "des", "los", "que"))
    weighted = turns.withColumn("weight", F.greatest(F.lit(0.25), 1 - F.col("turn") / 8))
    found = matching.mention_evidence(weighted, ["conv_id", "word"], "weight")
    return found.withColumn("strength", matching.strength(F.col("evidence")))


@query
def seniority_case(spark, d):
    parts = read(spark, d, "part")
    level = F.when(F.col("p_type") == "PROMO", "staff").when(F.col("p_name").rlike("^(small|red) "), "junior").when(F.col("p_size") > 35, "senior").otherwise("mid")
    return parts.select("p_partkey", level.alias("level"), score.rank_of(level).alias("rank"))


@query
def work_mode_case(spark, d):
    docs = read(spark, d, "documents")
    declared = F.when(F.col("lang") == "de", "hybrid").when(F.col("source") == "src3", "Remote").otherwise("")
    mode = tx.work_mode(declared, F.col("text"))
    return docs.groupBy("lang", "source", mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query
def geo_resolve(spark, d):
    nation, region, customer = (read(spark, d, t) for t in ("nation", "region", "customer"))
    places = nation.select(F.lower("n_name").alias("token"), F.lit(1).alias("tier"), F.lower("n_name").alias("tag")).unionByName(region.select(F.lower("r_name").alias("token"), F.lit(2).alias("tier"), F.lower("r_name").alias("tag")))
    where = customer.join(shortlist.small(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(shortlist.small(region), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Remote, "), "r_name")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("Somewhere")).otherwise(F.concat("n_name", F.lit(" / "), "r_name"))
    found = geo.countries(where.select("c_custkey", F.array(text).alias("locations")), "c_custkey", "locations", places)
    return found.select("c_custkey", F.array_join("countries", "/").alias("countries"))


@query
def permit_semi(spark, d):
    allowed = read(spark, d, "nation").where("n_regionkey IN (1, 3)").select(F.col("n_nationkey").alias("c_nationkey"))
    return read(spark, d, "customer").join(allowed, "c_nationkey", "left_semi").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 2).cast("double").alias("balance"))


@query
def closed_anti(spark, d):
    orders = read(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    open_ = orders.where("year < 2000").select("o_custkey", "o_orderstatus").distinct()
    now = orders.where("year >= 2000").select("o_custkey").distinct()
    scanned = orders.where("year >= 2000").select("o_orderstatus").distinct()
    return history.closures(open_, now, scanned, "o_custkey", "o_orderstatus").select("o_custkey", "o_orderstatus")


@query
def repost_self(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("title"), (F.col("o_orderstatus") == "F").alias("closed"))
    return history.reposts(orders, "title", "closed").select("o_orderkey", "reposts")


@query
def trigger_activation(spark, d):
    held = read(spark, d, "events").select("user_id", "event_type").distinct()
    triggers = spark.createDataFrame([("buyer", "purchase", True, 2), ("buyer", "click", False, 2), ("fragile", "error", False, 2), ("fragile", "signup", False, 2), ("reader", "view", False, 3), ("reader", "click", False, 3), ("reader", "signup", False, 3)], "family string, event_type string, strong boolean, least int")
    return matching.activated(held, triggers, "user_id", "event_type", "family")


@query
def profile_cross_score(spark, d):
    profiles = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 2 + 1).alias("size"))
    parts = read(spark, d, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    # every profile sees every posting; the table of profiles is the small side
    pairs = shortlist.spread(parts, profiles.count()).join(shortlist.small(profiles))
    points = F.greatest(F.lit(0), 45 - F.abs(F.col("p_size") - F.col("size"))) + F.when(F.col("p_type") == "PROMO", 15).otherwise(0)
    return shortlist.top_per_group(pairs.withColumn("points", points), ["n_nationkey"], [F.col("points").desc(), F.col("p_partkey")], 10).select("n_nationkey", "rank", "p_partkey", "points")


@query
def overlap_join(spark, d):
    names = read(spark, d, "part").select("p_name", "p_type").distinct()
    queries = names.select(F.col("p_name").alias("q")).distinct().withColumn("tokens", tx.token_set(F.col("q")))
    paths = names.select(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("p")).distinct().withColumn("tokens", tx.token_set(F.col("p")))
    return matching.overlap(queries, paths, "q", "p")


@query
def prefix_sector(spark, d):
    paths = read(spark, d, "part").select(tx.slug(F.concat_ws(" ", "p_name", "p_type")).alias("path")).unionByName(read(spark, d, "part").select(tx.slug(F.col("p_name")).alias("path"))).distinct()
    return matching.prefix_sectors(paths, "path")


@query
def topk_per_group(spark, d):
    return shortlist.top_per_group(read(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "rank", "o_orderkey", "o_totalprice")


@query
def history_lag(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("hash"), F.date_trunc("hour", "ts").alias("updated"))
    return history.compared(events, "user_id", ["ts", "event_id"], "hash", "updated").select("event_id", "nth", "fake_refresh", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_micros"))


def _sightings(events: DataFrame) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("long")
    return events.select(day.alias("run_id"), F.concat_ws(":", F.lit("u"), F.col("user_id").cast("string"), "event_type").alias("uid"), F.col("event_type").alias("board_token"), F.col("event_type").alias("title_key"), F.col("ts").alias("seen_at"), F.md5(F.col("props")).alias("content_hash"), F.when(F.col("value") > 20, F.col("props")).otherwise("").alias("description"), "event_id")


def _one_sighting(sightings: DataFrame) -> DataFrame:
    """One sighting of a uid in a run: the last."""
    w = Window.partitionBy("uid", "run_id").orderBy(F.col("seen_at").desc(), F.col("event_id").desc())
    return sightings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "event_id")


@query
def seen_counts_snapshot(spark, d):
    state = history.snapshot(_one_sighting(_sightings(read(spark, d, "events"))))
    return state.select("uid", "seen", "closed", "last_run", "content_hash", "description", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_micros"))


@query
def carry_forward(spark, d):
    events = read(spark, d, "events")
    out = intervals.carried(events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), F.col("event_type") == "signup", "carried")
    return out.select("event_id", "carried")


@query
def neighbour_window(spark, d):
    lines = read(spark, d, "lineitem")
    w = intervals.neighbours(["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], 1, 2)
    flagged = lines.withColumn("near_return", F.max((F.col("l_returnflag") == "R").cast("int")).over(w)).withColumn("near_qty", F.sum("l_quantity").over(w))
    return flagged.groupBy("l_orderkey").agg(F.sum("near_return").cast("long").alias("near_returns"), F.max("near_qty").alias("most_qty"), F.min("near_qty").alias("least_qty"))


@query
def interval_union(spark, d):
    start = F.datediff("o_orderdate", F.to_date(F.lit("1995-01-01")))
    rows = read(spark, d, "orders").select("o_custkey", start.alias("s"), (start + 30 + F.col("o_orderkey") % 200).alias("e"))
    return intervals.union_length(rows, ["o_custkey"], "s", "e")


@query
def half_life_decay(spark, d):
    age = days_between(F.to_date(F.lit(AS_OF)), F.col("o_orderdate")) / 365.25
    return read(spark, d, "orders").select("o_custkey", intervals.half_life(age).alias("w")).groupBy("o_custkey").agg(F.round(F.sum("w"), 4).alias("decayed"))


@query
def dhondt_seats(spark, d):
    parties = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return shortlist.dhondt(parties, "c_nationkey", "n", "c_nationkey", 40)


@query
def round_robin(spark, d):
    both = read(spark, d, "nation").select(F.lit(0).alias("owner"), F.row_number().over(Window.orderBy("n_nationkey")).alias("place"), F.col("n_regionkey").cast("string").alias("value"))
    more = read(spark, d, "supplier").select((F.col("s_nationkey") % 3 + 1).alias("owner"), F.col("s_suppkey").alias("key"), F.concat_ws("-", F.col("s_nationkey").cast("string"), F.floor(F.col("s_acctbal") / 2500).cast("string")).alias("value"))
    placed = more.select("owner", F.row_number().over(Window.partitionBy("owner").orderBy("key")).alias("place"), "value")
    return shortlist.round_robin(both.unionByName(placed), "owner", "place", "value", 24).select("slot", "owner", "place", "value")


@query
def best_relative(spark, d):
    parts = read(spark, d, "part")
    return shortlist.near_best(parts, ["p_brand"], "p_retailprice", 0.95).select("p_partkey", "p_brand", "best")


@query
def systematic_sample(spark, d):
    return shortlist.systematic_sample(read(spark, d, "orders"), "o_orderkey", 1500).select("o_orderkey", "o_custkey")


@query
def rolling_budget(spark, d):
    events = read(spark, d, "events").select("event_id", "event_type", "ts")
    counted = intervals.rolling_count(events, ["event_type"], "ts", 3600, "used")
    return counted.select("event_id", "used", F.greatest(F.lit(0), F.least(6 - F.col("used"), F.lit(4))).alias("left"))


@query
def cooloff(spark, d):
    events = read(spark, d, "events")
    return intervals.cooled_off(events, ["user_id"], "ts", F.col("event_type") == "error", 6).select("event_id", "allowed")


@query
def ttl_cache(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    before = F.max(F.when(F.col("event_type") != "error", F.col("at"))).over(Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    hours = (F.col("at") - before) / 3_600_000_000
    state = F.when(hours < 12, "cached").when((F.col("event_type") == "error") & (hours < 72), "stale").when(F.col("event_type") == "error", "failed").otherwise("fetched")
    return events.select("event_id", state.alias("state"))


@query
def union_pool(spark, d):
    pool = shortlist.union_pool(customers=read(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").alias("nation")), suppliers=read(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_nationkey").alias("nation")))
    return pool.groupBy("pool", "nation").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


@query
def version_diff(spark, d):
    orders = read(spark, d, "orders")
    lists = orders.groupBy("o_custkey", (F.col("o_orderdate") < F.to_timestamp(F.lit("1998-07-01"))).alias("old")).agg(F.collect_set("o_orderpriority").alias("items"))
    diff = history.version_diff(lists.where("old"), lists.where("NOT old"), "o_custkey", "items")
    return diff.select("o_custkey", F.array_join("entered", ",").alias("entered"), F.array_join("left", ",").alias("left_"))


@query
def role_argmax(spark, d):
    parts = read(spark, d, "part")
    families = (("metal", "bolt|gear|widget", 0.8), ("shape", "ring|bolt", 0.9), ("colour", "^(red|blue|green) ", 0.9), ("size", "^(small|large) ", 0.5))
    # a small table of patterns is a list of constant conditions, not a join that tries each pattern on each row
    found = F.array_compact(F.array(*[F.when(F.col("p_name").rlike(pattern), F.struct(F.lit(name).alias("family"), F.lit(weight).alias("weight"), F.lit(i).alias("ord"))) for i, (name, pattern, weight) in enumerate(families)]))
    hits = parts.select("p_partkey", F.inline(found))
    return matching.best_role(parts, ["p_partkey"], hits, "weight", "ord", "family")


@query
def family_weight(spark, d):
    lines = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("triggers"), F.max(F.year("l_shipdate")).alias("y"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    ready = rows.select("p_type", "p_brand", F.lit(1.0).alias("base"), "triggers", F.when(F.col("y") >= 2001, 1.0).otherwise(0.6).alias("recency"), (F.col("r") == 1).alias("strong"))
    return ready.select("p_type", "p_brand", matching.family_weight(ready, "base", "triggers", "recency", "strong", ["p_type"]).alias("weight"))


@query
def late_materialise(spark, d):
    labels = read(spark, d, "labels").where("quality = 1").select("doc_id")
    best = read(spark, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left_semi").orderBy(F.col("n_chars").desc(), "doc_id").limit(30)
    texts = read(spark, d, "documents").join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi")
    return texts.select("doc_id", F.md5(F.col("text")).alias("digest"), F.length("text").alias("chars"))


def _centre(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    each = rows.where(condition).select(F.posexplode("embedding").alias("i", "x"))
    return each.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(name))


def _contrast(spark, d) -> DataFrame:
    rows = read(spark, d, "embeddings")
    own, other = _centre(rows, F.col("label") == 0, "own"), _centre(rows, F.col("label") != 0, "other")
    return rows.join(F.broadcast(own)).join(F.broadcast(other)).withColumn("fit", fit.contrast(F.col("embedding"), F.col("own"), F.col("other")))


@query
def contrast_cosine(spark, d):
    return _contrast(spark, d).select("vec_id", F.round("fit", 6).alias("fit"))


@query
def fit_band_score(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), (F.col("n_chars") % 100).cast("double").alias("total"))
    joined = _contrast(spark, d).select("vec_id", F.round("fit", 6).alias("fit")).join(docs, "vec_id")
    return joined.select("vec_id", score.tenths(score.unrounded(F.col("total"), (F.col("vec_id") % 4) / 4, F.when(F.col("vec_id") % 7 != 0, F.col("fit")))).alias("final"))


@query
def stable_sort_limit(spark, d):
    return shortlist.stable_top(read(spark, d, "orders"), "o_totalprice", "o_orderkey", 25).select("o_orderkey", "o_totalprice")


@query
def store_stats(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.countDistinct("o_custkey").alias("customers"))


@query
def json_sidecar(spark, d):
    k = F.from_json("props", "k int")["k"]
    return read(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("kind"), k.alias("k"))).alias("sidecar"))


@query
def coverage_ratio(spark, d):
    covered = F.col("p_name").rlike("bolt|ring|gear")
    return read(spark, d, "part").groupBy("p_type").agg(F.round(F.avg(covered.cast("double")), 6).alias("simple"), F.round(F.sum(F.when(covered, F.col("p_size")).otherwise(0)) / F.sum("p_size"), 6).alias("weighted"))


@query
def topn_quality(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    top = shortlist.top_per_group(rows, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 10)
    return top.groupBy("source").agg(F.count(F.lit(1)).alias("filled"), F.count_if(F.col("toxic") == 1).alias("leaked"), F.count_if((F.col("rank") <= 5) & (F.col("quality") == 1)).alias("hits"))


@query
def conversation_context(spark, d):
    turns = read(spark, d, "conversations")
    w = intervals.neighbours(["conv_id"], ["turn"], 1, 1)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), ">").alias("context"), F.sum(F.length("text")).over(w).alias("chars"))


@query
def years_required(spark, d):
    posts = standin.postings(read(spark, d, "documents"))
    # every tenth text gets a second mention behind the first, and one that is too high before it
    more = F.when(F.col("seq") % 10 == 3, F.concat(F.lit("Up to 40 years of experience are fine! "), "description", F.lit(". At least 2+ years of experience."))).otherwise(F.col("description"))
    return posts.select("seq", score.required_years(more).alias("years"))


@query
def escaped_html_to_text(spark, d):
    escaped = F.replace(F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    return read(spark, d, "pages").select("page_id", tx.html_text(escaped).alias("text"))


@query
def work_mode_full(spark, d):
    posts = standin.postings(read(spark, d, "documents"))
    mode = tx.work_mode(F.when(F.col("seq") % 9 == 0, "Hybrid").otherwise(""), F.col("description"), F.col("remote_flag"), F.col("locations"))
    return posts.select("seq", mode.alias("mode"), tx.employment_type(F.when(F.col("seq") % 5 == 0, "Full-Time").otherwise(""), F.when(F.col("seq") % 3 == 0, F.lit("Internship, part time")).otherwise("")).alias("employment"))


@query
def skill_regex_exact(spark, d):
    return matching.pattern_matches(read(spark, d, "documents"), ["doc_id"], "text", [(c, t, False) for c, t, _ in TERMS])


@query
def nfc_normalise(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.nfc(F.col("text"))).alias("digest"))


@query
def stream_sightings(spark, d):
    from ..streaming.sightings import counted_stream

    return counted_stream(spark, f"{d}/events.parquet")


def _shown(rows: DataFrame) -> DataFrame:
    """A posting as flat columns."""
    return rows.select(
        "company", "board_token", "native_id", "title", "url", F.array_join("locations", "|").alias("locations"), "description", "department", "employment_type", "remote_flag", F.unix_seconds("posted_at").alias("posted"),
        F.coalesce(F.concat_ws(";", "raw.workplace_type", "raw.salary", F.array_join("raw.tags", ","), "raw.level", "raw.valid_until"), F.lit("")).alias("sidecar"),
    )


def _feed(name: str) -> Query:
    def run(spark, d):
        return _shown(feeds.PARSERS[name](feed_standin.payloads(read(spark, d, "documents"), name)))

    run.__name__ = f"feed_{name}"
    return run


for _name in feed_standin.FEEDS:
    query(_feed(_name))


@query
def feed_weworkremotely(spark, d):
    return _shown(feeds.weworkremotely(feed_standin.pages(read(spark, d, "documents"), feed_standin.RSS)))


@query
def feed_board_cards(spark, d):
    return _shown(feeds.board_cards(feed_standin.pages(read(spark, d, "documents"), feed_standin.CARD), F.to_timestamp(F.lit("2024-06-01 00:00:00")))).select("company", "board_token", "native_id", "title", "locations", "employment_type", "remote_flag", "posted", "sidecar")


@query
def feed_job_posting_ld(spark, d):
    docs = read(spark, d, "documents")
    return _shown(feeds.job_posting_ld(docs.select(F.col("doc_id").cast("string").alias("token"), F.upper("source").alias("company"), F.expr(feed_standin.LD).alias("payload"))))


@query
def feed_list_links(spark, d):
    anchor = "concat('<a class=\"c\" href=\"/job/', doc_id % 10, '\" title=\"Title ', doc_id, '\">x</a>')"
    return feeds.list_links(feed_standin.pages(read(spark, d, "documents"), anchor)).select("token", "path", "title")


@query
def feed_board_detail(spark, d):
    page = F.concat(F.lit("<div>short</div><section class='x'>"), F.lit("<p>About "), "source", F.lit("</p><p>in "), "lang", F.lit("</p></section><dl><dt>Level</dt><dd>"), F.col("doc_id").cast("string"), F.lit("</dd></dl>"))
    return feeds.board_detail(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("token"), page.alias("payload")))


@query
def sitemap_paths(spark, d):
    maps = read(spark, d, "pages").select(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url><url><loc>https://other.test/x</loc></url>")).alias("payload"))
    return feeds.sitemap_paths(maps, "example")


@query
def firm_paths(spark, d):
    paths = read(spark, d, "part").select(F.concat(F.lit("/firma/"), tx.slug(F.col("p_name")), F.lit("-"), F.col("p_partkey").cast("string")).alias("path"))
    return feeds.firm_paths(paths, "red")


@query
def feed_pool(spark, d):
    docs = read(spark, d, "documents")
    pool = feeds.pool(spark, {name: feed_standin.payloads(docs, name) for name in ("lever", "remoteok")})
    return pool.select("seq", "source", "board_token", "native_id")


@query
def flagship_shortlist(spark, d):
    return flagship(spark, d)


def _ranked_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return ranking.with_risk(ranking.facts(ranking.variants_folded(standin.postings(docs)), F.to_timestamp(F.lit(standin.AS_OF))))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return ranking.decided(ranking.scored(_ranked_rows(spark, d), standin.profiles(spark)))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    """The pairs worth ranking, from the candidates only."""
    rows, profiles = _ranked_rows(spark, d), standin.profiles(spark)
    return ranking.decided(ranking.scored(rows, profiles, ranking.candidates(rows, profiles))).where("verdict = 'kept'")


@query
def kept_candidates(spark, d):
    return _kept(spark, d).select("profile_id", "seq", "risk", "total", "final")


@query
def variants_folded(spark, d):
    rows = ranking.variants_folded(standin.postings(read(spark, d, "documents")))
    return rows.select("seq", F.col("native_id").cast("long").alias("winner"), "variants", tx.title_key(F.col("board_token"), F.col("title")).alias("title_key"))


@query
def posting_facts(spark, d):
    joined = lambda c, between=",": F.array_join(c, between)
    return _ranked_rows(spark, d).select("seq", "level", "years", "practitioner", joined("title_families").alias("title_families"), joined("skills").alias("skills"), joined("title_skills").alias("title_skills"), joined("countries", "/").alias("countries"), "same_title")


@query
def posting_risk(spark, d):
    return _ranked_rows(spark, d).select("seq", "risk", "band", F.array_join("reasons", "; ").alias("reasons"))


@query
def skill_rarity(spark, d):
    return ranking.rarity(_ranked_rows(spark, d)).select(F.explode("idf").alias("canonical", "idf"))


@query
def location_decision(spark, d):
    return _pairs(spark, d).select("profile_id", "seq", "place.status", "place.ok")


@query
def elimination_full(spark, d):
    return _pairs(spark, d).select("profile_id", "seq", "reason")


@query
def elimination_histogram(spark, d):
    return _pairs(spark, d).groupBy("profile_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def total_score(spark, d):
    return _pairs(spark, d).select("profile_id", "seq", "role", F.round("skill", 6).alias("skill"), "bonus", F.col("missing").cast("long").alias("missing"), "off_domain", "total")


@query
def final_score(spark, d):
    return _pairs(spark, d).select("profile_id", "seq", "risk", "total", "final", "verdict")


@query
def shortlist_with_fit(spark, d):
    """The shortlist in two phases: rules and scores for all pairs, vectors for the first 400 kept ones of each profile."""
    from ..streaming.sightings import folder

    rows = _ranked_rows(spark, d)
    pairs = ranking.decided(ranking.scored(rows, standin.profiles(spark)))
    best = ranking.ranked(ranking.with_fit(pairs, rows.select("seq", "title", "description"), folder(spark)))
    return best.select("profile_id", "rank", "seq", "fit", "final")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked, explained shortlists: the pool without variants, every profile's eliminations, scores and risks, three postings of a company, 25 a profile."""
    best = ranking.ranked(_kept(spark, sf_dir))
    return best.select("profile_id", "rank", "seq", "title", "company", "final", "band", F.array_join("reasons", "; ").alias("reasons"), F.array_join("known", ",").alias("known"))


def queries() -> dict[str, Query]:
    return _FOUND | more.QUERIES | state.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE | ranking_sql.ORACLE | feed_sql.ORACLE | more_sql.ORACLE | state.ORACLE
