"""Feed parsers: raw payload text to postings. Fetching is elsewhere, so a parser is a pure plan over (payload, seq columns)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import any_date, html_text, listed_text, or_else, relative_days, squeezed, text_or_empty

RAW = "struct<workplace_type:string,salary:string,tags:array<string>,level:string,valid_until:string,sector:string,detail_fetched:boolean>"


def _c(name: str) -> Column:
    return F.col(f"x.{name}")


def _clean(items: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")))


def _split(c: Column, pattern: str) -> Column:
    return _clean(F.transform(F.split(text_or_empty(c), pattern), lambda x: F.trim(x)))


def _posting(rows: DataFrame, source: str, **given: Column) -> DataFrame:
    """Fills what a feed doesn't give; text is never null, remote_flag may be. ``extra`` columns make up the sidecar."""
    blank, none = F.lit(""), F.lit(None)
    extra = given.pop("extra", {})
    kinds = {"workplace_type": "string", "salary": "string", "tags": "array<string>", "level": "string", "valid_until": "string", "sector": "string", "detail_fetched": "boolean"}
    text = {n: text_or_empty(given.get(n, blank).cast("string")) for n in ("company", "board_token", "native_id", "title", "url", "description", "department", "employment_type")}
    return rows.select(
        F.lit(source).alias("source"), *[c.alias(n) for n, c in text.items()], _clean(given.get("locations")).alias("locations") if "locations" in given else F.array().cast("array<string>").alias("locations"),
        given.get("remote_flag", none).cast("boolean").alias("remote_flag"), given.get("posted_at", none).cast("timestamp").alias("posted_at"), given.get("updated_at", none).cast("timestamp").alias("updated_at"),
        F.struct(*[extra.get(n, none).cast(k).alias(n) for n, k in kinds.items()]).alias("raw"),
    )


def _items(payloads: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    """payloads: token, company, payload. One row for each item."""
    parsed = payloads.withColumn("__j", F.from_json("payload", schema))
    return parsed.select("token", "company", F.explode(F.col(f"__j.{path}") if path else F.col("__j")).alias("x"))


def greenhouse(p: DataFrame) -> DataFrame:
    job = "id long, title string, absolute_url string, content string, first_published string, updated_at string, company_name string, location struct<name:string>, offices array<struct<name:string>>, departments array<struct<name:string>>"
    rows = _items(p, f"jobs array<struct<{_ddl(job)}>>", "jobs")
    offices = F.transform(F.coalesce(_c("offices"), F.array().cast("array<struct<name:string>>")), lambda o: o["name"])
    return _posting(rows, "greenhouse", company=or_else(F.col("company"), _c("company_name")), board_token=F.col("token"), native_id=_c("id"), title=_c("title"), url=_c("absolute_url"), locations=F.concat(_split(_c("location.name"), r"[;|]"), _clean(offices)), description=html_text(_c("content")), department=listed_text(F.transform(_c("departments"), lambda d: d["name"])), posted_at=any_date(_c("first_published")), updated_at=any_date(_c("updated_at")))


def _ddl(columns: str) -> str:
    """``a int, b string`` as the fields of a struct."""
    depth, out = 0, []
    for part in columns.split(", "):
        out.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def lever(p: DataFrame) -> DataFrame:
    job = "id string, text string, hostedUrl string, applyUrl string, descriptionPlain string, description string, additionalPlain string, workplaceType string, createdAt long, categories struct<location:string,allLocations:array<string>,department:string,commitment:string,team:string>"
    rows = _items(p, f"array<struct<{_ddl(job)}>>")
    mode = F.lower(_c("workplaceType"))
    return _posting(rows, "lever", company=F.col("company"), board_token=F.col("token"), native_id=_c("id"), title=_c("text"), url=or_else(_c("hostedUrl"), _c("applyUrl")), locations=F.concat(F.array(_c("categories.location")), F.coalesce(_c("categories.allLocations"), F.array().cast("array<string>"))), description=F.concat_ws("\n", or_else(_c("descriptionPlain"), html_text(_c("description"))), F.nullif(_c("additionalPlain"), F.lit(""))), department=or_else(_c("categories.department"), _c("categories.team")), employment_type=_c("categories.commitment"), remote_flag=F.when(mode == "remote", True).when(mode.isin("onsite", "on-site", "hybrid"), False), posted_at=F.timestamp_millis(_c("createdAt")), extra={"workplace_type": _c("workplaceType")})


def ashby(p: DataFrame) -> DataFrame:
    job = "id string, title string, isListed boolean, location string, secondaryLocations array<string>, isRemote boolean, workplaceType string, jobUrl string, applyUrl string, descriptionPlain string, descriptionHtml string, department string, team string, employmentType string, publishedAt string, updatedAt string"
    rows = _items(p, f"jobs array<struct<{_ddl(job)}>>", "jobs").where(F.coalesce(_c("isListed"), F.lit(True)))
    # an item is a name or an object; read as text, an object is its JSON
    second = F.transform(F.coalesce(_c("secondaryLocations"), F.array().cast("array<string>")), lambda s: F.when(F.startswith(s, F.lit("{")), F.get_json_object(s, "$.location")).otherwise(s))
    return _posting(rows, "ashby", company=F.col("company"), board_token=F.col("token"), native_id=_c("id"), title=_c("title"), url=or_else(_c("jobUrl"), _c("applyUrl")), locations=F.concat(F.array(_c("location")), second), description=or_else(_c("descriptionPlain"), html_text(_c("descriptionHtml"))), department=or_else(_c("department"), _c("team")), employment_type=_c("employmentType"), remote_flag=F.coalesce(_c("isRemote"), F.when(F.lower(_c("workplaceType")) == "remote", True)), posted_at=any_date(_c("publishedAt")), updated_at=any_date(_c("updatedAt")), extra={"workplace_type": _c("workplaceType")})


def workable(p: DataFrame) -> DataFrame:
    job = "shortcode string, id string, slug string, title string, url string, location struct<city:string,region:string,country:string>, locations array<struct<city:string,region:string,country:string,hidden:boolean>>, remote boolean, workplace string, department string, published string, published_on string, created_at string, description string, type string"
    rows = _items(p, f"results array<struct<{_ddl(job)}>>", "results")
    name = lambda x: F.concat_ws(", ", F.nullif(x["city"], F.lit("")), F.nullif(x["region"], F.lit("")), F.nullif(x["country"], F.lit("")))
    shown = F.transform(F.filter(F.coalesce(_c("locations"), F.array().cast("array<struct<city:string,region:string,country:string,hidden:boolean>>")), lambda x: ~F.coalesce(x["hidden"], F.lit(False))), name)
    department = F.when(F.startswith(_c("department"), F.lit("[")), listed_text(F.from_json(_c("department"), "array<string>"))).otherwise(_c("department"))
    return _posting(rows, "workable", company=F.col("company"), board_token=F.col("token"), native_id=or_else(_c("shortcode"), _c("id"), _c("slug")), title=_c("title"), url=_c("url"), locations=F.when(F.size(shown) > 0, shown).otherwise(F.array(name(_c("location")))), description=html_text(_c("description")), department=department, employment_type=_c("type"), remote_flag=F.coalesce(_c("remote"), F.when(_c("workplace") == "remote", True)), posted_at=any_date(or_else(_c("published"), _c("published_on"), _c("created_at"))))


def smartrecruiters(p: DataFrame) -> DataFrame:
    job = "id string, name string, applyUrl string, jobAd string, location struct<city:string,region:string,country:string,remote:boolean>, department struct<label:string>, typeOfEmployment struct<label:string>, releasedDate string"
    rows = _items(p, f"content array<struct<{_ddl(job)}>>", "content")
    ad = html_text(F.regexp_replace(text_or_empty(_c("jobAd")), r'[{}"]|\b(sections|title|text)\b:', " "))
    return _posting(rows, "smartrecruiters", company=F.col("company"), board_token=F.col("token"), native_id=_c("id"), title=_c("name"), url=_c("applyUrl"), locations=F.array(F.concat_ws(", ", _c("location.city"), _c("location.region"), _c("location.country"))), description=ad, department=_c("department.label"), employment_type=_c("typeOfEmployment.label"), remote_flag=_c("location.remote"), posted_at=any_date(_c("releasedDate")))


def remotive(p: DataFrame) -> DataFrame:
    job = "id long, title string, company_name string, url string, candidate_required_location string, description string, category string, job_type string, publication_date string, salary string, tags array<string>"
    rows = _items(p, f"jobs array<struct<{_ddl(job)}>>", "jobs")
    places = _split(_c("candidate_required_location"), ",")
    return _posting(rows, "remotive", company=_c("company_name"), board_token=F.concat(F.lit("remotive:"), "token"), native_id=_c("id"), title=_c("title"), url=_c("url"), locations=F.when(F.size(places) > 0, places).otherwise(F.array(F.lit("Remote"))), description=html_text(_c("description")), department=_c("category"), employment_type=_c("job_type"), remote_flag=F.lit(True), posted_at=any_date(_c("publication_date")), extra={"salary": _c("salary"), "tags": _c("tags")})


def remoteok(p: DataFrame) -> DataFrame:
    job = "id string, position string, company string, location string, url string, apply_url string, description string, tags array<string>, date string, salary_min long, salary_max long"
    rows = _items(p, f"array<struct<{_ddl(job)}>>").where((text_or_empty(_c("id")) != "") & (text_or_empty(_c("position")) != ""))
    pay = F.when(_c("salary_min") > 0, F.concat_ws("-", _c("salary_min").cast("string"), _c("salary_max").cast("string")))
    return _posting(rows, "remoteok", company=_c("company"), board_token=F.lit("remoteok"), native_id=_c("id"), title=_c("position"), url=or_else(_c("url"), _c("apply_url")), locations=_split(_c("location"), ","), description=F.concat_ws("\n", html_text(_c("description")), listed_text(_c("tags"))), remote_flag=F.lit(True), posted_at=any_date(_c("date")), extra={"salary": pay, "tags": _c("tags")})


def arbeitnow(p: DataFrame) -> DataFrame:
    job = "slug string, title string, company_name string, location string, url string, remote boolean, description string, tags array<string>, job_types array<string>, created_at long"
    rows = _items(p, f"data array<struct<{_ddl(job)}>>", "data")
    return _posting(rows, "arbeitnow", company=_c("company_name"), board_token=F.lit("arbeitnow"), native_id=_c("slug"), title=_c("title"), url=_c("url"), locations=F.array(_c("location")), description=html_text(_c("description")), employment_type=listed_text(_c("job_types")), remote_flag=_c("remote"), posted_at=F.timestamp_seconds(_c("created_at")), extra={"tags": _c("tags")})


def themuse(p: DataFrame) -> DataFrame:
    job = "id long, name string, contents string, company struct<name:string>, locations array<struct<name:string>>, categories array<struct<name:string>>, levels array<struct<name:string>>, refs struct<landing_page:string>, publication_date string"
    rows = _items(p, f"results array<struct<{_ddl(job)}>>", "results")
    places = F.transform(F.coalesce(_c("locations"), F.array().cast("array<struct<name:string>>")), lambda x: x["name"])
    far = F.exists(places, lambda x: F.lower(x).rlike("flexible|remote"))
    return _posting(rows, "themuse", company=_c("company.name"), board_token=F.lit("themuse"), native_id=_c("id"), title=_c("name"), url=_c("refs.landing_page"), locations=places, description=html_text(_c("contents")), department=listed_text(F.transform(_c("categories"), lambda x: x["name"])), remote_flag=F.when(far, True), posted_at=any_date(_c("publication_date")), extra={"level": listed_text(F.transform(_c("levels"), lambda x: x["name"]))})


def himalayas(p: DataFrame) -> DataFrame:
    job = "guid string, title string, companyName string, applicationLink string, locationRestrictions array<string>, description string, categories array<string>, employmentType string, pubDate long, expiryDate long, minSalary long, maxSalary long, currency string"
    rows = _items(p, f"jobs array<struct<{_ddl(job)}>>", "jobs")
    pay = F.when(_c("minSalary") > 0, F.concat(_c("minSalary").cast("string"), F.lit("-"), F.coalesce(_c("maxSalary"), _c("minSalary")).cast("string"), F.lit(" "), text_or_empty(_c("currency"))))
    return _posting(rows, "himalayas", company=_c("companyName"), board_token=F.lit("himalayas"), native_id=_c("guid"), title=_c("title"), url=_c("applicationLink"), locations=_c("locationRestrictions"), description=html_text(_c("description")), department=listed_text(_c("categories")), employment_type=_c("employmentType"), remote_flag=F.lit(True), posted_at=any_date(_c("pubDate").cast("string")), extra={"salary": pay, "valid_until": _c("expiryDate").cast("string")})


def jobicy(p: DataFrame) -> DataFrame:
    job = "id long, jobTitle string, companyName string, url string, jobGeo string, jobDescription string, jobIndustry array<string>, jobType array<string>, jobLevel string, pubDate string"
    rows = _items(p, f"jobs array<struct<{_ddl(job)}>>", "jobs")
    return _posting(rows, "jobicy", company=_c("companyName"), board_token=F.lit("jobicy"), native_id=_c("id"), title=_c("jobTitle"), url=_c("url"), locations=_split(_c("jobGeo"), ","), description=html_text(_c("jobDescription")), department=listed_text(_c("jobIndustry")), employment_type=listed_text(_c("jobType")), remote_flag=F.lit(True), posted_at=any_date(_c("pubDate")), extra={"level": _c("jobLevel")})


def weworkremotely(p: DataFrame) -> DataFrame:
    """RSS: the title is ``Company: Role``."""
    items = p.select("token", "company", F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("x"))
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    parts = F.split(tag("title"), ": ", 2)
    named = F.size(parts) > 1
    when = F.try_to_timestamp(F.regexp_extract(tag("pubDate"), r"([0-9]{2} \w{3} [0-9]{4} [0-9:]{8})", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return _posting(items, "weworkremotely", company=F.when(named, F.get(parts, F.lit(0))).otherwise(""), board_token=F.lit("weworkremotely"), native_id=tag("link"), title=F.when(named, F.get(parts, F.lit(1))).otherwise(tag("title")), url=tag("link"), locations=F.array(tag("region")), description=html_text(tag("description")), department=tag("category"), remote_flag=F.lit(True), posted_at=when)


def board_cards(p: DataFrame, as_of: Column) -> DataFrame:
    """List page of a board: anchors with ``data-test`` fields; the age is relative to ``as_of``; the first card of each path wins."""
    cards = p.select("token", "company", F.posexplode(F.regexp_extract_all("payload", F.lit(r'(?s)(<a [^>]*href="/is-ilani/[^"]+".*?</a>)'), F.lit(1))).alias("n", "x"))
    # up to the end of the span, as a field may hold markup of its own
    field = lambda name: squeezed(F.regexp_extract("x", rf'(?s)data-test="{name}"[^>]*>(.*?)</span>', 1))
    path = F.regexp_extract("x", r'href="([^"?]+)', 1)
    first = cards.withColumn("path", path).groupBy("token", "path").agg(F.min_by("x", "n").alias("x"), F.first("company").alias("company"))
    days = relative_days(field("ad-date"))
    mode = field("work-model")
    return _posting(first, "kariyer", company=or_else(field("subtitle"), F.col("company")), board_token=F.col("token"), native_id=F.col("path"), title=field("ad-title"), url=F.col("path"), locations=_split(field("location"), ","), employment_type=field("work-type"), remote_flag=F.when(mode.rlike("(?iU)uzaktan|remote"), True).when(mode != "", False), posted_at=F.when(days.isNotNull(), as_of - F.make_dt_interval(days=days)), extra={"workplace_type": mode})


def board_detail(p: DataFrame) -> DataFrame:
    """token, text: the longest block of a detail page, with its title and value pairs."""
    blocks = F.transform(F.regexp_extract_all("payload", F.lit(r"(?s)<(div|section|article)\b[^>]*>((?:(?!<(?:div|section|article)\b).)*?)</\1>"), F.lit(2)), html_text)
    best = F.array_max(F.transform(blocks, lambda b: F.struct(F.length(b).alias("n"), b.alias("t"))))["t"]
    pairs = F.regexp_replace(F.array_join(F.regexp_extract_all("payload", F.lit(r"(?s)<dt[^>]*>(.*?</dt>\s*<dd[^>]*>.*?)</dd>"), F.lit(1)), "\n"), r"</dt>\s*<dd[^>]*>", ": ")
    return p.select("token", F.trim(F.concat_ws("\n", best, F.nullif(pairs, F.lit("")))).alias("text"))


def job_posting_ld(p: DataFrame) -> DataFrame:
    """Detail page with a schema.org JobPosting: the first such block; its address may be a list or an object."""
    blocks = F.regexp_extract_all("payload", F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    found = F.get(F.filter(blocks, lambda b: F.lower(F.get_json_object(b, "$.@type")) == "jobposting"), F.lit(0))
    at = lambda path: F.get_json_object("x", path)
    rows = p.select("token", "company", found.alias("x")).where(F.col("x").isNotNull())
    place = F.coalesce(at("$.jobLocation.address.addressLocality"), at("$.jobLocation[0].address.addressLocality"))
    return _posting(rows, "eleman", company=or_else(at("$.hiringOrganization.name"), F.col("company")), board_token=F.lit("eleman"), native_id=F.col("token"), title=at("$.title"), url=at("$.url"), locations=F.array(place), description=html_text(at("$.description")), employment_type=at("$.employmentType"), posted_at=any_date(at("$.datePosted")), extra={"salary": at("$.baseSalary.value.value"), "valid_until": at("$.validThrough"), "detail_fetched": F.lit(True)})


def list_links(p: DataFrame) -> DataFrame:
    """token, path, title of a list page's anchors, each path once, the first title kept."""
    each = p.select("token", F.posexplode(F.regexp_extract_all("payload", F.lit(r'<a [^>]*href="([^"]+)"[^>]*title="[^"]*"'), F.lit(0))).alias("n", "a"))
    named = each.select("token", "n", F.regexp_extract("a", 'href="([^"]+)"', 1).alias("path"), F.regexp_extract("a", 'title="([^"]*)"', 1).alias("title"))
    return named.groupBy("token", "path").agg(F.min_by("title", "n").alias("title"), F.min("n").alias("n"))


def sitemap_paths(p: DataFrame, host: str) -> DataFrame:
    """path: distinct paths of a host's site maps."""
    locs = p.select(F.explode(F.regexp_extract_all("payload", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc"))
    return locs.where(F.contains("loc", F.lit(host))).select(F.regexp_extract("loc", r"^https?://[^/]+(/[^?#]*)", 1).alias("path")).where("path <> ''").distinct()


def firm_paths(paths: DataFrame, slug: str, n: int = 2) -> DataFrame:
    return paths.where(F.contains("path", F.lit(slug))).orderBy(F.length("path"), "path").limit(n)


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (greenhouse, lever, ashby, workable, smartrecruiters, remotive, remoteok, arbeitnow, themuse, himalayas, jobicy, weworkremotely, job_posting_ld)}


#: How each source is asked: once a company, once a query, as one stream, or page by page under a board's budget.
KINDS = {"greenhouse": "company", "lever": "company", "ashby": "company", "workable": "company", "smartrecruiters": "company", "remotive": "query", "remoteok": "stream", "arbeitnow": "stream", "themuse": "stream", "himalayas": "stream", "jobicy": "stream", "weworkremotely": "stream", "job_posting_ld": "board"}
#: How pages of a source follow each other, how many are read at most, and how many items a full page has.
PAGING = {"workable": ("cursor", 20, 0), "smartrecruiters": ("offset", 20, 100), "arbeitnow": ("number", 3, 50), "themuse": ("number", 4, 1), "himalayas": ("offset", 3, 100)}


def registered(spark) -> dict[str, str]:
    """Registers the paged reader with the session; gives the known sources with their kinds."""
    from .fetch import FeedSource

    spark.dataSource.register(FeedSource)
    return dict(KINDS)


def options(source: str, plan: list[tuple[str, str]], fetcher: str) -> dict[str, str]:
    """Reader options of a source for a plan of (token, company)."""
    import json

    paging, pages, full = PAGING.get(source, ("number", 1, 0))
    return {"plan": json.dumps(plan), "fetcher": fetcher, "paging": paging, "pages": str(pages), "fullpage": str(full)}


def pool(spark, payloads: dict[str, DataFrame]) -> DataFrame:
    """All feeds in one pool. ``seq`` orders the whole pool by source (in the order given), token and native id and repeats nowhere, as later steps depend on the order.

    Rows are numbered within their token (a company, or a stream) and go on where the tokens before it end; only the table of tokens is put in one order.
    """
    from functools import reduce

    rank = {name: i for i, name in enumerate(payloads)}
    both = reduce(DataFrame.unionByName, [PARSERS[name](p).withColumn("__rank", F.lit(rank[name])) for name, p in payloads.items()])
    within = F.row_number().over(Window.partitionBy("__rank", "board_token").orderBy("native_id", "url"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__rank", "board_token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tokens = both.groupBy("__rank", "board_token").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", before)
    return both.withColumn("__at", within).join(tokens, ["__rank", "board_token"]).withColumn("seq", (F.col("__before") + F.col("__at")).cast("long")).drop("__rank", "__at", "__n", "__before")
