"""A paged Python data source, its retry policy, and the plans of page cache and request budget. The caller gives the fetcher, so nothing here opens a socket by itself."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Age in hours up to which a cached page is used, by kind; up to which a stale one stands in for a failed fetch; hours of silence after a block.
TTL_HOURS = {"list": 12, "detail": 24 * 14, "robots": 24}
STALE_HOURS, COOL_OFF_HOURS, KEEP_PAGES_DAYS, KEEP_LEDGER_DAYS = 72, 6, 30, 2
PER_HOUR, PER_RUN, FOR_DETAIL = 24, 16, 6


class Permanent(Exception):
    """No retry helps."""


def with_retries(call: Callable[[], tuple[int, str, float | None]], sleep: Callable[[float], None] = time.sleep, tries: int = 3) -> str:
    """Body of a (status, body, retry-after) call: 404 is final, 429 gets one short wait (5 s at most), 5xx and errors wait 1.5 * 2 ** n."""
    limited = False
    for n in range(tries):
        try:
            status, body, after = call()
        except OSError:
            status, body, after = 599, "", None
        if status < 300:
            return body
        if status == 429 and not limited:
            limited = True
            sleep(min(after or 5.0, 5.0))
        elif status < 500:
            raise Permanent(f"status {status}")
        elif n + 1 < tries:
            sleep(1.5 * 2**n)
    raise OSError("gave up")


class _Page(InputPartition):
    def __init__(self, token: str, company: str, pages: int) -> None:
        super().__init__((token, company, pages))


class FeedReader(DataSourceReader):
    """Options: plan, fetcher, and how pages follow each other. ``paging`` is ``number`` (0, 1, 2 …), ``offset`` (0, fullpage, 2 * fullpage … up to the total that the fetcher tells) or ``cursor`` (what the fetcher returned with the page before)."""

    def __init__(self, options: dict) -> None:
        self.plan = json.loads(options["plan"])
        self.module, self.name = options["fetcher"].rsplit(".", 1)
        self.pages, self.least, self.paging = int(options.get("pages", "1")), int(options.get("fullpage", "0")), options.get("paging", "number")

    def partitions(self) -> list[InputPartition]:
        return [_Page(token, company, self.pages) for token, company in self.plan]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Pages of one request plan until the feed says that there are no more, or ``pages`` are read.

        The fetcher takes (token, at) and returns (payload, n): the number of items for ``number``, the total for ``offset``, the next cursor or null for ``cursor``.
        """
        import importlib

        fetch = getattr(importlib.import_module(self.module), self.name)
        token, company, pages = partition.value
        at = None if self.paging == "cursor" else 0
        for page in range(pages):
            payload, n = fetch(token, at)
            if payload:
                yield token, company, page, payload
            if self.paging == "cursor":
                at = n
                if not at:
                    return
            elif self.paging == "offset":
                at += self.least
                if at >= n:
                    return
            else:
                at += 1
                if n == 0 or n < self.least:
                    return


def _called(name: str) -> Callable:
    import importlib

    module, function = name.rsplit(".", 1)
    return getattr(importlib.import_module(module), function)


class FeedStreamReader(DataSourceStreamReader):
    """Polls feeds that grow at their end. The offset is the number of pages of each token that are there, so a stream that is started again goes on behind the last page it has committed,
    and a batch that is run again asks for the same pages.

    Options: plan, fetcher, paging (``number`` or ``offset``), fullpage, ``pages`` (most in one partition, so what has piled up is read in parallel) and ``counter`` (module.function: token to
    number of pages). Cursors name no page before the one ahead of them is read, so feeds with cursors are read as batches. A token that can't be counted stops the stream: without its number
    its place would be lost. A token that leaves the plan and comes back is read from its beginning. Spark runs ``availableNow`` over a Python source as one batch, so a run after a failure
    does the failed batch only.
    """

    def __init__(self, options: dict) -> None:
        self.plan = [(token, company) for token, company in json.loads(options["plan"])]
        self.fetcher, self.counter = options["fetcher"], options["counter"]
        self.pages, self.full, self.paging = int(options.get("pages", "10")), int(options.get("fullpage", "1")), options.get("paging", "number")
        if self.paging not in ("number", "offset"):
            raise ValueError("only feeds paged by number or offset can be polled")

    def initialOffset(self) -> dict:
        return {token: 0 for token, _ in self.plan}

    def latestOffset(self) -> dict:
        from concurrent.futures import ThreadPoolExecutor

        tokens = list(dict.fromkeys(token for token, _ in self.plan))
        with ThreadPoolExecutor(8) as pool:
            return dict(zip(tokens, map(int, pool.map(_called(self.counter), tokens)), strict=True))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for token, company in dict(self.plan).items():
            # a feed that has become shorter gives nothing until it is longer again
            first, last = int(start.get(token, 0)), int(end.get(token, 0))
            out += [InputPartition((token, company, at, min(at + self.pages, last))) for at in range(first, last, self.pages)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = _called(self.fetcher)
        token, company, first, last = partition.value
        for page in range(first, last):
            payload, _ = fetch(token, page * self.full if self.paging == "offset" else page)
            if payload:
                yield token, company, page, payload

    def commit(self, end: dict) -> None:
        """Nothing is kept here: the checkpoint has the offset."""


class FeedSource(DataSource):
    """``spark.read.format("feed")`` with options plan (JSON pairs of token and company), fetcher (module.function), pages, fullpage, paging. One partition for each company.
    ``spark.readStream.format("feed")`` polls, see :class:`FeedStreamReader`."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "token string, company string, page int, payload string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)


def aged(urls: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """``urls`` (url, kind) with ``due``: whether ``cache`` (url, fetched_at) has no fresh enough page."""
    ttl = F.create_map(*[F.lit(x) for kv in TTL_HOURS.items() for x in kv])
    latest = cache.groupBy("url").agg(F.max("fetched_at").alias("__at"))
    old = F.col("__at").isNull() | F.coalesce((F.unix_timestamp(as_of) - F.unix_timestamp("__at")) > F.try_element_at(ttl, F.col("kind")) * 3600, F.lit(False))
    return urls.join(latest, "url", "left").withColumn("due", old).drop("__at")


def due(urls: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Rows of ``urls`` (url, kind) without a fresh enough page in ``cache`` (url, fetched_at)."""
    return aged(urls, cache, as_of).where("due").drop("due")


def served(fetched: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """url, body, origin of each fetch (url, body or null): network, or a cached page up to STALE_HOURS old where the fetch failed, else failed."""
    latest = cache.groupBy("url").agg(F.max_by("body", "fetched_at").alias("__body"), F.max("fetched_at").alias("__at"))
    young = (F.unix_timestamp(as_of) - F.unix_timestamp("__at")) <= STALE_HOURS * 3600
    j = fetched.join(latest, "url", "left")
    return j.select("url", F.coalesce("body", F.when(young, F.col("__body"))).alias("body"), F.when(F.col("body").isNotNull(), "network").when(young, "stale").otherwise("failed").alias("origin"))


def evicted(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col(at) >= as_of - F.make_dt_interval(days=F.lit(days)))


def allowance(ledger: DataFrame, as_of: Column, for_detail: bool = False, since: Column | None = None) -> DataFrame:
    """board, left: requests that each board's last hour, this run's cap (less what it has asked for ``since`` its start) and a block of the last COOL_OFF_HOURS leave."""
    hour = F.unix_timestamp("at") > F.unix_timestamp(as_of) - 3600
    asked = F.lit(0) if since is None else F.count_if(F.col("at") >= since)
    used = ledger.groupBy("board").agg(F.count_if(hour).alias("used"), asked.alias("asked"), F.max(F.when(F.col("status").isin(403, 429), F.unix_timestamp("at"))).alias("blocked"))
    free = F.greatest(F.lit(0), F.least(PER_HOUR - F.col("used"), PER_RUN - F.col("asked")) - (0 if for_detail else FOR_DETAIL))
    cold = F.coalesce(F.unix_timestamp(as_of) - F.col("blocked") < COOL_OFF_HOURS * 3600, F.lit(False))
    return used.select("board", F.when(cold, F.lit(0)).otherwise(free).cast("long").alias("left"))


def allowed_by_robots(robots: str, path: str, agent: str = "*") -> bool:
    from urllib.robotparser import RobotFileParser

    rules = RobotFileParser()
    rules.parse(robots.splitlines())
    return rules.can_fetch(agent, path)


def record(pages: DataFrame, folder: str) -> None:
    """Stores fetched pages (url, payload) so that a later run can be replayed from them."""
    pages.select("url", "payload").write.mode("append").parquet(folder)


def replayed(spark, folder: str) -> DataFrame:
    """url, payload of what :func:`record` stored; of a page stored twice either copy."""
    return spark.read.schema("url string, payload string").parquet(folder).dropDuplicates(["url"])


def recorded(spark, folder: str) -> DataFrame:
    """url, payload of pages that were stored before, a file each."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("payload"))
