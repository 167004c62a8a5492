"""A board run as one plan: which pages are due, which requests the budget allows, what is served from where, and the board's status."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import fetch


@F.pandas_udf(T.BinaryType())
def packed(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Page text as it is kept in the cache."""
    for s in bodies:
        yield s.map(lambda x: zlib.compress(x.encode()), na_action="ignore")


@F.pandas_udf(T.StringType())
def unpacked(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What :func:`packed` kept; null where a page can't be read."""

    def one(raw: bytes) -> str | None:
        try:
            return zlib.decompress(raw).decode("utf-8", "replace")
        except zlib.error:
            return None

    for s in bodies:
        yield s.map(one, na_action="ignore")


def requests(urls: DataFrame, cache: DataFrame, ledger: DataFrame, as_of: Column, since: Column | None = None) -> DataFrame:
    """board, url, kind, place, origin of every wanted page (board, url, kind, page, query): ``cache`` where a fresh copy is there, ``network`` for as many of the others as the board's
    allowance leaves, list pages before details and first pages of all queries before second ones, and ``later`` for the rest. Only the first due pages of a board, as many as a run may ask
    for, have a ``place``, so a board of any size is cut down before it is shuffled. ``since`` is the start of a run that has asked for pages already."""
    rows = fetch.aged(urls, cache, as_of).select("board", "url", "kind", "page", "query", "due")
    left = fetch.allowance(ledger, as_of, for_detail=True, since=since).select("board", "left")
    most = min(fetch.PER_HOUR, fetch.PER_RUN)
    order = Window.partitionBy("board").orderBy(F.col("kind") == "detail", "page", "query", "url")
    first = rows.where("due").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("board", "url", "place")
    placed = rows.join(first, ["board", "url"], "left").join(left, "board", "left")
    free = F.coalesce("left", F.lit(most))
    # details may use everything, list pages leave some for details
    room = F.when(F.col("kind") == "detail", free).otherwise(F.greatest(F.lit(0), free - fetch.FOR_DETAIL))
    origin = F.when(~F.col("due"), "cache").when(F.col("place") <= room, "network").otherwise("later")
    return placed.select("board", "url", "kind", "place", origin.alias("origin"))


def status(served: DataFrame, ledger: DataFrame, postings: DataFrame, as_of: Column) -> DataFrame:
    """board, pages by origin, postings, carried, hours that a block still lasts, requests left: one row for each board with any page."""
    pages = served.groupBy("board").agg(*[F.count_if(F.col("origin") == o).alias(o) for o in ("network", "cache", "stale", "failed", "later")])
    found = postings.groupBy("board").agg(F.count_if(~F.col("carried")).alias("postings"), F.count_if("carried").alias("carried"))
    blocked = ledger.where(F.col("status").isin(403, 429)).groupBy("board").agg(F.max("at").alias("__at"))
    still = F.greatest(F.lit(0.0), fetch.COOL_OFF_HOURS - (F.unix_timestamp(as_of) - F.unix_timestamp("__at")) / 3600)
    out = pages.join(found, "board", "left").join(blocked, "board", "left").join(fetch.allowance(ledger, as_of), "board", "left")
    return out.select("board", "network", "cache", "stale", "failed", "later", F.coalesce("postings", F.lit(0)).alias("postings"), F.coalesce("carried", F.lit(0)).alias("carried"), F.round(F.coalesce(still, F.lit(0.0)), 2).alias("blocked_hours"), F.coalesce("left", F.lit(fetch.PER_RUN - fetch.FOR_DETAIL)).cast("long").alias("left"))


def paths_or_old(fresh: DataFrame, old: DataFrame, complete: bool) -> DataFrame:
    """Sorted distinct paths of a site map; where not all of its parts could be read, those of the old copy too."""
    return (fresh if complete else fresh.unionByName(old)).distinct().orderBy("path")


def validated(rows: DataFrame, n: int = 6) -> DataFrame:
    """The first rows of a connector with what is wrong about each: no title, no id, no text, no place, no date."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    wrong = F.array_compact(F.array(F.when(blank(F.col("title")), "title"), F.when(blank(F.col("native_id")), "id"), F.when(blank(F.col("description")), "text"), F.when(F.size("locations") == 0, "place"), F.when(F.coalesce("posted_at", "updated_at").isNull(), "date")))
    return rows.limit(n).select("source", "board_token", "native_id", "title", F.array_join(wrong, ",").alias("wrong"))
