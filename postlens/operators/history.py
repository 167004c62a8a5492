"""Run-over-run history as an append-only log of sightings; the state of a posting is a view of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def appended(sightings: DataFrame, path: str) -> None:
    """Adds a run's sightings, a partition for each run; a run that is written again replaces its own partition."""
    sightings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def compared(sightings: DataFrame, key: str, order: list[str], hash_: str, updated: str) -> DataFrame:
    """Ordinal of each sighting, when its key was first seen, and whether its date moved while its content did not."""
    w = Window.partitionBy(key).orderBy(*order)
    before, stamp = F.lag(hash_).over(w), F.lag(updated).over(w)
    same = (before == F.col(hash_)) & stamp.isNotNull() & F.col(updated).isNotNull() & (stamp != F.col(updated))
    return sightings.withColumn("nth", F.row_number().over(w).cast("long")).withColumn("first_seen", F.first(order[0]).over(w)).withColumn("fake_refresh", F.coalesce(same, F.lit(False)))


def snapshot(sightings: DataFrame) -> DataFrame:
    """State of each uid: latest values, first and last seen, count, last description that isn't empty, and whether it is closed.

    Closed: its token was scanned in the latest run, and it wasn't seen there.
    """
    latest = sightings.agg(F.max("run_id").alias("__run"))
    scanned = sightings.join(F.broadcast(latest), F.col("run_id") == F.col("__run")).select(F.col("board_token").alias("__token")).distinct()
    text = F.nullif(F.col("description"), F.lit(""))
    state = sightings.groupBy("uid").agg(
        F.max_by("board_token", "run_id").alias("board_token"), F.max_by("title_key", "run_id").alias("title_key"), F.max_by("content_hash", "run_id").alias("content_hash"),
        F.max_by("description", F.when(text.isNotNull(), F.col("run_id"))).alias("description"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count(F.lit(1)).alias("seen"), F.max("run_id").alias("last_run"),
    )
    joined = state.join(F.broadcast(latest)).join(scanned, F.col("board_token") == F.col("__token"), "left")
    return joined.withColumn("closed", F.col("__token").isNotNull() & (F.col("last_run") < F.col("__run"))).drop("__token", "__run")


def closures(open_rows: DataFrame, seen_now: DataFrame, scanned: DataFrame, uid: str, token: str) -> DataFrame:
    """Open rows of scanned tokens that weren't seen in this run."""
    return open_rows.join(scanned.select(token).distinct(), token, "left_semi").join(seen_now.select(uid), uid, "left_anti")


def reposts(rows: DataFrame, title: str, closed: str) -> DataFrame:
    """``reposts``: how many other closed rows have the same title; one window instead of a join of rows with themselves."""
    n = F.sum(F.col(closed).cast("long")).over(Window.partitionBy(title))
    return rows.withColumn("reposts", n - F.col(closed).cast("long"))


def of_source(rows: DataFrame, source: str, since: Column | None = None) -> DataFrame:
    """History of one source, from ``since`` on if given."""
    own = rows.where(F.col("source") == source)
    return own if since is None else own.where(F.col("last_seen") >= since)


def carried_over(recent: DataFrame, fetched: DataFrame, uid: str, last_seen: str, as_of, hours: int = 72) -> DataFrame:
    """Open rows seen in the last ``hours`` that this run didn't fetch."""
    return recent.where(~F.col("closed") & (F.col(last_seen) >= as_of - F.expr(f"INTERVAL {hours} HOURS"))).join(fetched.select(uid), uid, "left_anti")


def version_diff(old: DataFrame, new: DataFrame, key: str, items: str) -> DataFrame:
    """Items that entered and left each key's list between two versions."""
    a, b = old.select(key, F.col(items).alias("__a")), new.select(key, F.col(items).alias("__b"))
    both = a.join(b, key)
    return both.select(key, F.array_sort(F.array_except("__b", "__a")).alias("entered"), F.array_sort(F.array_except("__a", "__b")).alias("left"))
