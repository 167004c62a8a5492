"""Ordered shapes: unions of intervals, carried values, neighbours, rolling counts, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union_length(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Total length and number of islands of each key's intervals, overlaps counted once."""
    before = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).withColumn("__new", F.when(F.max(end).over(before) >= F.col(start), 0).otherwise(1))
    island = F.sum("__new").over(Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0))
    spans = marked.withColumn("__i", island).groupBy(*key, "__i").agg((F.max(end) - F.min(start)).alias("__l"))
    return spans.groupBy(*key).agg(F.sum("__l").alias("length"), F.count(F.lit(1)).alias("islands"))


def carried(rows: DataFrame, key: list[str], order: list[str], value: Column, reset: Column, name: str) -> DataFrame:
    """The last non-null ``value`` up to each row since the last row where ``reset`` holds."""
    w = Window.partitionBy(*key).orderBy(*order)
    sections = rows.withColumn("__s", F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*key, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn(name, F.last(value, ignorenulls=True).over(inner)).drop("__s")


def neighbours(key: list[str], order: list[str], before: int, after: int):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(-before, after)


def rolling_count(rows: DataFrame, key: list[str], at: str, seconds: int, name: str) -> DataFrame:
    """How many rows of the key lie in the ``seconds`` up to and including each row (whole seconds).

    A key's time is cut into buckets of ``seconds``. A row counts in its own bucket and, as one that is only looked back at, in the next; so a few keys with many rows are as many
    tasks as they have buckets.
    """
    second = F.unix_timestamp(at)
    copies = rows.withColumn("__t", second).withColumn("__later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__bucket", F.floor(F.col("__t") / seconds) + F.col("__later"))
    w = Window.partitionBy(*key, "__bucket").orderBy("__t").rangeBetween(-seconds, 0)
    return copies.withColumn(name, F.count(F.lit(1)).over(w)).where("__later = 0").drop("__t", "__later", "__bucket")


def cooled_off(rows: DataFrame, key: list[str], at: str, blocked: Column, hours: int) -> DataFrame:
    """``allowed``: whether no block of the key lies in the ``hours`` before a row."""
    w = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(blocked, F.col(at))).over(w)
    return rows.withColumn("allowed", last.isNull() | (F.col(at) >= last + F.expr(f"INTERVAL {hours} HOURS")))


def half_life(age_years: Column, grace: float = 1.5, half: float = 2.0, floor: float = 0.25) -> Column:
    return F.when(age_years <= grace, F.lit(1.0)).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(0.5), (age_years - grace) / half)))
