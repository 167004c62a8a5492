"""Site-map paths for search queries: scores, one per province, shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import matching, shortlist

#: What a path with a city, and the one asked for, have more.
CITY, ASKED = 0.12, 0.5


def scored(queries: DataFrame, paths: DataFrame, stop: tuple[str, ...], requested: str = "wanted_city", share: float | None = None) -> DataFrame:
    """q, p, score: token overlap, 0.12 more for a path with a city, 0.5 more for the one that is asked for. With ``share`` only pairs that may be within it of their query's best are made.

    ``queries``: q, tokens and the asked city; ``paths``: p, tokens, city (null for nation-wide).
    """
    base = matching.overlap(queries, paths, "q", "p", stop) if share is None else matching.near_overlap(queries, paths, "q", "p", stop, share, CITY + ASKED)
    rows = base.join(queries.select("q", requested), "q").join(paths.select("p", "city"), "p")
    extra = F.when(F.col("city").isNotNull(), CITY).otherwise(0.0) + F.when(F.col("city") == F.col(requested), ASKED).otherwise(0.0)
    return rows.select("q", "p", "city", F.round(F.col("score") + extra, 4).alias("score"))


def chosen(scores: DataFrame, share: float = 0.72, most: int = 4) -> DataFrame:
    """Of each query's paths within ``share`` of the best: the nation-wide one first, then one a province, ``most`` in all."""
    near = shortlist.near_best(scores, ["q"], "score", share)
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("q", "city").orderBy(F.col("score").desc(), "p"))).where("n = 1").drop("n")
    order = Window.partitionBy("q").orderBy(F.col("city").isNotNull(), F.col("score").desc(), "p")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("best")


def interleaved(pages: DataFrame, query: str, page: str, cap: int) -> DataFrame:
    """First pages of all queries, then second ones, up to ``cap`` requests."""
    return pages.orderBy(page, query).limit(cap)


def coverage(positions: DataFrame, patterns: list[str]) -> DataFrame:
    """simple, weighted: share of positions (name, weight) that some title pattern matches. The patterns are constants of the plan."""
    hit = F.greatest(*[F.col("name").rlike(f"(?iU){p}") for p in patterns], F.lit(False))
    rows = positions.withColumn("hit", F.coalesce(hit, F.lit(False)))
    return rows.agg(F.avg(F.col("hit").cast("double")).alias("simple"), (F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("weighted"))
