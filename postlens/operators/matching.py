"""Dictionary matching, and what is derived from matches. Terms are found by :mod:`.automaton`; here are the exact patterns it is held to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import term_pattern
from .automaton import matched, token_matches, with_matched  # noqa: F401

WORD = r"[^\p{L}\p{N}+#&]+"


def words(text: Column) -> Column:
    """Words with + # & as letters, so that C++, C# and R&D stay whole."""
    return F.filter(F.split(text, WORD), lambda x: x != "")


def pattern_matches(docs: DataFrame, key: list[str], text: str, terms: list[tuple[str, str, bool]]) -> DataFrame:
    """key, canonical by the exact look-around patterns, (canonical, term, case sensitive): the yardstick of :func:`token_matches`."""
    by: dict[str, list[Column]] = {}
    for canonical, term, cs in terms:
        by.setdefault(canonical, []).append(F.col(text).rlike(term_pattern(term, cs)))
    found = F.array_compact(F.array(*[F.when(_any(c), F.lit(name)) for name, c in by.items()]))
    return docs.select(*key, F.explode(found).alias("canonical"))


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def idf(matches: DataFrame, name: str, total: Column) -> DataFrame:
    """name, df, idf = ln(1 / max(df / n, 1 / 4n)) within [0.3, 4], to 2 places. ``total`` is the number of texts; df is over all of them."""
    counts = matches.groupBy(name).agg(F.count(F.lit(1)).alias("df"))
    share = F.greatest(F.col("df") / total, 1 / (4 * total))
    return counts.select(name, "df", F.round(F.least(F.lit(4.0), F.greatest(F.lit(0.3), F.ln(1 / share))), 2).alias("idf"))


def skill_score(matches: DataFrame, key: list[str], weights: DataFrame) -> DataFrame:
    """key, n_matched, score = min(sum of weight * idf / 8, 1) * 45; ``weights`` has canonical and w (weight times idf)."""
    joined = matches.join(weights, "canonical")
    return joined.groupBy(*key).agg(F.count(F.lit(1)).alias("n_matched"), F.round(F.least(F.sum("w") / 8, F.lit(1.0)) * 45, 4).alias("score"))


def mention_evidence(lines: DataFrame, key: list[str], weight: str) -> DataFrame:
    """Evidence of a term from its mentions: sum of 0.5 + 0.5 * weight, at most 6, over 6."""
    return lines.groupBy(*key).agg(F.round(F.least(F.sum(0.5 + 0.5 * F.col(weight)), F.lit(6.0)) / 6, 6).alias("evidence"), F.count(F.lit(1)).alias("mentions"))


def strength(evidence: Column) -> Column:
    return F.when(evidence >= 0.45, "strong").otherwise("weak")


def activated(held: DataFrame, triggers: DataFrame, owner: str, item: str, key: str) -> DataFrame:
    """owner, key: active families: one strong trigger, or enough supporting ones. ``triggers``: key, item, strong, least."""
    met = held.select(owner, item).distinct().join(triggers, item)
    return met.groupBy(owner, key).agg(F.count_if("strong").alias("n_strong"), F.count_if(~F.col("strong")).alias("n_support"), F.max("least").alias("least")).where((F.col("n_strong") >= 1) | (F.col("n_support") >= F.col("least"))).drop("least")


def best_role(titles: DataFrame, key: list[str], hits: DataFrame, weight: str, order: str, name: str) -> DataFrame:
    """Of each title's families the one of highest weight; equal weights go to the first in catalogue order."""
    return hits.groupBy(*key).agg(F.max_by(F.struct(name, weight), F.struct(F.col(weight), -F.col(order))).alias("__b")).select(*key, F.col(f"__b.{name}").alias(name), F.col(f"__b.{weight}").alias(weight))


def family_weight(rows: DataFrame, base: str, triggers: str, recency: str, strong: str, over: list[str]) -> Column:
    """base * min(1, (0.55 or 0.40) + 0.45 * triggers / most triggers) * (0.55 + 0.45 * recency), to 2 places."""
    most = F.max(triggers).over(Window.partitionBy(*over))
    part = F.least(F.lit(1.0), F.when(F.col(strong), 0.55).otherwise(0.40) + 0.45 * F.col(triggers) / most)
    return F.round(F.col(base) * part * (0.55 + 0.45 * F.col(recency)), 2)


def _asked(queries: DataFrame, paths: DataFrame, q: str, p: str, stop: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Each query with ``__order``, its tokens outside ``stop`` that paths have, rarest first; and each path once for each such token."""
    own = lambda c: F.filter(c, lambda t: ~t.isin(*stop)) if stop else c
    right = paths.select(p, F.col("tokens").alias("__pt"), F.explode(own(F.col("tokens"))).alias("t"))
    counts = right.groupBy("t").agg(F.count(F.lit(1)).alias("__n"))
    asked = queries.select(q, F.col("tokens").alias("__qt"), F.explode(own(F.col("tokens"))).alias("t")).join(counts, "t")
    ranked = asked.groupBy(q, "__qt").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "t"))), lambda x: x["t"]).alias("__order"))
    return ranked, right


def _pair_score(q: str, p: str) -> list[Column]:
    common = F.size(F.array_intersect("__qt", "__pt"))
    return [F.col(q), F.col(p), common.cast("long").alias("common"), F.round(common / F.size("__qt") - 0.04 * (F.size("__pt") - common), 4).alias("score")]


def overlap(queries: DataFrame, paths: DataFrame, q: str, p: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """q, p, common, score: pairs that share a token outside ``stop``: share of the query's tokens met, less 0.04 for each other token of the path.

    ``queries`` and ``paths`` have a token array ``tokens``. Pairs meet by an equi-join on the tokens outside ``stop`` only, each once, by the one that the fewest paths have;
    so a frequent token joins only pairs that share nothing rarer. The rest is worked out from the arrays of the pair.
    """
    ranked, right = _asked(queries, paths, q, p, stop)
    met = ranked.select(q, "__qt", "__order", F.explode("__order").alias("t")).join(right, "t")
    first = F.get(F.filter("__order", lambda t: F.array_contains(F.col("__pt"), t)), F.lit(0)) == F.col("t")
    return met.where(first).select(*_pair_score(q, p))


def near_candidates(queries: DataFrame, paths: DataFrame, q: str, p: str, stop: tuple[str, ...], share: float, extra: float = 0.0) -> DataFrame:
    """Pairs that :func:`overlap` must score for the rows within ``share`` of each query's best; others are never made. ``extra`` is the most that is added to a score later.

    A query's paths with its rarest token give a score that the best one reaches. From it follows how many tokens a near one has in common with the query, so it holds one of the query's
    n - common + 1 rarest ones: only those are joined, and no others however many paths have them. The path's length bounds its score before the arrays are compared.
    """
    ranked, right = _asked(queries, paths, q, p, stop)
    rare = ranked.withColumn("t", F.get("__order", F.lit(0))).join(right, "t").select(*_pair_score(q, p))
    bound = rare.groupBy(q).agg(F.max("score").alias("__low"))
    # half a unit of the fourth place and what a sum of doubles may be off
    need = F.least(F.col("__low"), share * F.col("__low")) - extra - 0.0002
    known = ranked.join(bound, q).withColumn("__need", need)
    stopped = F.size(F.array_intersect("__qt", F.array(*[F.lit(t) for t in stop]).cast("array<string>"))) if stop else F.lit(0)
    least = F.greatest(F.lit(1), F.ceil(F.col("__need") * F.size("__qt")).cast("int") - stopped)
    prefix = F.slice("__order", F.lit(1), F.greatest(F.lit(0), F.size("__order") - least + 1))
    met = known.withColumn("__prefix", prefix).select(q, "__qt", "__prefix", "__need", F.explode("__prefix").alias("t")).join(right, "t")
    short = F.least(F.size("__qt"), F.size("__pt"))
    able = short / F.size("__qt") - 0.04 * (F.size("__pt") - short) >= F.col("__need")
    first = F.get(F.filter("__prefix", lambda t: F.array_contains(F.col("__pt"), t)), F.lit(0)) == F.col("t")
    return met.where(able & first)


def near_overlap(queries: DataFrame, paths: DataFrame, q: str, p: str, stop: tuple[str, ...], share: float, extra: float = 0.0) -> DataFrame:
    """:func:`overlap` without most pairs that can't be within ``share`` of their query's best, whatever up to ``extra`` is added to them."""
    return near_candidates(queries, paths, q, p, stop, share, extra).select(*_pair_score(q, p))


def prefix_sectors(paths: DataFrame, path: str, least: int = 3) -> DataFrame:
    """path, n: paths that at least ``least`` others extend by ``+``-separated words; all proper prefixes are joined by equality."""
    parts = F.split(path, r"\+")
    prefixes = paths.where(F.contains(F.col(path), F.lit("+"))).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "+"))).alias(path))
    counts = prefixes.groupBy(path).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return paths.select(path).distinct().join(counts, path)
