"""Text vectors learnt from the corpus by random indexing, for the fit of postings and profiles.

Every text has an index vector of signs, drawn from a digest of its key. A token's vector is the sum of the index vectors of the texts that hold it, at length 1: tokens that stand in the same texts are near each other. A text's vector is the sum of
its distinct tokens' vectors, each times ln(1 + texts / texts with it), at length 1. Learning is one aggregation with partial sums, so a token in every text is no hot key. The model has every token of ``LEAST`` texts and more;
texts meet it by a join on their tokens (:func:`summed`), so it may be of any size. :func:`loader` broadcasts one of at most ``MOST`` tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import norm, unit
from . import fit, shortlist

DIMENSIONS, LEAST, MOST = 64, 2, 50_000
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def learnt(texts: DataFrame, key: str, text: str, least: int = LEAST, most: int | None = None) -> DataFrame:
    """token, weight, sums (the vector before it has length 1) of the corpus, of all tokens or of the ``most`` that stand in most texts. Null and empty texts count as texts without tokens."""
    digest = F.md5(F.col(key).cast("string"))
    # a text's 64 signs as two numbers of 32 bits, so that what is exploded stays narrow
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    each = texts.select(half(1).alias("a"), half(9).alias("b"), F.explode(tokens(F.col(text))).alias("token"))
    ones = [F.sum(F.shiftright(c, 31 - i).bitwiseAND(F.lit(1).cast("long"))).alias(f"{c}{i}") for c in "ab" for i in range(32)]
    sums = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), *ones).where(F.col("df") >= least)
    total = texts.agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row
    some = (sums if most is None else sums.orderBy(F.col("df").desc(), "token").limit(most)).join(F.broadcast(total))
    return some.select("token", F.ln(1 + F.col("n") / F.col("df")).alias("weight"), F.array(*[2 * F.col(f"{c}{i}") - F.col("df") for c in "ab" for i in range(32)]).alias("sums"))


def loader(model: DataFrame) -> Callable[[], Callable[[str], np.ndarray]]:
    """What a worker loads: a function from text to vector by the broadcast model, of MOST tokens at most."""
    rows = model.limit(MOST + 1).toArrow()
    if rows.num_rows > MOST:
        raise ValueError(f"a model of more than {MOST} tokens isn't broadcast; give it to vectors as a table")
    table = np.array(rows.column("sums").to_pylist(), np.float64).reshape(-1, DIMENSIONS)
    table *= rows.column("weight").to_numpy()[:, None] / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
    shared = model.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(rows.column("token").to_pylist())}, table))

    def load() -> Callable[[str], np.ndarray]:
        places, vectors = shared.value

        def one(text: str) -> np.ndarray:
            at = sorted({places[t] for t in _TOKEN.findall(text.lower()) if t in places})
            out = vectors[at].sum(axis=0) if at else np.zeros(DIMENSIONS)
            return out / max(float(np.linalg.norm(out)), 1e-12)

        return one

    return load


def summed(texts: DataFrame, model: DataFrame) -> DataFrame:
    """hash, vector of ``texts`` (hash, text) by the tokens of ``model`` (that of :func:`learnt`), joined and summed; texts without any of them have zeros."""
    scale = F.col("weight") / F.greatest(norm(F.col("sums")), F.lit(1e-12))
    known = model.select("token", scale.alias("scale"), "sums")
    met = texts.select("hash", F.explode(tokens(F.col("text"))).alias("token")).join(known, "token")
    sums = met.groupBy("hash").agg(*[F.sum(F.get("sums", F.lit(i)) * F.col("scale")).alias(f"v{i}") for i in range(DIMENSIONS)])
    told = sums.select("hash", unit(F.array(*[f"v{i}" for i in range(DIMENSIONS)])).alias("vector"))
    return texts.select("hash").join(told, "hash", "left").select("hash", F.coalesce("vector", F.array_repeat(F.lit(0.0), DIMENSIONS)).alias("vector"))


def vectors(texts: DataFrame, model: Callable | DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """hash, vector of ``texts`` (hash, text), each distinct text once; what ``cache`` (hash, vector) has isn't scored again. ``model`` is a column function or a table of :func:`learnt`."""
    scored = lambda some: summed(some, model) if isinstance(model, DataFrame) else some.select("hash", model(F.col("text")).alias("vector"))
    distinct = texts.dropDuplicates(["hash"])
    if cache is None:
        return scored(distinct)
    fresh = scored(distinct.join(cache, "hash", "left_anti"))
    return fresh.unionByName(cache.join(distinct, "hash", "left_semi").select("hash", "vector"))


def fits(kept: DataFrame, model: Callable | DataFrame, own: Column, other: Column, cap: int = 400, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(profile_id, seq, fit) of each profile's first ``cap`` rows in list order, and the vectors (hash, vector) for the next run's cache.

    ``kept``: profile_id, seq, title, description and what the sentences ``own`` and ``other`` are made of. The cap comes before the model: texts of other rows never reach it.
    """
    few = shortlist.scored_by_model(kept, "profile_id", "seq", cap).where("for_model")
    texts = [F.col("title"), F.concat_ws("\n", "title", "description"), own, other]
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.md5(t).alias("hash"), t.alias("text")) for k, t in enumerate(texts)])
    each = few.select("profile_id", "seq", F.explode(slots).alias("x")).select("profile_id", "seq", "x.*")
    found = vectors(each.select("hash", "text"), model, cache)
    met = each.drop("text").join(found, "hash")
    v = [F.max(F.when(F.col("slot") == k, F.col("vector"))).alias(f"v{k}") for k in range(4)]
    doc = fit.document_vector(F.col("v0"), F.col("v1"))
    return met.groupBy("profile_id", "seq").agg(*v).select("profile_id", "seq", F.round(fit.contrast(doc, F.col("v2"), F.col("v3")), 6).alias("fit")), found


def next_cache(found: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Vectors for the next run: those used now, and the ones that were there before."""
    return found if before is None else before.unionByName(found.join(before, "hash", "left_anti"))

