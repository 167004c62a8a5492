"""URL filters by a cascade of Bloom filters.

Level 1 holds the listed keys. Level 2 holds the keys of the corpus that aren't listed but pass level 1, level 3 the listed
keys that pass level 2, and so on, each level built over the complete key universe of the corpus, until no false positive is left.
A key of that universe is listed exactly if the first level that it fails is an even one, so membership is exact and
needs no join with the list. The first level's error rate is the one that makes the second level about as large as the first,
so the whole cascade grows with the list and not with the corpus. All its levels together are broadcast only up to ``MAX_BYTES``; a larger list is
split by key hash into as many shards as that takes, and the pages are told shard by shard, each shard's filters being dropped before the next ones are sent.

A page's keys are its host and every parent domain of it. Defined cases: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; equal rows give equal rows; repeated and null names of the list count once and not at all; extra columns are ignored; an empty list or an empty
corpus gives an empty cascade, in which nothing is listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import in_arrow, written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Listed hosts: each name under each of the endings.
LISTED_NAMES = ("casino-win", "free-bets", "ads-track", "cheap-pills", "spam-farm", "adult-x", "click-bait", "fake-news", "win-prize", "pirate-films")
LISTED_ENDINGS = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{name}.{ending}" for name in LISTED_NAMES for ending in LISTED_ENDINGS)
#: Bytes of all levels of a cascade; the driver holds about three times as much while it gathers them.
MAX_BYTES = 64 << 20
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    hashes: int
    words: np.ndarray

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        a, b = _mixed(h1, self.seed), _mixed(h2, self.seed) | np.uint64(1)
        for j in range(self.hashes):
            at = (a + np.uint64(j) * b) % np.uint64(self.bits)
            ok &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def member(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys are listed: those whose first failed level is an even one, or that pass all of an odd number of levels."""
    undecided = np.ones(len(h1), bool)
    listed = np.zeros(len(h1), bool)
    for number, level in enumerate(levels, 1):
        passed = level.passes(h1, h2)
        if number % 2 == 0:
            listed |= undecided & ~passed
        undecided &= passed
    return listed | undecided if len(levels) % 2 else listed


def _hashed(key: str) -> list[Column]:
    return [F.xxhash64(F.lit(17), F.col(key)).alias("h1"), F.xxhash64(F.lit(71), F.col(key)).alias("h2")]


def _places(level: Level):
    """Bit words of a level: each batch sends the words that its own keys set, or-ed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            a, b = _mixed(h1, level.seed), _mixed(h2, level.seed) | np.uint64(1)
            at = np.unique(np.concatenate([(a + np.uint64(j) * b) % np.uint64(level.bits) for j in range(level.hashes)]))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    return run


def _passing(level: Level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(level.passes(*(batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)))))

    return run


def keyed(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """h1, h2, l (1: listed) of each distinct key of ``universe`` (column key, repeats allowed), told by ``listed`` (column key) in one aggregation with a partial one before the shuffle."""
    both = universe.select("key", F.lit(0).alias("l")).unionByName(listed.select("key", F.lit(1).alias("l"))).where(F.col("key").isNotNull())
    return both.groupBy("key").agg(F.max("l").alias("l"), F.count_if(F.col("l") == 0).alias("seen")).where("seen > 0").select("l", *_hashed("key"))


def _first_rate(n: int, other: int) -> float:
    return min(0.5, max(1e-6, math.sqrt(0.5) * n / max(other, 1)))


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(n * 1.4427 * math.log2(1 / rate)))


def shards_for(n: int, other: int) -> int:
    """Shards that keep a cascade within MAX_BYTES: the first level, and about twice a filter of one bit a key for all others."""
    return max(1, -(-(_bits(n, _first_rate(n, other)) + 4 * _bits(n, 0.5)) // (8 * MAX_BYTES))) if n else 1


def cascade(keys: DataFrame, n: int, other: int) -> list[Level]:
    """Levels for ``keys`` (h1, h2, l), of which n are listed and ``other`` aren't.

    What reaches the driver are the words of the filters, a few bits for each listed key.
    """
    held, tested = (keys.where(F.col("l") == side).select("h1", "h2") for side in (1, 0))
    levels: list[Level] = []
    while n:
        rate = 0.5 if levels else _first_rate(n, other)
        bits = _bits(n, rate)
        blank = Level(len(levels) + 1, bits, max(1, round(math.log2(1 / rate))), np.empty(0, np.uint64))
        rows = in_arrow(held, _places(blank), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros((bits + 63) // 64, np.uint64)
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        levels.append(Level(blank.seed, bits, blank.hashes, words))
        # the false positives of this level go into the next one, which must tell them from what this one holds
        held, tested = written(in_arrow(tested, _passing(levels[-1]), "h1 long, h2 long"), "passing"), held
        n = held.count()
    return levels


def listed_flag(rows: DataFrame, keys: str, shared: Broadcast, flag: str, shard: int = 0, shards: int = 1) -> DataFrame:
    """``rows`` with a boolean column: whether any of the array ``keys`` is listed, by the broadcast levels of one shard."""

    @F.arrow_udf("boolean")
    def told(h1: pa.Array, h2: pa.Array) -> pa.Array:
        flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (h1, h2)]
        found = member(shared.value, *flat)
        if shards > 1:
            found &= flat[0].view(np.int64) % shards == shard
        ends = np.cumsum(h1.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        sums = np.concatenate(([0], np.cumsum(found)))[np.concatenate(([0], ends))]
        return pa.array(np.diff(sums) > 0)

    hashed = lambda seed: F.transform(F.col(keys), lambda k: F.xxhash64(F.lit(seed), k))
    return rows.withColumn(flag, told(hashed(17), hashed(71)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judged(pages: DataFrame, listed: Sequence[str] | DataFrame = LISTED, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url). ``listed`` are names, or a table of them (column key)."""
    spark: SparkSession = pages.sparkSession
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = parsed.select("host").distinct().select(F.explode(keys_of(F.col("host"))).alias("key"))
    names = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(x,) for x in listed], "key string")
    keys = written(keyed(universe, names), "keys")
    size = {r["l"]: r["count"] for r in keys.groupBy("l").count().collect()}
    shards = shards_for(size.get(1, 0), size.get(0, 0))
    flagged = parsed.withColumn("__keys", keys_of(F.col("host"))).withColumn("__listed", F.lit(False))
    for shard in range(shards):
        own = written(keys.where(F.pmod("h1", F.lit(shards)) == shard), "shard") if shards > 1 else keys
        count = {r["l"]: r["count"] for r in own.groupBy("l").count().collect()} if shards > 1 else size
        shared = spark.sparkContext.broadcast(cascade(own, count.get(1, 0), count.get(0, 0)))
        one = listed_flag(flagged, "__keys", shared, "__one", shard, shards)
        flagged = one.withColumn("__listed", F.col("__listed") | F.col("__one")).drop("__one")
        if shards > 1:
            # told before the next shard's filters come, so that no more than one is held
            flagged = written(flagged, "flagged")
            shared.unpersist(blocking=True)
    told = flagged.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__r.verdict"), F.when(F.col("__listed"), F.lit("block")).otherwise(F.lit("allow")))
    return told.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), verdict.alias("verdict"))
