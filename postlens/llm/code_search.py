"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, and the index holds each code under the value of each of its segments. There are as many segments as make a value about as rare as one code
in the table (8 of 8 bits for small tables, 3 of 22 bits from about half a million codes on). In a round a query looks up, in each segment, the values at
the round's distances from its own (0 to 2 in the first, then one more each time); after distance r, every code within segments * (r + 1) - 1 has been met. A query is closed when its
kth verified distance is within that radius, so ties at the kth place are settled too; only the others go on to the next round, each with the best it has found in all the index so far.
A code met through several segments is verified once: in the segment where it is nearest (the first of these). Values are listed by their masks, or, in rounds with more masks than the
index has values, by the distances of the values that occur; either table has two million rows at most and may be broadcast. No round compares codes that share no looked-up value.

Equal codes are kept once, with only as many of their smallest ids as any answer can hold. A frequent value is a frequent join key between two tables, which
adaptive execution splits. Results are ordered by distance, then id; a query's own id isn't among its answers. Defined cases: a null vector has code 0, null or
NaN components have bit 0, a vector of more than 64 components is refused with an error; a null id is no row of the index and no query; repeated ids count once for each distinct
code; an empty table gives an empty result; a table of fewer rows than k gives all there are; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import forget, written

BITS, FEWEST, MOST = 64, 3, 8


@dataclass(frozen=True)
class Segments:
    """``count`` segments of ``width`` bits, the last of which may be narrower."""

    count: int

    @classmethod
    def of(cls, codes: int) -> Segments:
        return cls(min(MOST, max(FEWEST, round(BITS / math.log2(max(codes, 2))))))

    @property
    def width(self) -> int:
        return -(-BITS // self.count)

    @property
    def rounds(self) -> list[tuple[int, int]]:
        """Least and largest distance of a segment's values in each round: the first three distances have few masks and go together."""
        return [(0, 2), *((r, r) for r in range(3, self.width + 1))]

    def masks(self, low: int, high: int) -> int:
        return self.count * sum(math.comb(self.width, r) for r in range(low, high + 1))

    def value(self, code: Column, s: Column | int) -> Column:
        by = F.lit(s * self.width) if isinstance(s, int) else s * self.width
        return F.call_function("shiftrightunsigned", code, by.cast("int")).bitwiseAND(F.lit((1 << self.width) - 1)).cast("int")

    def each(self, rows: DataFrame, code: str) -> DataFrame:
        """``rows`` once for each segment, with its number ``s`` and value ``v``."""
        more = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(self.count - 1))))
        return more.withColumn("v", self.value(F.col(code), F.col("s")))


def sign_code(vector: Column) -> Column:
    """Bit i is set where component i is positive; a vector of more than 64 components doesn't fit a code and is refused."""
    bits = F.transform(F.coalesce(vector, F.array().cast("array<float>")), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit("a code has 64 bits, this vector has more components")).cast("long")).otherwise(code)


def _probes(open_: DataFrame, values: DataFrame, n_values: int, cut: Segments, low: int, high: int) -> DataFrame:
    """q, s, v: what each open query looks up in a round."""
    own = cut.each(open_.select("q"), "q")
    if cut.masks(low, high) <= n_values:
        # masks by their number of bits; bits that a narrower last segment hasn't are no values of it
        masks = open_.sparkSession.range(1 << cut.width).select(F.bit_count("id").alias("r"), F.col("id").cast("int").alias("mask")).where(F.col("r").between(low, high))
        each = own.withColumn("r", F.explode(F.sequence(F.lit(low), F.lit(high)))).join(F.broadcast(masks), "r")
        last = (F.col("s") < cut.count - 1) | (F.col("mask") < 1 << (BITS - (cut.count - 1) * cut.width))
        return each.where(last).select("q", "s", F.col("v").bitwiseXOR(F.col("mask")).alias("v"))
    there = values.select(F.col("s").alias("at"), F.col("v").alias("value"))
    return own.join(F.broadcast(there), (F.col("s") == F.col("at")) & (F.bit_count(F.col("v").bitwiseXOR(F.col("value"))).between(low, high))).select("q", "s", F.col("value").alias("v"))


def _met(probes: DataFrame, index: DataFrame, cut: Segments) -> DataFrame:
    """q, code, least, distance of the codes that a round meets for the first time, each once."""
    # a few queries make many probes, which estimates from the file of queries don't show: never to be broadcast
    pairs = probes.hint("merge").join(index, ["s", "v"])
    apart = F.col("q").bitwiseXOR(F.col("code"))
    here, first = F.bit_count(cut.value(apart, F.col("s"))), F.lit(True)
    for t in range(cut.count):
        # nearer in another segment, or as near in an earlier one: met there
        d = F.bit_count(cut.value(apart, t))
        first = first & F.when(F.col("s") > t, d > here).otherwise(d >= here)
    return pairs.where(first).select("q", "code", "least", F.bit_count(apart).alias("distance"))


def nearest(codes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q, code, least, distance: the k codes nearest to each of ``asked`` (q), by distance and least id. ``codes`` has code and least."""
    cut = Segments.of(codes.count())
    index = written(cut.each(codes.select("code", "least"), "code"), "index")
    values = written(index.select("s", "v").distinct(), "values")
    n_values = values.count()
    order = Window.partitionBy("q").orderBy("distance", "least", "code")
    open_, found, closed = asked, None, []
    for low, high in cut.rounds:
        met = _met(_probes(open_, values, n_values, cut, low, high), index, cut)
        if found is not None:
            met = met.unionByName(found.join(open_, "q", "left_semi"))
        # the best of a round with a partial limit before the shuffle
        best = written(met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k), "best")
        done = best.where(F.col("distance") <= cut.count * (high + 1) - 1).groupBy("q").agg(F.count(F.lit(1)).alias("within")).where(F.col("within") >= k).select("q") if high < cut.width else open_
        closed.append(best.drop("n").join(done, "q", "left_semi"))
        if high == cut.width:
            break
        open_ = written(open_.join(done, "q", "left_anti"), "open")
        if open_.isEmpty():
            break
        found = best.drop("n")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    out = written(out, "nearest")
    forget(index)
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, id, distance. ``rows`` and ``queries`` have id and code."""
    rows = rows.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    queries = queries.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct()
    # of equal codes the k + 1 smallest ids can be in an answer (one more, as a query leaves itself out)
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    codes = written(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("least")), "codes")
    best = nearest(codes, written(queries.select("q").distinct(), "asked"), k + 1)
    each = best.select("q", "code", "distance").join(codes.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("id"))
    # k + 1 ids a code of the query before they meet the queries of that code
    short = each.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("n") <= k + 1).drop("n")
    pairs = queries.join(short, "q").where(F.col("id") != F.col("query_id"))
    ranked = pairs.groupBy("query_id", "id").agg(F.min("distance").alias("distance")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
