"""Orders, tops, samples and allocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with a hint to broadcast it if it has ``most`` rows at most; beyond that the join picks its own way."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(rows: DataFrame, fan: int, most: int = 1_000_000) -> DataFrame:
    """``rows`` dealt evenly to as many tasks as leave each ``most`` rows, if every row becomes ``fan`` of them: what a task sorts then doesn't grow with the table. A file of few bytes may hold many rows."""
    return rows.repartition(max(1, -(-rows.count() * max(1, fan) // most)))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """At most ``k`` rows of each group, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def stable_top(rows: DataFrame, score: str, seq: str, n: int) -> DataFrame:
    """Best ``n`` by score, in order of arrival where equal."""
    return rows.orderBy(F.col(score).desc(), F.col(seq)).limit(n)


def systematic_sample(rows: DataFrame, seq: str, n: int) -> DataFrame:
    """Every stride-th row in order of seq, ``n`` at most. ``seq`` counts rows from 0 without gaps, so no global sort is needed."""
    total = rows.agg(F.count(F.lit(1)).alias("__t"))
    stride = F.greatest(F.lit(1), F.floor(F.col("__t") / n))
    return rows.join(F.broadcast(total)).where((F.col(seq) % stride == 0) & (F.floor(F.col(seq) / stride) < n)).drop("__t")


def round_robin(lists: DataFrame, owner: str, place: str, value: str, cap: int) -> DataFrame:
    """Values of ordered lists dealt in turn, each once, ``cap`` in all: by place, then by owner."""
    once = lists.groupBy(value).agg(F.min(F.struct(place, owner)).alias("at"))
    turn = once.select(value, F.col(f"at.{place}").alias(place), F.col(f"at.{owner}").alias(owner)).orderBy(place, owner).limit(cap)
    return turn.withColumn("slot", F.row_number().over(Window.orderBy(place, owner)).cast("long"))


def dhondt(parties: DataFrame, name: str, weight: str, order: str, seats: int, power: int = 3) -> DataFrame:
    """Seats by greatest quotients weight ** power / (seats held + 1): name, seats. As many quotients a party as there are seats are ranked."""
    quotients = parties.select(name, order, weight, F.explode(F.sequence(F.lit(1), F.lit(seats))).alias("s")).withColumn("q", F.pow(F.col(weight).cast("double"), F.lit(power)) / F.col("s"))
    won = quotients.orderBy(F.col("q").desc(), order, "s").limit(seats)
    return won.groupBy(name).agg(F.count(F.lit(1)).alias("seats"))


def query_slots(owners: list[tuple[str, float, bool, list[str]]], seats: int, power: int = 3) -> list[str]:
    """Search queries of one profile's families (name, weight, by level, ordered queries): families named after a level go first with one query each, then
    the greatest quotient takes the next query of its list. A query that is there already moves its list on without taking a seat. A handful of lists, so on the driver.
    """
    taken: list[str] = []
    cursor, held = dict.fromkeys(range(len(owners)), 0), dict.fromkeys(range(len(owners)), 0)

    def next_of(i: int) -> bool:
        """Whether list i still had a query that isn't taken."""
        while cursor[i] < len(owners[i][3]):
            item = owners[i][3][cursor[i]]
            cursor[i] += 1
            if item not in taken:
                taken.append(item)
                held[i] += 1
                return True
        return False

    for i, (_, _, by_level, _) in enumerate(owners):
        if by_level and len(taken) < seats:
            next_of(i)
    open_ = set(range(len(owners)))
    while open_ and len(taken) < seats:
        best = max(open_, key=lambda i: (owners[i][1] ** power / (held[i] + 1), -i))
        if not next_of(best):
            open_.discard(best)
    return taken


def slots(first: Column, owners: Column, seats: int, power: int = 3) -> Column:
    """Search queries of one row's lists, as an array of at most ``seats``: those of ``first`` go before all others, then the greatest quotient weight ** power / (seats held + 1)
    takes the next query of its list, the earlier list where quotients are equal. A query that is there already moves its list on without taking a seat.

    ``owners`` is an array of structs with ``weight`` and ``queries``. The fold's accumulator holds what is taken, and seats and place of each list, so each row is told by itself, without a
    shuffle. Null lists, queries and weights count for nothing.
    """
    kind = "struct<taken:array<string>,held:array<int>,at:array<int>>"
    own = F.coalesce(F.transform(owners, lambda o: F.struct(F.pow(F.coalesce(o["weight"], F.lit(0.0)), F.lit(power)).alias("w"), F.array_compact(F.coalesce(o["queries"], F.array().cast("array<string>"))).alias("q"))), F.array().cast("array<struct<w:double,q:array<string>>>"))
    start = F.slice(F.array_distinct(F.array_compact(F.coalesce(first, F.array().cast("array<string>")))), 1, seats)

    def told(lists: Column) -> Column:
        none = F.transform(lists, lambda _: F.lit(0))

        def turn(s: Column, _: Column) -> Column:
            quotients = F.transform(lists, lambda o, i: F.when(F.get(s["at"], i) < F.size(o["q"]), F.struct((o["w"] / (F.get(s["held"], i) + 1)).alias("v"), (-i).alias("i"))))
            # bound once: a list's number and its next query, then whether it is new
            best = F.filter(F.array(F.array_max(quotients)), lambda b: b.isNotNull())
            chosen = F.transform(best, lambda b: F.struct((-b["i"]).alias("i"), F.get(F.get(lists, -b["i"])["q"], F.get(s["at"], -b["i"])).alias("item")))
            new = F.transform(chosen, lambda c: F.struct(c["i"].alias("i"), c["item"].alias("item"), (~F.array_contains(s["taken"], c["item"])).alias("new")))
            moved = F.transform(new, lambda c: F.struct(
                F.when(c["new"], F.array_append(s["taken"], c["item"])).otherwise(s["taken"]).alias("taken"),
                F.transform(s["held"], lambda h, j: F.when((j == c["i"]) & c["new"], h + 1).otherwise(h)).alias("held"),
                F.transform(s["at"], lambda x, j: F.when(j == c["i"], x + 1).otherwise(x)).alias("at"),
            ).cast(kind))
            return F.when(F.size(s["taken"]) >= seats, s).otherwise(F.coalesce(F.get(moved, F.lit(0)), s))

        turns = F.sequence(F.lit(1), F.aggregate(lists, F.lit(1), lambda n, o: n + F.size(o["q"])))
        return F.aggregate(turns, F.struct(start.alias("taken"), none.alias("held"), none.alias("at")).cast(kind), turn, lambda s: s["taken"])

    return F.get(F.transform(F.array(own), told), F.lit(0))


def distinct_capped(*lists: Column, cap: int = 8) -> Column:
    """Items of the lists one after another, each at its first place, ``cap`` at most."""
    return F.slice(F.array_distinct(F.array_compact(F.concat(*lists))), 1, cap)


def cut_by_weight(rows: DataFrame, owner: str, weight: str, recency: str, share: float = 0.7, fresh: float = 0.75) -> DataFrame:
    """Rows of at least ``share`` of their owner's best weight and of recency ``fresh``; where an owner has none so fresh, all that pass the weight."""
    best = F.max(weight).over(Window.partitionBy(owner))
    near = rows.withColumn("__best", best).where(F.col(weight) >= share * F.col("__best"))
    some = F.max((F.coalesce(F.col(recency), F.lit(1.0)) >= fresh).cast("int")).over(Window.partitionBy(owner))
    return near.withColumn("__some", some).where((F.col("__some") == 0) | (F.coalesce(F.col(recency), F.lit(1.0)) >= fresh)).drop("__best", "__some")


def scored_by_model(rows: DataFrame, group: str, seq: str, cap: int = 400) -> DataFrame:
    """``for_model``: whether a row is among the first ``cap`` of its list, in list order and not by score."""
    return rows.withColumn("for_model", F.row_number().over(Window.partitionBy(group).orderBy(seq)) <= cap)


def detail_candidates(rows: DataFrame, boards: list[str], score: str, seq: str, most: int = 30) -> DataFrame:
    """Board postings without a text, best first, ``most`` in all: what a detail page is fetched for."""
    return rows.where(F.col("source").isin(boards) & (F.trim("description") == "")).orderBy(F.col(score).desc(), seq).limit(most)


def near_best(rows: DataFrame, group: list[str], score: str, share: float) -> DataFrame:
    """Rows whose score is at least ``share`` of their group's best."""
    best = F.max(score).over(Window.partitionBy(*group))
    return rows.withColumn("best", best).where(F.col(score) >= share * F.col("best"))


def union_pool(**sources: DataFrame) -> DataFrame:
    """All sources in one pool, with their name; rows keep the order (source, seq)."""
    out = None
    for name, df in sources.items():
        one = df.withColumn("pool", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
