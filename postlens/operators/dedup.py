"""Posting deduplication: an order-dependent fold in each group of variants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def variant_key(company: Column, title: Column, places: list[str]) -> Column:
    """Compacted company, and the title without up to three trailing places (``… | Germany | Remote``)."""
    import re

    tail = r"(?iU)[\s|,(\[–-]+(?:" + "|".join(sorted(map(re.escape, [*places, "remote", "hybrid", "onsite"]), key=len, reverse=True)) + r")\s*[)\]]?\s*$"
    for _ in range(3):
        title = F.regexp_replace(title, tail, "")
    return F.concat_ws("|", F.regexp_replace(F.lower(company), r"[^\p{L}\p{N}]+", ""), F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}+#]+", " ")))


def fold(rows: DataFrame, key: list[str], seq: str, length: str, fresh: str, places: str) -> DataFrame:
    """Winner of each group: key columns, ``winner`` (its seq), ``rank`` (smallest seq, the group's place) and ``size``.

    In order of seq, a newcomer wins if its text is over 1.2 times as long, loses if it is over 1.2 times shorter, else wins if fresher, and if as fresh,
    if it names more places. The rule isn't transitive, so no sort, arg-max or partial aggregate gives it. Rows are put in order by a sort that may spill and then
    go by once; four numbers of each are looked at and one group's state is held, so a group may have any size. Null numbers count as 0.
    """
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in ((length, "__len"), (fresh, "__fresh"), (places, "__places"))]
    placed = rows.select(*key, F.col(seq).cast("long").alias("__seq"), *numbers).withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__seq", "__len", "__fresh", "__places")))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*key).schema.fields)
    return placed.mapInArrow(_folded(len(key)), f"{shape}, winner long, rank long, size long")


def _folded(n_key: int):
    """Rows that come group by group (a group begins where the last column is 1) to one row for each group."""

    def better(held: tuple, new: tuple) -> tuple:
        _, a, fresh, places = held
        _, b, later, more = new
        if b > 1.2 * a:
            return new
        if a > 1.2 * b:
            return held
        return new if (later, more) > (fresh, places) else held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = key = None
        held, rank, size = None, 0, 0
        for batch in batches:
            names = names or batch.schema.names[:n_key]
            rows = list(zip(*(batch.column(n_key + i).to_pylist() for i in range(4)), strict=True))
            starts = [i for i, n in enumerate(batch.column(n_key + 4).to_pylist()) if n == 1]
            done: list[tuple[int, int, int]] = []
            before = held is not None and bool(rows)
            keys = [key] if before and starts else []
            edges = [*starts, len(rows)]
            for i in range(0, edges[0]):
                held, size = better(held, rows[i]), size + 1
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if held is not None:
                    done.append((held[0], rank, size))
                held, rank, size = rows[low], rows[low][0], high - low
                for i in range(low + 1, high):
                    held = better(held, rows[i])
            if starts:
                own = batch.select(names)
                keys += [own.slice(i, 1) for i in starts[:-1]]
                key = own.slice(starts[-1], 1)
                if done:
                    yield _group_rows(keys, done)
        if held is not None:
            yield _group_rows([key], [(held[0], rank, size)])

    return run


def _group_rows(keys: list[pa.RecordBatch], done: list[tuple[int, int, int]]) -> pa.RecordBatch:
    table = pa.Table.from_batches(keys).combine_chunks()
    columns = [table.column(i).chunk(0) if table.column(i).num_chunks else table.column(i).combine_chunks() for i in range(table.num_columns)]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array([d[i] for d in done], pa.int64()) for i in range(3)]], [*table.schema.names, "winner", "rank", "size"])


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: that of smallest ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")
