"""Running sums over a sorted table, with no group in one task.

Rows are dealt by ranges of (group, order), so a large group spans tasks. Each task adds up within itself in one streaming pass; what
goes over a border is one sum for each task, so the offsets are as many as tasks and are added from a broadcast list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import in_arrow, written

#: Hashes are added up modulo 2**62, so that two sums never overflow a long.
MASK = (1 << 62) - 1


def _opens(column: pa.Array, last) -> tuple[np.ndarray, object]:
    """Whether each row has another group than the row before it, and the batch's last group; ``last`` is a list of the group before, or None."""
    now, tail = column, column[len(column) - 1].as_py()
    before = pa.concat_arrays([pa.array([last[0] if last else None], column.type), now.slice(0, len(now) - 1)])
    same = pc.or_kleene(pc.fill_null(pc.equal(now, before), False), pc.and_(pc.is_null(now), pc.is_null(before)))
    opens = ~same.to_numpy(zero_copy_only=False).astype(bool)
    if not last:
        opens[0] = True
    return opens, [tail]


def running_sums(df: DataFrame, by: str, deal: list[Column | str], order: list[Column | str], sums: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with each long column of ``sums`` replaced by its inclusive running sum within ``by`` (a long column), modulo 2**62.

    ``deal`` has the columns of the ranges, ``order`` those of the sort within a task; (by, deal) has to be a prefix of (by, order) in meaning,
    so that ranges follow the order. Rows that are equal in (by, deal) meet in one task. The result is a written table.
    """
    schema = StructType(list(df.schema.fields)).add("_part", "long").add("_row", "long")
    names, at = df.columns, [df.columns.index(c) for c in sums]
    group = names.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, carry, seen = TaskContext.get().partitionId(), None, np.zeros(len(at), np.int64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            opens, last = _opens(batch.column(group), last)
            starts = np.flatnonzero(opens)
            which = np.cumsum(opens)  # 0: the group goes on from the batch before
            columns = list(batch.columns)
            for k, c in enumerate(at):
                total = np.cumsum(columns[c].to_numpy(zero_copy_only=False).astype(np.int64))
                base = np.concatenate([[-carry[k]], np.where(starts > 0, total[starts - 1], 0)])
                out = (total - base[which]) & MASK
                columns[c], carry[k] = pa.array(out, pa.int64()), out[-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(seen, seen + n), pa.int64())], [*names, "_part", "_row"])
            seen += n

    dealt = df.repartitionByRange(*([parts] if parts else []), F.col(by).asc_nulls_first(), *deal).sortWithinPartitions(F.col(by).asc_nulls_first(), *order)
    rows = written(in_arrow(dealt, run, schema), name)
    # one row for each task
    ends = rows.groupBy("_part").agg(F.min_by(F.struct(by), "_row").alias("a"), F.max_by(F.struct(by), "_row").alias("z"), *[F.max_by(c, "_row").alias(f"s{k}") for k, c in enumerate(sums)]).orderBy("_part").collect()
    offsets, carry, group_before = [], [0] * len(sums), None
    for r in ends:
        go_on = group_before is not None and r.a[0] == group_before[0]
        before = carry if go_on else [0] * len(sums)
        if any(before):
            offsets.append((r._part, r.a[0], *before))
        totals = [r[f"s{k}"] for k in range(len(sums))]
        carry = [(x + y) & MASK for x, y in zip(before, totals, strict=True)] if r.a[0] == r.z[0] else totals
        group_before = [r.z[0]]
    if not offsets:
        return rows.drop("_part", "_row")
    # at most one offset for each task, hence the broadcast
    small = df.sparkSession.createDataFrame(offsets, "_at long, _group long, " + ", ".join(f"_o{k} long" for k in range(len(sums))))
    met = rows.join(F.broadcast(small), (F.col("_part") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_group")), "left")
    added = {c: (F.col(c) + F.coalesce(F.col(f"_o{k}"), F.lit(0))).bitwiseAND(F.lit(MASK)) for k, c in enumerate(sums)}
    return met.select(*[added.get(c, F.col(f"`{c}`")).alias(c) for c in names])


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, the row's place in its conversation from 1: by turn with null first, then by role and text; nothing else tells rows apart.

    A conversation of any length is dealt over tasks; rows that agree in conversation, turn, role and their first 32 characters meet in one.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", F.lit(1).cast("long").alias("n"))
    ties = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    return running_sums(rows, "conv_id", [*ties, F.substring("text", 1, 32).asc_nulls_first()], [*ties, F.col("text").asc_nulls_first()], ["n"], "numbered")
