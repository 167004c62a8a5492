"""Connected components by min-label propagation with pointer jumping, all in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, written


def labels(edges: DataFrame) -> DataFrame:
    """id, label (the smallest id of the component) of every node of ``edges`` (a, b). Nothing is collected; each round is a table.

    A round takes the smallest label among a node's neighbours and then the label of that label, so chains halve.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(state, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        # a large component's label is a hot key of the next join: both of its sides are tables, so that it can be split
        moved = written(state.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")), "labels")
        far = moved.select(F.col("id").alias("__of"), F.col("label").alias("__label"))
        jumped = written(moved.join(far, F.col("label") == F.col("__of"), "left").select("id", F.least("label", F.coalesce("__label", "label")).alias("label"), F.col("old")), "labels")
        still = jumped.where("label <> old").isEmpty()
        forget(state)
        forget(moved)
        state = jumped.drop("old")
        if still:
            forget(both)
            return state
