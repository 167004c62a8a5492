"""Trie of conversation prefixes, with its nodes in preorder and subtrees as intervals.

A node is a distinct sequence of first turns. Every turn has a hash of its place, role and text; running sums of those name the prefixes (two sums modulo 2**62), so a long conversation is named in many tasks. Rows
of one name are summed up into nodes; a node is called by the smallest conversation that has it, its owner, and its depth.

Preorder: along a path the owner only rises, so a path is told by where its owner changes, (-depth, owner) for each change. Sorted by these, the nodes an owner has come
first and then what branches off them, deepest branch first, so each subtree is an interval. A key has as many entries as its path has owners, and k owners on one path have k (k + 1) / 2 turns between them,
so keys are at most as long as the root of twice the rows. A node enters at (key, its depth) and its subtree ends at (key, -depth) before what branches off
above it. One range sort of both kinds of events and running sums over it give positions; leaves and savings are differences of the sums at a subtree's end and at its start.

Defined cases: rows are in order of turn with null first, then role and text; null roles and texts are empty; rows without conv_id belong to no conversation and are left out; a conversation without turns is a member of the root;
an empty table has no nodes, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import MASK, numbered, running_sums
from .storage import in_arrow, written

KEY = ("depth", "h1", "h2")
WORD = r"[^\x20\x09-\x0D]+"
LOWEST = -(1 << 62)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role, text in order."""
    plain = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return numbered(plain).select("conv_id", F.col("n").alias("depth"), "role", "text")


def hashed(rows: DataFrame) -> DataFrame:
    """conv_id, depth, words, t1, t2 (hash of role and text) of :func:`turns`: texts are needed no more."""
    return rows.select("conv_id", "depth", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), *[F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)])


def shared_openings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and conversations after each has its first h turns from the one at the start of its block of 20, h = crc32(id) % 4: at most 3 rows go to at most 20 conversations."""
    convs = rows.groupBy("conv_id").agg(F.max("depth").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h")
    block = F.col("conv_id") - F.col("conv_id") % 20
    first = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.least("own", F.lit(3)).alias("there"))
    plan = written(convs.select("conv_id", h, block.alias("b")).join(first, F.col("b") == F.col("base"), "left").select("conv_id", "h", "b", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")), "openings")
    opening = rows.where("conv_id % 20 = 0 AND depth <= 3").withColumnRenamed("conv_id", "from")
    taken = plan.join(opening, (F.col("b") == F.col("from")) & (F.col("depth") <= F.col("h"))).select("conv_id", "depth", "words", "t1", "t2")
    moved = plan.where("taken < h").select(F.col("conv_id").alias("c"), (F.col("h") - F.col("taken")).alias("less"))
    kept = rows.where(F.col("depth") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).join(moved, F.col("conv_id") == F.col("c"), "left")
    return kept.select("conv_id", (F.col("depth") - F.coalesce("less", F.lit(0))).alias("depth"), "words", "t1", "t2").unionByName(taken), plan.select("conv_id")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the comma-joined ids of each node; rows come by node and id."""
    node, digest = None, None
    for batch in batches:
        out = []
        for *key, conv in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key != node:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(str(conv).encode())
        yield _ends(out)
    if node:
        yield _ends([(*node, digest.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 3 else pa.int64()) for k in range(4)], [*KEY, "ends_sha256"])


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations given as hashed ``rows`` and all ids ``convs``: owner, depth, parent, members, children, leaves, savings, ends, and the preorder interval [start, stop)."""
    # names of prefixes: sums of hashes that know their place
    placed = rows.select("conv_id", "depth", "words", *[F.xxhash64(F.lit(k), "depth", f"t{k}").bitwiseAND(F.lit(MASK)).alias(f"h{k}") for k in (1, 2)])
    own = placed.select("*", F.col("h1").alias("v1"), F.col("h2").alias("v2"))
    paths = running_sums(own, "conv_id", ["depth"], ["depth"], ["h1", "h2"], "paths")
    # the parent's name is the sum before; kept below the mask, as longs must not overflow
    paths = paths.select("conv_id", "words", *KEY, *[(F.col(f"h{k}") - F.col(f"v{k}")).bitwiseAND(F.lit(MASK)).alias(f"p{k}") for k in (1, 2)])
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner")).where("n_convs > 0").select(*[zero.alias(k) for k in KEY], "n_convs", "owner", zero.alias("words"), zero.alias("p1"), zero.alias("p2"))
    found = paths.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), *[F.max(c).alias(c) for c in ("words", "p1", "p2")]).unionByName(root)
    children = paths.select(*KEY, "p1", "p2").distinct().groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    whole = paths.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("e"))
    ended = convs.join(whole, "conv_id", "left").select(*[F.coalesce(f"e.{k}", zero).alias(k) for k in KEY], "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    ends = in_arrow(ended, _ended, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string")
    table = written(found.join(children, list(KEY), "left").join(ends, list(KEY), "left").na.fill(0, ["n_children"]).na.fill(hashlib.sha256().hexdigest(), ["ends_sha256"]), "nodes")
    # keys of the owners' chains: where on the path the owner changes; the owner of the root opens every path and isn't told
    smallest = table.where("depth = 0").select(F.col("owner").alias("top"))
    changes = paths.select("conv_id", *KEY).join(table.select(*KEY, "owner"), list(KEY)).groupBy("conv_id", "owner").agg(F.min("depth").alias("since"))
    changes = changes.join(F.broadcast(smallest), F.col("owner") == F.col("top"), "left_anti")  # one row is broadcast
    key = F.expr("transform(sort_array(collect_list(struct(since, owner))), x -> struct(-x.since AS a, x.owner AS b))")
    keys = changes.groupBy(F.col("conv_id").alias("c")).agg(key.alias("key"))
    keyed = table.select("owner", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")).join(keys, F.col("owner") == F.col("c"), "left")
    start = F.coalesce("key", F.expr("CAST(array() AS array<struct<a: bigint, b: bigint>>)"))
    step = lambda a, b: F.array(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")))
    event = lambda end, last, *sums: F.struct(F.concat(start, last).alias("key"), F.lit(end).alias("is_end"), *[s.cast("long").alias(n) for s, n in zip(sums, ("count", "leaves", "saving"), strict=True)])
    enters, leaves = event(False, step(F.lit(LOWEST), F.col("depth")), F.lit(1), F.col("leaf"), F.col("saved")), event(True, step(-F.col("depth"), F.lit(LOWEST)), zero, zero, zero)
    events = keyed.select("owner", "depth", "leaf", "saved", F.explode(F.array(enters, leaves)).alias("e")).select("owner", "depth", "leaf", "saved", "e.*", zero.alias("all"))
    summed = running_sums(events, "all", ["key"], ["key"], ["count", "leaves", "saving"], "preorder")
    # what a node's own event adds belongs to its subtree
    at = lambda c, own: (F.max(F.when(F.col("is_end"), F.col(c))) - F.max(F.when(~F.col("is_end"), F.col(c) - own)))
    spans = summed.groupBy("owner", "depth").agg(F.max(F.when(~F.col("is_end"), F.col("count") - 1)).alias("start"), F.max(F.when(F.col("is_end"), F.col("count"))).alias("stop"), at("leaves", F.col("leaf")).alias("n_leaves"), at("saving", F.col("saved")).alias("saved_tokens"))
    parents = table.select((F.col("depth") + 1).alias("pd"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("owner").alias("parent_conv_id"))
    joined = table.join(parents, (F.col("depth") == F.col("pd")) & (F.col("p1") == F.col("x1")) & (F.col("p2") == F.col("x2")), "left").drop("pd", "x1", "x2").join(spans, ["owner", "depth"])
    return joined.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "start", "stop")
