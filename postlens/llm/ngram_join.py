"""N-gram Jaccard join by vertical partitioning.

Texts become sets of 64-bit hashes of their five-word shingles; texts of equal sets are one class. The join runs over classes:

1. Each class sends the prefix of its set in hash order, about half of it, to fragments by hash; a fragment's task finds the shingles that stand in two or
   more classes. Two sets of n and m shingles and similarity t share f of the first n - ceil(t * n) + f and m - ceil(t * m) + f shingles, so a class
   that shares fewer than any partner's f has no partner. What is left (about a tenth here) is told in a second pass by a Bloom filter of bounded
   size, whose false positives cost work only, and sends its whole set to fragments. A class goes on if three quarters of its shingles are shared.
2. The global order puts rare shingles first: by the binary logarithm of their count, then by hash. Classes that meet in the short prefixes of that order are candidates.
3. The global order is cut into vertical fragments, each a table of (class, fragment, shingles). A candidate pair's overlap is counted in each fragment by
   itself, (pair, fragment, count), and the counts are summed per pair; the sum decides.

:func:`pairs` gives all links between classes. :func:`joined` asks for components only, so not all pairs of a group are made: first each prefix group is a star
around its smallest class, and a class is held against one middle, then against those of other components. Then, with the components of those links, members of one star that lie in different components are held against each other by
parity sketches, and the pairs which these can't rule out are counted, of each class and other component one pair first. No link between different components is missed; what is left out would join classes
that are joined already. A class's copies are never paired with each other.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text of fewer than five words is one shingle; equal rows are of one
class; a null id takes part, though it is nobody's component id; extra columns are ignored; an empty table gives an empty result. Sizes of tasks follow counts taken from the data.
Sets are told by 128 bits; the tables of fragments name a class by 64 of them and a shingle by 40 bits next to its fragment's number, so among N classes about N * N / 2 ** 65 pairs are mistaken for one there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .components import labels
from .quality_rules import let
from .storage import forget, in_arrow, written
from .url_filter import Level, _places

#: Similarity in hundredths, shingles for each fragment's task, shingles that a block gathers, ranges in each of the count classes of the order.
PERCENT, FRAGMENT, BLOCK, RANGES, CLASSES = 75, 500_000, 400_000, 2, 4
#: Words of 64 bits in a sketch; members of a star that one task compares with each other.
SKETCH, MEMBERS = 16, 512
#: Pairs of a class and another component that two blocks give to choose from.
FEW = 3
#: Hundredths of a set that its prefix has beyond what the similarity asks for; bits of the Bloom filter at most, and for each class.
SURPLUS, BLOOM_BITS, BLOOM_EACH = 25, 1 << 27, 12
_LOW = np.uint64((1 << 40) - 1)
_SECOND = np.uint64(0x5851F42D4C957F2D)


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))


def _signed(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed hashes for each set: equal for equal sets only."""
    sums = []
    for salt in (np.uint64(0), _SECOND):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles.mix(values ^ salt), dtype=np.uint64)))
        sums.append(run[bounds[1:]] - run[bounds[:-1]])
    return sums[0], sums[1]


def _ids(c1: np.ndarray, c2: np.ndarray) -> pa.Array:
    """16 bytes for each class."""
    flat = np.empty((len(c1), 2), ">u8")
    flat[:, 0], flat[:, 1] = c1, c2
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(c1), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _sets(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for low, high, texts in shingles.slices(batch.column(column)):
            yield batch.slice(low, high - low), *shingles.shingle_sets(texts)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, values, bounds in _sets(batches):
        c1, c2 = _signed(values, bounds)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds), pa.int64()), _ids(c1, c2), pa.array(c1.view(np.int64))], ["doc_id", "n_shingles", "class", "key"])


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, key (64 bits of the class) of every row."""
    return in_arrow(_raw(docs), _documents, "doc_id long, n_shingles long, class binary, key long")


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpacked(block: bytes, *kinds) -> list[np.ndarray]:
    lengths = np.frombuffer(block, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(lengths.tolist(), kinds, strict=True):
        out.append(np.frombuffer(block, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _five(x: np.ndarray) -> np.ndarray:
    """The low 40 bits as five bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)


def _eight(x: np.ndarray) -> np.ndarray:
    full = np.zeros((len(x) // 5, 8), np.uint8)
    full[:, :5] = x.reshape(-1, 5)
    return full.reshape(-1).view("<u8").astype(np.uint64)


def _cut(slot: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each slot, in the order they come."""
    order = np.argsort(slot, kind="stable")
    slot, columns = slot[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True]))) if len(slot) else np.zeros(0, np.int64)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(slot[low]), [c[low:high] for c in columns]


def needed(n):
    """Least overlap of a set of n with any partner."""
    return -(-PERCENT * n // 100)


def surplus(n):
    """Shingles of the prefix beyond n - needed(n); at least one, never more than needed."""
    return np.minimum(np.maximum(SURPLUS * n // 100, 1), needed(n))


def prefix_of(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted sets: the prefixes, and their bounds."""
    n = np.diff(bounds)
    length = np.where(n > 0, n - needed(n) + surplus(n), 0)
    ends = np.concatenate(([0], np.cumsum(length)))
    return values[np.repeat(bounds[:-1] - ends[:-1], length) + np.arange(ends[-1])], ends


def _fragments(count: int, chosen):
    """(fragment, block): shingles of the classes in a task, each class once a block. ``chosen`` cuts sets (values, bounds, key) down to what is sent (values, bounds)."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        values, sizes, keys = (np.concatenate([x[i] for x in held]) for i in range(3))
        _, first = np.unique(keys, return_index=True)
        use = np.zeros(len(keys), bool)
        use[first] = True
        values, keys = values[np.repeat(use, sizes)], np.repeat(keys[use], sizes[use])
        rows = [(f, _packed(k, _five(t))) for f, (k, t) in _cut((values % np.uint64(count)).astype(np.int32), keys, values // np.uint64(count) & _LOW)]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["fragment", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for _, values, bounds in _sets(batches):
            key = _signed(values, bounds)[0]
            values, bounds = chosen(values, bounds, key)
            held.append((values, np.diff(bounds), key))
            size += len(values)
            if size >= BLOCK:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _common(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one fragment: (shingle, key, number of classes) of the shingles that stand in two classes or more, each class once."""
    parts = [_unpacked(x.as_py(), np.uint64, np.uint8) for x in table.column("block")]
    keys, owner = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    tokens = _eight(np.concatenate([p[1] for p in parts]))
    del parts
    if len(keys) < 1 << 24:
        both = np.unique(tokens << np.uint64(24) | owner.astype(np.uint64))
        tokens, owner = both >> np.uint64(24), (both & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[new], owner[new]
    start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    df = np.diff(np.append(start, len(tokens)))
    each = np.repeat(df, df)
    use = each > 1
    return tokens[use], keys[owner[use]], each[use].astype(np.uint32)


def _tally(count: int):
    """Of one fragment: (key, shared), how many of a class's shingles there stand in other classes too, in blocks by class bucket. A row for each class would be one for each class and fragment."""

    def run(table: pa.Table) -> pa.Table:
        keys, shared = np.unique(_common(table)[1], return_counts=True)
        rows = [(s, _packed(*x)) for s, x in _cut((keys % np.uint64(count)).astype(np.int32), keys, shared.astype(np.uint32))]
        return pa.table({"bucket": pa.array([s for s, _ in rows], pa.int32()), "block": pa.array([b for _, b in rows], pa.binary())})

    return run


def _summed(table: pa.Table) -> pa.Table:
    """key, shared of one class bucket, over all fragments."""
    parts = [_unpacked(x.as_py(), np.uint64, np.uint32) for x in table.column("block")]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    shared = np.zeros(len(keys), np.int64)
    np.add.at(shared, at, np.concatenate([p[1] for p in parts]))
    return pa.table({"key": pa.array(keys.view(np.int64)), "shared": pa.array(shared)})


def _shared(count: int):
    """Of one fragment: the shingles of two or more classes, in blocks by class bucket."""

    def run(table: pa.Table) -> pa.Table:
        tokens, keys, df = _common(table)
        fragment = np.uint64(table.column("fragment")[0].as_py())
        rows = [(s, _packed(*x)) for s, x in _cut((keys % np.uint64(count)).astype(np.int32), keys, tokens * np.uint64(count) + fragment, df)]
        return pa.table({"bucket": pa.array([s for s, _ in rows], pa.int32()), "block": pa.array([b for _, b in rows], pa.binary())})

    return run


def _ordered(table: pa.Table) -> pa.Table:
    """Of one class bucket: each class's shared shingles in global order with the count class of each, and their sketch."""
    parts = [_unpacked(x.as_py(), np.uint64, np.uint64, np.uint32) for x in table.column("block")]
    keys, tokens, df = (np.concatenate([p[i] for p in parts]) for i in range(3))
    del parts
    lot = np.minimum(np.log2(df).astype(np.int64) - 1, CLASSES - 1)
    order = np.lexsort((tokens, lot, keys))
    keys, tokens, lot = keys[order], tokens[order], lot[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    own, ends = keys[at], np.append(at, len(keys)).astype(np.int32)
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
    sketches = np.zeros((len(own), SKETCH), np.uint64)
    hashed = shingles.mix(tokens)
    row = np.repeat(np.arange(len(own)), np.diff(ends))
    np.bitwise_xor.at(sketches, (row, (hashed >> np.uint64(6)).astype(np.int64) % SKETCH), np.uint64(1) << (hashed & np.uint64(63)))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * SKETCH, pa.int32()), pa.array(sketches.reshape(-1).view(np.int64)))
    return pa.table({"key": pa.array(own.view(np.int64)), "m": pa.array(np.diff(ends), pa.int64()), "sketch": flat, "shingles": lists(tokens.astype(np.int64), pa.int64()), "lots": lists(lot, pa.int32())})


def _dealt(docs: DataFrame, count: int, chosen) -> DataFrame:
    parts = max(count, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return in_arrow(_raw(docs), _fragments(count, chosen), "fragment int, block binary").repartition(parts, "fragment").groupBy("fragment")


def fragments_of(total: int) -> int:
    return max(16, -(-total // FRAGMENT))


def _bloom(keys: DataFrame, n: int) -> Level:
    """A Bloom filter of the keys, at most BLOOM_BITS long however many there are: then it lets more through, and the exact test comes later."""
    bits = min(BLOOM_BITS, max(64, BLOOM_EACH * n))
    blank = Level(1, bits, 4, np.empty(0, np.uint64))
    both = keys.select(F.col("key").alias("h1"), F.shiftleft("key", 32).bitwiseOR(F.shiftrightunsigned("key", 32)).alias("h2"))
    rows = in_arrow(both, _places(blank), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((bits + 63) // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Level(1, bits, 4, words)


def tallies(docs: DataFrame, total: int) -> DataFrame:
    """bucket, block: what each fragment of the prefixes tells of the classes of a bucket, whose tallies are no more than two fragments' shingles."""
    return _dealt(docs, fragments_of(total // 2), lambda values, bounds, key: prefix_of(values, bounds)).applyInArrow(_tally(fragments_of(total // 4)), "bucket int, block binary")


def likely_classes(docs: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """key: classes whose prefixes in hash order share enough with other classes to have a partner."""
    parts = max(fragments_of(total // 4), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = tallies(docs, total).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_summed, "key long, shared long")
    # a partner has three quarters of n shingles at least, so its own surplus is at least this
    n = F.ceil(F.col("n") * PERCENT / 100)
    least = F.greatest(F.lit(1), F.floor(n * SURPLUS / 100))
    return classes.join(sums, "key").where(F.col("shared") >= least).select("key").distinct()


def survivors(docs: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """class, n, m (shared shingles), sketch (parity of the shared shingles' hashes in 1024 bits), shingles, lots: what can have a partner. ``table`` is that of :func:`documents`."""
    classes = table.where("n_shingles > 0").select("class", F.col("n_shingles").alias("n"), "key").distinct()
    likely = written(likely_classes(docs, classes, total), "likely")
    stats = likely.join(classes, "key").agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(likely, stats["classes"]))

    def chosen(values: np.ndarray, bounds: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(bounds)
        use = shared.value.passes(key, key << np.uint64(32) | key >> np.uint64(32))
        return values[np.repeat(use, n)], np.concatenate(([0], np.cumsum(np.where(use, n, 0))))

    count = fragments_of(stats["shingles"])
    blocks = _dealt(docs, count, chosen).applyInArrow(_shared(count), "bucket int, block binary")
    parts = max(count, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = blocks.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_ordered, "key long, m long, sketch array<long>, shingles array<long>, lots array<int>")
    return written(ordered.join(classes, "key").where(100 * F.col("m") >= PERCENT * F.col("n")).drop("key"), "survivors")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, class) of the shared part of each prefix in the global order."""
    for batch in batches:
        classes, n, lists = (batch.column(i) for i in range(3))
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        length = np.maximum(sizes - needed(n.to_numpy()) + 1, 0)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(length)))[:-1], length) + np.arange(length.sum())
        yield pa.RecordBatch.from_arrays([lists.flatten().take(pa.array(at)), classes.take(pa.array(np.repeat(np.arange(len(sizes)), length)))], ["shingle", "class"])


def _stars(kept: DataFrame) -> DataFrame:
    """(a, b): each prefix group as a star around its smallest class, whatever the sizes: who isn't like the middle may be like another member."""
    postings = in_arrow(kept.select("class", "n", "shingles"), _postings, "shingle long, class binary")
    hubs = postings.groupBy("shingle").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("of")).where("of > 1").select("shingle", "a")
    return postings.join(hubs, "shingle").where(F.col("class") > F.col("a")).select("a", F.col("class").alias("b")).distinct()


def _may_link(an: Column, bn: Column, most: Column) -> Column:
    """False only if sizes or sketches prove too small an overlap."""
    return (100 * F.least(an, bn) >= PERCENT * F.greatest(an, bn)) & (100 * most >= PERCENT * (an + bn - most))


def _across(everything: bool, best: bool):
    """Of two blocks of a star's members: the pairs that the sketches don't rule out, all of them or those in different components; with ``best`` only the FEW of each class and other component that may be most alike."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, names = table.column("class").to_pylist(), table.column("part").to_pylist()
        n, m, block = (table.column(c).to_numpy() for c in ("n", "m", "block"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
        if everything:
            part, largest = np.arange(len(ids)), -1
        else:
            _, part = np.unique(np.array(names, object).astype("S16"), return_inverse=True)
            largest = np.bincount(part).argmax()
        two = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        found: list[tuple[bytes, bytes, bytes, bytes, float]] = []
        # those of the largest component needn't be told from each other, so each other one is held against all
        for i in np.flatnonzero(part != largest).tolist():
            other = (part != part[i]) & ((part == largest) | (np.arange(len(part)) > i))
            if two:
                other &= block != block[i]
            j = np.flatnonzero(other & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])))
            apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64)
            most = (m[j] + m[i] - apart) // 2
            may = 100 * most >= PERCENT * (n[j] + n[i] - most)
            j, score = j[may], (most / np.maximum(n[j] + n[i] - most, 1))[may]
            if best and len(j):
                order = np.lexsort((-score, part[j]))
                j, score = j[order], score[order]
                first = np.concatenate(([True], part[j][1:] != part[j][:-1]))
                use = np.arange(len(j)) - np.flatnonzero(first)[np.cumsum(first) - 1] < FEW
                j, score = j[use], score[use]
            found += [(min(ids[i], ids[k]), max(ids[i], ids[k]), ids[i], names[k], x) for k, x in zip(j.tolist(), score.tolist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = {"a": pa.binary(), "b": pa.binary(), "of": pa.binary(), "other": pa.binary(), "score": pa.float64()}
        return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), columns, strict=True)})

    return run


def _within_stars(stars: DataFrame, named: DataFrame, everything: bool, best: bool = False) -> DataFrame:
    """Pairs (a, b) of members of one star that may link, with other columns of :func:`_across`; any two classes that meet in a prefix are members of that group's star. ``named`` has class, n, m, sketch, part. A pair may come twice.

    Unless ``everything`` is asked for, stars of one component are dropped, and pairs within a component. A star is cut into blocks of about MEMBERS, and each pair of blocks is a group of its own.
    """
    members = stars.select(F.col("a").alias("hub"), F.col("b").alias("class")).unionByName(stars.select(F.col("a").alias("hub"), F.col("a").alias("class")).distinct())
    rows = written(members.join(named, "class"), "members")
    # both sides of the join by hub are tables, so a hub with many rows can be split there
    sizes = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), (F.min("part") != F.max("part")).alias("mixed")).where(F.lit(everything) | F.col("mixed"))
    blocks = written(sizes.select("hub", F.ceil(F.col("size") / MEMBERS).cast("int").alias("blocks")), "sizes")
    cut = rows.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = cut.withColumn("o", other).withColumns({"low": F.least("block", "o"), "high": F.greatest("block", "o")})
    # dealt anew by the pair of blocks: else all blocks of a hub would stay in the task that its rows met in
    spread = dealt.select("hub", "low", "high", "block", "class", "n", "m", "sketch", "part").repartition("hub", "low", "high")
    return spread.groupBy("hub", "low", "high").applyInArrow(_across(everything, best), "a binary, b binary, of binary, other binary, score double")


def _vertical(kept: DataFrame, top: float) -> DataFrame:
    """class, v, piece: the shared shingles of each class in each vertical fragment of the global order (by count class, then by ranges of the hash)."""
    place = lambda lot, s: lot * RANGES + F.floor(s.cast("double") / F.lit(top / RANGES)).cast("int")
    coded = F.zip_with("lots", "shingles", lambda lot, x: F.struct(place(lot, x).alias("v"), x.alias("s")))
    cut = let(coded, lambda z: F.transform(F.sequence(F.lit(0), F.lit(CLASSES * RANGES - 1)), lambda v: F.transform(F.filter(z, lambda x: x["v"] == v), lambda x: x["s"])))
    return kept.select("class", F.posexplode(cut).alias("v", "piece")).where(F.size("piece") > 0)


def _likely(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """a, b, an, bn, most of the pairs that sizes and sketches don't rule out. ``most`` is what they can share: two parities differ in no more bits than the sets differ in shingles."""
    side = lambda name: kept.select(F.col("class").alias(name), F.col("n").alias(f"{name}n"), F.col("m").alias(f"{name}m"), F.col("sketch").alias(f"{name}s"))
    apart = F.aggregate(F.zip_with("as", "bs", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").withColumn("most", F.floor((F.col("am") + F.col("bm") - apart) / 2))
    return met.where(_may_link(F.col("an"), F.col("bn"), F.col("most"))).select("a", "b", "an", "bn", "most")


def _linked(likely: DataFrame, vertical: DataFrame) -> DataFrame:
    """a, b, an, bn, common of the pairs (a, b, an, bn) whose overlap is enough. It is counted in each vertical fragment by itself and summed by pair."""
    every = F.explode(F.sequence(F.lit(0), F.lit(CLASSES * RANGES - 1))).alias("v")
    met = written(likely.select("a", "b", "an", "bn"), "likely").select("a", "b", "an", "bn", every)
    piece = lambda name: vertical.select(F.col("class").alias(name), "v", F.col("piece").alias(f"{name}p"))
    # a pair is a row for each fragment here, which estimates from its file don't show: never to be broadcast
    partial = met.hint("merge").join(piece("a"), ["a", "v"]).join(piece("b"), ["b", "v"]).select("a", "b", "an", "bn", F.size(F.array_intersect("ap", "bp")).alias("count"))
    counted = partial.groupBy("a", "b", "an", "bn").agg(F.sum("count").alias("common"))
    return counted.where(100 * F.col("common") >= PERCENT * (F.col("an") + F.col("bn") - F.col("common"))).select("a", "b", "an", "bn", "common")


def _star_links(stars: DataFrame, kept: DataFrame, vertical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join what the stars' links join, and the components (id, label) of them.

    A class is in as many stars as its prefix has groups, so first it is held against one middle only, the one that it can share most with; of its other pairs those are counted that lie in different components by then.
    """
    near = written(_likely(stars, kept), "near")
    best = F.max_by(F.struct("a", "an", "bn"), F.struct("most", "a")).alias("x")
    links = written(_linked(near.groupBy("b").agg(best).select("x.a", "b", "x.an", "x.bn"), vertical).select("a", "b"), "links")
    parts = labels(links)
    other = lambda name: parts.select(F.col("id").alias(name), F.col("label").alias(f"{name}_part"))
    apart = near.join(other("a"), "a", "left").join(other("b"), "b", "left").where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b"))
    more = written(_linked(apart, vertical).select("a", "b"), "links")
    forget(near)
    if more.isEmpty():
        return links, parts
    both = written(links.unionByName(more), "links")
    return both, labels(both)


def _prepared(docs: DataFrame, table: DataFrame, total: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes that can have a partner, their vertical fragments, and the stars of their prefixes."""
    kept = survivors(docs, table, total)
    top = kept.agg(F.max(F.array_max("shingles"))).first()[0] or 0
    vertical = written(_vertical(kept, float(top + 1)), "vertical")
    return kept, vertical, written(_stars(kept), "stars")


def class_components(docs: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """class, part: the component of each class that has links, named by its smallest class."""
    kept, vertical, stars = _prepared(docs, table, total)
    links, parts = _star_links(stars, kept, vertical)
    tried = stars
    # a class that links with one of a large component mostly links with many: it is held against one first, and against all that it may link with only if it isn't joined by that
    for best in (True, False):
        named = written(kept.join(parts, kept["class"] == parts["id"], "left").select("class", "n", "m", "sketch", F.coalesce("label", "class").alias("part")), "named")
        open_ = _within_stars(stars, named, False, best).join(tried, ["a", "b"], "left_anti")
        if best:
            open_ = open_.groupBy("of", "other").agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("x")).select("x.a", "x.b")
        fresh = written(open_.select("a", "b").distinct(), "pairs")
        found = written(_linked(_likely(fresh, kept), vertical).select("a", "b"), "links")
        if not found.isEmpty():
            links = written(links.unionByName(found), "links")
            parts = labels(links)
        tried = tried.unionByName(fresh)
        forget(named)
    for done in (kept, vertical, stars):
        forget(done)
    return parts.select(F.col("id").alias("class"), F.col("label").alias("part"))


def pairs(docs: DataFrame) -> DataFrame:
    """a, b, an, bn, common: every link between two classes of different sets, with the sizes of the sets and of what they share; :func:`documents` has each row's class.

    The whole join: a group of k classes that are all alike has k * (k - 1) / 2 links, which are found in blocks. For groups alone use :func:`joined`.
    """
    table = written(documents(docs), "documents")
    kept, vertical, stars = _prepared(docs, table, table.agg(F.sum("n_shingles")).first()[0] or 0)
    return _linked(_likely(_within_stars(stars, kept.select("class", "n", "m", "sketch", F.col("class").alias("part")), True).select("a", "b").distinct(), kept), vertical)


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, component_id of every row; component_id is the smallest id reachable by links."""
    table = written(documents(docs), "documents")
    total = table.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return table.drop("key").withColumn("component_id", F.col("doc_id"))
    parts = class_components(docs, table, total)
    # smallest id by class first, with a partial sum before the shuffle, then by component
    classes = table.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    # a large component is a hot key of the join by part: both of its sides are tables, so that it can be split
    named = written(classes.join(parts, "class", "left").select("class", "least", F.coalesce("part", "class").alias("part")), "named")
    least = written(named.groupBy("part").agg(F.min("least").alias("component")), "least")
    ids = written(named.join(least, "part").select(F.col("class").alias("c"), "component"), "components")
    out = table.join(ids, F.col("class") == F.col("c"), "left")
    return out.select("doc_id", "n_shingles", "class", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates, all columns as they were: of each component the document of smallest id stays, once.

    Rows without shingles all stay; a row without an id stays unless it is linked with one that has an id.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    told = joined(docs.select("doc_id", "text")).where((F.col("n_shingles") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    # what goes is named by id and class; the class is found again from the text, so rows of equal id and other text aren't meant
    gone = written(told.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("__d"), F.col("class").alias("__c")), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), place.alias("__d"))
    at = docs.columns.index("text")

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(at).fill_null("").cast(pa.binary())
            for low, high, some in shingles.slices(texts):
                values, bounds = shingles.shingle_sets(some)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _ids(*_signed(values, bounds)), pa.array(np.diff(bounds), pa.int64())], ["__row", "__d", "__c", "__n"])

    kind = T.StructType([rows.schema["__row"], T.StructField("__d", T.LongType()), T.StructField("__c", T.BinaryType()), T.StructField("__n", T.LongType())])
    left = in_arrow(rows, classed, kind).join(gone, ["__d", "__c"], "left_anti")
    salt = F.when(F.col("__n") == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))
    single = left.withColumn("__salt", salt).dropDuplicates(["__d", "__c", "__salt"])
    return single.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
