"""Conversation structure repair by signature deduplication.

A conversation's rows become one character each: the role's initial (s, u, a, or x for any other), in upper case if the text is cut off, or d if the row is blank or was seen before
and so has to go. Strings of at most ``CHUNK`` characters are the signatures. Each distinct signature is solved once, by memoised recursion, from each of four states to each of them:
0 nothing is out yet, 1 a system turn is out, 2 a user turn is out, 3 an assistant turn is out. The solutions are joined back. Conversations of more than one chunk are walked twice over their chunks, backwards
for what the rest costs and forwards for the states, in streaming passes; then the edits are replayed on the rows, each with its own (conversation, chunk), so no conversation has to meet in one task for that.
Only what a contract wants as one value (the audit, a digest of the whole text) is gathered a conversation, the digest in a streaming pass over sorted rows.

Edits: K keep (0), R rerole to user or assistant (1), D delete (2), I insert an empty user or assistant turn (5); a cut-off row that isn't deleted costs 5 more. The cheapest edits that give role initials
``(s?(ua)+)?`` are taken, of equally cheap ones the least string of initials. From one state every edit leads to one state, and two ways through a chunk end in the edit of a row, so
neither is a prefix of the other: the least string of a conversation has the least string in each chunk.

Defined cases: rows are in order of turn with null first, then role and text; a null conv_id is a conversation of its own; an empty role has initial x; a text that equals an earlier one of its role is told by 128 bits of
hash; a row that is blank and repeated is blank; conversations without rows have no edits; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import numbered
from .storage import in_arrow, written

#: Rows of a signature at most; longer conversations have several.
CHUNK = 256
SPACE, FAR = " \t\n\x0b\x0c\r", 10**12
#: By state: what a kept initial leads to; the insert and its state; the rerole and its state. Codes: i, j insert and r, q rerole to user and assistant.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INSERT = (("i", 2), ("i", 2), ("j", 3), ("i", 2))
REROLE = (("r", 2), ("r", 2), ("q", 3), ("r", 2))
#: What is inserted at the end of a conversation in each state, and its cost.
TAIL = ("", "ij", "j", "")
INITIALS = str.maketrans("ijrq", "IIRR")
ADJACENT = ("su", "ua", "au")


def solve(signature: str) -> tuple[list[int], list[int], list[str]]:
    """For each pair (from, to) of states: least cost, rank of its initials among those from the same state, codes of the edits."""
    n = len(signature)

    @cache
    def best(i: int, state: int, goal: int) -> tuple[int, str]:
        if i == n:
            return (0, "") if state == goal else (FAR, "")
        options, before, kind = [], "", signature[i]
        for inserts in range(3):
            found = [("D", 2, state)]
            if kind != "d":
                extra = 5 * kind.isupper()
                role, after = REROLE[state]
                found.append((role, 1 + extra, after))
                if kind.lower() in KEEP[state]:
                    found.append(("K", extra, KEEP[state][kind.lower()]))
            for code, cost, after in found:
                rest, codes = best(i + 1, after, goal)
                options.append((5 * inserts + cost + rest, (before + code).translate(INITIALS), before + code + codes))
            code, state = INSERT[state]
            before += code
        cost, _, codes = min(options)
        return min(cost, FAR), codes

    pairs = [[best(0, a, z) for z in range(4)] for a in range(4)]
    ranks = [sorted(range(4), key=lambda z, a=a: pairs[a][z][1].translate(INITIALS)).index(z) for a in range(4) for z in range(4)]
    return [c for row in pairs for c, _ in row], ranks, [s for row in pairs for _, s in row]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve(s) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())))]], ["signature", "costs", "ranks", "codes"])


def initial(role: Column) -> Column:
    head = F.substring(role, 1, 1)
    return F.when(head.isin("s", "u", "a"), head).otherwise("x")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, n, turn, head, fault (blank, duplicate, truncated or null) of numbered rows whose role and text aren't null."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select("conv_id", "n", "turn", "role", F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"), (trimmed == "").alias("empty"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    # only what stands there twice is joined; a hot key is summed up before it is dealt and split by the join
    twice = slim.groupBy("conv_id", "role", "h1", "h2").agg(F.min("n").alias("first"), F.count("*").alias("times")).where("times > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), "first")
    met = slim.join(twice, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")), "left")
    fault = F.when(F.col("empty"), "blank").when(F.col("n") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return met.select("conv_id", "n", "turn", initial(F.col("role")).alias("head"), fault.alias("fault"))


def chunks(found: DataFrame) -> DataFrame:
    """One row for at most CHUNK rows of a conversation: its signature, counts within it, and what stands at its ends."""
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper("head")).otherwise(F.col("head"))
    count = lambda what: F.count(F.when(F.col("fault") == what, 1)).alias(what)
    met = found.groupBy("conv_id", ((F.col("n") - 1) / CHUNK).cast("long").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("n", kind.alias("kind"), "head", "turn"))).alias("r"), count("blank"), count("duplicate"), count("truncated"), F.min("turn").alias("low"), F.max("turn").alias("high")
    )
    pairs = F.expr("filter(transform(r, (x, i) -> concat(r[greatest(i - 1, 0)].head, x.head)), (p, i) -> i > 0 AND p NOT IN ('su', 'ua', 'au'))")
    turns = F.expr("filter(r, (x, i) -> x.turn IS NOT NULL AND (i = 0 OR NOT x.turn <=> r[greatest(i - 1, 0)].turn))")
    ends = [F.expr("r[0].head").alias("head_a"), F.expr("element_at(r, -1).head").alias("head_z"), F.expr("r[0].turn").alias("turn_a"), F.expr("element_at(r, -1).turn").alias("turn_z")]
    return met.select("conv_id", "chunk", F.expr("array_join(transform(r, x -> x.kind), '')").alias("signature"), "blank", "duplicate", "truncated", "low", "high", F.size(pairs).cast("long").alias("illegal"), F.size(turns).cast("long").alias("turns"), *ends)


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the best next state of each state and whether the chunk is the last; chunks come last first."""
    conv, rest = None, []
    for batch in batches:
        nexts, lasts = [], []
        for c, costs, ranks in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "costs", "ranks")), strict=True):
            lasts.append(conv != [c])
            if lasts[-1]:
                conv, rest = [c], [5 * len(t) for t in TAIL]
            ways = [min((costs[4 * a + z] + rest[z], ranks[4 * a + z], z) for z in range(4)) for a in range(4)]
            nexts.append([w[2] for w in ways])
            rest = [min(w[0], FAR) for w in ways]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nexts, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())], [*batch.schema.names, "nexts", "last"])


_WALKED = "conv_id long, chunk long, code string, cost long, illegal long, turns long, blank long, duplicate long, truncated long, low long, high long"


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each chunk; counts get what lies between two chunks."""
    conv, state, head, turn = None, 0, "", None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            illegal, turns = r["illegal"], r["turns"]
            if conv != [r["conv_id"]]:
                conv, state = [r["conv_id"]], 0
            else:
                illegal += head + r["head_a"] not in ADJACENT
                turns -= turn is not None and turn == r["turn_a"]
            after = r["nexts"][state]
            tail = TAIL[after] if r["last"] else ""
            out.append((r["conv_id"], r["chunk"], r["codes"][4 * state + after] + tail, r["costs"][4 * state + after] + 5 * len(tail), illegal, turns, r["blank"], r["duplicate"], r["truncated"], r["low"], r["high"]))
            state, head, turn = after, r["head_z"], r["turn_z"]
        kinds = [pa.string() if k == 2 else pa.int64() for k in range(11)]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], [f.split()[0] for f in _WALKED.split(", ")])


def edits(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, code and counts of each chunk of numbered rows."""
    cut = written(chunks(faults(rows)), "signatures")
    solved = in_arrow(cut.select("signature").distinct(), _solved, "signature string, costs array<long>, ranks array<long>, codes array<string>")
    met = cut.join(solved, "signature").drop("signature").repartition("conv_id")
    back = in_arrow(met.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("chunk").desc()), _backwards, met.schema.simpleString()[7:-1].replace(":", " ", met.schema.simpleString().count(":")) + ", nexts array<long>, last boolean")
    return written(in_arrow(back.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk"), _forwards, _WALKED), "edits")


def repaired(rows: DataFrame, made: DataFrame) -> DataFrame:
    """conv_id, n, k, role, text of the repaired conversations in order of (n, k): the edits of each chunk replayed on its rows."""
    slim = made.select(F.col("conv_id").alias("c"), F.col("chunk").alias("at"), F.regexp_extract_all("code", F.lit("[ij]*[KDrq](?:[ij]*$)?"), F.lit(0)).alias("each"))
    met = rows.withColumn("chunk", ((F.col("n") - 1) / CHUNK).cast("long")).join(slim, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("at")))
    one = F.expr("filter(split(each[int(n - 1 - chunk * %d)], ''), x -> x NOT IN ('', 'D'))" % CHUNK)
    turn = F.expr("transform(codes, x -> named_struct('role', CASE WHEN x = 'K' THEN role WHEN x IN ('i', 'r') THEN 'user' ELSE 'assistant' END, 'text', CASE WHEN x IN ('i', 'j') THEN '' ELSE text END))")
    return met.withColumn("codes", one).select("conv_id", "n", F.posexplode(turn).alias("k", "turn")).select("conv_id", "n", "k", "turn.role", "turn.text")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation's ``role:text`` joined by newlines; rows come in order."""
    conv, digest = None, None
    for batch in batches:
        ids, sums = [], []
        for c, role, text in zip(*(batch.column(k) for k in ("conv_id", "role", "text")), strict=True):
            c = [c.as_py()]
            if conv != c:
                if conv:
                    ids.append(conv[0])
                    sums.append(digest.hexdigest())
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role.as_py()}:{text.as_py()}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])
    if conv:
        yield pa.RecordBatch.from_arrays([pa.array([conv[0]], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


def audited(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: faults, cost, audit and digest of ``rows`` (numbered) as repaired."""
    made = edits(rows)
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0).cast("long"))
    audit = F.expr("array_join(transform(sort_array(collect_list(struct(chunk, code))), x -> translate(x.code, 'ijrq', 'IIRR')), '')")
    by = made.groupBy(F.col("conv_id").alias("c")).agg(gaps.alias("gaps"), *[F.sum(x).alias(x) for x in counts], audit.alias("audit"))
    turns = repaired(rows, made).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "n", "k")
    digests = in_arrow(turns, _digested, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "d")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    met = every.join(by, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    return met.select("conv_id", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", *counts)], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def ready(conversations: DataFrame) -> DataFrame:
    """Numbered rows; a null role or text is one space."""
    return numbered(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, told by checksum: one in twenty each is dropped, emptied, loses its full stops, is repeated, or gets role user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    made = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "fault")
    return made.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
