"""Byte-level BPE encoding and decoding with overlapping chunks.

A text up to ``CHUNK`` characters is one piece. A longer one is cut into chunks that overlap by ``OVERLAP``;
chunks are pre-tokenised in parallel, each from its own start, and two neighbours are stitched at the first
place of their overlap where both have a pre-token boundary after a character that isn't white space. The pattern looks
only ahead, so from a common boundary on both agree, and cutting there changes no pre-token. Where an overlap has no such
place (one pre-token fills it), the neighbours become one piece. The pieces are then encoded in parallel.
Decoding concatenates the raw bytes of the ids.

Defined cases: null text counts as empty; an empty text has 0 tokens and the digests of the empty string; text
that spells a special token is ordinary text; rows are independent, so equal rows give equal rows, null or repeated ids included.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import in_arrow

CHUNK, OVERLAP = 1 << 15, 1 << 10
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder, bytes of each id, and decimal text of each id, built once a worker from a rank file."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.decimal = np.zeros((size, len(str(size)) + 1), np.uint8)
        for rank in range(size):
            text = f"{rank} ".encode()
            self.decimal[rank, : len(text)] = np.frombuffer(text, np.uint8)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32) if text else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()])

    def spelled(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        flat = self.decimal[ids].ravel()
        return flat[flat != 0].tobytes()[:-1]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    # the encoder's \s is Unicode's White_Space, which differs from this library's \s
    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def boundaries(text: str, low: int, high: int) -> list[int]:
    """Starts of pre-tokens in [low, high) whose token before ends in no white space, pre-tokenising from 0."""
    return [m.start() for m in _pattern().finditer(text) if low <= m.start() < high and m.start() and not text[m.start() - 1].isspace()]


def stitched(chunks: list[tuple[str, list[int], list[int]]]) -> Iterator[str]:
    """Pieces of one text from its chunks in order: own characters, boundaries in the own first and in the next chunk's first OVERLAP (from its start)."""
    held: list[str] = []
    tail: list[int] = []
    for own, head, next_tail in chunks:
        common = sorted(set(tail) & set(head))
        if common:
            yield "".join([*held, own[: common[0]]])
            held = [own[common[0] :]]
        else:
            held.append(own)
        tail = next_tail
    yield "".join(held)


def _lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            rows: tuple[list, list, list] = ([], [], [])
            for text in texts:
                tokens = made.encode(text)
                rows[0].append(len(tokens))
                rows[1].append(hashlib.sha256(made.spelled(tokens)).hexdigest())
                rows[2].append(hashlib.sha256(made.decode(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _pretokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ids, numbers, texts = _lists(batch, "key", "doc_id", "no", "text")
        heads = [boundaries(t, 0, OVERLAP) for t in (x[: 2 * OVERLAP] for x in texts)]
        # the last tokens of what is seen may be cut, so boundaries in the last few characters are no use
        tails = [[b - CHUNK for b in boundaries(t, CHUNK, CHUNK + OVERLAP - 2)] for t in texts]
        own = [t[:CHUNK] for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((keys, pa.int64()), (ids, pa.int64()), (numbers, pa.int32()), (own, pa.string()), (heads, pa.list_(pa.int32())), (tails, pa.list_(pa.int32())))], ["key", "doc_id", "no", "text", "head", "tail"])


def _pieces(table: pa.Table) -> pa.Table:
    table = table.sort_by("no")
    parts = list(stitched(list(zip(*(table.column(n).to_pylist() for n in ("text", "head", "tail")), strict=True))))
    n = len(parts)
    return pa.table({"key": pa.array([table.column("key")[0].as_py()] * n, pa.int64()), "doc_id": pa.array([table.column("doc_id")[0].as_py()] * n, pa.int64()), "no": pa.array(range(n), pa.int32()), "text": pa.array(parts, pa.string())})


def _encoded_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            keys, ids, numbers, texts = _lists(batch, "key", "doc_id", "no", "text")
            tokens = [made.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array([len(t) for t in tokens], pa.int64()), pa.array([made.spelled(t) for t in tokens], pa.binary()), pa.array([made.decode(t) for t in tokens], pa.binary())],
                ["key", "doc_id", "no", "n", "spelled", "bytes"],
            )

    return run


def pieces(docs: DataFrame) -> DataFrame:
    """key, doc_id, no, text: the stitched pieces of every text longer than a chunk. ``key`` tells rows of equal doc_id apart."""
    long = docs.where(F.length("text") > CHUNK).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("key"))
    cut = long.select("key", "doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int"))).alias("no", "_"))
    chunks = cut.select("key", "doc_id", "no", F.substring("text", F.col("no") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("text"))
    seen = in_arrow(chunks, _pretokenised, "key long, doc_id long, no int, text string, head array<int>, tail array<int>")
    return seen.groupBy("key").applyInArrow(_pieces, "key long, doc_id long, no int, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    short = in_arrow(texts.where(F.length("text") <= CHUNK), _digests(path), DIGESTS)
    encoded = in_arrow(pieces(texts).repartition("key", "no"), _encoded_pieces(path), "key long, doc_id long, no int, n long, spelled binary, bytes binary")
    whole = encoded.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("no", "spelled", "bytes"))).alias("p"))
    # one join of all pieces each, as appending piece by piece would copy what is there each time; bytes go as hex, which may be cut anywhere
    spelled = F.array_join(F.transform("p", lambda x: x["spelled"].cast("string")), " ")
    raw = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["bytes"])), ""))
    long = whole.select("doc_id", "n_tokens", F.sha2(spelled.cast("binary"), 256).alias("ids_sha256"), F.sha2(raw, 256).alias("decoded_sha256"))
    return short.unionByName(long)


def ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the token ids of every whole text as an array."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codec(path).encode(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return in_arrow(texts, run, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes: what the ids of :func:`ids` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codec(path).decode(np.asarray(x or [], np.uint32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")
