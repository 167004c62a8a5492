"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is cut into runs of letters and digits and runs of other signs. Features are the lower-cased tokens, pairs of neighbours, and two marks (a word in capitals, a token that equals the one before),
hashed into ``2 ** BITS`` places; two that meet in a place add up. A feature's value is the root of its share of all features, so texts of any length have length 1 and the score is one sparse dot product.
Training is the proximal form of the update, with a rate and a regulariser for each place, over the sample in an order drawn by hash, ``EPOCHS`` times. That is sequential: one task streams over the sample, holding nothing but the
model, and the model between two epochs is a table. The sample is bounded, at most ``SAMPLE`` labelled rows, those of smallest id hash, and so is the model; features of the sample and the scores of all documents are worked out in parallel.

Defined cases: null and empty texts have no features and get the score of the bias alone; texts are scored whole; equal texts get equal scores; without labels nothing is learnt and every score is 0.5; a document labelled
twice counts twice; labels other than 1 count as 0, null ones not at all; a null id is never held out and has no label; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, in_arrow, written
from .toxicity import held_out

#: Bounds: labelled rows of the fit, places of the model (as a power of two).
SAMPLE, BITS = 200_000, 20
EPOCHS = 3
#: Rate, its smoothing, and the two regularisers.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
#: Tokens whose hashes a task keeps at hand.
AT_HAND = 500_000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_UNI, _FIRST, _SECOND, _CAPITALS, _SAME = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


class _Hashes(dict):
    """Twice the checksum of each lower-cased token, and 1 more for capitals."""

    def __missing__(self, token: str) -> int:
        if len(self) >= AT_HAND:
            self.clear()
        found = self[token] = 2 * crc32(token.lower().encode()) + (len(token) > 1 and token.isupper())
        return found


def features(text: str, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places in rising order, and their values; place 0 is the bias."""
    found = np.array([hashes[t] for t in _TOKEN.findall(text)], np.uint64)
    if not len(found):
        return np.zeros(1, np.int64), np.ones(1)
    words = found >> np.uint64(1)
    pairs = words[:-1] * _FIRST ^ words[1:] * _SECOND
    marks = np.concatenate([np.full(int((found & np.uint64(1)).sum()), _CAPITALS), np.full(int((words[1:] == words[:-1]).sum()), _SAME)])
    places, counts = np.unique((np.concatenate([words * _UNI, (pairs ^ pairs >> np.uint64(29)) * _UNI, marks]) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    values = np.sqrt(counts / counts.sum())
    # what is hashed to the bias's place is left out there
    return np.concatenate([[0], places[places > 0]]), np.concatenate([[1.0], values[places > 0]])


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> DataFrame:
    """h, text, y of the labelled rows to learn from: not held out, at most ``limit``."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    few = marked.select(F.xxhash64(F.lit(11), "doc_id").alias("h"), "doc_id", (F.col(label) == 1).cast("int").alias("y")).orderBy("h", "doc_id", "y").limit(limit)
    # ids and labels of the sample are broadcast, as the sample's bound is theirs; texts aren't shuffled
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("h", F.coalesce(F.col("text"), F.lit("")).alias("text"), "y")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        found = [features(t.as_py(), hashes) for t in batch.column(1)]
        places = pa.array([p for p, _ in found], pa.list_(pa.int32()))
        values = pa.array([v for _, v in found], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), places, values, batch.column(2)], ["h", "places", "values", "y"])


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that the sums of gradients and of their squares stand for."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-x))) if x >= 0 else float(np.exp(x) / (1 + np.exp(x)))


def learn(z: np.ndarray, n: np.ndarray, places: np.ndarray, values: np.ndarray, y: int) -> None:
    """One update of the model by one text, in place."""
    zs, ns = z[places], n[places]
    w = weights(zs, ns)
    g = (sigmoid(w @ values) - y) * values
    after = ns + g * g
    z[places] = zs + g - (np.sqrt(after) - np.sqrt(ns)) / ALPHA * w
    n[places] = after


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Weights of all places."""
    spark, size = docs.sparkSession, 1 << BITS
    # one task by intent: the sample is bounded, and the update is sequential
    ordered = written(in_arrow(sample(docs, labels, label), _featured, "h long, places array<int>, values array<float>, y int").repartition(1).sortWithinPartitions("h", "y", "places"), "features")
    state = (np.zeros(size), np.zeros(size))
    for _ in range(EPOCHS):
        shared = spark.sparkContext.broadcast(state)

        def epoch(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            z, n = (x.copy() for x in shared.value)
            for batch in batches:
                for places, values, y in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                    learn(z, n, places.values.to_numpy(), values.values.to_numpy().astype(np.float64), y)
            at = np.flatnonzero(n)
            for k in range(0, len(at), 50_000):
                part = at[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(z[part]), pa.array(n[part])], ["place", "z", "n"])

        # a shuffle-free read of the sample; the sort makes its order that of the hashes, however files are split
        model = written(in_arrow(ordered.coalesce(1).sortWithinPartitions("h", "y", "places"), epoch, "place long, z double, n double"), "model")
        found = model.toArrow()  # at most 2 ** BITS rows
        z, n = np.zeros(size), np.zeros(size)
        at = found.column("place").to_numpy()
        z[at], n[at] = found.column("z").to_numpy(), found.column("n").to_numpy()
        state = (z, n)
        shared.unpersist()
        forget(model)
    forget(ordered)
    return weights(*state).astype(np.float32)


def scored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1, the chance of label 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hashes = shared.value, _Hashes()
        for batch in batches:
            out = []
            for text in batch.column(1):
                places, values = features(text.as_py(), hashes)
                out.append(sigmoid(w[places].astype(np.float64) @ values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), run, "doc_id long, score double")
