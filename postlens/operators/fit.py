"""Semantic fit as a contrast of cosines: sentences about the candidate, text to vectors, and the contrast itself."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine, unit, weighted

DIMENSIONS = 64
#: Occupations of the sentence about others, with the families that they belong to.
OTHERS = (("nurses and physicians", ("health",)), ("recruiters", ("people",)), ("sales representatives", ("sales",)), ("accountants", ("finance",)), ("mechanical engineers", ("mechanical",)), ("software developers", ("software", "data", "cloud")))


def document_vector(title: Column, body: Column) -> Column:
    """unit(0.6 * title + 0.4 * title and text)."""
    return unit(weighted(title, body, 0.6, 0.4))


def contrast(doc: Column, own: Column, other: Column) -> Column:
    """Nearness to the own profession less nearness to the others'."""
    return cosine(doc, own) - cosine(doc, other)


def other_sentence(families: Column) -> Column:
    """Sentence of the other occupations: those of no family of the candidate."""
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(f) for f in of]).alias("of")) for name, of in OTHERS])
    left = F.filter(rows, lambda r: ~F.arrays_overlap(r["of"], families))
    return F.concat(F.lit("Work of "), F.array_join(F.transform(left, lambda r: r["name"]), ", "))


def token_vectors(dimensions: int = DIMENSIONS) -> Callable[[str], np.ndarray]:
    """A model without weights, for tests and plans without a corpus (:mod:`.embedding` has one that is learnt): each token's vector is drawn by its checksum; a text's is the mean over its tokens, at length 1."""
    known: dict[str, np.ndarray] = {}

    def one(text: str) -> np.ndarray:
        tokens = text.lower().split()
        for t in tokens:
            if t not in known:
                known[t] = np.random.default_rng(zlib.crc32(t.encode())).standard_normal(dimensions)
        if not tokens:
            return np.zeros(dimensions)
        mean = np.mean([known[t] for t in tokens], axis=0)
        return mean / max(float(np.linalg.norm(mean)), 1e-12)

    return one


def text_to_vector(load: Callable[[], Callable[[str], np.ndarray]] = token_vectors, kind: type = np.float32):
    """A column function from text to vector of floats or doubles (``kind``). ``load`` makes the model once a worker and batch stream, so a real one can be loaded there; null texts have null vectors."""

    @F.pandas_udf(T.ArrayType(T.FloatType() if kind is np.float32 else T.DoubleType()))
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in texts:
            yield batch.map(lambda t: model(t).astype(kind).tolist(), na_action="ignore")

    return vectors
