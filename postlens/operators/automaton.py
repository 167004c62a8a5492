"""Dictionary terms of any length, with endings, found by one walk of an automaton over each text.

It finds what ``functions.text.term_pattern`` says: a term stands alone (names of three letters and less not beside + # & either), its words may have any white space between them, and terms of several words or of seven
letters and more may take an ending of up to six letters. The automaton gives every place of every term; only there boundaries and endings are looked at, so the cost is that of the text and of the hits, whatever the dictionary's size.
Letters are compared as the pattern's Unicode case does it, one by one: dotted and dotless i are both i, and the final sigma is a sigma.

A dictionary that is larger than ``MAX_TERMS`` is walked in shards, each within that bound, so what a task holds doesn't grow with it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms of one automaton.
MAX_TERMS = 100_000
#: Bytes of an Arrow batch of texts.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
ENDING = 6
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Letters whose case isn't that of str.lower, and what they are told as: both dotless and dotted i, long s, sigma at any place, capital sharp s, and the signs of kelvin, ohm and angstrom.
_ODD = {ord(a): b for a, b in zip("\u0130\u0131\u017f\u03a3\u03c2\u1e9e\u212a\u2126\u212b", "iis\u03c3\u03c3\u00dfk\u03c9\u00e5", strict=True)}
_ODD_ONES = re.compile("[" + "".join(map(chr, _ODD)) + "]")


def folded(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    return (text.translate(_ODD) if _ODD_ONES.search(text) else text).lower()


@cache
def is_word(ch: str) -> bool:
    return unicodedata.category(ch) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Pc", "Mn", "Me", "Mc") or ch in "\u200c\u200d"


class Finder:
    """Canonical names of (canonical, term, case sensitive) in a text. Terms without any character but white space are never found."""

    def __init__(self, terms: Iterable[tuple[str, str, bool]]):
        import ahocorasick

        tables: dict[bool, dict[str, dict[tuple[bool, bool], set[str]]]] = {True: {}, False: {}}
        for name, term, exact in terms:
            parts = _SPACE.sub(" ", term).strip(" ")
            if name is None or not parts:
                continue
            # whether an ending may follow, and whether + # & count as letters beside it
            how = (" " in term or len(term) >= 7, len(term) <= 3)
            tables[bool(exact)].setdefault(parts if exact else folded(parts), {}).setdefault(how, set()).add(name)
        self.automata = {}
        for exact, table in tables.items():
            if table:
                made = ahocorasick.Automaton()
                for key, found in table.items():
                    made.add_word(key, (len(key), [(ending, strict, frozenset(names)) for (ending, strict), names in found.items()]))
                made.make_automaton()
                self.automata[exact] = made

    def names(self, text: str | None) -> list[str]:
        found: set[str] = set()
        if not text:
            return []
        even = _SPACE.sub(" ", text)
        n = len(even)
        for exact, automaton in self.automata.items():
            for last, (size, kinds) in automaton.iter(even if exact else folded(even)):
                start, end = last - size + 1, last + 1
                before = even[start - 1] if start else ""
                if before and is_word(before):
                    continue
                for ending, strict, names in kinds:
                    if names <= found or (strict and before and before in "+#&"):
                        continue
                    z = end
                    while ending and z < n and z - end < ENDING and is_word(even[z]):
                        z += 1
                    if z == n or not (is_word(even[z]) or (strict and even[z] in "+#&")):
                        found |= names
        return sorted(found)


def matched(text: Column, terms: list[tuple[str, str, bool]]) -> Column:
    """Sorted canonical names met in a text, for a dictionary that is a parameter of the plan, of MAX_TERMS terms at most; null and empty texts have none."""
    return F.get(_names(terms)(F.coalesce(text, F.lit(""))), F.lit(0))


def with_matched(docs: DataFrame, texts: dict[str, Column], terms: list[tuple[str, str, bool]]) -> DataFrame:
    """``docs`` with a column of :func:`matched` for each of ``texts``. All texts of a row go by one Python worker in one pass, in batches that are bounded by bytes."""
    bounded(docs.sparkSession)
    found = docs.withColumn("__names", _names(terms)(*[F.coalesce(t, F.lit("")) for t in texts.values()]))
    return found.withColumns({name: F.get("__names", F.lit(i)) for i, name in enumerate(texts)}).drop("__names")


def bounded(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES, unless the session has a bound of its own: Spark's is 64 MB for each worker, and as much again as strings."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def _names(terms: list[tuple[str, str, bool]]):
    if len(terms) > MAX_TERMS:
        raise ValueError(f"{len(terms)} terms as a parameter of a plan; give them as a table to token_matches")

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def names(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        finder = Finder(terms)
        for batch in batches:
            # of one column Spark gives the series itself
            columns = (batch,) if isinstance(batch, pd.Series) else batch
            yield pd.Series([[finder.names(t) for t in row] for row in zip(*columns, strict=True)], dtype=object)

    # else a filter on what is found (as of explode) is tried on every row below the joins, and the texts are walked again above them
    return names.asNondeterministic()


def token_matches(docs: DataFrame, key: list[str], text: str, terms: DataFrame) -> DataFrame:
    """key, canonical: each dictionary entry met in each text, once, if no two rows of ``docs`` have one key. ``terms``: canonical, term, case_sensitive.

    Nothing is shuffled for a dictionary of one shard. A text meets each shard of a larger one, in a pass of its own.
    """
    bounded(docs.sparkSession)
    table = terms.select("canonical", "term", F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive")).where("canonical IS NOT NULL AND term IS NOT NULL").distinct()
    shards = max(1, -(-table.count() // MAX_TERMS))
    narrow = docs.select(*key, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("canonical", T.StringType())])
    # rows of a shard by a hash of the name: about even, and a canonical name with all its terms is in one
    dealt = table.withColumn("__shard", F.pmod(F.xxhash64("canonical"), F.lit(shards)))
    out = None
    for shard in range(shards):
        rows = [tuple(r) for r in dealt.where(F.col("__shard") == shard).drop("__shard").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for batch in batches:
                at, names = [], []
                for i, t in enumerate(batch.column(len(key)).to_pylist()):
                    found = finder.names(t)
                    at += [i] * len(found)
                    names += found
                kept = batch.take(pa.array(at, pa.int64())) if at else batch.slice(0, 0)
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(key)], pa.array(names, pa.string())], [*key, "canonical"])

        part = narrow.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
