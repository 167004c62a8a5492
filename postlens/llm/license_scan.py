"""License scans by ordered signature rules.

An automaton over the keywords of all rules is the gate: it says which of the
rules can match a text at all, and only their patterns run. Detections are taken by priority, then length, then rule order; one that lies within
the interval of a detection taken before gives way to it (detections that only overlap both stay). What stays names the labels.

Defined cases: null text counts as empty; no words, no places and no labels for it; the score is then 0. Equal rows give
equal rows, null ids too. Of detections of equal priority and length the rule that comes first is taken. Long texts are scanned whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import rules
from .storage import in_arrow

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Bytes that stand in no word become spaces; capitals are lower-cased.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@lru_cache(maxsize=1)
def _compiled():
    import ahocorasick

    made = [(label, priority, re.compile(pattern)) for label, priority, _, pattern in rules()]
    by: dict[str, list[int]] = {}
    for i, (_, _, keywords, _) in enumerate(rules()):
        for keyword in keywords:
            by.setdefault(keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for keyword, numbers in by.items():
        automaton.add_word(keyword, numbers)
    automaton.make_automaton()
    return made, automaton


def detections(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of what stays, over the lower-cased text with white space as single spaces."""
    made, automaton = _compiled()
    numbers: set[int] = set()
    for _, found in automaton.iter(text):
        numbers.update(found)
    hits = [(-made[n][1], m.start() - m.end(), n, m.start(), m.end()) for n in numbers for m in made[n][2].finditer(text)]
    kept: list[tuple[int, int, str, int]] = []
    starts: list[int] = []  # of the outermost kept intervals, none within another: their ends rise with their starts
    ends: list[int] = []
    for priority, _, n, start, end in sorted(hits):
        i = bisect_right(starts, start)
        if i and ends[i - 1] >= end:
            continue
        kept.append((start, end, made[n][0], -priority))
        low, high = bisect_left(starts, start), bisect_right(ends, end)
        starts[low:high], ends[low:high] = [start], [end]
    return sorted(kept)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word number, label) of all places of the base phrases."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in BASE:
        needle, at = f" {phrase} ".encode(), -1
        while (at := joined.find(needle, at + 1)) >= 0:
            found.append((at, label))
    if not found:
        return []
    found.sort()
    out, seen, last = [], 0, 0
    for at, label in found:
        seen += joined.count(b" ", last, at)
        last = at
        out.append((seen, label))
    return out


def scanned(raw: bytes) -> tuple:
    words = raw.translate(_WORDS).split()
    low = b" ".join(raw.lower().split())
    places = base_places(words) if b"license" in low else []  # every phrase has that word
    kept = detections(low.decode())
    base = sorted({label for _, label in places})
    labels = sorted({label for _, _, label, _ in kept} | set(base))
    score = max([p / 100 for _, _, _, p in kept] + [0.5] * bool(base), default=0.0)
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(labels), score


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for batch in batches:
        rows = [scanned(raw) for raw in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], ["doc_id", *names])


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))


def scan(docs: DataFrame) -> DataFrame:
    """The scan of every row of ``docs`` (doc_id, text)."""
    return in_arrow(_raw(docs), _scan, SCHEMA)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, label, priority of each detection, in the lower-cased text with single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *d) for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in detections(b" ".join(raw.lower().split()).decode())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()))], ["doc_id", "start", "end", "label", "priority"])

    return in_arrow(_raw(docs), run, "doc_id long, start long, end long, label string, priority int")
