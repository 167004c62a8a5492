"""Toxicity by maximum-scoring segments.

Token weights are log-odds: the share of toxic texts among those with a token, smoothed by a Dirichlet prior of ``PRIOR`` texts in the
shares of all labelled texts, against that share. Both signs count; a token that a likelihood-ratio test can't tell from the margins has weight 0, and
every token costs ``DRIFT``, so that a text without evidence drifts down. Prior and bar are numbers of texts and of standard deviations: they don't grow with the
sample, so rare words of languages with few labels count as soon as they can be told. A linear scan over a text's weights finds all maximal
scoring segments (the disjoint ones that no extension or merger improves).

How high the best segment of a text without toxicity goes is an extreme value. Its Gumbel law, with a location that rises with the logarithm of the length, is fitted
to the other labelled texts, each scanned with weights learnt without its own fold. A passage is significant where that law leaves it a p-value under 0.02.
The score of a text joins the p-values of its segments (the best one, and Fisher-like the further significant ones) and turns them to (0, 1) by the share of toxic texts at such evidence in
the same folds: rising steps with straight lines between them, which labels that are wrong at either end don't bend as they would a logistic curve.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled rows, those of smallest id hash, so the fit is the same at every run; it keeps at most ``TOKENS`` tokens, those of
strongest evidence. Only words of the text are inputs. Defined cases: null and empty texts have no segment and get the score of no evidence; texts are scanned whole; equal texts get
equal scores, repeated rows too; without toxic or without other labelled texts nothing is learnt and every score is that of no evidence; a document labelled twice counts twice, of
segments that tie the first is the best one; extra columns are ignored; a null id is never held out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import in_arrow, written

#: Bounds on labelled rows of the fit and on tokens kept.
SAMPLE, TOKENS = 200_000, 200_000
#: Standard deviations (signed root of the likelihood ratio) that a token must pass, texts that the prior stands for, cost of each token, folds of the calibration.
Z, PRIOR, DRIFT, FOLDS = 2.5, 1.0, 0.05, 4
#: -log10 of the p-value under which a passage is significant: one clean text in fifty has one by chance.
SIGNIFICANT = 1.7
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def maximal_segments(scores: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time; ``scores`` has (place, weight) of the places that have one, and every place costs DRIFT.

    Each held segment keeps the number of the nearest one before it whose sum before is smaller, so no segment is passed twice in the search for it.
    """
    starts: list[int] = []
    ends: list[int] = []
    befores: list[float] = []
    afters: list[float] = []
    links: list[int] = []
    total, last = 0.0, -1
    for place, weight in scores:
        total -= DRIFT * (place - last - 1)
        last = place
        gain = weight - DRIFT
        if gain <= 0:
            total += gain
            continue
        start, before = place, total
        total += gain
        j = len(starts) - 1
        while True:
            while j >= 0 and befores[j] >= before:
                j = links[j]
            if j < 0 or afters[j] >= total:
                break
            start, before = starts[j], befores[j]
            j, cut = links[j], j
            del starts[cut:], ends[cut:], befores[cut:], afters[cut:], links[cut:]
        starts.append(start)
        ends.append(place + 1)
        befores.append(before)
        afters.append(total)
        links.append(j)
    return [(a, b, after - before) for a, b, before, after in zip(starts, ends, befores, afters, strict=True)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    #: Gumbel law of the best segment: location at one word, its rise with ln(words), scale.
    location: float = 0.0
    rise: float = 0.0
    scale: float = 1.0
    #: (ln(1 + evidence), share of toxic texts) in rising order.
    steps: tuple[tuple[float, float], ...] = ((0.0, 0.02),)

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        weights = self.weights
        return maximal_segments([(i, weights[w]) for i, w in enumerate(words) if w in weights])

    def surprise(self, score: float, n: int) -> float:
        """-log10 of the chance that a clean text of n words has a best segment as high; 30 at most."""
        z = (score - self.location - self.rise * math.log(max(n, 1))) / self.scale
        p = -math.expm1(-math.exp(-z)) if z > -6 else 1.0
        return -math.log10(max(p, 1e-30))

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Surprise of the best segment and of the further significant ones."""
        values = sorted((self.surprise(s, n) for _, _, s in segments), reverse=True)
        return sum((v for v in values[1:] if v > SIGNIFICANT), values[0]) if values else self.surprise(0.0, n)

    def score(self, evidence: float) -> float:
        """Between two steps by a straight line; below the first and above the last on towards 0 and 1, so that more evidence always scores higher."""
        x, steps = math.log1p(evidence), self.steps
        i = bisect_right(steps, (x, 2.0))
        if i == 0:
            return steps[0][1] * (1 + x / steps[0][0]) / 2
        if i == len(steps):
            return 1 - (1 - steps[-1][1]) * (1 + steps[-1][0]) / (1 + x)
        (low, a), (high, b) = steps[i - 1], steps[i]
        return a + (b - a) * (x - low) / (high - low)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """fold, text, toxic of the labelled rows to learn from: not held out, at most ``limit``."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", "toxic")
    few = marked.select(F.xxhash64(F.lit(5), "doc_id").alias("h"), "doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy("h", "doc_id").limit(limit)
    # ids and labels of the sample are broadcast, as the sample's bound is theirs; texts aren't shuffled
    fold = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(fold, F.coalesce(F.col("text"), F.lit("")).alias("text"), "toxic")


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    for x in batch.column(column):
        yield x.as_py()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, counts (texts with it by fold, the others first, then the toxic ones): sums over a batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for fold, text, toxic in zip(batch.column(0).to_pylist(), _texts(batch, 1), batch.column(2).to_pylist(), strict=True):
            for w in set(words_of(text)):
                counts.setdefault(w, [0] * (2 * FOLDS))[fold + FOLDS * (toxic == 1)] += 1
        keys = list(counts)
        columns = [pa.array([counts[k][i] for k in keys], pa.int64()) for i in range(2 * FOLDS)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *columns], ["token", *_COUNTS])


_COUNTS = [f"{side}{i}" for side in "yx" for i in range(FOLDS)]


def _weight(x: Column, y: Column, t: int, o: int) -> tuple[Column, Column]:
    """Weight and likelihood ratio of a token in x of t toxic texts and y of o others."""
    share, n = t / (t + o), x + y
    # the four cells, each count against what the margins alone lead one to expect; a cell of 0 adds nothing
    cells = ((x, n * share), (y, n * (1 - share)), (t - x, (t + o - n) * share), (o - y, (t + o - n) * (1 - share)))
    g = 2 * sum((F.when((seen > 0) & (due > 0), seen * F.ln(seen / due)).otherwise(0.0) for seen, due in cells), F.lit(0.0))
    p = (x + PRIOR * share) / (n + PRIOR)
    return F.when(g > Z * Z, F.ln(p / (1 - p)) - math.log(share / (1 - share))).otherwise(0.0), g


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = written(sample(docs, labels), "sample")
    sizes = [[0] * FOLDS, [0] * FOLDS]
    for r in rows.groupBy("fold", (F.col("toxic") == 1).alias("toxic")).count().collect():
        sizes[bool(r["toxic"])][r["fold"]] += r["count"]
    o, t = map(sum, sizes)
    # without some of both in what each fold learns from, nothing can be told
    if any(not t - sizes[1][k] or not o - sizes[0][k] for k in range(FOLDS)):
        return Model()
    counts = in_arrow(rows, _counted, "token string, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("token").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    x, y = (sum((F.col(f"{side}{k}") for k in range(1, FOLDS)), F.col(f"{side}0")) for side in "xy")
    made = {"w": _weight(x, y, t, o)}
    made |= {f"w{k}": _weight(x - F.col(f"x{k}"), y - F.col(f"y{k}"), t - sizes[1][k], o - sizes[0][k]) for k in range(FOLDS)}
    told = counts.where(x + y > 1).select("token", *[w.alias(name) for name, (w, _) in made.items()], made["w"][1].alias("g"))
    kept = told.where(" OR ".join(f"{name} <> 0" for name in made)).orderBy(F.col("g").desc(), "token").limit(TOKENS).toArrow()
    tokens = kept.column("token").to_pylist()
    tables = {name: {w: v for w, v in zip(tokens, kept.column(name).to_pylist(), strict=True) if v} for name in made}
    shared = docs.sparkSession.sparkContext.broadcast([Model(tables[f"w{k}"]) for k in range(FOLDS)])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of all segments of each text by the weights of the other folds, best first."""
        for batch in batches:
            sums, sizes = [], []
            for fold, text in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                words = words_of(text)
                sums.append(sorted((s for _, _, s in shared.value[fold].segments(words)), reverse=True)[:64])
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), batch.column(2)], ["segments", "n", "toxic"])

    seen = in_arrow(rows, scanned, "segments array<double>, n long, toxic int").toArrow().to_pylist()
    clean = [r for r in seen if r["toxic"] != 1]
    location, rise, scale = gumbel([max(r["segments"], default=0.0) for r in clean], [r["n"] for r in clean])
    second = Model(tables["w"], location, rise, scale)
    xs = [math.log1p(second.evidence([(0, 0, s) for s in r["segments"]], r["n"])) for r in seen]
    return Model(tables["w"], location, rise, scale, isotonic(xs, [int(r["toxic"] == 1) for r in seen]))


def gumbel(best: list[float], n: list[int]) -> tuple[float, float, float]:
    """Location at one word, rise with ln(n), scale: the rise by least squares, the rest by the median and the ninth tenth of what is left, which a few mislabelled texts don't move."""
    logs = [math.log(max(x, 1)) for x in n]
    mean_x, mean_y = sum(logs) / len(logs), sum(best) / len(best)
    spread = sum((x - mean_x) ** 2 for x in logs)
    rise = max(sum((x - mean_x) * (y - mean_y) for x, y in zip(logs, best, strict=True)) / spread, 0.0) if spread else 0.0
    left = sorted(y - rise * x for x, y in zip(logs, best, strict=True))
    half, high = (left[int(q * (len(left) - 1))] for q in (0.5, 0.9))
    quantile = lambda q: -math.log(-math.log(q))
    scale = max((high - half) / (quantile(0.9) - quantile(0.5)), 0.3)
    return half - scale * quantile(0.5), rise, scale


def isotonic(x: list[float], y: list[int]) -> tuple[tuple[float, float], ...]:
    """Steps (mean of x, share of y): runs of a 200th of the values (3 to 10), neighbours joined until the shares rise; each share is drawn to the overall one by one value."""
    share, least = sum(y) / len(y), max(3, min(10, len(y) // 200))
    blocks: list[list[float]] = []  # n, sum of x, sum of y
    ordered = sorted(zip(x, y, strict=True))
    for i in range(0, len(ordered), least):
        run = ordered[i : i + least]
        blocks.append([len(run), sum(a for a, _ in run), sum(b for _, b in run)])
        while len(blocks) > 1 and _share(blocks[-2], share) >= _share(blocks[-1], share):
            n, sx, sy = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + sx, blocks[-1][2] + sy]
    steps = [(sx / n, _share([n, sx, sy], share)) for n, sx, sy in blocks]
    # runs of equal x may meet in one place: the last one holds there
    return tuple(step for step, after in zip(steps, [*steps[1:], (math.inf, 1.0)], strict=True) if step[0] < after[0])


def _share(block: list[float], overall: float) -> float:
    return (block[2] + overall) / (block[0] + 1)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_passages (significant segments), best_start, best_end (words) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            out = []
            for text in _texts(batch, 1):
                words = words_of(text)
                segments = m.segments(words)
                top = max(segments, key=lambda s: s[2], default=None)
                strong = sum(m.surprise(s, len(words)) > SIGNIFICANT for _, _, s in segments)
                out.append((m.score(m.evidence(segments, len(words))), strong, top[0] if top else None, top[1] if top else None))
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]], ["doc_id", "score", "n_passages", "best_start", "best_end"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return in_arrow(texts, run, "doc_id long, score double, n_passages long, best_start long, best_end long")
