"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A document fails the base rules when it is too short or mostly repeats itself. Further rules
compare a ratio of the text with a cutoff. The cutoffs are not chosen by hand: a labelled
holdout is split into strata, every (stratum, rule, cutoff) of a fixed grid is tested with an
exact binomial bound on its rate of rejecting documents labelled good, and in each stratum the
strictest cutoff whose bound holds is used. The error level is shared among all tests
(Bonferroni), so with probability ``1 - delta`` no stratum loses more than ``alpha`` of its
good documents to any one rule. Each of the rules gets ``alpha / len(RULES)``, so that the rules of
a stratum together stay below ``alpha``.

Defined cases: null or empty text has no words, all counts are 0 and it fails the base rules; a null
stratum is a stratum of its own; a stratum without enough good labels gets no cutoffs, so nothing but
the base rules rejects there; trials must be independent, so repeated label rows count once, and so do the labelled copies of one text in a stratum (a document
labelled both ways is good); repeated documents are judged one by one; an empty table gives an empty result. Columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

WORD = r"[^\x20\x09-\x0D]+"
#: A text has less than 2 ** 30 words, as it has less than 2 ** 31 bytes.
PLACE_BITS = 30
SYMBOLS = r"[#*$%&|<>]"

#: Grid of cutoffs of each rule, strictest first. A document is rejected where its ratio is above.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0, 2.0),
    "repeated_words": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4),
    "repeated_lines": (0.05, 0.1, 0.2, 0.3, 0.5),
    "upper_case": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "same_as_previous": (0.05, 0.1, 0.2, 0.3, 0.5),
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once: a lambda's variable is never inlined again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spaced(text: Column) -> Column:
    for white in ("\t", "\n", "\x0b", "\x0c", "\r"):
        text = F.replace(text, F.lit(white), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """The runs of other characters than space and \\x09-\\x0D, in order."""
    return F.array_remove(F.split(_spaced(text), " "), "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window which occurs twice or more in the array.

    A text whose window hashes all differ has none. Else windows are sorted as longs, hash above and place below; neighbours of equal hash are compared
    word by word, and only where some differ in spite of it are the candidates sorted as text.
    """

    def body(w: Column) -> Column:
        n = F.size(w) - 2
        bits = PLACE_BITS
        hashes = F.transform(F.slice(w, F.lit(1), n), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        keyed = lambda h: F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, bits), bits).bitwiseOR(i.cast("long")))

        head = lambda x: F.shiftright(x, bits)
        place = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

        def candidates(s: Column) -> Column:
            return F.filter(s, lambda x, i: (head(x) == head(F.get(s, i - 1))) | (head(x) == head(F.get(s, i + 1))))

        def differ(i: Column, j: Column) -> Column:
            return (F.get(w, i) != F.get(w, j)) | (F.get(w, i + 1) != F.get(w, j + 1)) | (F.get(w, i + 2) != F.get(w, j + 2))

        def collided(c: Column) -> Column:
            return F.size(F.filter(c, lambda x, k: (k > 0) & (head(x) == head(F.get(c, k - 1))) & differ(place(x), place(F.get(c, k - 1))))) > 0

        def compared(c: Column) -> Column:
            grams = F.sort_array(F.transform(c, lambda x: F.struct(F.concat_ws(" ", F.get(w, place(x)), F.get(w, place(x) + 1), F.get(w, place(x) + 2)).alias("g"), x.alias("x"))))
            return let(grams, lambda g: F.transform(F.filter(g, lambda a, k: (a["g"] == F.get(g, k - 1)["g"]) | (a["g"] == F.get(g, k + 1)["g"])), lambda a: a["x"]))

        covered = lambda c: F.size(F.array_distinct(F.flatten(F.transform(c, lambda x: F.sequence(place(x), place(x) + 2)))))
        repeated = lambda h: let(let(F.sort_array(keyed(h)), candidates), lambda c: F.when(F.size(c) < 2, F.lit(0)).when(collided(c), covered(compared(c))).otherwise(covered(c)))
        found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))
        return F.when(n < 2, F.lit(0)).otherwise(found)

    return let(words, body)


def measures(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and one struct ``m`` of counts for each row of ``docs`` (text in column ``text``)."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    staged = docs.select(*keep, raw.alias("__t"), words_of(raw).alias("__w"))
    t, w = F.col("__t"), F.col("__w")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    counted = staged.select(
        *[c for c in staged.columns if c not in ("__t", "__w")],
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))).alias("lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            let(w, lambda x: F.size(F.filter(x, lambda a, i: a == F.get(x, i - 1)))).cast("long").alias("n_same"),
            F.xxhash64(t).alias("text"),
        ).alias("m"),
    )
    return counted


def ratios(m: Column) -> dict[str, Column]:
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": per(m["n_symbols"], m["n_words"]),
        "repeated_words": per(m["n_repeat_words"], m["n_words"]),
        "repeated_lines": per(m["lines"]["again"], m["lines"]["all"]),
        "upper_case": per(m["n_upper"], m["word_chars"]),
        "same_as_previous": per(m["n_same"], m["n_words"]),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _ln_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence: error below 1e-11."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    down = F.lit(0.0)
    for k in range(8):
        down = down + F.ln(x + k)
    return series - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from k downwards until terms no longer matter.

    Used for k below n * p only (1.0 otherwise), where each term is smaller than the one above it; the number
    of terms that matter is then a few standard deviations, so 64 of those plus 64 bound the sum.
    """
    kd, nd = k.cast("double"), n.cast("double")
    first = F.exp(_ln_gamma(nd + 1) - _ln_gamma(kd + 1) - _ln_gamma(nd - kd + 1) + kd * F.ln(F.lit(p)) + (nd - kd) * F.ln(F.lit(1 - p)))
    terms = F.least(k, F.ceil(64 * F.sqrt(nd * p) + 64)).cast("long")
    odds = (1 - p) / p
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        j = kd - i.cast("double") + 1
        term = acc["term"] * (j / (nd - j + 1)) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<long>")), start, step, lambda acc: acc["sum"])
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff) for each stratum and rule where some cutoff is proven safe.

    ``measured`` has doc_id, stratum and m. All labelled documents count; the aggregation holds one row for each
    stratum, rule and cutoff. Documents that the base rules reject are left out: the bound is on what the further rules take away.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("__id")).distinct()
    labelled = measured.where(~base_failed(F.col("m"))).join(good, F.col("doc_id") == F.col("__id"), "inner")
    rows = labelled.groupBy("stratum", F.col("m.text").alias("__text")).agg(F.first("m").alias("m"))
    # the ratios are columns before they are counted: written into each count they would make one very large method
    rows = rows.select("stratum", *[ratio.alias(rule) for rule, ratio in ratios(F.col("m")).items()])
    counts = [F.count_if(F.col(rule) > cut).alias(f"{rule}:{cut}") for rule in RULES for cut in RULES[rule]]
    per = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    grid = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(float(cut)).alias("cutoff"), F.col(f"`{rule}:{cut}`").alias("k")) for rule, cuts in RULES.items() for cut in cuts])
    tested = per.select("stratum", "n", F.inline(grid))
    strata = per.agg(F.count(F.lit(1)).alias("strata"))
    grid_size = sum(map(len, RULES.values()))
    level = F.lit(delta) / (F.greatest(F.col("strata"), F.lit(1)) * grid_size)
    safe = tested.join(F.broadcast(strata)).where(binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= level)
    return safe.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept. A stratum's cutoffs come as one map, joined by stratum."""
    maps = cuts.groupBy(F.col("stratum").alias("__s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cuts"))
    joined = measured.join(maps, F.col("stratum").eqNullSafe(F.col("__s")), "left")
    broken = F.lit(False)
    for rule, ratio in ratios(F.col("m")).items():
        broken = broken | F.coalesce(ratio > F.col("__cuts")[rule], F.lit(False))
    failed = base_failed(F.col("m"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~broken).drop("__s", "__cuts")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, stratum, m, base_failed, kept for every document. Texts are measured once; only counts are written."""
    measured = written(measures(docs, [F.col("doc_id"), F.col(stratum).alias("stratum")]), "measures")
    return judged(measured, cutoffs(measured, labels, alpha, delta))


def passed(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were. Rows travel with their counts in one written table, so texts are neither measured twice nor shuffled."""
    keep = [F.struct(*docs.columns).alias("__row"), F.col("doc_id"), F.col(stratum).alias("stratum")]
    measured = written(measures(docs, keep), "measured")
    small = measured.select("doc_id", "stratum", "m")
    told = judged(measured, written(cutoffs(small, labels, alpha, delta).coalesce(1), "cutoffs"))
    return told.where("kept").select(*[F.col("__row")[c].alias(c) for c in docs.columns])
