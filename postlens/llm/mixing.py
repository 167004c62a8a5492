"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). The unit of budgets is the word, as a token: texts are encoded later. The budget in tokens goes down the tree by weight; a child takes at most what its leaves can
give in ``max_epochs`` passes, and what it can't take goes to its siblings, again by weight, before anything goes back to the parent, whose
own siblings then share it. Each leaf's budget is spent on whole epochs and then on the token-prefix of one more: documents in the order of a
hash of (seed, epoch, id), as many as fit, so that a prefix of a smaller budget lies within that of a larger one.

No leaf is sorted in one task. The hash cuts each leaf into slots, more of them the more rows it has; token sums by slot (a table of
leaves and slots) give the slot where the prefix ends, and only that slot's documents are put in order. A document is in the
prefix while the tokens up to and including it are within the budget.

Defined cases: null language or source is a leaf of its own; null text or an empty one has 0 tokens and goes along where its hash lies within the prefix;
rows of equal id and text have equal hashes and are told apart by nothing, so they go together; weights that are missing count ``other``, a weight of 0 takes nothing; documents whose points tie lie in the prefix together or not at all; an empty table gives an
empty result; extra columns are kept by :func:`mixed` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality_rules import words_of
from .storage import written

LEAF = ("domain", "lang", "source")
#: Rows that a slot holds on average.
SLOT_ROWS = 2_000


@dataclass(frozen=True)
class Weights:
    """Weights among siblings, by name; ``other`` is that of names not listed. A source may have a weight in any domain and language."""

    domain: Mapping[str, float] = field(default_factory=dict)
    lang: Mapping[str, float] = field(default_factory=dict)
    source: Mapping[str, float] = field(default_factory=dict)
    other: float = 1.0


#: Domains by source name: the parameter of the query. A source without an entry is in domain ``web``.
DOMAINS = {"src1": "books", "src2": "books", "src3": "books", "src4": "code", "src5": "code", "src6": "news", "src7": "news", "src8": "news", "src9": "reference", "src10": "reference"}
WEIGHTS = Weights(domain={"web": 4.0, "books": 2.0, "code": 1.0, "news": 2.0, "reference": 3.0}, lang={"en": 4.0, "de": 1.5, "fr": 1.5, "es": 1.0}, source={"src0": 2.0})


def domain_of(source: Column, domains: Mapping[str, str] = DOMAINS) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in domains.items() for x in kv])
    return F.when(source.isNull(), F.lit("web")).otherwise(F.coalesce(F.element_at(pairs, source), F.lit("web")))


def tokens_of(text: Column) -> Column:
    """Words, the unit of budgets here."""
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def shares(children: list[tuple[float, float]], budget: float) -> list[float]:
    """Budget for each child (weight, capacity): by weight, a child's shortage going to the siblings that still have room."""
    given = [0.0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = min(budget, sum(children[i][1] for i in open_))
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if children[i][1] <= left * children[i][0] / total + 1e-12]
        if not full:
            for i in open_:
                given[i] = left * children[i][0] / total
            return given
        for i in full:
            given[i] = children[i][1]
        left -= sum(children[i][1] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return given


def split_by_language(groups: list[tuple[str | None, str | None, float]], budget: float, weights: Weights) -> dict[tuple, float]:
    """Budget for each (domain, lang) from (domain, lang, capacity): by domain, then by language within it; a language's shortage goes to its siblings before the domain's."""
    domains: dict[str | None, list[tuple[str | None, float]]] = {}
    for domain, lang, capacity in sorted(groups, key=str):
        domains.setdefault(domain, []).append((lang, capacity))
    tops = shares([(weights.domain.get(d, weights.other), sum(c for _, c in langs)) for d, langs in domains.items()], budget)
    out: dict[tuple, float] = {}
    for (domain, langs), top in zip(domains.items(), tops, strict=True):
        given = shares([(weights.lang.get(la, weights.other), c) for la, c in langs], top)
        out |= {(domain, la): amount for (la, _), amount in zip(langs, given, strict=True)}
    return out


def source_budgets(leaves: DataFrame, budget: float, weights: Weights, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with budget, whole tokens rounded down.

    There may be as many sources as hosts, so those of a (domain, lang) aren't collected: what such a group holds per unit of weight is raised, round by round, as in :func:`shares`,
    from two sums over its sources: the capacities of those that the level fills and the weights of the others. The driver sees groups only.
    """
    spark = leaves.sparkSession
    named = F.create_map(*[F.lit(x) for kv in weights.source.items() for x in kv]) if weights.source else F.create_map().cast("map<string,double>")
    weight = F.when(F.col("source").isNull(), F.lit(weights.other)).otherwise(F.coalesce(F.try_element_at(named, F.col("source")), F.lit(weights.other)))
    rows = written(leaves.withColumn("__w", weight).withColumn("__c", F.when(F.col("__w") > 0, F.col("tokens") * float(max_epochs)).otherwise(0.0)), "leaves")
    groups = rows.groupBy("domain", "lang").agg(F.sum("__c").alias("c"), F.sum(F.when(F.col("__c") > 0, F.col("__w")).otherwise(0.0)).alias("w")).collect()
    given = split_by_language([(r["domain"], r["lang"], r["c"]) for r in groups], budget, weights)
    levels = {(r["domain"], r["lang"]): given[r["domain"], r["lang"]] / r["w"] if r["w"] else 0.0 for r in groups}
    open_ = set(levels)

    def levelled(some: set) -> DataFrame:
        table = spark.createDataFrame([(d, la, levels[d, la]) for d, la in some], "__d string, __l string, level double")
        return rows.join(F.broadcast(table) if len(some) <= MAX_LEAVES else table, F.col("domain").eqNullSafe(F.col("__d")) & F.col("lang").eqNullSafe(F.col("__l")))

    full = F.col("__c") <= F.col("level") * F.col("__w") + 1e-12
    while open_:
        sums = levelled(open_).groupBy("domain", "lang").agg(F.sum(F.when(full, F.col("__c")).otherwise(0.0)).alias("filled"), F.sum(F.when(full, 0.0).otherwise(F.col("__w"))).alias("left")).collect()
        raised = set()
        for r in sums:
            key = (r["domain"], r["lang"])
            level = (given[key] - r["filled"]) / r["left"] if r["left"] else float("inf")
            if level > levels[key] * (1 + 1e-12):
                levels[key] = level
                raised.add(key)
        open_ = {k for k in raised if levels[k] != float("inf")}
    amount = F.floor(F.least(F.col("__c"), F.when(F.col("__w") > 0, F.col("level") * F.col("__w")).otherwise(0.0)) + 1e-6).cast("long")
    return levelled(set(levels)).withColumn("budget", amount).select(*leaves.columns, "budget")


def _point(seed: int, epoch: Column, doc_id: Column, size: Column) -> Column:
    """A number in [0, 2 ** 40) by hash of seed, epoch and document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, doc_id, size), 24)


def planned(counts: DataFrame, budget_share: float, weights: Weights, max_epochs: int) -> DataFrame:
    """Leaves with epochs (whole), rest (tokens of one more), budget and slots."""
    leaves = counts.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    given = source_budgets(leaves, int(total * budget_share), weights, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.least(F.lit(max_epochs), F.floor(F.col("budget") / F.col("tokens")))).otherwise(0).cast("long")
    return given.withColumn("epochs", epochs).select(*LEAF, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest"), "budget", F.greatest(F.lit(1), F.ceil(F.col("n") / SLOT_ROWS)).cast("long").alias("slots"))


#: A table of leaves is broadcast only up to so many rows (a few MB); beyond it the join picks its own way.
MAX_LEAVES = 100_000


def _hinted(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= MAX_LEAVES else small


def _leaf_join(rows: DataFrame, small: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Null-safe join on the leaf's columns; those of ``small`` don't come along."""
    other = small.select(*[F.col(c).alias(f"__j_{c}") for c in LEAF], *[c for c in small.columns if c not in LEAF])
    on = [F.col(f"__{c}" if f"__{c}" in rows.columns else c).eqNullSafe(F.col(f"__j_{c}")) for c in LEAF]
    return rows.join(_hinted(other, n), on, how).drop(*[f"__j_{c}" for c in LEAF])


def _slotted(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (doc_id, __key, epochs, slots) with their place in the order of the leaf's last epoch."""
    point = _point(seed, F.col("epochs"), F.col("doc_id"), F.col("__key"))
    return rows.withColumn("__point", point).withColumn("__slot", F.floor(F.col("__point").cast("double") * F.col("slots") / float(1 << 40)).cast("long"))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def decisions(docs: DataFrame, budget_share: float, weights: Weights, domains: Mapping[str, str], max_epochs: int, seed: int) -> tuple[DataFrame, int]:
    """For each leaf: epochs, slots, rest, edge (the slot where the prefix ends; null where it takes all) and cutoff (last point taken in it); and the number of leaves."""
    counts = written(docs.select("doc_id", domain_of(F.col("source"), domains).alias("domain"), "lang", "source", tokens_of(F.col("text")).alias("tokens"), _text_key().alias("__key")), "tokens")
    plan = written(planned(counts, budget_share, weights, max_epochs), "plan")
    n = plan.count()
    placed = _slotted(_leaf_join(counts, plan.select(*LEAF, "epochs", "rest", "slots"), n), seed)
    sums = placed.groupBy(*LEAF, "rest", "__slot").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*LEAF).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")))
    edges = written(edges.groupBy(*LEAF).agg(F.min("__slot").alias("edge"), F.min_by("before", "__slot").alias("before")), "edges")
    order = Window.partitionBy(*LEAF).orderBy("__point").rangeBetween(Window.unboundedPreceding, 0)
    last = _leaf_join(placed, edges, n).where(F.col("__slot") == F.col("edge")).withColumn("run", F.sum("tokens").over(order))
    cutoffs = last.where(F.col("before") + F.col("run") <= F.col("rest")).groupBy(*LEAF).agg(F.max("__point").alias("cutoff"))
    made = _leaf_join(_leaf_join(plan, edges.drop("before"), n, "left"), written(cutoffs, "cutoffs"), n, "left")
    return written(made.select(*LEAF, "epochs", "rest", "slots", "edge", "cutoff"), "mix"), n


def with_copies(docs: DataFrame, decided: DataFrame, n: int, domains: Mapping[str, str], seed: int) -> DataFrame:
    """``docs`` with __domain and __copies: each row is told by its own hash, without a shuffle of the texts."""
    rows = docs.withColumns({"__domain": domain_of(F.col("source"), domains), "__key": _text_key()})
    told = _slotted(_leaf_join(rows, decided, n), seed)
    inside = F.col("edge").isNull() | (F.col("__slot") < F.col("edge")) | ((F.col("__slot") == F.col("edge")) & (F.col("__point") <= F.col("cutoff")))
    extra = F.when((F.col("rest") > 0) & F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    return told.withColumn("__copies", (F.col("epochs") + extra).cast("long")).drop("epochs", "rest", "slots", "edge", "cutoff", "__key", "__point", "__slot")


def selected(docs: DataFrame, budget_share: float = 0.6, weights: Weights = WEIGHTS, domains: Mapping[str, str] = DOMAINS, max_epochs: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, domain, lang, source, tokens, copies: how often each row of ``docs`` is taken (0 included)."""
    rows = docs.select("doc_id", "text", "lang", "source")
    told = with_copies(rows, *decisions(rows, budget_share, weights, domains, max_epochs, seed), domains, seed)
    return told.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", tokens_of(F.col("text")).alias("tokens"), F.col("__copies").alias("copies"))


def mixed(docs: DataFrame, budget_share: float = 0.6, weights: Weights = WEIGHTS, domains: Mapping[str, str] = DOMAINS, max_epochs: int = 2, seed: int = 11) -> DataFrame:
    """Rows of ``docs`` as often as they are taken, all columns kept."""
    rows = docs.select("doc_id", "text", "lang", "source")
    packed = docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("__row"))
    told = with_copies(packed, *decisions(rows, budget_share, weights, domains, max_epochs, seed), domains, seed)
    repeated = told.where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return repeated.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
