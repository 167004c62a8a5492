"""The shortlist as one plan: postings and profiles in, every pair out with the reason it is out or its score, and the ranked rest.

pool -> one of each group of variants -> facts of a posting -> pairs with profiles -> elimination in order -> scores -> staleness -> order.
Facts that don't depend on the profile are worked out once a posting, before the pairs are made; pairs carry arrays of names, so nothing is exploded or shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import catalog
from ..functions import text as tx
from ..operators import dedup, embedding, fit, geo, ghost, matching, score

#: Least score before the fit, risk from which a posting is held for stale, inverse frequency from which a skill tells something, characters of a text worth the name.
MIN_SCORE, GHOST_AT, INFORMATIVE, TEXT_LEAST = 25.0, 0.70, 1.5, 400
#: Rows up to which the table of profiles is broadcast.
MAX_PROFILES = 10_000
HEAD = 900
#: Family of a key that any family meets.
ANY = "*"


def terms() -> list[tuple[str, str, bool]]:
    return [(name, term, cs) for _, name, some, cs in catalog.SKILLS for term in some]


def family_hits(text: Column) -> Column:
    """Names of the families of which some title pattern matches, in catalogue order; the patterns are constants of the plan."""
    hit = lambda patterns: F.greatest(*[text.rlike(tx.unicode_pattern(p)) for p in patterns], F.lit(False))
    return F.array_compact(F.array(*[F.when(hit(patterns), F.lit(name)) for name, _, patterns, *_ in catalog.FAMILIES]))


def variants_folded(postings: DataFrame) -> DataFrame:
    """One posting of each group of variants, at the place (``seq``) of the group's first, with ``variants``, their number."""
    keyed = postings.withColumn("__key", dedup.variant_key(F.col("company"), F.col("title"), catalog.place_names()))
    sizes = keyed.select("__key", "seq", F.length("description").alias("__len"), F.coalesce(F.unix_seconds("posted_at"), F.lit(0)).alias("__fresh"), F.size("locations").alias("__places"))
    winners = dedup.fold(sizes, ["__key"], "seq", "__len", "__fresh", "__places").select("winner", F.col("rank").alias("__rank"), F.col("size").alias("variants"))
    return postings.join(winners, F.col("seq") == F.col("winner")).withColumn("seq", F.col("__rank")).drop("winner", "__rank")


def facts(postings: DataFrame, as_of: Column) -> DataFrame:
    """What is known of each posting without a profile."""
    text = tx.combined_text(F.col("title"), F.col("department"), F.col("locations"), F.col("description"))
    head = F.concat_ws(" ", F.col("department"), F.left("description", F.lit(HEAD)))
    made = postings.select(
        *postings.columns,
        text.alias("text"),
        tx.title_key(F.col("board_token"), F.col("title")).alias("title_key"),
        tx.age_days(F.col("posted_at"), F.col("updated_at"), as_of).alias("age"),
        score.seniority(F.col("title"), F.col("description")).alias("level"),
        score.required_years(F.col("description")).alias("years"),
        (F.col("title").rlike(score.PRACTITIONER)).alias("practitioner"),
        family_hits(F.col("title")).alias("title_families"),
        family_hits(head).alias("text_families"),
        F.col("title").rlike(ghost.POOL_TITLE).alias("pool_title"),
        F.left("description", F.lit(4000)).rlike(ghost.POOL_TEXT).alias("pool_text"),
    )
    made = matching.with_matched(made, {"skills": F.concat_ws("\n", "title", "description"), "title_skills": F.col("title")}, terms())
    places = catalog.places(postings.sparkSession)
    found = geo.countries(made.select("seq", "locations"), "seq", "locations", F.broadcast(places))
    same = F.count(F.lit(1)).over(Window.partitionBy("title_key"))
    return made.join(found, "seq", "left").withColumn("same_title", same)


def with_risk(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``rows`` with risk, band, evidence and reasons. ``history`` has title_key's closed postings and refreshes by uid: uid, fake_refresh, reposts, seen."""
    if history is None:
        rows = rows.withColumns({"fake_refresh": F.lit(False), "reposts": F.lit(0).cast("long"), "seen": F.lit(1).cast("long")})
    else:
        rows = rows.withColumn("uid", tx.uid(F.col("source"), F.col("board_token"), F.col("native_id"))).join(history, "uid", "left")
        rows = rows.withColumns({"fake_refresh": F.coalesce("fake_refresh", F.lit(False)), "reposts": F.coalesce("reposts", F.lit(0)), "seen": F.coalesce("seen", F.lit(1))})
    given = (F.col("age"), F.col("pool_title"), F.col("pool_text"), F.size("locations"), F.col("same_title"), F.col("fake_refresh"), F.col("reposts"))
    return rows.withColumns({"risk": F.round(ghost.risk(*given), 4), "reasons": ghost.reasons(*given), "evidence": ghost.evidence(F.col("seen"), F.col("fake_refresh"), F.col("reposts"))}).withColumn("band", ghost.band(F.col("risk")))


def rarity(rows: DataFrame) -> DataFrame:
    """One row, ``idf``: skill to inverse frequency over all postings. As large as the dictionary."""
    total = rows.agg(F.count(F.lit(1)).cast("double").alias("__n"))
    counts = rows.select(F.explode("skills").alias("canonical")).join(F.broadcast(total)).groupBy("canonical", "__n").agg(F.count(F.lit(1)).alias("df"))
    share = F.greatest(F.col("df") / F.col("__n"), 1 / (4 * F.col("__n")))
    value = F.round(F.least(F.lit(4.0), F.greatest(F.lit(0.3), F.ln(1 / share))), 2)
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("canonical", value.alias("v")))).alias("idf"))


def best_family(families: Column, held: Column) -> Column:
    """struct(weight, name) of the profile's family of highest weight among the names ``held``; the first in the profile's order where weights are equal; null without any."""
    own = F.filter(F.transform(families, lambda f, i: F.struct(f["weight"].alias("weight"), (-i).alias("o"), f["name"].alias("name"))), lambda f: F.array_contains(held, f["name"]))
    return F.array_max(own)


def candidates(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pairs of ``rows`` and ``profiles`` that place, profession and level leave open, each once, with the columns of both; all others would be taken out by one of those rules.

    Both sides are exploded to keys (permit, family) and meet by equality: a posting by what grants it and its title's families, a profile by its permits and families. A profile that shows
    other professions (or doesn't say) meets all postings that a permit grants, by the key of no family, so no rule is skipped for it. A pair with several keys in common stays at the least of them.
    Few profiles are broadcast to the postings; of more, only keys and numbers are joined, and the texts come to the pairs afterwards. ``permits`` hold no nulls; ``seq`` and ``profile_id`` are unique.
    """
    few = profiles.count() <= MAX_PROFILES
    product = lambda tags, names: F.flatten(F.transform(tags, lambda t: F.transform(names, lambda n: F.concat_ws("/", t, n))))
    none = F.array(F.lit(ANY))
    shown = F.coalesce("show_off_domain", F.lit(True))
    asked = profiles.withColumn("__asked", F.array_distinct(product(F.col("permits"), F.when(shown, none).otherwise(F.transform("families", lambda f: f["name"])))))
    given = rows.withColumn("__given", F.array_distinct(product(geo.granting(F.col("locations"), F.col("title"), F.col("description"), F.col("remote_flag"), F.col("countries")), F.concat(none, F.col("title_families")))))
    wide, small = (given, F.broadcast(asked)) if few else (given.select("seq", "level", "__given"), asked.select("profile_id", "max_level", "__asked"))
    left, right = wide.withColumn("__key", F.explode("__given")), small.withColumn("__key", F.explode("__asked"))
    right = F.broadcast(right) if few else right
    above = F.coalesce(score.rank_of(F.col("level")) > score.rank_of(F.col("max_level")), F.lit(False))
    met = left.join(right, "__key").where(~above & (F.col("__key") == F.array_min(F.array_intersect("__given", "__asked"))))
    if few:
        return met.drop("__key", "__given", "__asked")
    return met.select("seq", "profile_id").join(rows, "seq").join(profiles, "profile_id")


def scored(rows: DataFrame, profiles: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Every posting with every profile, or the pairs ``among`` them (:func:`candidates`): family, role, skill, bonus, missing, off_domain, total and ``reason``, the first rule that takes it out (null for those that stay).

    A profile has profile_id, permits, max_level, max_years, forbidden, needs_sponsor, languages, practitioner, show_off_domain, families (name, weight), weights (skill to weight), remote_bonus
    and sectors (pattern, weight) as arrays and maps.
    """
    if among is None:
        among = rows.join(F.broadcast(profiles) if profiles.count() <= MAX_PROFILES else profiles)
    pairs = among.join(F.broadcast(rarity(rows)))
    families = F.col("families")
    title, body = best_family(families, F.col("title_families")), best_family(families, F.col("text_families"))
    technical = [name for name, *_, t in catalog.FAMILIES if t]
    markers = F.create_map(*[x for name, _, _, strong, *_ in catalog.FAMILIES for x in (F.lit(name), F.array(*[F.lit(s) for s in strong]))])
    known = F.filter("skills", lambda s: F.coalesce(F.try_element_at("weights", s), F.lit(0.0)) > 0)
    worth = lambda s: F.try_element_at("weights", s) * F.coalesce(F.try_element_at("idf", s), F.lit(1.0))
    sector = F.get(F.filter("sectors", lambda x: F.regexp_like(F.lower("text"), x["pattern"])), F.lit(0))["weight"]
    pairs = pairs.withColumns({"__title": title, "__text": body, "known": known})
    pairs = pairs.withColumns({
        "family": F.coalesce("__title.name", "__text.name"),
        "off_domain": F.col("__title").isNull(),
        "role": score.role_score(F.coalesce("__title.weight", "__text.weight", F.lit(0.0)), F.col("__title").isNotNull(), F.col("__text").isNotNull()),
        "skill": F.when(F.trim("description") == "", F.least(F.size(F.filter("title_skills", lambda s: F.array_contains(F.map_keys("weights"), s))), F.lit(3)).cast("double")).otherwise(F.least(F.aggregate("known", F.lit(0.0), lambda t, s: t + worth(s)) / 8, F.lit(1.0)) * 45),
        "bonus": score.bonus(F.when(F.col("remote_flag"), F.col("remote_bonus")), sector),
        "missing": F.size(F.filter("title_skills", lambda s: ~F.array_contains(F.map_keys("weights"), s))),
        "informative": F.size(F.filter("known", lambda s: F.coalesce(F.try_element_at("idf", s), F.lit(0.0)) >= INFORMATIVE)),
        # another family's title, and none of the own
        "conflict": F.col("__title").isNull() & (F.size("title_families") > 0),
        "accidental": F.coalesce(F.col("__title.name").isin(technical) & (F.length("description") >= TEXT_LEAST) & (F.size("known") == 0) & ~F.arrays_overlap("skills", F.try_element_at(markers, F.col("__title.name"))), F.lit(False)),
        "place": geo.decision(F.col("locations"), F.col("title"), F.col("description"), F.col("remote_flag"), F.col("countries"), F.col("permits")),
    })
    pairs = pairs.withColumn("total", score.total(F.col("role"), F.col("skill"), F.col("bonus"), F.col("off_domain"), F.col("missing")))
    p = {"title": F.col("title"), "text": F.col("description"), "practitioner": F.col("practitioner"), "level": F.col("level"), "years": F.col("years"), "location_ok": F.col("place.ok"), "location_status": F.col("place.status"), "conflict": F.col("conflict"), "off_domain": F.col("off_domain"), "informative": F.col("informative"), "accidental": F.col("accidental")}
    q = {n: F.col(n) for n in ("forbidden", "max_level", "max_years", "needs_sponsor", "languages", "show_off_domain")} | {"practitioner": F.col("is_practitioner")}
    return pairs.withColumn("reason", score.elimination(p, q)).drop("__title", "__text")


def decided(pairs: DataFrame, fit_: Column | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """``pairs`` with ``final`` and ``verdict``: why a pair is out (its reason, ghost, low score) or ``kept``. The least score is asked of the score before the fit."""
    none = F.lit(None).cast("double")
    before = score.final(F.col("total"), F.col("risk"), none)
    verdict = F.coalesce(F.trim(F.split_part("reason", F.lit("("), F.lit(1))), F.when(F.col("risk") >= GHOST_AT, "ghost"), F.when(before < min_score, "low score"), F.lit("kept"))
    return pairs.withColumn("verdict", verdict).withColumn("final", score.final(F.col("total"), F.col("risk"), none if fit_ is None else fit_))


def own_sentence() -> Column:
    """What a profile says of itself: its families and skills."""
    return F.concat(F.lit("Work in "), F.array_join(F.transform("families", lambda f: f["name"]), ", "), F.lit(" with "), F.array_join(F.array_sort(F.map_keys("weights")), ", "))


def with_fit(pairs: DataFrame, corpus: DataFrame, path: str, cap: int = 400, cache: DataFrame | None = None) -> DataFrame:
    """The second phase: the kept pairs with ``fit`` and the final score by it; each profile's first ``cap`` pairs have a fit, the others' score stays.

    ``corpus`` (seq, title, description) is what the vectors are learnt from. The kept pairs are written below ``path`` once, so that the first phase runs once; the vectors used are written beside them (``vectors``) as the next run's ``cache``.
    """
    spark = pairs.sparkSession
    pairs.where("verdict = 'kept'").write.mode("overwrite").parquet(f"{path}/kept")
    kept = spark.read.parquet(f"{path}/kept")
    model = embedding.learnt(corpus.select("seq", F.concat_ws("\n", "title", "description").alias("text")), "seq", "text")
    other = fit.other_sentence(F.transform("families", lambda f: f["name"]))
    fits, vectors = embedding.fits(kept, model, own_sentence(), other, cap, cache)
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    # what has just been written serves the join, so nothing is scored twice
    known = spark.read.parquet(f"{path}/vectors")
    told, _ = embedding.fits(kept, _unscored, own_sentence(), other, cap, known)
    return kept.join(told, ["profile_id", "seq"], "left").withColumn("final", score.final(F.col("total"), F.col("risk"), F.col("fit")))


def _unscored(text: Column) -> Column:
    """The model of a plan whose texts are all in the cache."""
    return F.lit(None).cast("array<double>")


def ranked(pairs: DataFrame, per_company: int = 3, most: int = 25) -> DataFrame:
    """The kept pairs by profile: best first, in order of the pool where equal, ``per_company`` of a company and ``most`` in all."""
    order = (F.col("final").desc(), F.col("seq"))
    kept = pairs.where("verdict = 'kept'")
    few = kept.withColumn("__c", F.row_number().over(Window.partitionBy("profile_id", "company").orderBy(*order))).where(F.col("__c") <= per_company)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("profile_id").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("__c")
