"""From CV texts to the profiles that the ranking reads, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions.text import unicode_pattern
from ..operators import cv, shortlist

#: What a profile has where neither the CV nor its owner says anything.
DEFAULTS = {"needs_sponsor": False, "show_off_domain": False, "remote_bonus": 0.3}
#: Highest rank of a posting by the rank of the candidate: one above the own.
ABOVE = {"junior": "mid", "mid": "senior", "senior": "staff", "staff": "staff"}
SPOKEN = unicode_pattern(r"\b(english|german|french|spanish|dutch|italian|japanese|arabic|turkish)\b")


def from_cvs(docs: DataFrame, key: str, text: str, as_of: Column, permits: Column) -> DataFrame:
    """One profile for each CV. ``permits`` is what the owner says of where they may work, which no CV tells.

    A text without any skill or family gives a profile without them; postings are then off its domain. Rows of equal key are one CV.
    """
    spark = docs.sparkSession
    once = docs.dropDuplicates([key])
    lines = cv.lines(once, key, text, as_of)
    skills = cv.skills(lines, key, catalog.skills(spark))
    families = cv.families(skills, catalog.families(spark), key)
    held = families.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "family", "weight"))), lambda x: F.struct(x["family"].alias("name"), x["weight"].cast("double").alias("weight"))).alias("families"))
    weights = skills.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canonical", F.col("weight").cast("double"))))).alias("weights"))
    years = cv.experience(once, lines, key, text)
    level = cv.seniority(F.col(text), F.col("years"))
    above = F.create_map(*[F.lit(x) for kv in ABOVE.items() for x in kv])
    rows = once.join(years, key).join(held, key, "left").join(weights, key, "left")
    languages = F.array_distinct(F.concat(F.array(F.lit("english")), F.transform(F.regexp_extract_all(F.col(text), F.lit(SPOKEN), F.lit(1)), F.lower)))
    nothing = F.array().cast("array<struct<name:string,weight:double>>")
    return rows.select(
        F.col(key).cast("string").alias("profile_id"), permits.alias("permits"), F.try_element_at(above, level).alias("max_level"), F.when(F.col("years") > 0, F.ceil(F.col("years") + 2)).otherwise(0).cast("int").alias("max_years"),
        cv.forbidden_patterns(F.transform("families", lambda f: f["name"]), level).alias("forbidden"), F.lit(DEFAULTS["needs_sponsor"]).alias("needs_sponsor"), languages.alias("languages"), cv.practitioner(F.col(text)).alias("is_practitioner"),
        F.lit(DEFAULTS["show_off_domain"]).alias("show_off_domain"), F.coalesce("families", nothing).alias("families"), F.coalesce("weights", F.create_map().cast("map<string,double>")).alias("weights"),
        F.lit(DEFAULTS["remote_bonus"]).alias("remote_bonus"), F.array().cast("array<struct<pattern:string,weight:double>>").alias("sectors"),
    )


def search_queries(profile: dict, titles: dict[str, list[str]], seats: int = 6) -> list[str]:
    """Search queries of a profile's families (name, weight, recency), fresh ones first, by greatest quotients over their titles."""
    held = profile["families"]
    best = max((f["weight"] for f in held), default=0.0)
    near = [f for f in held if f["weight"] >= 0.7 * best]
    fresh = [f for f in near if f.get("recency", 1.0) >= 0.75] or near
    return shortlist.query_slots([(f["name"], f["weight"], False, titles.get(f["name"], [])) for f in fresh], seats)


def searches(profiles: DataFrame, titles: dict[str, list[str]], by_level: tuple[str, ...] = (), seats: int = 6, share: float = 0.7, fresh: float = 0.75) -> DataFrame:
    """``profiles`` (families: name, weight, recency, heaviest first) with ``queries``: the titles of families named after a level, then those of the families of at least ``share``
    of the greatest weight, fresh ones only where there are any, by greatest quotients. ``titles`` is a constant of the plan, as large as the dictionary of families."""
    listed = F.create_map(*[x for name, some in titles.items() for x in (F.lit(name), F.array(*[F.lit(t) for t in some]).cast("array<string>"))]) if titles else F.create_map().cast("map<string,array<string>>")
    held = profiles.withColumn("__all", F.transform(F.coalesce("families", F.array().cast("array<struct<name:string,weight:double,recency:double>>")), lambda f: F.struct(f["name"].alias("name"), f["weight"].alias("weight"), F.coalesce(f["recency"], F.lit(1.0)).alias("recency"), F.try_element_at(listed, f["name"]).alias("queries"))))
    # fresh ones are told first: the weight is measured against the best of those
    held = held.withColumn("__new", F.filter("__all", lambda f: f["recency"] >= fresh)).withColumn("__new", F.when(F.size("__new") > 0, F.col("__new")).otherwise(F.col("__all")))
    held = held.withColumn("__best", F.array_max(F.transform("__new", lambda f: f["weight"]))).withColumn("__near", F.filter("__new", lambda f: f["weight"] >= share * F.col("__best")))
    before = F.flatten(F.transform(F.filter("__all", lambda f: f["name"].isin(*by_level)) if by_level else F.slice("__all", 1, 0), lambda f: F.coalesce(f["queries"], F.array().cast("array<string>"))))
    return held.withColumn("queries", shortlist.slots(before, F.col("__near"), seats)).drop("__all", "__new", "__best", "__near")
