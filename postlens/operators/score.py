"""Elimination in a fixed order with the first reason reported, and additive scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unicode_pattern

RANK = {"junior": 0, "mid": 1, "senior": 2, "staff": 3}
LEVELS = (("junior", r"\b(intern(ship)?|junior|jr|entry[- ]level|graduate|stajyer)\b"), ("staff", r"\b(staff|principal|head of|director|vp|chief|lead architect)\b"), ("senior", r"\b(senior|sr|lead|kıdemli)\b"))
PRACTITIONER = unicode_pattern(r"\b(technician|operator|driver|welder|cashier|teknisyen|operatör|şoför|kaynakçı|kasiyer)\b")
WHITE_COLLAR = unicode_pattern(r"\b(engineer|manager|analyst|consultant|mühendis|müdür|uzman)\b")
NO_SPONSOR = unicode_pattern(r"\b(no|not|unable to|cannot)\b.{0,40}\bsponsor")
LANGUAGE = unicode_pattern(r"\b(?:fluent|native|proficient)\b.{0,20}\b(german|french|spanish|dutch|italian|japanese|arabic)\b")


def first_reason(rules: Sequence[tuple[Column, Column]]) -> Column:
    """Reason of the first rule that holds, else null. Later conditions aren't evaluated for rows that an earlier one took."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(list(rules)):
        out = F.when(F.coalesce(condition, F.lit(False)), reason).otherwise(out)
    return out


def histogram(rows: DataFrame, reason: str) -> DataFrame:
    """Counts by reason up to its first bracket."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.trim(F.split_part(reason, F.lit("("), F.lit(1))).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def seniority(title: Column, text: Column) -> Column:
    """A range counts by its lower end; else the title's words, then those of the text's first 1500 characters, else mid."""
    low = F.regexp_extract(title, unicode_pattern(r"\b(junior|mid|senior|staff)\s*(?:/|-|–|to)\s*(?:mid|senior|staff)\b"), 1)
    out = F.lit("mid")
    for where in (F.left(text, F.lit(1500)), title):
        for name, pattern in reversed(LEVELS):
            out = F.when(where.rlike(unicode_pattern(pattern)), F.lit(name)).otherwise(out)
    return F.when(low != "", F.lower(low)).otherwise(out)


def rank_of(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, level), F.lit(1))


#: A sentence asks for experience if it has a span of years and a word for experience and isn't about who offers the work.
SPAN = unicode_pattern(r"(?<![\w.,])([0-9]{1,2})\s?\+?(?:\s?(?:-|–|to)\s?[0-9]{1,2})?\s?\+?\s(?:full\s)?(?:years?|yrs?|yıl)\b")
EXPERIENCE = unicode_pattern(r"\b(experience|deneyim\w*|tecrübe\w*)\b")
OFFERER = unicode_pattern(r"\b(we|our|us|company|founded|biz|şirketimiz)\b")
MOST_YEARS = 20


def required_years(text: Column) -> Column:
    """Years of experience that a text asks for: those of the first sentence that asks for MOST_YEARS at most, its lower bound where it gives a range; null if there is none."""
    asking = F.filter(F.split(text, r"[.;!?\n]+"), lambda s: s.rlike(SPAN) & s.rlike(EXPERIENCE) & ~s.rlike(OFFERER))
    years = F.transform(asking, lambda s: F.regexp_extract(s, SPAN, 1).cast("int"))
    return F.get(F.filter(years, lambda y: y <= MOST_YEARS), F.lit(0))


def elimination(p: dict[str, Column], q: dict[str, Column]) -> Column:
    """Reason for which a posting (``p``) is no option for a profile (``q``), in order, cheap rules first; null for survivors.

    p: title, text, practitioner, level, years, location_ok, location_status, conflict, off_domain, informative, accidental.
    q: forbidden (array), practitioner, max_level, max_years, needs_sponsor, languages, show_off_domain.
    """
    word = F.filter(F.transform(q["forbidden"], lambda x: F.regexp_substr(p["title"], x)), lambda x: x.isNotNull())
    asked = F.lower(F.regexp_extract(F.concat_ws("\n", p["title"], F.left(p["text"], F.lit(4000))), LANGUAGE, 1))
    senior = p["title"].rlike(unicode_pattern(LEVELS[1][1] + "|" + LEVELS[2][1]))
    rules = [
        (F.size(word) > 0, F.concat(F.lit("forbidden title ("), F.left(F.get(word, F.lit(0)), F.lit(40)), F.lit(")"))),
        (p["practitioner"] & ~q["practitioner"] & ~senior, F.lit("practitioner posting")),
        (q["practitioner"] & ~p["practitioner"] & p["title"].rlike(WHITE_COLLAR), F.lit("office posting")),
        (rank_of(p["level"]) > rank_of(q["max_level"]), F.concat(F.lit("seniority ("), p["level"], F.lit(")"))),
        (F.nullif(p["years"], F.lit(0)) > F.nullif(q["max_years"], F.lit(0)), F.concat(F.lit("years asked ("), p["years"].cast("string"), F.lit(")"))),
        (~p["location_ok"], F.concat(F.lit("location ("), p["location_status"], F.lit(")"))),
        (q["needs_sponsor"] & p["text"].rlike(NO_SPONSOR), F.lit("no sponsorship")),
        ((asked != "") & ~F.array_contains(q["languages"], asked), F.concat(F.lit("language ("), asked, F.lit(")"))),
        (p["conflict"] & ~q["show_off_domain"], F.lit("other profession")),
        (p["off_domain"] & ~q["show_off_domain"], F.lit("off domain")),
        (p["off_domain"] & (p["informative"] < 2), F.lit("off domain, few skills")),
        (p["accidental"], F.lit("accidental title")),
    ]
    return first_reason(rules)


def role_score(weight: Column, title_hit: Column, text_hit: Column) -> Column:
    return F.when(title_hit, weight * 40).when(text_hit, weight * 20).otherwise(F.lit(0.0))


def bonus(remote: Column, sector: Column) -> Column:
    return F.least(F.coalesce(remote, F.lit(0.0)) + F.coalesce(sector, F.lit(0.0)), F.lit(1.0)) * 15


def total(role: Column, skill: Column, extra: Column, off_domain: Column, missing: Column) -> Column:
    """Rounded to 1 place after each step, as the steps are part of the contract."""
    t = F.round(role + skill + extra, 1)
    t = F.when(off_domain, F.round(t * 0.55, 1)).otherwise(t)
    return F.when(missing >= 2, F.round(t * 0.5, 1)).when(missing == 1, F.round(t * 0.7, 1)).otherwise(t)


def unrounded(total_: Column, risk: Column, fit: Column) -> Column:
    discounted = total_ * (1 - 0.75 * risk)
    return F.when(fit.isNull(), discounted).otherwise(discounted * F.greatest(F.lit(0.82), F.least(F.lit(1.18), 1 + 4.5 * fit)))


def final(total_: Column, risk: Column, fit: Column) -> Column:
    return F.round(unrounded(total_, risk, fit), 1)


def tenths(c: Column) -> Column:
    """Rounded to tenths, halves up, where a product of decimals may be off in its last bit: 36 * 0.625 * 1.18, a little under 26.55 as a double, is 26.6. Times ten such halves are whole halves again."""
    return F.round(c * 10, 0) / 10
