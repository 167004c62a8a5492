"""From CV text to a profile: lines, dated weights, skills, experience, families, filters, queries. ``as_of`` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cv_normalised, nfc, unicode_pattern
from . import intervals, matching

#: CVs of one task.
EACH = 20_000
MONTHS = {"jan": 1, "oca": 1, "feb": 2, "şub": 2, "mar": 3, "apr": 4, "nis": 4, "may": 5, "jun": 6, "haz": 6, "jul": 7, "tem": 7, "aug": 8, "ağu": 8, "sep": 9, "eyl": 9, "oct": 10, "eki": 10, "nov": 11, "kas": 11, "dec": 12, "ara": 12, "spring": 3, "summer": 6, "fall": 9, "autumn": 9, "winter": 1}
_MONTH = "(" + "|".join(MONTHS) + r")\w*\.?"
_NOW = r"present|current|now|today|günümüz|halen|devam"
RANGE = unicode_pattern(rf"(?:{_MONTH}\s+)?((?:19|20)[0-9]{{2}})(?:\s+{_MONTH})?\s*(?:-|–|—|to)\s*(?:(?:{_MONTH}\s+)?((?:19|20)[0-9]{{2}})(?:\s+{_MONTH})?|({_NOW}))")
YEAR = "(?:19|20)[0-9]{2}"
#: "June - July 2024": one year for both months. "Summer 2025": no months at all.
MONTHS_OF_YEAR = unicode_pattern(r"(?<![\w/])(\p{L}{3,9})\.?\s*(?:--?|–|—|to|ile)\s*(\p{L}{3,9})\.?\s+((?:19|20)[0-9]{2})(?![\w/])")
SEASON = unicode_pattern(r"\b(spring|summer|fall|autumn|winter|yaz)\s+((?:19|20)[0-9]{2})\b")
SECTIONS = (("experience", r"^\W*(work |professional )?(experience|employment)|^\W*(iş )?deneyim"), ("education", r"^\W*education|^\W*eğitim"), ("skills", r"^\W*(technical )?skills|^\W*(teknik )?(yetenek|beceri)"), ("other", r"^\W*(projects|languages|references|certificates|projeler|diller|referanslar|sertifikalar)\W*$"))
SAID = unicode_pattern(r"([0-9]{1,2})\+?\s*(?:years?|yıl)\w*\s+(?:of\s+)?(?:\w+\s+){0,2}(?:experience|deneyim|tecrübe)")
VOLUNTEER, EDUCATION = unicode_pattern(r"\b(volunteer|gönüllü)"), unicode_pattern(r"\b(university|degree|bachelor|master|üniversite|lisans)")


def _month(*months: Column) -> Column:
    """Number of the first month or season that is known, else null."""
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    lower = [F.lower(F.nullif(m, F.lit(""))) for m in months]
    return F.coalesce(*[F.try_element_at(table, F.left(m, F.lit(3))) for m in lower], *[F.try_element_at(table, m) for m in lower])


def _year(year: Column, *months: Column) -> Column:
    """Decimal year; the month is the first that is given, else January."""
    return F.nullif(year, F.lit("")).cast("double") + (F.coalesce(_month(*months), F.lit(1)) - 1) / 12


def _short_period(line: Column) -> Column:
    """struct(start, end) of a period with one year: from month to month, the last one included, or else two months of a season; null without any.

    Of the two words before the year one has to be a month (the other then counts as July), so that two plain words with a dash are none; a last month before the first one is none either.
    """
    m = lambda i: F.regexp_extract(line, MONTHS_OF_YEAR, i)
    first, last = F.coalesce(_month(m(1)), F.lit(7)), F.coalesce(_month(m(2)), F.lit(7))
    year = F.nullif(m(3), F.lit("")).cast("double")
    span = lambda y, a, months: F.struct((y + (a - 1) / 12).alias("start"), (y + (a - 1 + months) / 12).alias("end"))
    told = year.isNotNull() & F.coalesce(_month(m(1)), _month(m(2))).isNotNull() & (last >= first)
    season = F.nullif(F.regexp_extract(line, SEASON, 2), F.lit("")).cast("double")
    return F.when(told, span(year, first, last - first + 1)).when(season.isNotNull(), span(season, F.coalesce(_month(F.regexp_extract(line, SEASON, 1)), F.lit(6)), F.lit(2)))


def dealt(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` by key in at least as many tasks as a shuffle has, each of about ``EACH`` CVs at most."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(max(parts, -(-docs.count() // EACH)), key)


def lines(docs: DataFrame, key: str, text: str, as_of: Column) -> DataFrame:
    """key, line_no, line, section, start, end, weight, kind of each line.

    A line's weight comes from the end date that holds for it: its own, or the last one above it in the same section. Lines of the skills section have kind ``skill``.
    """
    now = F.year(as_of) + (F.month(as_of) - 1) / 12
    # dealt before lines are made: a small file holds many CVs, which one task would read line by line
    docs = dealt(docs.select(key, text), key)
    each = docs.select(key, F.posexplode(F.split(cv_normalised(nfc(F.col(text))), "\n")).alias("line_no", "line"))
    # every period has a year, so the long patterns see no other lines; those are null here
    each = each.withColumn("__dated", F.when(F.col("line").rlike(YEAR), F.col("line")))
    g = lambda i: F.regexp_extract("__dated", RANGE, i)
    section = F.coalesce(*[F.when(F.col("line").rlike(unicode_pattern(p)) & (F.length("line") < 40), F.lit(n)) for n, p in SECTIONS])
    dated = each.withColumn("heading", section).withColumn("start", _year(g(2), g(1), g(3)))
    # a period with two years goes before one with a single year
    dated = dated.withColumn("end", F.when(F.col("start").isNotNull(), F.coalesce(_year(g(5), g(4), g(6)), now))).withColumn("__short", _short_period(F.col("__dated")))
    dated = dated.withColumn("end", F.when(F.col("start").isNull(), F.col("__short.end")).otherwise(F.col("end"))).withColumn("start", F.coalesce("start", "__short.start")).drop("__short")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = dated.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit("top")))
    carried = intervals.carried(placed, [key], ["line_no"], F.col("end"), F.col("heading").isNotNull(), "__end")
    weight = F.when(F.col("section") == "skills", F.lit(1.0)).when(F.col("__end").isNotNull(), intervals.half_life(now - F.col("__end"))).otherwise(F.lit(1.0))
    kind = F.when(F.col("heading").isNotNull(), "heading").when(F.col("section") == "skills", "skill").when(F.col("__end").isNotNull(), "dated").otherwise("undated")
    return carried.select(key, "line_no", "line", "section", "start", "end", weight.alias("weight"), kind.alias("kind"))


def skills(lines_: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """key, canonical, weight, strength, recency: evidence of each dictionary entry in a CV's lines."""
    met = matching.token_matches(lines_.where("kind <> 'heading'"), [key, "line_no", "weight", "kind"], "line", terms)
    dated = F.max(F.when(F.col("kind") == "dated", F.col("weight")))
    listed, undated = F.bool_or(F.col("kind") == "skill"), F.bool_or(F.col("kind") == "undated")
    found = met.groupBy(key, "canonical").agg(F.sum(0.5 + 0.5 * F.col("weight")).alias("s"), dated.alias("d"), listed.alias("listed"), undated.alias("undated"))
    recency = F.when(F.col("d").isNotNull(), F.when(F.col("listed"), F.greatest("d", F.lit(0.6))).otherwise(F.col("d"))).when(F.col("undated"), F.lit(1.0))
    weight = F.least(F.lit(1.0), F.least("s", F.lit(6.0)) / 6 + F.when(F.col("listed"), 0.35 * F.coalesce(recency, F.lit(1.0))).otherwise(0.0))
    out = found.select(key, "canonical", F.round(weight, 3).alias("evidence"), recency.alias("recency"))
    return out.select(key, "canonical", F.when(F.col("evidence") >= 0.45, F.col("evidence")).otherwise(F.col("evidence") / 2).alias("weight"), matching.strength(F.col("evidence")).alias("strength"), "recency")


def experience(docs: DataFrame, lines_: DataFrame, key: str, text: str) -> DataFrame:
    """key, years: what the text says of itself, else the union of the experience section's intervals, else of all but education and volunteering."""
    near = lambda before, after: F.array_join(F.collect_list("line").over(intervals.neighbours([key], ["line_no"], before, after)), "\n")
    marked = lines_.withColumn("school", near(1, 1).rlike(EDUCATION) | (F.col("section") == "education")).withColumn("free", near(1, 2).rlike(VOLUNTEER))
    work = intervals.union_length(marked.where((F.col("section") == "experience") & ~F.col("free")), [key], "start", "end").select(key, F.col("length").alias("w"))
    whole = intervals.union_length(marked.where(~F.col("school") & ~F.col("free")), [key], "start", "end").select(key, F.col("length").alias("a"))
    said = docs.select(key, F.nullif(F.regexp_extract(text, SAID, 1), F.lit("")).cast("double").alias("said"))
    return said.join(work, key, "left").join(whole, key, "left").select(key, F.round(F.coalesce("said", "w", "a", F.lit(0.0)), 1).alias("years"))


def seniority(text: Column, years: Column) -> Column:
    head = F.left(text, F.lit(900))
    lead = head.rlike(unicode_pattern(r"\b(staff|principal|director|head of|chief|vp)\b")) & ~head.rlike(unicode_pattern(r"\bassistant to\b"))
    return F.when(lead, "staff").when((years >= 6) | head.rlike(unicode_pattern(r"\b(senior|lead|kıdemli)\b")), "senior").when(years >= 2.5, "mid").otherwise("junior")


def practitioner(text: Column) -> Column:
    """Whether one of the first three lines with text (up to 250 characters) names a trade."""
    first = F.slice(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & (F.length(x) <= 250)), 1, 3)
    return F.exists(first, lambda x: x.rlike(unicode_pattern(r"\b(technician|operator|driver|welder|cashier|teknisyen|operatör|şoför|kaynakçı|kasiyer)\b")))


def families(skills_: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """key, family, weight, recency: active families by weight; those under 70 % of the best go."""
    triggers = catalogue.select("family", "least", F.explode(F.concat(F.transform("strong", lambda s: F.struct(s.alias("canonical"), F.lit(True).alias("strong"))), F.transform("supporting", lambda s: F.struct(s.alias("canonical"), F.lit(False).alias("strong"))))).alias("t")).select("family", F.col("t.canonical").alias("canonical"), F.col("t.strong").alias("strong"), "least")
    active = matching.activated(skills_, triggers, key, "canonical", "family")
    strong = skills_.join(triggers, "canonical").groupBy(key, "family").agg(F.max(F.when(F.col("strong"), F.col("recency"))).alias("rs"), F.max("recency").alias("ra"))
    rows = active.join(strong, [key, "family"]).join(catalogue.select("family", F.col("weight").alias("base"), "ord"), "family")
    ready = rows.select(key, "family", "base", "ord", (F.col("n_strong") + F.col("n_support")).alias("triggers"), F.coalesce("rs", "ra", F.lit(1.0)).alias("recency"), (F.col("n_strong") > 0).alias("has_strong"))
    weighted = ready.withColumn("weight", matching.family_weight(ready, "base", "triggers", "recency", "has_strong", [key]))
    best = F.max("weight").over(Window.partitionBy(key))
    return weighted.withColumn("best", best).where(F.col("weight") >= 0.7 * F.col("best")).select(key, "family", "weight", "recency", F.row_number().over(Window.partitionBy(key).orderBy(F.col("weight").desc(), "ord")).alias("rank"))


def self_sentence(family: Column, level: Column, top: Column) -> Column:
    """Sentence of the own profession for the vector contrast: at most 16 skills, best first."""
    return F.concat_ws(" ", F.initcap(level), family, F.lit("with experience in"), F.array_join(F.slice(top, 1, 16), ", "))


#: pattern, families that it doesn't concern: titles that are no option for others.
FILTERS = (
    (r"\b(recruiter|talent acquisition|headhunter)\b", ("people",)), (r"\b(sales|account executive|business development)\b", ("sales",)), (r"\b(nurse|physician|caregiver|hemşire)\b", ("health",)), (r"\b(accountant|auditor|bookkeeper|muhasebeci)\b", ("finance",)), (r"\b(intern|trainee|stajyer)\b", ()),
    (r"\b(teacher|tutor|öğretmen)\b", ("teaching",)), (r"\b(lawyer|attorney|avukat)\b", ("law",)), (r"\b(driver|courier|warehouse|forklift)\b", ("logistics",)), (r"\b(call cent(er|re)|customer (service|support))\b", ("service",)),
    # managers of people, not of products and projects
    (r"(?<!product )(?<!project )(?<!program )\bmanager\b", ("people", "sales", "product", "hospitality")),
)
#: Titles above a level.
ABOVE = {"junior": r"\b(senior|sr|lead|principal|staff|head of|director|vp|chief)\b", "mid": r"\b(principal|staff|head of|director|vp|chief)\b", "senior": r"\b(head of|director|vp|chief)\b"}


def forbidden_patterns(own: Column, level: Column) -> Column:
    """Patterns of FILTERS that none of the own families is exempt from, and that of the titles above the own level."""
    rules = F.array(*[F.struct(F.lit(unicode_pattern(p)).alias("p"), F.array(*[F.lit(x) for x in e]).cast("array<string>").alias("e")) for p, e in FILTERS])
    above = F.create_map(*[F.lit(x) for name, p in ABOVE.items() for x in (name, unicode_pattern(p))])
    kept = F.transform(F.filter(rules, lambda r: ~F.arrays_overlap(r["e"], F.coalesce(own, F.array().cast("array<string>")))), lambda r: r["p"])
    return F.array_compact(F.concat(kept, F.array(F.try_element_at(above, level))))


def forbidden(families_: DataFrame, key: str) -> DataFrame:
    """key, forbidden: the patterns of each owner of families, whatever their level."""
    held = families_.groupBy(key).agg(F.collect_set("family").alias("own"))
    return held.select(key, forbidden_patterns(F.col("own"), F.lit(None).cast("string")).alias("forbidden"))


def fingerprint(*parts: str) -> str:
    """12 hex digits of what an engine's results depend on; a profile with another one is made anew."""
    import hashlib

    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:12]


def refreshed(old: dict, new: dict, edited: tuple[str, ...]) -> dict:
    """A new profile with the old one's values of the fields that a user has changed."""
    return {**new, **{k: old[k] for k in edited if k in old}}
