"""Where a posting is, and whether a profile may take it. Unknown means no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import COUNTRIES
from ..functions.text import ascii_folded, unicode_pattern

GLOBAL = unicode_pattern(r"\b(worldwide|anywhere in the world|work from anywhere|remote,? global|global remote)\b")
EMEA = unicode_pattern(r"\b(emea|europe, middle east|cet)\b")
EUROPE = unicode_pattern(r"\banywhere in europe\b")
US_LOCK = unicode_pattern(r"\b(us|u\.s\.|united states) (only|based|residents)\b|\bauthorized to work in the (us|united states)\b")
MODE_WORDS = unicode_pattern(r"\b(remote|hybrid|on-?site|office|uzaktan|hibrit)\b")


def location_tokens(locations: Column) -> Column:
    """(token, pass): pieces of each location; pass 2 also cuts at hyphens."""
    plain = F.transform(locations, lambda x: F.regexp_replace(F.lower(x), MODE_WORDS, " "))
    cut = lambda pattern: F.filter(F.transform(F.flatten(F.transform(plain, lambda x: F.split(x, pattern))), lambda t: F.trim(t)), lambda t: t != "")
    first, second = cut(r"[,/|()\[\]&+;]| and "), cut(r"[,/|()\[\]&+;-]| and ")
    return F.array_distinct(F.concat(F.transform(first, lambda t: F.struct(t.alias("token"), F.lit(1).alias("pass"))), F.transform(second, lambda t: F.struct(t.alias("token"), F.lit(2).alias("pass")))))


def countries(postings: DataFrame, key: str, locations: str, places: DataFrame) -> DataFrame:
    """key, countries: tags of the first tier that finds any: whole pieces before hyphen parts, countries before states and regions before cities."""
    each = postings.select(key, F.explode(location_tokens(F.col(locations))).alias("x")).select(key, F.col("x.token").alias("token"), F.col("x.pass").alias("pass"))
    found = each.join(places, "token").withColumn("rank", F.when(F.col("tier") == 3, 4 + F.col("pass")).otherwise(2 * F.col("pass") + (F.col("tier") - 1)))
    tags = found.groupBy(key, "rank").agg(F.array_sort(F.collect_set("tag")).alias("countries"))
    return tags.groupBy(key).agg(F.min_by("countries", "rank").alias("countries"))


def decision(locations: Column, title: Column, text: Column, remote: Column, countries_: Column, permits: Column) -> Column:
    """struct(status, ok) in the order that is documented: home country, global, region, countries, remote wording, refusal."""
    field = F.array_join(locations, " / ")
    where = F.concat_ws(" ", field, title)
    may = lambda tag: F.array_contains(permits, tag)
    names = F.create_map(*[F.lit(x) for tag, name, _, _ in COUNTRIES for x in (tag, name)])
    shown = F.array_join(F.transform(countries_, lambda t: F.coalesce(F.try_element_at(names, t), t)), "/")
    hit = F.arrays_overlap(countries_, permits) | (may("remote_emea") & remote & text.rlike(EUROPE))
    result = lambda status, ok: F.struct((status if isinstance(status, Column) else F.lit(status)).alias("status"), ok.alias("ok"))
    no = F.lit(False)
    far = F.coalesce(remote, F.lit(False))
    return (
        F.when(where.rlike(unicode_pattern(r"\b(t[uü]rk(iye|ey)|istanbul|ankara|izmir)\b")), result("home", may("turkey")))
        .when(F.lower(F.trim(field)).isin("global", "worldwide", "anywhere") | where.rlike(GLOBAL), result("global", may("remote_global")))
        .when(where.rlike(EMEA), result("emea", may("remote_emea")))
        .when(F.size(F.coalesce(countries_, F.array().cast("array<string>"))) > 0, result(F.concat(F.when(far, "remote, ").otherwise(""), shown, F.when(F.coalesce(hit, no), "").otherwise(" - no permit")), F.coalesce(hit, no)))
        .when(far & F.left(text, F.lit(3000)).rlike(US_LOCK), result("remote, us only", no))
        .when(far & F.left(text, F.lit(3000)).rlike(GLOBAL), result("remote, global", may("remote_global")))
        .when(far & F.left(text, F.lit(3000)).rlike(EMEA), result("remote, emea", may("remote_emea")))
        .when(far, result("remote, unclear", no))
        .when(F.size(locations) > 0, result(F.concat(F.lit("office: "), F.array_join(F.slice(locations, 1, 2), ", ")), no))
        .otherwise(result("no location", no))
    )


def city_suffix(locations: Column, cities: dict[str, str]) -> Column:
    """`` · City`` of the first location of the home country whose parts name a known city (folded name -> shown name); empty without one."""
    home = F.filter(locations, lambda x: x.rlike(unicode_pattern(r"\b(t[uü]rk(iye|ey)|istanbul|ankara|izmir|bursa|antalya)\b")))
    parts = F.transform(F.split(F.get(home, F.lit(0)), r"[,/|()\-]"), lambda x: F.lower(ascii_folded(F.trim(x))))
    names = F.create_map(*[F.lit(x) for kv in cities.items() for x in kv])
    found = F.get(F.filter(F.transform(parts, lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(F.concat(F.lit(" · "), found), F.lit(""))


def granting(locations: Column, title: Column, text: Column, remote: Column, countries_: Column) -> Column:
    """Permits of which any one makes :func:`decision` say yes, in the same order of cases; empty where none does. Known of a posting without a profile."""
    field = F.array_join(locations, " / ")
    where = F.concat_ws(" ", field, title)
    tags = lambda *names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    far = F.coalesce(remote, F.lit(False))
    held = F.coalesce(countries_, tags())
    return (
        F.when(where.rlike(unicode_pattern(r"\b(t[uü]rk(iye|ey)|istanbul|ankara|izmir)\b")), tags("turkey"))
        .when(F.lower(F.trim(field)).isin("global", "worldwide", "anywhere") | where.rlike(GLOBAL), tags("remote_global"))
        .when(where.rlike(EMEA), tags("remote_emea"))
        .when(F.size(held) > 0, F.array_distinct(F.concat(held, F.when(far & F.coalesce(text.rlike(EUROPE), F.lit(False)), tags("remote_emea")).otherwise(tags()))))
        .when(far & F.left(text, F.lit(3000)).rlike(US_LOCK), tags())
        .when(far & F.left(text, F.lit(3000)).rlike(GLOBAL), tags("remote_global"))
        .when(far & F.left(text, F.lit(3000)).rlike(EMEA), tags("remote_emea"))
        .otherwise(tags())
    )
