"""Column expressions for text, keys and dates. The evaluation time is always an argument."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unicode_pattern(pattern: str, ignore_case: bool = True) -> str:
    """Java reads classes and case as Unicode only with the U flag; without it other languages' letters are no letters."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def term_pattern(term: str, case_sensitive: bool = False) -> str:
    """A dictionary term as a pattern: short names stand alone, long ones may take an ending."""
    import re

    body = r"\s+".join(re.escape(x) for x in term.split())
    tail = r"\w{0,6}" if " " in term or len(term) >= 7 else ""
    bound = r"[\w+#&]" if len(term) <= 3 else r"\w"
    return unicode_pattern(rf"(?<!{bound}){body}{tail}(?!{bound})", ignore_case=not case_sensitive)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def listed_text(c: Column, between: str = ", ") -> Column:
    """An array as text; nulls and empty items don't count."""
    return F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), between)


def or_else(*cols: Column) -> Column:
    """First column that is neither null nor empty: the reading of ``a or b`` for text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def uid(source: Column, token: Column, native: Column) -> Column:
    return F.concat_ws(":", source, token, native)


def title_key(token: Column, title: Column) -> Column:
    t = F.regexp_replace(F.lower(text_or_empty(title)), r"\([^)]*\)|\[[^\]]*\]", " ")
    t = F.regexp_replace(t, r"[^a-z0-9+#]+", " ")
    t = F.regexp_replace(t, r"\b(remote|hybrid|onsite|fmd|mfd|w)\b", " ")
    return F.concat(token, F.lit("|"), F.trim(F.regexp_replace(t, r"\s+", " ")))


def content_hash(title: Column, locations: Column, description: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", title, F.array_join(F.array_sort(locations), "|"), description), 256), F.lit(16))


def age_days(posted: Column, updated: Column, as_of: Column) -> Column:
    at = F.coalesce(posted, updated)
    return F.when(at.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000.0))


def combined_text(title: Column, department: Column, locations: Column, description: Column) -> Column:
    return F.concat_ws("\n", title, department, F.array_join(locations, " "), description)


#: Named entities (fixed values) that are resolved in place, ``&amp;`` last so that nothing is resolved twice; the whole table is for :func:`unescaped`.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&rsquo;", "\u2019"), ("&lsquo;", "\u2018"), ("&rdquo;", "\u201d"), ("&ldquo;", "\u201c"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&bull;", "\u2022"), ("&euro;", "\u20ac"), ("&uuml;", "ü"), ("&ouml;", "ö"), ("&auml;", "ä"), ("&szlig;", "ß"), ("&ccedil;", "ç"), ("&eacute;", "é"), ("&amp;", "&"))
_NUMERIC = r"&#(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});"


def entities_resolved(c: Column) -> Column:
    """Numbered entities and the named ones of ENTITIES, each once; numbers beyond Unicode stay."""

    def character(n: Column) -> Column:
        return F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def number(code: Column) -> Column:
        return F.when(F.startswith(code, F.lit("x")), F.conv(F.substring(code, F.lit(2), F.lit(6)), 16, 10).cast("long")).otherwise(code.cast("long"))

    def rebuilt(t: Column) -> Column:
        # both arrays are arguments, so that the text is searched once and not for each of its entities
        pairs = F.zip_with(F.split(t, _NUMERIC, -1), F.regexp_extract_all(t, F.lit(_NUMERIC), F.lit(1)), lambda x, code: F.struct(x.alias("x"), code.alias("code"), number(code).alias("n")))
        return F.array_join(F.transform(pairs, lambda p: F.concat(p["x"], F.coalesce(character(p["n"]), F.concat(F.lit("&#"), p["code"], F.lit(";")), F.lit("")))), "")

    c = F.when(F.contains(c, F.lit("&#")), rebuilt(c)).otherwise(c)
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_text(c: Column) -> Column:
    """Markup, escaped or not, to text: entities first, as feeds escape whole documents; no scripts and styles, breaks and closed blocks as lines, items as bullets, white space squeezed."""
    c = entities_resolved(text_or_empty(c))
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)<br[^>]*>|</(p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|section|article)>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<li[^>]*>", "- "), r"<[^>]*>", " ")
    # what was escaped twice inside escaped markup is text by now
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\r]+", " "), r" ?\n ?", "\n")
    return F.btrim(F.regexp_replace(c, r"\n{3,}", "\n\n"), F.lit(" \n"))


@F.pandas_udf(T.StringType())
def unescaped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All named and numbered entities; there is no built-in for them."""
    for s in texts:
        yield s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Composed Unicode form; there is no built-in for it. Plain ASCII passes at once."""
    for s in texts:
        yield s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


MOJIBAKE = r"[ÃÂÄÅâ][\x{80}-\x{BF}]"


def mojibake_repaired(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, undone where that leaves fewer marks of it and nothing is lost."""
    raw = F.encode(c, "ISO-8859-1")
    fits = ~c.rlike(r"[^\x{00}-\x{FF}]")
    fixed = F.when(fits, F.decode(raw, "UTF-8"))
    ok = F.is_valid_utf8(raw.cast("string")) & (F.regexp_count(fixed, F.lit(MOJIBAKE)) < F.regexp_count(c, F.lit(MOJIBAKE)))
    return F.when(fits & F.coalesce(ok, F.lit(False)), fixed).otherwise(c)


def any_date(c: Column) -> Column:
    """Text as a timestamp in UTC: epoch seconds or milliseconds, ISO with or without zone; null where it is none of these."""
    number = F.when(c.rlike(r"^[0-9]{9,14}(\.[0-9]+)?$"), F.try_to_number(F.regexp_extract(c, "^[0-9]+", 0), F.lit("99999999999999")).cast("long"))
    epoch = F.when(number >= 100_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    return F.coalesce(epoch, F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(c)))


def local_date(c: Column, hours: int = 3) -> Column:
    """ISO text without a zone is local time, ``hours`` ahead of UTC."""
    zoned = c.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(zoned, F.try_to_timestamp(c)).otherwise(F.try_to_timestamp(c) - F.expr(f"INTERVAL {hours} HOURS"))


#: Days of each unit in relative ages.
UNIT_DAYS = {"saat": 0, "gün": 1, "hafta": 7, "ay": 30, "yıl": 365, "hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}


def relative_days(c: Column) -> Column:
    low = F.lower(c)
    unit = F.regexp_extract(low, "(" + "|".join(UNIT_DAYS) + ")", 1)
    table = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])
    n = F.regexp_extract(low, "([0-9]+)", 1)
    return F.when(F.contains(low, F.lit("bugün")) | F.contains(low, F.lit("today")), F.lit(0)).when((unit != "") & (n != ""), n.cast("int") * F.try_element_at(table, unit))


_FOLD = ("çğıöşüÇĞİÖŞÜâîûéèêëáàäíìïóòôúùñß", "cgiosuCGIOSUaiueeeeaaaiiiooouuns")


def ascii_folded(c: Column) -> Column:
    return F.translate(c, *_FOLD)


def slug(c: Column) -> Column:
    """Lower-cased ASCII words joined by +."""
    plain = F.regexp_replace(F.lower(ascii_folded(c)), r"[^a-z0-9 ]+", " ")
    return F.replace(F.trim(F.regexp_replace(plain, " +", " ")), F.lit(" "), F.lit("+"))


def url_joined(base: Column, path: Column) -> Column:
    """``path`` as seen from the page ``base``: whole addresses stay, rooted paths are of the same host, others of the same folder; spaces are quoted."""
    origin, folder = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1), F.regexp_extract(base, r"^([a-z]+://[^/?#]+(?:/[^?#]*/)?)", 1)
    joined = F.when(path.rlike("^[a-z]+://"), path).when(F.startswith(path, F.lit("//")), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), path)).when(F.startswith(path, F.lit("/")), F.concat(origin, path))
    return F.replace(joined.otherwise(F.concat(folder, F.when(F.endswith(folder, F.lit("/")), "").otherwise("/"), path)), F.lit(" "), F.lit("%20"))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def token_set(c: Column, stop: tuple[str, ...] = ()) -> Column:
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9+#]+", " "), " "), lambda x: x != ""))
    return F.array_except(words, F.array(*[F.lit(s) for s in stop])) if stop else words


def spaced_heading(line: Column) -> Column:
    """Letters set apart (``E X P`` or ``DE NE YİM``) as one word: four or more groups of one to three capitals."""
    parts = F.split(F.trim(line), r"\s+")
    spaced = (F.size(parts) >= 4) & F.forall(parts, lambda x: x.rlike(r"^[A-ZÇĞİÖŞÜ]{1,3}$"))
    return F.when(spaced, F.array_join(parts, "")).otherwise(line)


def cv_normalised(c: Column) -> Column:
    """Years split by a space, words cut at a line's end, and dashes left alone at it, put right; composed form is :func:`nfc`'s task."""
    c = F.regexp_replace(c, r"\b([12]) ([0-9]{3})\b|\b([12][0-9]) ([0-9]{2})\b|\b([12][0-9]{2}) ([0-9])\b", "$1$2$3$4$5$6")
    c = F.regexp_replace(c, r"(\p{L})-\n(\p{Ll})", "$1$2")
    c = F.regexp_replace(c, r"[–—-] *\n *(?=[0-9]|\p{Lu})", "– ")
    return F.array_join(F.transform(F.split(c, "\n"), spaced_heading), "\n")


#: Mode by wording; hybrid goes before remote, as hybrid postings name remote days.
MODES = ((r"\b(hybrid|hibrit)\b", "hybrid"), (r"\b(remote|uzaktan|work from home|evden)\b", "remote"), (r"\b(on-?site|in office|office|ofis)\b", "office"))


def work_mode(declared: Column, text: Column, remote: Column | None = None, locations: Column | None = None) -> Column:
    """A declared field beats the remote flag, that the wording of the locations, and that free text; hybrid goes before remote, remote before office. A place alone means the office."""

    def named(where: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, name in reversed(MODES):
            out = F.when(where.rlike(unicode_pattern(pattern)), F.lit(name)).otherwise(out)
        return out

    steps = [named(declared)]
    if remote is not None:
        steps.append(F.when(remote, F.lit("remote")))
    if locations is not None:
        steps.append(named(F.array_join(locations, " / ")))
    steps.append(named(text))
    if locations is not None:
        steps.append(F.when(F.size(locations) > 0, F.lit("office")))
    return F.coalesce(*steps, F.lit("unknown"))


EMPLOYMENT = {"full-time": "full", "full_time": "full", "fulltime": "full", "permanent": "full", "part-time": "part", "part_time": "part", "contract": "contract", "contractor": "contract", "temporary": "contract", "intern": "intern", "internship": "intern", "freelance": "freelance"}


def employment_type(declared: Column, text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EMPLOYMENT.items() for x in kv])
    rules = ((r"\b(intern(ship)?|staj(yer)?)\b", "intern"), (r"\b(part[- ]time|yarı zamanlı)\b", "part"), (r"\b(freelance|serbest)\b", "freelance"), (r"\b(contract(or)?|sözleşmeli|temporary)\b", "contract"), (r"\b(full[- ]time|tam zamanlı|permanent)\b", "full"))
    out = F.lit("unknown")
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(unicode_pattern(pattern)), F.lit(name)).otherwise(out)
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(declared))), out)


def hours_ago(at: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 3600)
