"""How likely a posting is not a real opening: additive evidence within 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import unicode_pattern

POOL_TITLE = unicode_pattern(r"\b(talent (pool|community)|general application|open application|genel başvuru|aday havuzu)\b")
POOL_TEXT = unicode_pattern(r"\b(future (openings|opportunities)|upcoming positions|ileride açılacak)\b")
#: Age in days above which a share of risk is added, oldest first.
AGE_TIERS = ((1095, 0.85), (730, 0.70), (365, 0.50), (180, 0.35))


def age_term(age: Column, max_age: float = 120.0) -> Column:
    out = F.when(age <= 14, F.lit(-0.10)).otherwise(F.lit(0.0))
    for days, share in [(max_age, 0.20), *reversed(AGE_TIERS)]:
        out = F.when(age > days, F.lit(share)).otherwise(out)
    return F.when(age.isNull(), F.lit(0.25)).otherwise(out)


def risk(age: Column, pool_title: Column, pool_text: Column, n_locations: Column, same_title: Column, fake_refresh: Column, reposts: Column, max_age: float = 120.0) -> Column:
    flag = lambda c, share: F.when(c, share).otherwise(F.lit(0.0))
    total = age_term(age, max_age) + flag(pool_title, 0.45) + flag(pool_text, 0.25) + flag(n_locations >= 10, 0.15) + flag(same_title >= 3, 0.10) + flag(fake_refresh, 0.35) + F.least(0.15 * reposts, F.lit(0.35))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def band(risk_: Column) -> Column:
    return F.when(risk_ >= 0.70, "ghost").when(risk_ >= 0.45, "doubtful").when(risk_ >= 0.20, "normal").otherwise("fresh")


def evidence(seen: Column, fake_refresh: Column, reposts: Column) -> Column:
    return F.when(fake_refresh | (reposts > 0), "strong").when(seen > 1, "medium").otherwise("weak")


def reasons(age: Column, pool_title: Column, pool_text: Column, n_locations: Column, same_title: Column, fake_refresh: Column, reposts: Column) -> Column:
    """Signed reasons in a fixed order: + adds to the risk, - takes from it."""
    return F.array_compact(
        F.array(
            F.when(age.isNull(), "+no date").when(age > 120, F.concat(F.lit("+open for "), F.floor(age).cast("string"), F.lit(" days"))).when(age <= 14, "-new"),
            F.when(pool_title, "+pool title"), F.when(pool_text, "+pool text"), F.when(n_locations >= 10, "+many places"), F.when(same_title >= 3, "+same title"), F.when(fake_refresh, "+date moved, text same"), F.when(reposts > 0, "+posted again"),
        )
    )
