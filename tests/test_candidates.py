import os

import pytest
from pyspark.sql import functions as F

from postlens.plans import ranking, standin

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("rows"))
    posts = standin.postings(spark.read.parquet(f"{DATA}/documents.parquet"))
    ranking.with_risk(ranking.facts(posts, F.to_timestamp(F.lit(standin.AS_OF)))).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def profiles(spark, n):
    """Profiles of one or two permits and families each; every 20th shows other professions, every 50th has no family, every 70th no permit."""
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.floor(F.col("id") / by), F.lit(len(values))).cast("int"))
    family = lambda by: F.struct(pick(["data", "software", "cloud", "health", "people", "finance", "legal"], by).alias("name"), (F.pmod("id", F.lit(5)) / 10 + 0.5).alias("weight"))
    permits = F.array_distinct(F.array(pick(["germany", "turkey", "israel", "canada", "usa", "remote_emea", "remote_global", "japan", "india"], 1), pick(["brazil", "spain", "germany", "kenya"], 9)))
    families = F.filter(F.array(family(3), family(11)), lambda f: F.pmod("id", F.lit(50)) != 7)
    full = standin.profiles(spark).where("profile_id = 'anna'").drop("profile_id", "permits", "families", "max_level", "show_off_domain", "max_years")
    some = spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("profile_id"), F.when(F.pmod("id", F.lit(70)) == 9, F.array().cast("array<string>")).otherwise(permits).alias("permits"), families.alias("families"), pick(["junior", "mid", "senior", "staff", None], 2).alias("max_level"), F.when(F.pmod("id", F.lit(20)) == 3, True).when(F.pmod("id", F.lit(40)) != 4, False).alias("show_off_domain"), F.lit(0).alias("max_years"))
    return some.join(F.broadcast(full))


def kept(rows, profiles, among=None):
    done = ranking.decided(ranking.scored(rows, profiles, among), min_score=5.0).where("verdict = 'kept'")
    return sorted(map(tuple, done.select("profile_id", "seq", "total", "final", "family").collect()))


@pytest.mark.parametrize("most", [10_000, 0])
def test_same_rows_are_kept(spark, rows, most, monkeypatch):
    """By broadcast and by the narrow join: what all pairs keep, and each pair once."""
    few = profiles(spark, 280)
    every = kept(rows, few)
    monkeypatch.setattr(ranking, "MAX_PROFILES", most)
    pairs = ranking.candidates(rows, few)
    assert len(every) > 50 and kept(rows, few, pairs) == every
    assert pairs.count() == pairs.select("profile_id", "seq").distinct().count()
    assert ranking.candidates(rows.limit(0), few).count() == 0 == ranking.candidates(rows, few.limit(0)).count()


def test_pairs_of_ten_thousand_profiles(spark, rows):
    """Most pairs are never made."""
    many = profiles(spark, 10_000)
    made = ranking.candidates(rows, many).count()
    assert 0 < made < rows.count() * 10_000 / 10
