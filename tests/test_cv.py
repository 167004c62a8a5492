from pyspark.sql import functions as F

from postlens import catalog
from postlens.operators import cv

TEXT = """Jane Doe
Senior Data Engineer
E X P E R I E N C E
Data Engineer, Acme          Jan 2020 – Present
- built pipelines with Spark and Kafka
Analyst, Globex              2015 - 2017
- reports in SQL and Excel
Education
BSc, University of Somewhere 2010 - 2014
Skills
Python, Spark, Airflow"""


def test_profile(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "")], "id int, text string")
    lines = cv.lines(docs, "id", "text", F.to_date(F.lit("2026-01-01"))).cache()
    weights = {r.line: (r.weight, r.kind) for r in lines.where("id = 1").collect()}
    assert weights["- built pipelines with Spark and Kafka"] == (1.0, "dated") and weights["- reports in SQL and Excel"][0] < 0.5
    skills = cv.skills(lines, "id", catalog.skills(spark))
    got = {r.canonical: (r.strength, r.recency) for r in skills.collect()}
    assert got["Spark"][0] == "strong" and got["Airflow"][1] is None and got["SQL"][1] < 0.5
    years = {r.id: r.years for r in cv.experience(docs, lines, "id", "text").collect()}
    assert years == {1: 8.0, 2: 0.0}
    families = [r.family for r in cv.families(skills, catalog.families(spark), "id").orderBy("rank").collect()]
    assert families[0] == "data"
    level = docs.where("id = 1").select(cv.seniority(F.col("text"), F.lit(8.0)).alias("l"), cv.practitioner(F.col("text")).alias("p")).first()
    assert (level.l, level.p) == ("senior", False)


def test_forbidden_titles(spark):
    import re

    row = spark.range(1).select(cv.forbidden_patterns(F.array(F.lit("data")), F.lit("mid")).alias("a"), cv.forbidden_patterns(F.array(F.lit("sales")), F.lit("staff")).alias("b")).first()
    hit = lambda patterns, title: spark.range(1).select(F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.regexp_like(F.lit(title), p)).alias("x")).first().x
    assert hit(row.a, "Engineering Manager") and not hit(row.a, "Product Manager") and hit(row.a, "Head of Data") and not hit(row.a, "Senior Data Engineer")
    assert not hit(row.b, "Sales Manager") and not hit(row.b, "Head of Sales") and hit(row.b, "Nurse") and all(re.match(r"\(\?iU\)", p) for p in row.a)


def test_periods_of_one_year(spark):
    said = {"June - July 2011": 2, "June – July 2011": 2, "Haziran ile Temmuz 2011": 2, "Summer 2010": 2, "winter 2010": 2, "Jan 2010 - Mar 2010": 2, "Nov - Feb 2011": 0, "Control - Automation 2011": 0, "Jan - Dec. 2011": 12, "Summer 2010, June - July 2011": 2, "2010 - 2011, June - July 2015": 12, "nothing": 0, "": 0}
    docs = spark.createDataFrame([(i, f"Experience\n{t}") for i, t in enumerate(said)], "id int, text string")
    got = {r.id: r.years for r in cv.experience(docs, cv.lines(docs, "id", "text", F.to_date(F.lit("2026-01-01"))), "id", "text").collect()}
    assert got == {i: round(m / 12, 1) for i, m in enumerate(said.values())}
