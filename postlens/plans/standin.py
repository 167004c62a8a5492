"""Postings, profiles and payloads made of the driver's tables, so that whole plans can be run and checked on them. The SQL beside it says the same on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-06-01 00:00:00"
#: Parts of the stand-in postings; each document takes one of each list by its id.
LEVELS = ("Senior", "Junior", "Lead", "", "Mid/Senior", "Principal")
ROLES = ("Data Engineer", "Backend Developer", "DevOps Engineer", "Nurse", "Recruiter", "Machine Operator", "Accountant", "Java Data Analyst")
SUFFIXES = ("", " | Germany | Remote", " (Berlin)", " - Hybrid", " | Canada")
PLACES = (("Remote - Germany",), ("Istanbul, Turkey",), ("Tel Aviv-Yafo",), ("United States & Canada",), ("Mars",), (), ("Remote, EMEA",))
INTROS = ("At least 5 years of experience with Python, Spark and Kafka.", "We have 15 years of experience in logistics.", "3-6 years experience required. Docker, Kubernetes and AWS.", "There is no visa sponsorship.", "Fluent German required; SQL and Excel.", "This is for future openings.", "", "12 years of experience. Java, SQL and Airflow.", "Patient care and amazon web services.")
DEPARTMENTS = ("Engineering", "", "Data Engineer guild")

#: profile_id, permits, max_level, max_years, forbidden, needs_sponsor, languages, practitioner, show_off_domain, families, weights, remote_bonus, sectors
PROFILES = (
    ("anna", ["germany", "remote_emea"], "senior", 8, [r"(?iU)\bprincipal\b"], False, ["english", "german"], False, False, [("data", 1.0), ("software", 0.6)], {"Python": 1.0, "Spark": 1.5, "Kafka": 0.8, "SQL": 1.0, "Airflow": 0.7, "Excel": 0.2}, 0.4, [("license", 0.5)]),
    ("bora", ["turkey", "israel", "canada", "usa"], "staff", 0, [], True, ["english"], False, True, [("cloud", 0.9), ("data", 0.9)], {"AWS": 1.2, "Docker": 1.0, "Kubernetes": 1.4, "SQL": 0.5, "Java": 0.9}, 0.0, []),
    ("carl", ["turkey", "germany", "canada", "israel", "usa", "remote_emea"], "mid", 4, [r"(?iU)\brecruiter\b", r"(?iU)\bnurse\b"], False, ["english"], True, True, [("health", 0.8), ("people", 0.7)], {"Patient care": 1.0, "Recruitment": 0.5}, 1.2, [("the", 0.3), ("license", 0.9)]),
)
PROFILE_TYPE = "profile_id string, permits array<string>, max_level string, max_years int, forbidden array<string>, needs_sponsor boolean, languages array<string>, is_practitioner boolean, show_off_domain boolean, families array<struct<name:string,weight:double>>, weights map<string,double>, remote_bonus double, sectors array<struct<pattern:string,weight:double>>"


def pick(values: tuple, by: int = 1) -> Column:
    """The value whose number is doc_id / by modulo their count."""
    place = F.pmod(F.floor(F.col("doc_id") / by), F.lit(len(values))).cast("int")
    items = [F.lit(v) if isinstance(v, str) else F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in values]
    return F.get(F.array(*items), place)


def postings(docs: DataFrame) -> DataFrame:
    """Each document as a posting: its source is the company, its text follows an opening sentence."""
    day = F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(days=(F.col("doc_id") * 37 % 1200).cast("int"))
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.lit("docs").alias("source"),
        F.col("source").alias("company"),
        F.col("source").alias("board_token"),
        F.col("doc_id").cast("string").alias("native_id"),
        F.concat(F.trim(F.concat_ws(" ", pick(LEVELS), pick(ROLES, 2))), pick(SUFFIXES, 3)).alias("title"),
        F.concat(F.lit("https://jobs.example/"), F.col("doc_id").cast("string")).alias("url"),
        pick(PLACES).alias("locations"),
        F.when(F.col("doc_id") % 23 == 0, "").otherwise(F.concat_ws("\n", pick(INTROS), F.col("text"))).alias("description"),
        pick(DEPARTMENTS, 5).alias("department"),
        F.lit("").alias("employment_type"),
        F.when(F.col("doc_id") % 4 == 0, True).when(F.col("doc_id") % 4 == 1, False).alias("remote_flag"),
        F.when(F.col("doc_id") % 11 != 0, day).alias("posted_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in PROFILES], PROFILE_TYPE)
