"""What a panel in front of the engine calls: profiles in and out, a run with progress, its results. Plain functions over a shared folder; a web server is the caller's."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .operators.cv import fingerprint
from .plans import profiles as made
from .plans import ranking, standin
from .sources import sinks

VERSION = "2"
#: Parts of the engine whose change makes profiles stale.
ENGINE = fingerprint(VERSION, json.dumps([catalog.SKILLS, catalog.FAMILIES], ensure_ascii=False))


def health() -> dict:
    return {"ok": True, "version": VERSION, "engine": ENGINE}


def countries() -> list[dict]:
    return [{"tag": tag, "name": name, "region": region} for tag, name, region, _ in catalog.COUNTRIES]


class Panel:
    """State of one panel below ``folder``: profiles, the latest run's results and header."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.status = {"stage": "idle", "rows": {}}

    def import_cvs(self, docs: DataFrame, key: str, text: str, as_of: str, permits: list[str]) -> DataFrame:
        """Profiles of CV texts, kept for later runs."""
        rows = made.from_cvs(docs, key, text, F.to_date(F.lit(as_of)), F.array(*[F.lit(p) for p in permits]).cast("array<string>"))
        rows.withColumn("engine", F.lit(ENGINE)).write.mode("overwrite").parquet(f"{self.folder}/profiles")
        return self.profiles()

    def profiles(self) -> DataFrame:
        return self.spark.read.schema(standin.PROFILE_TYPE + ", engine string").parquet(f"{self.folder}/profiles")

    def summaries(self) -> list[dict]:
        return [r.asDict() for r in sinks.profile_summary(self.profiles()).collect()]

    def stale(self) -> list[str]:
        """Profiles that another version of the engine made."""
        return [r.profile_id for r in self.profiles().where(F.col("engine") != ENGINE).select("profile_id").collect()]

    def edit(self, profile_id: str, families: list[str] | None = None, permits: list[str] | None = None) -> None:
        """Keeps only the named families, in that order, or replaces the permits, of one profile."""
        rows = self.profiles()
        mine = F.col("profile_id") == profile_id
        if families is not None:
            kept = F.array_compact(F.transform(F.array(*[F.lit(f) for f in families]).cast("array<string>"), lambda n: F.get(F.filter("families", lambda f: f["name"] == n), F.lit(0))))
            rows = rows.withColumn("families", F.when(mine, kept).otherwise(F.col("families")))
        if permits is not None:
            rows = rows.withColumn("permits", F.when(mine, F.array(*[F.lit(p) for p in permits]).cast("array<string>")).otherwise(F.col("permits")))
        # a table can't be overwritten by what is read from it
        rows.write.mode("overwrite").parquet(f"{self.folder}/edited")
        self.spark.read.schema(rows.schema).parquet(f"{self.folder}/edited").write.mode("overwrite").parquet(f"{self.folder}/profiles")

    def scan(self, postings: DataFrame, as_of: str, told: Callable[[str, int], None] = lambda stage, n: None, per_company: int = 3, most: int = 25) -> dict:
        """One run: every posting with every profile, the shortlist and its header written; ``told`` hears each stage and its rows."""

        def stage(name: str, n: int) -> None:
            self.status = {"stage": name, "rows": {**self.status["rows"], name: n}}
            told(name, n)

        at = F.to_timestamp(F.lit(as_of))
        rows = ranking.with_risk(ranking.facts(ranking.variants_folded(postings), at))
        ranking.decided(ranking.scored(rows, self.profiles().drop("engine"))).write.mode("overwrite").parquet(f"{self.folder}/pairs")
        pairs = self.spark.read.parquet(f"{self.folder}/pairs")
        stage("scored", pairs.count())
        best = ranking.ranked(pairs, per_company, most)
        shown = sinks.result_rows(best, at)
        sinks.json_rows(shown, f"{self.folder}/results", sinks.report_header(pairs, at, VERSION))
        sinks.markdown_report(best).write.mode("overwrite").parquet(f"{self.folder}/reports")
        stage("ranked", self.spark.read.json(f"{self.folder}/results/rows").count())
        stage("idle", 0)
        return self.header()

    def header(self) -> dict:
        return self.spark.read.json(f"{self.folder}/results/header").first().asDict(recursive=True)

    def results(self, profile_id: str | None = None) -> DataFrame:
        rows = self.spark.read.json(f"{self.folder}/results/rows")
        return rows if profile_id is None else rows.where(F.col("profile_id") == profile_id)

    def report(self, profile_id: str) -> str | None:
        found = self.spark.read.parquet(f"{self.folder}/reports").where(F.col("profile_id") == profile_id).first()
        return found.report if found else None
