"""Results as JSON with a header, as rows for a reader, as a Markdown report, as YAML profiles and as run and board reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import employment_type, hours_ago, text_or_empty, work_mode

DESCRIPTION = 12_000


def result_rows(results: DataFrame, as_of: Column) -> DataFrame:
    """A ranked posting as the profile and the flat fields that a reader is shown. Descriptions are cut for the reader's sake, here only."""
    c, mode = F.col, work_mode(F.col("raw.workplace_type") if "raw" in results.columns else F.lit(""), F.col("description"), F.col("remote_flag"), F.col("locations"))
    at = F.coalesce(c("posted_at"), c("updated_at"))
    return results.select(
        "profile_id", "rank", F.concat_ws(":", "source", "board_token", "native_id").alias("uid"), "source", "company", "title", "url", "locations", F.array_join("locations", " / ").alias("location"), text_or_empty(c("department")).alias("department"),
        mode.alias("work_mode"), employment_type(c("employment_type"), F.concat_ws(" ", "title", F.left("description", F.lit(600)))).alias("employment"), "remote_flag", at.alias("posted_at"), hours_ago(at, as_of).alias("hours_ago"), F.floor("age").alias("age_days"),
        "level", "years", c("place.status").alias("place"), "family", "role", "skill", "bonus", "total", c("known").alias("matched"), F.array_except("title_skills", F.map_keys("weights")).alias("missing"), "risk", "band", "reasons", "final", F.left("description", F.lit(DESCRIPTION)).alias("description"),
    )


def report_header(pairs: DataFrame, as_of: Column, version: str) -> DataFrame:
    """One row: when and by what a run was made, how many pairs it saw and what became of them."""
    counts = pairs.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("verdicts"), F.sum("n").alias("pairs")).select(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("made_at"), F.lit(version).alias("version"), "pairs", "verdicts")


def json_rows(results: DataFrame, path: str, header: DataFrame | None = None) -> None:
    """One JSON document a row under ``path``/rows, and the header, if there is one, under ``path``/header."""
    shown = results.withColumn("description", F.left("description", F.lit(DESCRIPTION))) if "description" in results.columns else results
    shown.write.mode("overwrite").json(f"{path}/rows" if header is not None else path)
    if header is not None:
        header.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def markdown_line(rank: Column, title: Column, company: Column, final: Column, url: Column, reasons: Column) -> Column:
    return F.concat_ws("\n", F.format_string("%d. [%s](%s) - %s (%.1f)", rank, title, url, company, final), F.array_join(F.transform(reasons, lambda r: F.concat(F.lit("   - "), r)), "\n"))


def markdown_report(ranked: DataFrame, name: str = "profile_id") -> DataFrame:
    """profile, report: a heading, a line for each posting with what speaks against it, in order of rank. A shortlist is short, so one array holds it."""
    line = markdown_line(F.col("rank"), F.col("title"), F.col("company"), F.col("final"), F.col("url"), F.col("reasons"))
    lists = ranked.select(name, F.struct("rank", F.regexp_replace(line, r"\n$", "").alias("line")).alias("x")).groupBy(name).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lists.select(name, F.concat(F.lit("# Shortlist of "), name, F.lit("\n\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n")).alias("report"))


def profile_yaml(profile: dict) -> str:
    import yaml

    return yaml.safe_dump(profile, allow_unicode=True, sort_keys=False)


def run_report(rows: DataFrame, source: str, reason: str, duplicate: str, ghosted: str) -> DataFrame:
    """Counts of a run by source: fetched, duplicates, eliminated, ghosted, kept."""
    gone = F.col(reason).isNotNull()
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("fetched"), F.count_if(duplicate).alias("duplicates"), F.count_if(gone & ~F.col(duplicate)).alias("eliminated"), F.count_if(F.col(ghosted) & ~gone & ~F.col(duplicate)).alias("ghosted"), F.count_if(~gone & ~F.col(duplicate) & ~F.col(ghosted)).alias("kept"))


def profile_summary(profiles: DataFrame) -> DataFrame:
    """What a reader sees of a profile: its families by weight, number of skills, the five that weigh most, limits."""
    top = F.slice(F.transform(F.array_sort(F.transform(F.map_entries("weights"), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k")))), lambda x: x["k"]), 1, 5)
    families = F.transform(F.array_sort(F.transform("families", lambda f, i: F.struct((-f["weight"]).alias("w"), i.alias("i"), f["name"].alias("name")))), lambda x: x["name"])
    return profiles.select("profile_id", F.array_join(families, ", ").alias("families"), F.size(F.map_keys("weights")).cast("long").alias("n_skills"), F.array_join(top, ", ").alias("top_skills"), "max_level", F.nullif("max_years", F.lit(0)).alias("max_years"), F.array_join(F.array_sort("permits"), ", ").alias("permits"))



def terminal_lines(ranked: DataFrame, width: int = 48) -> DataFrame:
    """profile_id, rank, line: a shortlist as lines of fixed columns."""
    cut = lambda c, n: F.rpad(F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 1)), F.lit("…"))).otherwise(c), n, " ")
    return ranked.select("profile_id", "rank", F.rtrim(F.concat_ws(" ", F.lpad(F.col("rank").cast("string"), 3, " "), F.lpad(F.format_string("%.1f", "final"), 6, " "), F.rpad("band", 8, " "), cut(F.col("title"), width), cut(F.col("company"), 20))).alias("line"))
