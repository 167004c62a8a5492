"""History kept by increments: the state of all postings as a bucketed table, moved on by one run at a time.

``history.snapshot`` reads the whole log; here a run costs its own rows' shuffle and one pass over the state. Both sides of the merge are in the same buckets of uid, so the old state isn't exchanged.
Every run makes a version of its own, ``run=N`` below the state's folder, from the latest version of an earlier run: a run that is merged again replaces its version and nothing else, a run that failed left no version.
A run in the past that changes is merged again together with those after it (:func:`replayed`). Versions are files with a fixed layout, so any session finds them; the catalogue only learns their buckets.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the state; updated_at and content_hash are the latest, description the latest that isn't empty.
STATE = "uid string, board_token string, title_key string, content_hash string, updated_at timestamp, description string, first_seen timestamp, last_seen timestamp, seen bigint, last_run bigint, refreshes bigint, closed boolean"
#: Boards of one run up to which their names are broadcast; beyond it they are joined by a shuffle.
MAX_BOARDS = 200_000


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Runs that have a finished version, in order."""
    where, fs = _files(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = [n for n in names if re.fullmatch(r"run=-?\d+", n) and fs.exists(_files(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n[4:]) for n in done)


def state(spark: SparkSession, path: str, run: int, buckets: int) -> DataFrame:
    """A version as a bucketed table: what is joined or grouped by uid isn't exchanged."""
    name = f"postings_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({STATE}) USING parquet CLUSTERED BY (uid) SORTED BY (uid) INTO {buckets} BUCKETS LOCATION '{path}/run={run}'")
    return spark.table(name)


def of_run(sightings: DataFrame) -> DataFrame:
    """One row for each uid of a run: its latest sighting, how often it was sighted in it (once a run counts), and the latest description that isn't empty."""
    latest = F.struct("seen_at", "content_hash")
    last = lambda c: F.max_by(c, latest).alias(c)
    text = F.nullif(F.col("description"), F.lit(""))
    return sightings.groupBy("uid").agg(last("board_token"), last("title_key"), last("content_hash"), last("updated_at"), F.max_by("description", F.when(text.isNotNull(), latest)).alias("description"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def merged(old: DataFrame, sightings: DataFrame, run: int) -> DataFrame:
    """The state after ``run``, from the state before it and the run's sightings."""
    delta = of_run(sightings)
    n = delta.select([F.col(c).alias(f"n_{c}") for c in delta.columns])
    met = old.join(n, F.col("uid") == F.col("n_uid"), "full_outer")
    # closed: the board was scanned in this run, and the posting wasn't there
    boards = sightings.where("board_token IS NOT NULL").select(F.col("board_token").alias("scanned")).distinct()
    few = boards.limit(MAX_BOARDS + 1).count() <= MAX_BOARDS
    now, moved = F.col("n_uid").isNotNull(), (F.col("content_hash") == F.col("n_content_hash")) & (F.col("updated_at") != F.col("n_updated_at"))
    take = lambda c: F.when(now, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    out = met.join(F.broadcast(boards) if few else boards, F.coalesce("board_token", "n_board_token") == F.col("scanned"), "left")
    return out.select(
        F.coalesce("n_uid", "uid").alias("uid"), take("board_token"), take("title_key"), take("content_hash"), take("updated_at"), F.coalesce("n_description", "description").alias("description"),
        F.least("first_seen", "n_first_seen").alias("first_seen"), F.greatest("last_seen", "n_last_seen").alias("last_seen"), (F.coalesce("seen", F.lit(0)) + now.cast("bigint")).alias("seen"),
        F.when(now, F.lit(run)).otherwise(F.col("last_run")).cast("bigint").alias("last_run"), (F.coalesce("refreshes", F.lit(0)) + F.coalesce(moved.cast("bigint"), F.lit(0))).cast("bigint").alias("refreshes"), (~now & F.col("scanned").isNotNull()).alias("closed"),
    )


def merge(spark: SparkSession, path: str, sightings: DataFrame, run: int, buckets: int) -> DataFrame:
    """Moves the state on by one run and returns it. ``sightings``: uid, board_token, title_key, content_hash, updated_at, description, seen_at."""
    before = [v for v in versions(spark, path) if v < run]
    old = state(spark, path, before[-1], buckets) if before else spark.createDataFrame([], STATE)
    out = merged(old, sightings, run)
    name = f"postings_{uuid.uuid4().hex}"
    # one file a bucket: the merge leaves its rows in the buckets already, only a first run has to be dealt out
    dealt = out if before else out.repartition(buckets, "uid")
    dealt.write.bucketBy(buckets, "uid").sortBy("uid").option("path", f"{path}/run={run}").mode("overwrite").saveAsTable(name)
    return spark.table(name)


def replayed(spark: SparkSession, path: str, log: DataFrame, since: int, buckets: int) -> DataFrame:
    """Merges the runs of ``log`` (with run_id) from ``since`` on, one after another, as a backfill or after a change in a past run."""
    drop(spark, path, [v for v in versions(spark, path) if v >= since])
    runs = [r[0] for r in log.where(F.col("run_id") >= since).select("run_id").distinct().orderBy("run_id").collect()]
    for run in runs:
        merge(spark, path, log.where(F.col("run_id") == run), run, buckets)
    return state(spark, path, versions(spark, path)[-1], buckets) if runs or versions(spark, path) else spark.createDataFrame([], STATE)


def drop(spark: SparkSession, path: str, runs: list[int]) -> None:
    for run in runs:
        where, fs = _files(spark, f"{path}/run={run}")
        fs.delete(where, True)


def kept(spark: SparkSession, path: str, last: int = 3) -> list[int]:
    """Drops all versions but the ``last`` ones: as many runs can be merged again without the log."""
    drop(spark, path, versions(spark, path)[:-last])
    return versions(spark, path)


_PERIOD = re.compile(r"period=(-?\d+),v=(\d+)")


def _periods(spark: SparkSession, archive: str) -> dict[int, int]:
    """The latest finished version of each period of an archive."""
    at, fs = _files(spark, archive)
    found: dict[int, int] = {}
    for m in [_PERIOD.fullmatch(s.getPath().getName()) for s in fs.listStatus(at)] if fs.exists(at) else []:
        if m and fs.exists(_files(spark, f"{archive}/{m[0]}/_SUCCESS")[0]):
            found[int(m[1])] = max(found.get(int(m[1]), 0), int(m[2]))
    return found


def _runs(spark: SparkSession, log: str) -> list[int]:
    where, fs = _files(spark, log)
    names = [re.fullmatch(r"run_id=(-?\d+)", s.getPath().getName()) for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(m[1]) for m in names if m)


def compacted(spark: SparkSession, log: str, archive: str, upto: int, size: int = 30) -> list[int]:
    """Moves the log's runs before ``upto`` into an archive with one folder for ``size`` runs, and returns those moved.

    A period is written whole, as a new version, from what the archive and the log have of it; the old version and the log's runs go only when it is finished. :func:`read_log` takes
    the latest finished version, and a run that both have from the log, so a failure anywhere loses and doubles nothing, and the next call does what is left.
    """
    old, periods = [r for r in _runs(spark, log) if r < upto], _periods(spark, archive)
    for period in sorted({r // size for r in old}):
        mine, before = [r for r in old if r // size == period], periods.get(period)
        rows = spark.read.parquet(log).where(F.col("run_id").isin(mine))
        if before is not None:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{archive}/period={period},v={before}").where(~F.col("run_id").isin(mine)))
        rows.repartitionByRange("run_id", "uid").sortWithinPartitions("run_id", "uid").write.mode("overwrite").parquet(f"{archive}/period={period},v={(before or 0) + 1}")
        for gone in ([f"{archive}/period={period},v={before}"] if before is not None else []) + [f"{log}/run_id={r}" for r in mine]:
            where, fs = _files(spark, gone)
            fs.delete(where, True)
    return old


def read_log(spark: SparkSession, log: str, archive: str) -> DataFrame:
    """All runs: the archive's, and those that are still in the log."""
    live, periods = _runs(spark, log), _periods(spark, archive)
    parts = [spark.read.parquet(log)] if live else []
    if periods:
        old = spark.read.parquet(*[f"{archive}/period={p},v={v}" for p, v in sorted(periods.items())])
        parts.append(old.where(~F.col("run_id").isin(live)))
    if not parts:
        raise ValueError(f"no runs below {log} or {archive}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].select(parts[0].columns))


def exchanged(df: DataFrame) -> list[str]:
    """The hash exchanges of a plan, for checks that a side isn't shuffled."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)

