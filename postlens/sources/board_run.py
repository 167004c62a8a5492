"""A board run: list pages, then the details they name, each under the board's allowance, into a page cache that the next run is served from.

Requests are planned by :func:`boards.requests`; the pages come in through a data source, ``board``, whose writer is the fetcher. Each board is one task's, in order, with a gap between
requests; a block ends the board's part. The folder (``pages`` and the lists of files that are committed) is cache and ledger at once: each request is a row, with its status.
A task that is run again asks again, and only what the commit names counts. A reader sees the runs up to the one that was last when it was made, so a plan doesn't change by what it writes.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import boards, fetch

SHAPE = "board string, url string, kind string, fetched_at timestamp, status int, body binary"
#: Seconds between requests to a board, failed connections in a row that end its part, pages of a group in a file.
GAP, FAILURES, GROUP = 6.0, 3, 64
BLOCKED = (403, 429)


def _arrow_shape():
    import pyarrow as pa

    return pa.schema([("board", pa.string()), ("url", pa.string()), ("kind", pa.string()), ("fetched_at", pa.timestamp("us", tz="UTC")), ("status", pa.int32()), ("body", pa.binary())])


def _files(path: str):
    """File system and folder of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def commits(path: str) -> list[str]:
    """Names of the committed writes, in order."""
    from pyarrow import fs

    files, root = _files(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(f.base_name for f in found if f.extension == "json")


def committed(path: str, upto: str | None = None) -> list[str]:
    """Files that the commits (up to one of them) name."""
    files, root = _files(path)
    named: list[str] = []
    for name in commits(path):
        if not upto or name <= upto:
            with files.open_input_stream(f"{root}/commits/{name}") as found:
                named += json.loads(found.read())["files"]
    return named


@dataclass
class _Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    requests: int = 0


class BoardWriter(DataSourceWriter):
    """Options: path; fetcher (module.function: (board, url) to (status, body)) or rows that bring status and body; gap; start in microseconds for a run whose clock is given."""

    def __init__(self, options: dict) -> None:
        self.path, self.fetcher = options["path"], options.get("fetcher")
        self.gap, self.start = float(options.get("gap", GAP)), options.get("start")

    def _asked(self, row, n: int) -> tuple[int, str | None, int]:
        """Status, body and time of one request; 599 where there was no connection."""
        if self.fetcher:
            module, name = self.fetcher.rsplit(".", 1)
            call = getattr(importlib.import_module(module), name)
            try:
                status, body = call(row["board"], row["url"])
            except OSError:
                status, body = 599, None
        else:
            status, body = row["status"] or 404, row["body"]
        at = int(time.time() * 1e6) if self.start is None else int(self.start) + int(n * self.gap * 1e6)
        return status, body if status < 300 else None, at

    def _pages(self, rows: Iterator) -> Iterator[dict]:
        """Pages of each board in turn, until it blocks or can't be reached."""
        board, n, lost, over = None, 0, 0, False
        for row in rows:
            if row["board"] != board:
                board, n, lost, over = row["board"], 0, 0, False
            if over:
                continue
            if n and self.start is None:
                time.sleep(self.gap)
            status, body, at = self._asked(row, n)
            n += 1
            lost = lost + 1 if status == 599 else 0
            over = status in BLOCKED or lost >= FAILURES
            yield {"board": board, "url": row["url"], "kind": row["kind"], "fetched_at": at, "status": status, "body": None if body is None else zlib.compress(body.encode())}

    def write(self, iterator: Iterator) -> _Written:
        import pyarrow as pa
        from pyarrow import parquet

        files, root = _files(self.path)
        done, out, group = _Written(), None, []
        name = f"pages/{uuid.uuid4().hex}.parquet"

        def flush() -> None:
            nonlocal out
            if out is None:
                files.create_dir(f"{root}/pages", recursive=True)
                out = parquet.ParquetWriter(f"{root}/{name}", _arrow_shape(), filesystem=files)
                done.files.append(name)
            out.write_table(pa.Table.from_pylist(group, _arrow_shape()))
            group.clear()

        for page in self._pages(iterator):
            group.append(page)
            done.requests += 1
            if len(group) >= GROUP:
                flush()
        if group:
            flush()
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list) -> None:
        """One small file names all the files of the write; it is there whole or not at all."""
        files, root = _files(self.path)
        files.create_dir(f"{root}/commits", recursive=True)
        name = f"{root}/commits/{time.time_ns():020d}-{uuid.uuid4().hex}"
        told = {"files": [f for m in messages if m for f in m.files], "requests": sum(m.requests for m in messages if m)}
        with files.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps(told).encode())
        files.move(f"{name}.part", f"{name}.json")

    def abort(self, messages: list) -> None:
        files, root = _files(self.path)
        for name in [f for m in messages if m for f in m.files]:
            files.delete_file(f"{root}/{name}")


class BoardReader(DataSourceReader):
    """Options: path, upto (name of the last commit that is read). One partition a file."""

    def __init__(self, options: dict) -> None:
        self.path, self.upto = options["path"], options.get("upto", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in committed(self.path, self.upto)]

    def read(self, partition: InputPartition | None) -> Iterator:
        from pyarrow import parquet

        if partition is None:
            return
        files, root = _files(self.path)
        yield from parquet.ParquetFile(files.open_input_file(f"{root}/{partition.value}")).iter_batches(GROUP)


class BoardSource(DataSource):
    """``format("board")``: writing fetches pages into the cache at ``path``, reading gives what committed writes have fetched."""

    @classmethod
    def name(cls) -> str:
        return "board"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> BoardReader:
        return BoardReader(self.options)

    def writer(self, schema, overwrite: bool) -> BoardWriter:
        return BoardWriter(self.options)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """All requests of the committed runs so far, as SHAPE. Later commits aren't seen by this frame."""
    found = committed(path)
    return spark.read.schema(SHAPE).parquet(*[f"{path}/{name}" for name in found]) if found else spark.createDataFrame([], SHAPE)


@F.pandas_udf(T.BooleanType())
def _may(rules: pd.Series, urls: pd.Series) -> pd.Series:
    """Whether a board's robots file lets each page be read; without a file all may be."""
    from urllib.robotparser import RobotFileParser

    parsed: dict[str, RobotFileParser] = {}
    for text in rules.dropna().unique():
        parsed[text] = RobotFileParser()
        parsed[text].parse(text.splitlines())
    return pd.Series([text is None or pd.isna(text) or parsed[text].can_fetch("*", url) for text, url in zip(rules, urls, strict=True)], dtype="bool")


def _permitted(urls: DataFrame, robots: DataFrame | None) -> DataFrame:
    """Each board and URL once, at its first place, with ``__may``."""
    once = urls.groupBy("board", "url").agg(F.min(F.struct("page", "query", "kind")).alias("x")).select("board", "url", "x.kind", "x.page", "x.query")
    if robots is None:
        return once.withColumn("__may", F.lit(True))
    return once.join(robots.select("board", F.col("body").alias("__rules")), "board", "left").withColumn("__may", _may("__rules", "url")).drop("__rules")


def fetched(urls: DataFrame, path: str, as_of: Column, since: Column, recorded: DataFrame | None = None, fetcher: str | None = None, robots: DataFrame | None = None, gap: float = GAP) -> DataFrame:
    """One round: what is due and allowed of ``urls`` (board, url, kind, page, query) is asked for; then board, url, kind, page, query, origin, body of all of them.

    origin: ``cache``, ``network``, ``stale`` (a copy of up to STALE_HOURS where it couldn't be asked for or failed), ``failed``, ``later``, ``forbidden``.
    ``recorded`` (url, status, body) answers in place of a ``fetcher``; a page that wasn't recorded is a 404. Then times follow ``as_of`` and nothing waits.
    """
    spark = urls.sparkSession
    spark.dataSource.register(BoardSource)
    before = kept(spark, path)
    asked = _permitted(urls, robots)
    cache, ledger = before.where("status < 300"), before.select("board", F.col("fetched_at").alias("at"), "status")
    plan = boards.requests(asked.where("__may"), cache, ledger, as_of, since)
    # the plan is a table of its own, so that what is asked for and what is told of it are the same rows, worked out once
    at = f"{path}/plans/{uuid.uuid4().hex}"
    asked.join(plan.select("board", "url", "place", "origin"), ["board", "url"], "left").write.parquet(at)
    plan = spark.read.parquet(at)
    todo = plan.where("origin = 'network'").select("board", "url", "kind", "place")
    given = {"path": path, "gap": str(gap)}
    if fetcher is None:
        todo = todo.join(recorded.select("url", "status", "body"), "url", "left").select("board", "url", "kind", "place", "status", "body")
        given["start"] = str(spark.range(1).select(F.unix_micros(as_of)).first()[0])
    else:
        given["fetcher"] = fetcher
    # a fixed number of parts, so that boards that wait don't wait for each other
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo.repartition(parts, "board").sortWithinPartitions("board", "place").write.format("board").options(**given).mode("append").save()
    after = kept(spark, path)
    good, new = F.col("status") < 300, F.col("fetched_at") >= since
    known = after.groupBy("url").agg(F.max_by(F.when(good, F.col("body")), F.when(good, F.col("fetched_at"))).alias("__body"), F.max(F.when(good, F.col("fetched_at"))).alias("__at"), F.bool_or(new & ~good).alias("__failed"))
    rows = plan.join(known, "url", "left")
    young = F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp("__at") <= fetch.STALE_HOURS * 3600, F.lit(False))
    origin = F.when(~F.col("__may"), "forbidden").when(F.col("origin") == "cache", "cache").when(F.col("__at") >= since, "network").when(young, "stale").when(F.col("__failed"), "failed").otherwise("later")
    rows = rows.withColumn("origin", origin)
    return rows.select("board", "url", "kind", "page", "query", "origin", F.when(F.col("origin").isin("cache", "network", "stale"), boards.unpacked("__body")).alias("body"))


def run(lists: DataFrame, details: Callable[[DataFrame], DataFrame], path: str, as_of: Column, recorded: DataFrame | None = None, fetcher: str | None = None, robots: DataFrame | None = None, gap: float = GAP) -> DataFrame:
    """Both rounds of a run: the list pages (board, url, page, query), then what ``details`` finds in those that are there (board, url, page, query).

    Returns what :func:`fetched` does, for pages of both kinds. All requests of the run count against its cap; list pages leave some of it for details.
    """
    given = {"recorded": recorded, "fetcher": fetcher, "robots": robots, "gap": gap}
    first = fetched(lists.withColumn("kind", F.lit("list")), path, as_of, as_of, **given)
    found = details(first.where(F.col("body").isNotNull())).select("board", "url", "page", "query", F.lit("detail").alias("kind"))
    return first.unionByName(fetched(found, path, as_of, as_of, **given))
