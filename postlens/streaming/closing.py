"""Postings that close, told by keyed state and timers in the stream itself.

Stage one lets each (board, run) through once and deals it to every bucket of the board as a mark that the board was scanned; stage two holds, for each (board, bucket), the postings of that bucket. A board of any size
is so many keys. When the watermark passes a run's end, its timer goes over the bucket's postings: those last seen before the run are closed, and those unseen for ``keep`` runs leave the state. Of runs that end together
the first timer's pass tells all.
What comes out are changes: opened, closed, opened again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keys that a board is dealt to.
BUCKETS = 16
CHANGES = "uid string, board_token string, change bigint, run bigint, closed boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Closing(StatefulProcessor):
    """State of a bucket: uid -> (last run, closed, changes so far) and the runs whose end is awaited."""

    def __init__(self, run_millis: int, keep: int):
        self.run_millis, self.keep = run_millis, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.postings = handle.getMapState("postings", "uid string", "last_run bigint, closed boolean, changes bigint")
        self.awaited = handle.getMapState("awaited", "run bigint", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        # a posting's state is asked for once a batch, however many frames its sightings are in
        newest: dict[str, int] = {}
        for frame in rows:
            for run in frame["run_id"].unique():
                ends = (int(run) + 1) * self.run_millis
                # a run that ended before the watermark is late: its sightings count, its end has been
                if ends > timerValues.getCurrentWatermarkInMs() and not self.awaited.containsKey((int(run),)):
                    self.awaited.updateValue((int(run),), (True,))
                    self.handle.registerTimer(ends)
            for uid, run in frame[frame["uid"].notna()].groupby("uid")["run_id"].max().items():
                newest[uid] = max(int(run), newest.get(uid, int(run)))
        for uid, run in newest.items():
            old = self.postings.getValue((uid,))
            last, closed, changes = (max(run, old[0]), old[1], old[2]) if old else (run, None, 0)
            if closed is not False and (old is None or run > old[0]):
                closed, changes = False, changes + 1
                out.append((uid, key[0], changes, run, False))
            self.postings.updateValue((uid,), (last, closed, changes))
        if out:
            yield pd.DataFrame(out, columns=["uid", "board_token", "change", "run", "closed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = expiredTimerInfo.getExpiryTimeInMs() // self.run_millis - 1
        if not self.awaited.containsKey((run,)):
            return
        # the runs whose ends have passed together are told by one pass over the bucket, not by one each
        passed = sorted(r for (r,) in self.awaited.keys() if r == run or (r + 1) * self.run_millis < timerValues.getCurrentWatermarkInMs())
        for r in passed:
            self.awaited.removeKey((r,))
        out, gone, closings = [], [], []
        for (uid,), (last, closed, changes) in self.postings.iterator():
            at = bisect_right(passed, last)
            if not closed and at < len(passed):
                out.append((uid, key[0], changes + 1, passed[at], True))
                closings.append((uid, last, changes + 1))
            if last < passed[-1] - self.keep:
                gone.append(uid)
        for uid, last, change in closings:
            self.postings.updateValue((uid,), (last, True, change))
        for uid in gone:
            self.postings.removeKey((uid,))
        if out:
            yield pd.DataFrame(out, columns=["uid", "board_token", "change", "run", "closed"])

    def close(self) -> None:
        pass


def changes(stream: DataFrame, run_hours: int = 24, delay: str = "1 hour", keep: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """Changes of each posting (CHANGES; ``change`` counts those of a uid) from a stream of run_id, uid, board_token, at. Run n lasts from n to n + 1 times ``run_hours`` after the epoch.

    The session's state store has to be RocksDB (:data:`PROVIDER`). Rows without a board are left out; a uid that left the state and comes back counts its changes from 1 again.
    """
    rows = stream.where("board_token IS NOT NULL AND run_id IS NOT NULL").select("run_id", "uid", "board_token", "at").withWatermark("at", delay)
    bucket = F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int")
    scans = rows.select("board_token", "run_id", "at").dropDuplicatesWithinWatermark(["board_token", "run_id"]).select("run_id", F.lit(None).cast("string").alias("uid"), "board_token", "at", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    dealt = rows.withColumn("bucket", bucket).unionByName(scans)
    return dealt.groupBy("board_token", "bucket").transformWithStateInPandas(statefulProcessor=Closing(run_hours * 3_600_000, keep), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def latest(log: DataFrame) -> DataFrame:
    """Where each posting stands by its last change: uid, board_token, run, closed."""
    last = F.max_by(F.struct("board_token", "run", "closed"), F.struct("run", "change"))
    return log.groupBy("uid").agg(last.alias("l")).select("uid", "l.board_token", "l.run", "l.closed")
