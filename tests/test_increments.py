import pytest
from pyspark.sql import functions as F

from postlens.operators import history, increments
from postlens.streaming import closing, sightings

SIGHTING = "run_id long, uid string, board_token string, title_key string, content_hash string, updated_at timestamp, description string, seen_at timestamp"


def log_of(spark, rows):
    """(run, uid, board, hash, updated day, description)"""
    day = lambda n: f"2024-01-{n:02} 00:00:00"
    made = spark.createDataFrame([(r, u, b, "t", h, day(up), text, day(r + 1)) for r, u, b, h, up, text in rows], "run_id long, uid string, board_token string, title_key string, content_hash string, updated string, description string, seen string")
    return made.select("run_id", "uid", "board_token", "title_key", "content_hash", F.to_timestamp("updated").alias("updated_at"), "description", F.to_timestamp("seen").alias("seen_at"))


ROWS = [
    (1, "a", "x", "h1", 1, "long text"), (1, "b", "x", "h1", 1, ""), (1, "c", "y", "h1", 1, None),
    (2, "a", "x", "h1", 2, ""), (2, "d", "x", "h4", 2, "d"),
    (3, "a", "x", "h2", 3, "new text"), (3, "c", "y", "h1", 3, "late"), (3, "c", "y", "h1", 3, "late"), (3, "e", None, "h5", 3, None),
    (5, "b", "x", "h1", 1, "b again"),
]
SHOWN = ("uid", "board_token", "content_hash", "description", "seen", "last_run", "refreshes", "closed")


def shown(df):
    return sorted(tuple(r) for r in df.select(*SHOWN).collect())


WANT = [("a", "x", "h2", "new text", 3, 3, 1, True), ("b", "x", "h1", "b again", 2, 5, 0, False), ("c", "y", "h1", "late", 2, 3, 1, False), ("d", "x", "h4", "d", 1, 2, 0, True), ("e", None, "h5", None, 1, 3, 0, False)]


def test_increments_are_the_full_state(spark, tmp_path):
    log, at = log_of(spark, ROWS), str(tmp_path / "state")
    assert shown(increments.replayed(spark, at, log, 0, 4)) == WANT
    assert increments.versions(spark, at) == [1, 2, 3, 5]
    # the whole log tells the same
    full = {r.uid: r for r in history.snapshot(log.dropDuplicates()).collect()}
    assert {u: (full[u].seen, full[u].last_run, full[u].closed) for u in full} == {w[0]: (w[4], w[5], w[7]) for w in WANT}


def test_a_run_again_and_a_run_in_the_past(spark, tmp_path):
    log, at = log_of(spark, ROWS), str(tmp_path / "state")
    increments.replayed(spark, at, log, 0, 4)
    for _ in range(2):
        assert shown(increments.merge(spark, at, log.where("run_id = 5"), 5, 4)) == WANT
    # run 3 loses c: what follows is merged again
    less = log.where("NOT (run_id = 3 AND uid = 'c')")
    got = {r[0]: r for r in shown(increments.replayed(spark, at, less, 3, 4))}
    assert got["c"] == ("c", "y", "h1", None, 1, 1, 0, False) and got["a"] == WANT[0]
    assert increments.kept(spark, at, 2) == [3, 5]
    assert shown(increments.state(spark, at, 5, 4)) == sorted(got.values())


def test_the_old_state_is_not_exchanged(spark, tmp_path):
    log, at = log_of(spark, ROWS), str(tmp_path / "state")
    increments.replayed(spark, at, log.where("run_id < 3"), 0, 4)
    exchanges = increments.exchanged(increments.merged(increments.state(spark, at, 2, 4), log.where("run_id = 3"), 3))
    # the run's rows by uid, and its boards
    assert len(exchanges) == 2 and any("scanned" in x for x in exchanges)


def test_no_runs(spark, tmp_path):
    assert increments.replayed(spark, str(tmp_path / "none"), log_of(spark, ROWS).where("false"), 0, 4).count() == 0


def test_compaction(spark, tmp_path):
    log, archive = str(tmp_path / "log"), str(tmp_path / "archive")
    rows = log_of(spark, ROWS)
    history.appended(rows, log)
    everything = lambda: sorted(map(str, increments.read_log(spark, log, archive).select(rows.columns).collect()))
    want = everything()
    assert increments.compacted(spark, log, archive, 3, 2) == [1, 2] and everything() == want
    # a run comes again after it was archived: the log's rows hold, and the next compaction takes them
    again = rows.where("run_id = 2 AND uid = 'a'")
    history.appended(again, log)
    less = sorted(map(str, rows.where("run_id <> 2 OR uid = 'a'").collect()))
    assert everything() == less
    assert increments.compacted(spark, log, archive, 6, 2) == [2, 3, 5] and everything() == less
    # what a failure leaves behind, an unfinished version, isn't read
    rows.limit(1).write.parquet(f"{archive}/period=0,v=9")
    (tmp_path / "archive" / "period=0,v=9" / "_SUCCESS").unlink()
    assert everything() == less and increments.compacted(spark, log, archive, 6, 2) == []
    with pytest.raises(ValueError, match="no runs"):
        increments.read_log(spark, str(tmp_path / "x"), str(tmp_path / "y"))


def test_closed_by_the_stream(spark, tmp_path):
    """Changes over several batches; what is unseen for long leaves the state store."""
    rows = [(0, "a", "x"), (0, "b", "x"), (0, "c", "y"), (1, "a", "x"), (2, "a", "x"), (2, "b", "x"), (0, "g", "x"), (6, "a", "x"), (9, "z", "z"), (9, None, None), (11, "b", "x")]
    df = spark.createDataFrame([(r, u, b, f"1970-01-{r + 1:02} 06:00:00") for r, u, b in rows], "run_id long, uid string, board_token string, t string").select("run_id", "uid", "board_token", F.to_timestamp("t").alias("at"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, closing.PROVIDER)
    try:
        for runs in ([0], [1], [2], [6], [9], [11]):
            df.where(F.col("run_id").isin(runs)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = closing.changes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), keep=4, buckets=3)
            stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r.uid, r.change, r.run, r.closed) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        left = {r.user_map_key.uid for r in spark.read.format("statestore").option("stateVarName", "postings").load(str(tmp_path / "ck")).collect()}
    finally:
        spark.conf.set(key, before)
    # g isn't in run 1; b is back by the time that run 1 ends, missed by run 6 and seen again in run 11; y was never scanned again
    assert got == [("a", 1, 0, False), ("b", 1, 0, False), ("b", 2, 6, True), ("b", 3, 11, False), ("c", 1, 0, False), ("g", 1, 0, False), ("g", 2, 1, True), ("z", 1, 9, False)]
    assert left == {"a", "b", "c", "z"}
    assert {r.uid: r.closed for r in closing.latest(spark.read.parquet(str(tmp_path / "out"))).collect()} == {"a": False, "b": False, "c": False, "g": True, "z": False}
