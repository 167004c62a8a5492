import pytest
from pyspark.sql import functions as F

from postlens.streaming import progress, sightings

ROWS = [("u1", "2024-01-01 00:00:00", 1), ("u1", "2024-01-01 00:10:00", 1), ("u2", "2024-01-01 00:59:00", 1), ("u1", "2024-01-02 00:00:00", 2)]


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "uid string, at string, run_id long").withColumn("ts", F.to_timestamp("at")).drop("at")
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    return f"{tmp_path}/rows"


def test_deduplicated_and_budget(spark, table):
    once = sightings.drained(sightings.deduplicated(sightings.stream_of(spark, table), ["uid"], "ts"), "append")
    assert sorted(r.uid for r in once.collect()) == ["u1", "u2"]
    used = sightings.drained(sightings.budget(sightings.stream_of(spark, table), "uid", "ts", "1 hour", "30 minutes"))
    got = {(r.uid, str(r.window.start)[11:16]): r.used for r in used.where("window.start >= '2024-01-01' AND window.start < '2024-01-01 02:00:00'").collect()}
    assert got == {("u1", "00:00"): 2, ("u2", "00:00"): 1, ("u2", "00:30"): 1}


def test_log_takes_a_batch_once(spark, table, tmp_path):
    """Repeats within a run count once, and a second run over the same checkpoint adds nothing."""
    for _ in range(2):
        sightings.into_log(sightings.stream_of(spark, table), f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted((r.run_id, r.uid) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [(1, "u1"), (1, "u2"), (2, "u1")]


def test_progress_is_told(spark, table):
    told = []
    listener = progress.Progress(lambda name, n: told.append((name, n)))
    spark.streams.addListener(listener)
    try:
        sightings.drained(sightings.state_of(sightings.stream_of(spark, table), "uid", "ts", "uid"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert any(n == len(ROWS) for _, n in told)
    rows, seen = progress.observed(spark.range(7), "stage")
    rows.collect()
    assert seen.get["rows"] == 7


def test_no_folder_of_this_machine_on_a_cluster():
    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        sightings.folder(Fake)


def test_cool_off_over_batches(spark, tmp_path):
    """A block that an earlier batch brought silences rows of a later one, until its hours are over."""
    kind = "board string, at string, blocked boolean"
    first = [("a", "2024-01-01 00:00:00", True), ("a", "2024-01-01 01:00:00", False), ("b", "2024-01-01 00:00:00", False)]
    later = [("a", "2024-01-01 05:59:59", False), ("a", "2024-01-01 06:00:00", False), ("b", "2024-01-01 03:00:00", True), ("b", "2024-01-01 04:00:00", False)]
    for i, rows in enumerate((first, later)):
        spark.createDataFrame(rows, kind).withColumn("ts", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        stream = sightings.cooled_off(sightings.stream_of(spark, f"{tmp_path}/rows"), "board", "ts", "blocked")
        stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = {(r.board, r.at[11:]): r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", "00:00:00"): True, ("a", "01:00:00"): False, ("b", "00:00:00"): True, ("a", "05:59:59"): False, ("a", "06:00:00"): True, ("b", "03:00:00"): True, ("b", "04:00:00"): False}
