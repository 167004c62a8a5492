"""Streaming forms of the run-over-run state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str = "72 hours") -> DataFrame:
    """First sighting of each key within the watermark; state older than that goes."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def budget(stream: DataFrame, board: str, at: str, window: str = "1 hour", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests of each board in sliding windows."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window, slide), board).agg(F.count(F.lit(1)).alias("used"))


def state_of(stream: DataFrame, key: str, at: str, hash_: str) -> DataFrame:
    """Evolving state of each key: count, first and last time, latest hash. Aggregates only, so it is kept in the state store by Spark."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by(hash_, at).alias("content_hash"))


def cooled_off(stream: DataFrame, key: str, at: str, blocked: str, hours: int = 6, delay: str = "10 minutes") -> DataFrame:
    """``stream`` (key, at, blocked and others) with ``allowed``: whether no block of the key lies in the ``hours`` before a row.

    The state of a key is the time of its last block. A timer in event time drops it once the watermark has passed the silence, so keys without blocks hold nothing. Rows of a key that come
    in one batch are put in order of time; rows that come later than ``delay`` see the state as it is by then.
    """
    import pandas as pd
    from pyspark.sql import types as T
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = stream.columns
    silence = hours * 3_600_000_000

    def told(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames), ignore_index=True).sort_values(at, kind="stable")
        allowed = []
        for micros, block in zip(rows[at].astype("datetime64[us]").astype("int64"), rows[blocked], strict=True):
            allowed.append(last is None or micros >= last + silence)
            if block:
                last = int(micros) if last is None else max(last, int(micros))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + silence) // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[names].assign(allowed=allowed)

    out = T.StructType([*stream.schema.fields, T.StructField("allowed", T.BooleanType())])
    return stream.withWatermark(at, delay).groupBy(key).applyInPandasWithState(told, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def into_log(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch, without its own repeats, to the log of sightings; a batch that is run again replaces its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["run_id", "uid"]).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one. Only a local session may go without: other executors wouldn't see a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="postlens-stream-")


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """All files of a Parquet table as a stream."""
    shape = spark.read.parquet(path).schema
    # a single file is read as its folder with a filter on the name
    parent, _, name = path.rpartition("/")
    files = spark.read.parquet(path).inputFiles()
    single = len(files) == 1 and files[0].rstrip("/").endswith(name)
    reader = spark.readStream.schema(shape)
    return reader.option("pathGlobFilter", name).parquet(parent) if single else reader.parquet(path)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives once all that is there has gone through it: the last result in complete mode, all rows in append mode."""
    spark = stream.sparkSession
    at = folder(spark)
    out = f"{at}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows if mode == "complete" else rows.select(*stream.columns)


def logged(stream: DataFrame) -> DataFrame:
    """The log of sightings after all that is there has been appended to it."""
    spark = stream.sparkSession
    at = folder(spark)
    into_log(stream, f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/log").drop("batch")


def counted_stream(spark: SparkSession, path: str) -> DataFrame:
    """State of each (user, event type) after a streaming run over all that is there: equal to the batch result."""
    state = state_of(stream_of(spark, path).withColumn("uid", F.concat_ws(":", F.col("user_id").cast("string"), "event_type")), "uid", "ts", "props")
    return drained(state).select("uid", "seen", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_micros"), F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_micros"))
