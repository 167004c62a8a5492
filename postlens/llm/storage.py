"""Written tables that cut lineage, in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


#: Bytes of an Arrow batch, unless the session says otherwise: rows alone don't bound it, as texts may be long.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local session gets a private temporary one and a cluster an error, as its executors wouldn't see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="postlens-"))
    return f"file://{_LOCAL[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The table is the recovery point: lost executors re-read it, and the plan above it
    starts from a scan. It is removed when the driver's JVM ends; the shuffles of the write go
    as soon as it is done, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/postlens/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches that are bounded by bytes."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH).rstrip("b") in ("", str((1 << 31) - 1)):
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` once nothing needs them any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
