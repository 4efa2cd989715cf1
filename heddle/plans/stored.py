"""The shared folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Held while a table is written: it takes the place of its shuffles, so their files go as soon
#: as it is there.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 4 MB instead of 64 where the session has Spark's default: batches
    of texts are held several times over, by each task and its Python worker."""
    if spark.conf.get(_BATCH) == _SPARKS_OWN:
        spark.conf.set(_BATCH, "4m")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where that is unset, one of our own, but only
    in local mode: executors elsewhere would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-heddle-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def session_root(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{shared_root(spark)}/heddle/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{session_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and lets several branches share one pass.

    The table stays until ``clean``, as results that are still to be computed read it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    small_batches(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote in the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``written`` gave and that nothing reads any more."""
    root = session_root(df.sparkSession).split("://")[-1]
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            drop_path(df.sparkSession, folder)


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application; call it once its results are stored."""
    drop_path(spark, session_root(spark))
