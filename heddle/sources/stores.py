"""Catalog versions and control tables: written aside, then named by a pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from heddle.functions.contents import CONTENT

SIDECARS = {
    "tombstones": "sha256 string, reason string, confirmed_at timestamp",
    "suppressions": "source_entry_id string, sha256 string, reason string, confirmed_at timestamp",
    "report": "sha256 string, state string, reason string, http_status int, checked_at timestamp, confirmations int",
    "cache": f"sha256 string, state string, checked_at timestamp, content {CONTENT}",
}
POINTER = "version string, activated_at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


def read_sidecar(spark: SparkSession, path: str | None, kind: str) -> DataFrame:
    """A control table; one that is not there is empty, one that is there must be readable."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], SIDECARS[kind])
    return spark.read.schema(SIDECARS[kind]).option("mode", "FAILFAST").json(path)


def write_sidecar(df: DataFrame, path: str, kind: str) -> None:
    names = [c.split()[0] for c in SIDECARS[kind].split(", ")]
    df.select(*names).orderBy(*[n for n in names if n in ("sha256", "source_entry_id")]).write.mode("overwrite").json(path, compression="gzip")


def version_of(df: DataFrame) -> str:
    """A version of a table's content, whatever the order of its rows: the hash of a sum of
    row hashes and the row count.  One row reaches the driver."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")
    got = df.agg(F.sha2(F.concat_ws("|", F.sum(row).cast("string"), F.count("*").cast("string")), 256).alias("v")).first()
    return got["v"]


def publish(df: DataFrame, root: str, version: str, at: str) -> None:
    """Write a version in a folder of its own, then point at it; readers see the old one or
    the new one, whole."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/versions/version={version}")
    spark.createDataFrame([(version,)], "version string").select("version", F.lit(at).cast("timestamp").alias("activated_at")).write.mode("append").parquet(f"{root}/pointer")


def active_version(spark: SparkSession, root: str) -> str | None:
    if not exists(spark, f"{root}/pointer"):
        return None
    row = spark.read.schema(POINTER).parquet(f"{root}/pointer").agg(F.max_by("version", "activated_at").alias("v")).first()
    return row["v"]


def read_active(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/version={active_version(spark, root)}")


def unprocessed(published: DataFrame, processed: DataFrame) -> DataFrame:
    return published.join(processed.select("version").distinct(), "version", "left_anti")


def drop_inactive(spark: SparkSession, root: str) -> int:
    """Delete the folders of versions that are not active; returns how many."""
    keep, jvm = active_version(spark, root), spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [x.getPath() for x in files.listStatus(where) if x.getPath().getName() != f"version={keep}"]
    for p in old:
        files.delete(p, True)
    return len(old)


def file_meta(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, modified, version (content hash) of the files at ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("version"))


CATALOG_VERSION = "1"


def write_catalog(entries: DataFrame, path: str) -> None:
    """The catalog as gzip JSON, a line an entry, each with the schema version."""
    entries.withColumn("catalog_schema", F.lit(CATALOG_VERSION)).write.mode("overwrite").json(path, compression="gzip")


def read_catalog(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_catalog`` wrote; another schema version or an unreadable line stops the job."""
    read = spark.read.schema(StructType([*schema.fields, StructField("catalog_schema", StringType())])).option("mode", "FAILFAST").json(path)
    known = F.when(F.col("catalog_schema") == CATALOG_VERSION, F.col("catalog_schema")).otherwise(F.raise_error(F.concat(F.lit("unsupported catalog schema "), F.coalesce("catalog_schema", F.lit("none")))))
    return read.filter(known.isNotNull()).drop("catalog_schema")
