"""Export snapshots: JSON documents, read with a fixed schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heddle.plans.stored import written
from heddle.sources import json_ranges

EXPORT_VERSION = "3"
LINK = "struct<url:string,host:string,provider:string,kind:string,role:string,primary:boolean,label:string,normalized_from:string,sources:array<string>>"
SCHEMA = (
    "schema_version string, exported_at string, source struct<channel_id:bigint,title:string,web_url:string,participants_count:bigint>, "
    "stats struct<retrieval:struct<exported_message_count:int>,parsing:struct<catalog_entry_count:int,parsed_link_count:int,password_value_count:int>>, "
    "messages array<struct<message_id:string,telegram_message_id:bigint,url:string,media:struct<type:string,document:struct<file_name:string,mime_type:string>>>>, "
    "catalog_entries array<struct<entry_id:string,message_id:string,source_message_ids:array<string>,added_at:string,origin:string,title:string,year:int,"
    f"year_range:struct<from:int,to:int>,availability:string,passwords:array<string>,notes:string,raw_block:string,credit:struct<author:string>,links:array<{LINK}>>>"
)


@dataclass
class Snapshots:
    """Tables of all snapshots: ``headers`` (snapshot_ord, exported_at, source, stats), and with
    snapshot_ord and pos ``messages`` and ``entries``."""

    headers: DataFrame
    messages: DataFrame
    entries: DataFrame


def _supported(version: str, file: Column) -> Column:
    return F.when(F.col("schema_version") == version, F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("unsupported schema version in "), file)))


def read_exports(spark: SparkSession, path: str, version: str = EXPORT_VERSION) -> DataFrame:
    """Snapshots of a folder, a row each, in the order of their names as ``snapshot_ord``.  A snapshot of
    another schema version stops the job.  A snapshot is read by one task: ``read_snapshots``
    takes large ones."""
    read = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").json(path).withColumn("file", F.input_file_name())
    names = read.select("file").distinct().withColumn("snapshot_ord", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("file")))
    return read.join(F.broadcast(names), "file").withColumn("schema_version", _supported(version, F.col("file")))


def _array_type(name: str) -> str:
    return StructType.fromDDL(SCHEMA)[name].dataType.elementType.simpleString()


def read_snapshots(spark: SparkSession, path: str, version: str = EXPORT_VERSION, suffix: str = ".json", range_bytes: int = json_ranges.RANGE_BYTES) -> Snapshots:
    """Snapshots of a folder and those below it, read by byte ranges, so that one large snapshot takes all tasks.
    A snapshot of another version, one that is cut off and one with an element that does not
    parse stop the job."""
    raw = written(json_ranges.read(spark, path, suffix, range_bytes), "snapshots")
    strict = {"mode": "FAILFAST"}
    pieces = F.array_sort(F.collect_list(F.struct("range", "data")))  # of what is outside the arrays
    shell = raw.filter("kind = 'shell'").groupBy("snapshot_ord").agg(F.aggregate(pieces, F.lit(b""), lambda whole, x: F.concat(whole, x["data"])).cast("string").alias("shell"))
    headers = shell.select("snapshot_ord", F.from_json("shell", SCHEMA, strict).alias("h")).select("snapshot_ord", "h.*").drop("messages", "catalog_entries")
    headers = headers.withColumn("schema_version", _supported(version, F.concat(F.lit("snapshot "), F.col("snapshot_ord").cast("string"))))
    # a version is looked at before anything else is made of the snapshots
    headers = written(headers.filter(F.col("schema_version").isNotNull()), "headers")

    def elements(key: str) -> DataFrame:
        rows = raw.filter((F.col("kind") == "element") & (F.col("key") == key))
        return rows.select("snapshot_ord", "pos", F.from_json(F.col("data").cast("string"), _array_type(key), strict).alias("x")).select("snapshot_ord", "pos", "x.*")

    return Snapshots(headers, elements("messages"), elements("catalog_entries"))


def as_snapshots(exports: DataFrame | Snapshots) -> Snapshots:
    """The tables of snapshots, also of those that are a row each."""
    if isinstance(exports, Snapshots):
        return exports
    each = lambda name: exports.select("snapshot_ord", F.posexplode(name).alias("pos", "x")).select("snapshot_ord", "pos", "x.*")
    return Snapshots(exports.drop("messages", "catalog_entries"), each("messages"), each("catalog_entries"))


def messages(exports: DataFrame | Snapshots) -> DataFrame:
    return as_snapshots(exports).messages


def entries(exports: DataFrame | Snapshots) -> DataFrame:
    return as_snapshots(exports).entries


def headers(exports: DataFrame | Snapshots) -> DataFrame:
    return as_snapshots(exports).headers.select("snapshot_ord", "exported_at", "source.*")
