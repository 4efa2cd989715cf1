"""Queries for snapshots in ranges and tables in versions, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import merge
from heddle.plans.stored import fresh_path
from heddle.registry import query, table
from heddle.sources import exports, versions
from heddle.streaming import jobs

_RANGE = 1 << 18


def _export(spark, sf) -> str:
    """Documents as snapshots, one for each source, in a folder of its own; written line by line."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", F.coalesce("source", F.lit("none")).alias("source"))
    first = docs.groupBy("source").agg(F.min("doc_id").alias("_first"), F.count("*").cast("int").alias("_n"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    entry = F.struct(F.col("doc_id").cast("string").alias("entry_id"), F.col("text").alias("title"), F.array(text("lang"), F.substring(text("text"), 1, 40)).alias("passwords"), F.struct(F.col("lang").alias("author")).alias("credit"))
    message = F.struct(F.concat(F.lit("m"), F.col("doc_id")).alias("message_id"), F.col("doc_id").alias("telegram_message_id"), F.struct(F.reverse(F.substring(text("text"), 1, 40)).alias("type")).alias("media"))
    each = docs.join(first, "source")
    comma = F.when(F.col("doc_id") == F.col("_first"), "").otherwise(",")
    lines = each.select("source", "_n", F.explode(F.array(F.struct(F.lit(1).alias("k"), F.concat(comma, F.to_json(message)).alias("value")), F.struct(F.lit(3).alias("k"), F.concat(comma, F.to_json(entry)).alias("value")))).alias("x"), "doc_id").select("source", "x.k", "doc_id", "x.value")
    told = F.to_json(F.struct(F.struct(F.struct(F.col("_n").alias("exported_message_count")).alias("retrieval")).alias("stats")))
    rest = {0: F.lit('{"schema_version" : "3", "source": {"channel_id":5}, "messages": [ '), 2: F.lit('], "catalog_entries" :['), 4: F.concat(F.lit("], "), F.substr(told, F.lit(2)))}
    around = first.select("source", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("value")) for k, v in rest.items()])).alias("x")).select("source", "x.k", F.lit(0).cast("long").alias("doc_id"), "x.value")
    path = fresh_path(spark, "exports")
    # one task a source, so one file: Spark drops a repartition by the very key of a join before it, and with it goes
    # the guarantee once that join becomes a broadcast at run time
    lines.unionByName(around).repartition(F.xxhash64("source")).sortWithinPartitions("source", "k", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    return path


@query("""
WITH d AS (SELECT doc_id, text, lang, coalesce(source, 'none') AS source FROM documents), o AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS snapshot_ord, n FROM (SELECT source, count(*) AS n FROM d GROUP BY 1))
SELECT snapshot_ord, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, CAST(doc_id AS VARCHAR) AS entry_id, md5(text) AS title, lang AS author, coalesce(lang, '') || '|' || left(coalesce(text, ''), 40) AS passwords,
  'm' || doc_id AS message_id, reverse(left(coalesce(text, ''), 40)) AS type, CAST(n AS INT) AS declared FROM d JOIN o USING (source)
""")
def snapshot_ranges(spark, sf):
    read = exports.read_snapshots(spark, _export(spark, sf), suffix=".txt", range_bytes=_RANGE)
    said = read.messages.select("snapshot_ord", "pos", "message_id", F.col("media.type").alias("type"))
    head = read.headers.select("snapshot_ord", F.col("stats.retrieval.exported_message_count").alias("declared"))
    entries = read.entries.select("snapshot_ord", "pos", "entry_id", F.md5("title").alias("title"), F.col("credit.author").alias("author"), F.array_join("passwords", "|").alias("passwords"))
    return entries.join(said, ["snapshot_ord", "pos"]).join(head, "snapshot_ord")


#: The tables are small; each bucket is files of its own.
_BUCKETS = 32
_AT = "2024-01-01 00:00:00"


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 50 <> 1), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 50 <> 2)
SELECT *, 'added' AS change FROM (FROM b EXCEPT ALL FROM a) UNION ALL SELECT *, 'removed' FROM (FROM a EXCEPT ALL FROM b)
""")
def version_differences(spark, sf):
    orders, root = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), fresh_path(spark, "versions")
    later = orders.filter("o_orderkey % 50 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")))
    versions.publish(orders.filter("o_orderkey % 50 <> 1"), root, ["o_orderkey"], _AT, buckets=_BUCKETS)
    versions.publish(later, root, ["o_orderkey"], _AT, buckets=_BUCKETS)
    return versions.differences(spark, root, 1, 2)


_PARTS = 3
_SAID = "CASE event_type WHEN 'error' THEN '' ELSE event_type END"


@query(f"""
WITH s AS (SELECT user_id, event_id % {_PARTS} AS k, arg_max({_SAID}, event_id) AS said, max(value) FILTER (value >= 5) AS value FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(said, k) FILTER (said <> '') AS said, arg_max(value, k) FILTER (value IS NOT NULL) AS value FROM s GROUP BY 1
""")
def stream_snapshots(spark, sf):
    """Snapshots become versions of a table; the stream of versions is written into a second one, whose rows are folded."""
    events, root, into = table(spark, sf, "events"), fresh_path(spark, "snapshots"), fresh_path(spark, "ingested")
    for k in range(_PARTS):
        part = events.filter(F.col("event_id") % _PARTS == k).groupBy("user_id").agg(F.max_by(F.expr(_SAID), "event_id").alias("said"), F.max(F.when(F.col("value") >= 5, F.col("value"))).alias("value"))
        versions.publish(part, root, ["user_id"], _AT, buckets=_BUCKETS)
    jobs.run_once(versions.append_stream(versions.stream(spark, root), into, ["user_id"], "ingest", buckets=_BUCKETS), fresh_path(spark, "checkpoint"))
    return merge.upsert(versions.read(spark, into), "user_id", ["version"]).drop("first_seen")


_OUTCOME = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'not_found' ELSE 'extracted' END"
_STALE = "INTERVAL 5 DAYS"


@query(f"""
WITH t AS (SELECT user_id, {_OUTCOME} AS state, ts, event_id FROM events WHERE event_type <> 'error'), l AS (SELECT user_id, arg_max(state, (ts, event_id)) AS state, max(ts) AS ts FROM t GROUP BY 1)
SELECT user_id, state FROM l WHERE ts + {_STALE} >= (SELECT max(ts) FROM t)
""")
def stream_cache(spark, sf):
    """Outcomes are appended as they come; the cache is the last one that says something, unless it is stale."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    outcomes = events.select(F.col("user_id").cast("string").alias("sha256"), F.expr(_OUTCOME).alias("state"), F.col("ts").cast("timestamp").alias("checked_at"), F.format_string("%015d", "event_id").alias("content"))
    root = fresh_path(spark, "cache")
    jobs.run_once(versions.append_stream(outcomes, root, ["sha256"], "cache", buckets=_BUCKETS), fresh_path(spark, "checkpoint"))
    return jobs.cache_into("", F.expr(_STALE)).fold(versions.read(spark, root)).select(F.col("sha256").cast("long").alias("user_id"), "state")
