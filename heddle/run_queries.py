"""Queries for single steps of the runs: headers, counters, control tables, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import contents
from heddle.functions import links as L
from heddle.operators import enrich, merge, quality, search, sidecars
from heddle.registry import query, table
from heddle.sources import attachments

_HEX = "md5(CAST(c_custkey AS STRING)) || substr(md5(CAST(c_nationkey AS STRING)), 1, 8)"
_MAGNET = f"""CASE c_custkey % 8 WHEN 0 THEN 'magnet:?xt=urn:btih:' || {_HEX} WHEN 1 THEN 'MAGNET:?dn=a&XT=URN:BTIH:' || upper({_HEX}) || '&tr=x' WHEN 2 THEN 'magnet:?xt=urn%3Abtih%3A' || {_HEX}
  WHEN 3 THEN 'magnet:?xt=urn:btih:' || substr({_HEX}, 1, 39) WHEN 4 THEN 'magnet:?xt=urn:btih:' || translate(substr({_HEX}, 1, 32), '0189', 'abcd') WHEN 5 THEN 'magnet:?xt=urn:sha1:' || {_HEX}
  WHEN 6 THEN 'magnet:?xt=urn:ed2k:x&xt=urn:btih:' || {_HEX} || '#end' ELSE 'magnet:?dn=urn:btih:' || {_HEX} END"""


@query(f"SELECT c_custkey, {_MAGNET} AS raw, c_custkey % 8 NOT IN (3, 5, 7) AS fine FROM customer")
def magnet_links(spark, sf):
    raw = F.expr(_MAGNET)
    return table(spark, sf, "customer").select("c_custkey", raw.alias("raw"), L.magnet_ok(raw).alias("fine"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 > 0 THEN 'content ' || l_suppkey END AS name FROM lineitem
""")
def cached_contents(spark, sf):
    key = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("sha256")
    s = F.col("s_suppkey")
    content = F.when(s % 3 > 0, F.from_json(F.to_json(F.struct(F.concat(F.lit("content "), s.cast("string")).alias("name"))), contents.CONTENT))
    cache = table(spark, sf, "supplier").select(key("s_suppkey"), F.when(s % 3 > 0, "extracted").otherwise("not_found").alias("state"), content.alias("content"))
    links = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key("l_suppkey"))
    return sidecars.attach_content(links, cache).select("l_orderkey", "l_linenumber", "content.name")


@query("SELECT arg_max(event_type, event_id) FILTER (event_type <> 'error') AS title, arg_max(user_id, event_id) FILTER (value > 20) AS channel_id, arg_max(value, event_id) FILTER (event_type = 'click') AS size FROM events")
def source_header(spark, sf):
    e, v = table(spark, sf, "events"), F.col("event_type")
    heads = e.select(F.col("event_id").alias("snapshot_ord"), F.when(v == "error", " ").otherwise(v).alias("title"), F.when(F.col("value") > 20, F.col("user_id")).alias("channel_id"), F.when(v == "click", F.col("value")).alias("size"))
    return merge.fold_header(heads, ["snapshot_ord"])


@query("""
SELECT (SELECT count(*) FROM orders) AS catalog_entry_count, (SELECT sum(o_orderkey % 4)::BIGINT FROM orders) AS parsed_link_count, (SELECT count(*) FILTER (o_orderstatus = 'O') FROM orders) AS password_value_count, (SELECT count(*) FROM customer) AS exported_message_count
""")
def source_counters(spark, sf):
    k = F.col("o_orderkey")
    links = F.when(k % 4 > 0, F.array_repeat(F.lit("x"), (k % 4).cast("int")))
    entries = table(spark, sf, "orders").select(links.alias("links"), F.when(F.col("o_orderstatus") == "O", F.array(F.lit("p"))).alias("passwords"))
    return merge.source_counts(entries, table(spark, sf, "customer"))


@query("""
WITH c AS (SELECT user_id, max(ts) AS checked FROM events WHERE event_type = 'click' GROUP BY 1), s AS (SELECT event_id, event_type, coalesce(ts < checked + INTERVAL 2 HOURS, false) AS fresh FROM events LEFT JOIN c USING (user_id))
SELECT count(*) AS candidates, count(*) FILTER (fresh) AS fresh, count(*) FILTER (NOT fresh) AS fetched, count(*) FILTER (NOT fresh AND event_type = 'purchase') AS extracted, count(*) FILTER (NOT fresh AND event_type = 'view') AS not_found, count(*) FILTER (NOT fresh AND event_type = 'error') AS failed FROM s
""")
def enrichment_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("sha256", F.col("user_id").cast("string"))
    cache = e.filter("event_type = 'click'").select("sha256", F.col("ts").alias("checked_at"))
    split = enrich.fresh_split(e, cache, F.col("ts"), F.expr("INTERVAL 2 HOURS"))
    state = F.when(F.col("event_type") == "purchase", "extracted").when(F.col("event_type") == "view", "not_found").when(F.col("event_type") == "error", "failed").otherwise("other")
    return enrich.run_counts(split, split.filter("not fresh").withColumn("state", state))


@query("SELECT p_partkey AS id, p_name FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part WHERE p_size % 3 > 0)")
def point_lookup(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("id"), "p_name", F.when(F.col("p_size") % 3 > 0, F.array("p_type")).otherwise(F.array("p_type", F.lit("Service "))).alias("categories"))
    wanted = p.filter("p_size % 3 > 0").agg(F.max("p_partkey").alias("k")).first()["k"]  # one number
    return search.point(rows, F.lit(wanted)).select("id", "p_name")


@query("SELECT event_id, CASE WHEN trim(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE event_type END) <> '' THEN value ELSE CAST(epoch_us(ts) AS DOUBLE) END AS key FROM events")
def default_order(spark, sf):
    k = F.col("event_id") % 3
    asked = F.when(k == 0, "").when(k == 1, "  ").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", search.default_sort(asked, F.col("value"), F.col("ts").cast("timestamp")).alias("key"))


_INFO = "'d6:lengthi' || CAST(length(coalesce(text, '')) AS STRING) || 'e4:name' || CAST(octet_length({b}) AS STRING) || ':' || coalesce(text, '') || 'e'"
_FILE = "CASE doc_id % 5 WHEN 0 THEN 'd4:info' || {i} WHEN 1 THEN 'd8:announce3:url4:info' || {i} || 'e ' WHEN 2 THEN 'd8:announce3:urle' ELSE 'd8:announce3:url4:info' || {i} || '4:listl1:ai-5eee' END"
_SPARK_INFO = _INFO.format(b="coalesce(text, '')")


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 5 > 2 THEN sha1({_INFO.format(b="encode(coalesce(text, ''))")}) END AS info_sha1 FROM documents
""")
def content_hashes(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(_FILE.format(i=_SPARK_INFO)).cast("binary").alias("content"))
    return attachments.hashes(files).select(F.col("path").cast("long").alias("doc_id"), "info_sha1")


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'short' ELSE sha256(CAST(o_custkey AS VARCHAR)) END AS h, CASE o_orderstatus WHEN 'O' THEN 'expired' WHEN 'F' THEN 'manual' ELSE 'odd' END AS r, CASE WHEN o_orderkey % 17 = 0 THEN 'soon' ELSE '2024-01-01T00:00:00Z' END AS c FROM orders)
SELECT 'tombstones' AS "table", h AS key, 'hash' AS rule, h AS value FROM t WHERE h = 'short' UNION ALL SELECT 'tombstones', h, 'reason', r FROM t WHERE r = 'odd' UNION ALL SELECT 'tombstones', h, 'confirmed_at', c FROM t WHERE c = 'soon'
UNION ALL SELECT 'tombstones', h, 'duplicate_key', CAST(count(*) AS VARCHAR) FROM t GROUP BY h HAVING count(*) > 1
""")
def tombstone_faults(spark, sf):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(F.when(k % 13 == 0, "short").otherwise(F.sha2(F.col("o_custkey").cast("string"), 256)).alias("sha256"), F.when(s == "O", "expired").when(s == "F", "manual").otherwise("odd").alias("reason"), F.when(k % 17 == 0, "soon").otherwise("2024-01-01T00:00:00Z").alias("confirmed_at"))
    return quality.tombstone_rules(rows)
