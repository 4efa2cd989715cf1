"""Queries over the driver tables, and the same in DuckDB SQL.

Each shows operators of the library on tables that grow; the tables hold no catalogs, so
columns stand in: a part's brand for a link, a user's events for audit observations.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions import links as L
from heddle.functions import text as T
from heddle.operators import audit, classify, cluster, enrich, merge, quality, search, sidecars
from heddle.registry import QUERIES, SQL, query, table
from heddle.streaming import jobs

_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(replace({c}, 'ё', 'е')), '(?:https?:|magnet:)\S+', ' ', 'g'), '[^\p{{L}}\p{{N}}+#]+', ' ', 'g'), ' +', ' ', 'g'))"""


@query(f"SELECT doc_id, {_NORM.format(c='text')} AS normalized FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize("text").alias("normalized"))


_LINK = r"""
SELECT page_id, CASE k WHEN 0 THEN url WHEN 1 THEN 'ftp' || url WHEN 2 THEN regexp_replace(url, '://', '://user@') WHEN 3 THEN regexp_replace(url, '(://[^/]+)', '\1:0') WHEN 4 THEN regexp_replace(url, '://[^/]+', '://localhost')
  WHEN 5 THEN upper(regexp_extract(url, '^([a-z]+://[^/]+)', 1)) || ':443' || regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1) ELSE url END AS raw FROM (SELECT *, page_id % 7 AS k FROM pages)
"""
_INSPECTED = f"""
SELECT page_id, raw, scheme, host, CASE WHEN scheme NOT IN ('http','https') THEN 'unsupported_scheme' WHEN port = '0' THEN 'invalid_port' WHEN auth LIKE '%@%' THEN 'credentials' WHEN host = 'localhost' THEN 'local_target' END AS rejection,
  scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END || rest AS canonical FROM (
  SELECT page_id, raw, lower(regexp_extract(raw, '^([A-Za-z]+):', 1)) AS scheme, auth, lower(regexp_extract(regexp_replace(auth, '^.*@', ''), '^([^:]*)', 1)) AS host, regexp_extract(auth, ':(\\d+)$', 1) AS port,
    regexp_replace(regexp_replace(raw, '^[A-Za-z]+://[^/]*', ''), '#.*$', '') AS rest FROM (SELECT *, regexp_extract(raw, '^[A-Za-z]+://([^/?#]*)', 1) AS auth FROM ({_LINK})))
"""


def _links(spark, sf):
    u, k = F.col("url"), F.col("page_id") % 7
    raw = (
        F.when(k == 1, F.concat(F.lit("ftp"), u))
        .when(k == 2, F.regexp_replace(u, "://", "://user@"))
        .when(k == 3, F.regexp_replace(u, "(://[^/]+)", "$1:0"))
        .when(k == 4, F.regexp_replace(u, "://[^/]+", "://localhost"))
        .when(k == 5, F.concat(F.upper(F.regexp_extract(u, "^([a-z]+://[^/]+)", 1)), F.lit(":443"), F.regexp_extract(u, "^[a-z]+://[^/]+(.*)$", 1)))
        .otherwise(u)
    )
    return L.with_link(table(spark, sf, "pages").select("page_id", raw.alias("raw")), "raw")


@query(f"SELECT page_id, canonical, sha256(canonical) AS sha256 FROM ({_INSPECTED}) WHERE rejection IS NULL")
def canonical_links(spark, sf):
    c = F.col("link.canonical")
    return _links(spark, sf).filter(F.col("link.rejection").isNull()).select("page_id", c.alias("canonical"), L.link_hash(c).alias("sha256"))


@query(f"SELECT coalesce(rejection, 'accepted') AS rejection, count(*) AS count FROM ({_INSPECTED}) GROUP BY 1")
def link_rejection_profile(spark, sf):
    return sidecars.rejection_profile(_links(spark, sf).select("page_id", "link.rejection"))


_RULES = [(0, "blog.example.net"), (1, "example.com"), (2, "example.net"), (3, "www.example.com")]


@query(f"""
SELECT page_id, host, min(rule_ord) AS rule_ord FROM (SELECT page_id, host FROM ({_INSPECTED}) WHERE rejection IS NULL)
LEFT JOIN (VALUES {", ".join(f"({o}, '{s}')" for o, s in _RULES)}) r(rule_ord, suffix) ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY 1, 2
""")
def host_rule_match(spark, sf):
    rows = _links(spark, sf).filter(F.col("link.rejection").isNull()).select("page_id", F.col("link.host").alias("host"))
    return audit.match_rule(rows, spark.createDataFrame(_RULES, "rule_ord int, host_suffix string")).select("page_id", "host", "rule_ord")


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'error') AS event_type, arg_max(value, (ts, event_id)) FILTER (value >= 5) AS value, count(*) AS versions,
  list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY 1
""")
def snapshot_upsert(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select("user_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("value") >= 5, F.col("value")).alias("value"), F.array("event_type").alias("types"), "ts", "event_id")
    folded = merge.upsert(rows, "user_id", ["ts", "event_id"], arrays=["types"])
    n = rows.groupBy("user_id").agg(F.count("*").alias("versions"))
    return folded.join(n, "user_id").select("user_id", "event_type", "value", "versions", F.array_sort("types").alias("types"))


@query("""
SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS key, 'count_mismatch' AS rule, declared || '<>' || actual AS value FROM (
  SELECT o_orderkey, 1 + CAST(floor(o_totalprice) AS BIGINT) % 4 AS declared, count(l_orderkey) AS actual FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, o_totalprice) WHERE declared <> actual
""")
def count_reconcile(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    declared, actual = 1 + F.floor("o_totalprice") % 4, F.coalesce("n", F.lit(0))
    return quality.check(o, "orders", "o_orderkey", {"count_mismatch": (declared == actual, F.concat_ws("<>", declared.cast("string"), actual.cast("string")))})


@query("""SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS key, 'orphan' AS rule, CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def orphan_check(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 0")
    return quality.references(table(spark, sf, "orders"), rich, "orders", "o_orderkey", "o_custkey", "c_custkey")


@query("""SELECT 'lineitem' AS "table", l_orderkey || '|' || l_partkey AS key, 'duplicate_key' AS rule, CAST(count(*) AS VARCHAR) AS value FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1""")
def pk_violations(spark, sf):
    return quality.unique(table(spark, sf, "lineitem"), "lineitem", ["l_orderkey", "l_partkey"])


_SHA = lambda c: F.sha2(c.cast("string"), 256)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 9)")
def tombstone_filter(spark, sf):
    dead = table(spark, sf, "events").filter("event_type = 'error' AND value > 9").select(_SHA(F.col("user_id")).alias("sha256"))
    return sidecars.tombstone_filter(table(spark, sf, "orders").withColumn("sha256", _SHA(F.col("o_custkey"))), dead).select("o_orderkey")


@query("""
SELECT CASE WHEN o_orderstatus = 'F' THEN 'structural' WHEN t.u IS NOT NULL THEN 'tombstoned' WHEN s.u IS NOT NULL THEN 'suppressed' ELSE 'kept' END AS disposition, count(*) AS count FROM orders
LEFT JOIN (SELECT DISTINCT user_id u FROM events WHERE event_type = 'error' AND value > 9) t ON o_custkey = t.u
LEFT JOIN (SELECT DISTINCT user_id u, event_id % 7 p FROM events WHERE event_type = 'click') s ON o_custkey = s.u AND o_orderkey % 7 = s.p GROUP BY 1
""")
def suppression_filter(spark, sf):
    e = table(spark, sf, "events")
    dead = e.filter("event_type = 'error' AND value > 9").select(_SHA(F.col("user_id")).alias("sha256"))
    quiet = e.filter("event_type = 'click'").select((F.col("event_id") % 7).cast("string").alias("source_entry_id"), _SHA(F.col("user_id")).alias("sha256"))
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 7).cast("string").alias("entry_id"), _SHA(F.col("o_custkey")).alias("sha256"), F.when(F.col("o_orderstatus") == "F", "structural").alias("rejection"))
    return sidecars.disposition_counts(sidecars.dispositions(rows, dead, quiet))


@query("""
SELECT l_suppkey, l_partkey, arg_min(l_shipdate, (l_orderkey, l_linenumber)) AS first_ship, bool_or(l_quantity > 45) AS "primary", arg_min(l_returnflag, (l_orderkey, l_linenumber)) FILTER (l_returnflag <> 'N') AS label FROM lineitem GROUP BY 1, 2
""")
def link_merge(spark, sf):
    li = table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string")
    rows = li.select("l_suppkey", "l_partkey", F.col("l_shipdate").alias("url"), s("l_partkey").alias("host"), s("l_suppkey").alias("provider"), F.lit("k").alias("kind"), F.lit("r").alias("role"), (F.col("l_quantity") > 45).alias("primary"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("label"), "l_orderkey", "l_linenumber")
    return merge.merge_links(rows, ["l_suppkey", "l_partkey"], F.lit("k"), ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_partkey", F.col("url").alias("first_ship"), "primary", "label")


_CC = """
WITH RECURSIVE e AS ({edges}), r(node, reach) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.node, e2.n FROM r JOIN e e1 ON e1.n = r.reach JOIN e e2 ON e2.k = e1.k)
SELECT node AS p_partkey, min(reach) AS component FROM r GROUP BY 1
"""


@query(_CC.format(edges="SELECT p_partkey n, 'A' || p_name || '|' || p_brand || '|' || p_size k FROM part UNION ALL SELECT p_partkey, 'B' || p_name || '|' || p_type || '|' || p_size FROM part"))
def identity_clusters(spark, sf):
    p = table(spark, sf, "part")
    # ids as text of one width, so that the smallest text is the smallest id
    rows = p.withColumn("node", F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    a = cluster.key_edges(rows, "node", T.identity_key("p_name", "p_brand", "p_size"), "I")
    b = cluster.key_edges(rows, "node", T.identity_key("p_name", "p_type", "p_size"), "T")
    return cluster.cluster(rows, "node", [a, b]).select("p_partkey", F.col("component").cast("long").alias("component"))


@query("""
WITH RECURSIVE t AS (SELECT p_partkey, p_brand l, lower(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || p_type END) t, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END y FROM part),
n AS (SELECT l, t, list(DISTINCT y) FILTER (y IS NOT NULL) ys, bool_or(y IS NULL) o FROM t GROUP BY 1, 2),
e0 AS (SELECT a.l, a.t ta, b.t tb FROM n a JOIN n b ON a.l = b.l AND (starts_with(a.t, b.t || ' ') OR ends_with(a.t, ' ' || b.t)) WHERE a.o OR b.o OR list_has_any(a.ys, b.ys)),
e AS (SELECT l, ta x, tb z FROM e0 UNION SELECT l, tb, ta FROM e0),
r(l, t, reach) AS (SELECT l, t, t FROM n UNION SELECT r.l, r.t, e.z FROM r JOIN e ON e.l = r.l AND e.x = r.reach)
SELECT p_partkey, c.c AS component FROM t JOIN (SELECT r.l, r.t, min(t2.p) c FROM r JOIN (SELECT l, t, min(p_partkey) p FROM t GROUP BY 1, 2) t2 ON t2.l = r.l AND t2.t = r.reach GROUP BY 1, 2) c ON c.l = t.l AND c.t = t.t
""")
def title_variant_clusters(spark, sf):
    p = table(spark, sf, "part")
    title = F.lower(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type")))
    rows = p.select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("node"), F.col("p_brand").alias("link"), title.alias("title"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("year"))
    same = cluster.key_edges(rows, "node", cluster.title_link_key("link", "title"), "TL")
    near = cluster.affix_edges(rows, "link", "title", "year")
    return cluster.cluster(rows, "node", [same, near]).select("p_partkey", F.col("component").cast("long").alias("component"))


@query("SELECT text, min(doc_id) AS doc_id, arg_min(source, (n_chars, doc_id)) AS source FROM documents WHERE text IS NOT NULL GROUP BY 1")
def canonical_member(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL").withColumn("h", F.sha2("text", 256))
    c = cluster.canonical(d, "h", ["n_chars", "doc_id"], ["text", "doc_id", "source"])
    return c.select("text", "doc_id", "source")


@query("""
SELECT lang, source, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id, count(*) AS members, list_sort(list(DISTINCT n_chars % 5)) AS kinds, arg_min(n_chars, (n_chars, doc_id)) AS n_chars FROM documents GROUP BY 1, 2
""")
def fold_entities(spark, sf):
    d = table(spark, sf, "documents").withColumns({"component": T.identity_key("lang", "source"), "kinds": F.array(F.col("n_chars") % 5), "pos": F.col("doc_id")})
    f = cluster.fold(d, "component", ["n_chars", "doc_id"], ["lang", "source", "n_chars"], ["kinds"], "doc_id", "pos")
    return f.select("lang", "source", "first_doc_id", "last_doc_id", "members", F.array_sort("kinds").alias("kinds"), "n_chars")


TAXONOMY = [("metal", "Metal", False, 0), ("small", "Small parts", False, 1), ("color", "Colors", False, 2), ("other", "Other", False, 3), ("service", "Service", True, 4)]
KEYWORDS = [("metal", "gear*"), ("metal", "bolt"), ("metal", "rod"), ("metal", "plate"), ("small", "small ring*"), ("small", "old anvil"), ("color", "red"), ("color", "blue"), ("color", "gold*"), ("service", "cold widget promo")]


@query("""
SELECT p_partkey, CASE WHEN s THEN ['service'] WHEN len(c) = 0 THEN ['other'] ELSE c END AS categories FROM (SELECT p_partkey, contains(t, ' cold widget promo ') s,
  list_filter([CASE WHEN regexp_matches(t, ' (bolt|rod) | (gear|plate)') THEN 'metal' END, CASE WHEN contains(t, ' old anvil ') THEN 'small' END, CASE WHEN regexp_matches(t, ' (red|blue) | gold') AND NOT contains(t, ' gizmo economy ') THEN 'color' END], lambda x: x IS NOT NULL) c
  FROM (SELECT p_partkey, ' ' || lower(p_name || ' ' || p_type) || ' ' t FROM part))
""")
def topic_classify(spark, sf):
    p = table(spark, sf, "part").withColumn("said", T.normalize(F.concat_ws(" ", "p_name", "p_type")))
    blocks = spark.createDataFrame([("color", "gizmo economy", "")], "id string, phrase string, unless string")
    return classify.classify(p, "p_partkey", F.col("said"), _taxonomy(spark), spark.createDataFrame(KEYWORDS, "id string, keyword string"), blocks)


def _taxonomy(spark):
    return spark.createDataFrame(TAXONOMY, "id string, label string, hidden boolean, ord int")


FORMATS = [("course", ["ring", "widget"], []), ("book_guide", ["anvil"], ["red plate"]), ("audio", ["rod"], [])]


@query("""
SELECT p_partkey, CASE WHEN len(f) = 0 THEN ['unspecified'] ELSE f END AS formats, CASE WHEN len(f) = 0 THEN 'fallback' WHEN f[1] = 'torrent_attachment' THEN 'availability' ELSE 'title' END AS source FROM (SELECT p_partkey, list_filter([
  CASE WHEN regexp_matches(t, ' (ring|widget) ') THEN 'course' END, CASE WHEN contains(t, ' anvil ') OR contains(t, ' red plate ') THEN 'book_guide' END, CASE WHEN contains(t, ' rod ') THEN 'audio' END, CASE WHEN p_size % 7 = 0 THEN 'torrent_attachment' END], lambda x: x IS NOT NULL) f
  FROM (SELECT *, ' ' || lower(p_name) || ' ' t FROM part))
""")
def format_classify(spark, sf):
    formats, source = classify.format_labels(T.tokens(T.normalize("p_name")), FORMATS, F.col("p_size") % 7 == 0)
    return table(spark, sf, "part").select("p_partkey", formats.alias("formats"), source.alias("source"))


@query("""
WITH d AS (SELECT doc_id, source, CASE WHEN quality IS NULL THEN 'other' WHEN quality = 1 OR doc_id % 11 = 0 THEN 'metal' ELSE 'small' END c FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT source, c, count(*) k FROM d WHERE c <> 'other' GROUP BY 1, 2), m AS (SELECT source, arg_max(c, (k, CASE c WHEN 'metal' THEN 0 ELSE -1 END)) main, max(k) top, sum(k) al FROM n GROUP BY 1)
SELECT doc_id, CASE WHEN c = 'other' AND al >= 2 AND top * 100 >= al * 60 THEN main ELSE c END AS category, coalesce(c = 'other' AND al >= 2 AND top * 100 >= al * 60, false) AS inherited FROM d LEFT JOIN m USING (source)
""")
def majority_propagation(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    c = F.when(F.col("quality").isNull(), "other").when((F.col("quality") == 1) | (F.col("doc_id") % 11 == 0), "metal").otherwise("small")
    out = classify.propagate_majority(d.withColumn("categories", F.array(c)), "source", "categories", _taxonomy(spark), percent=60)
    return out.select("doc_id", F.col("categories")[0].alias("category"), "inherited")


@query("""
SELECT id, label, ord, coalesce(k, 0) AS count FROM (VALUES ('metal','Metal',0),('small','Small parts',1),('color','Colors',2),('other','Other',3),('service','Service',4)) t(id, label, ord)
LEFT JOIN (SELECT c, count(*) k FROM (SELECT unnest(CASE p_size % 4 WHEN 0 THEN ['metal','color'] WHEN 1 THEN ['metal'] WHEN 2 THEN ['other'] ELSE ['color'] END) c FROM part) GROUP BY 1) ON c = id
""")
def facet_counts(spark, sf):
    k = F.col("p_size") % 4
    a = lambda *v: F.array(*[F.lit(x) for x in v])
    rows = table(spark, sf, "part").withColumn("categories", F.when(k == 0, a("metal", "color")).when(k == 1, a("metal")).when(k == 2, a("other")).otherwise(a("color")))
    return classify.facet_counts(rows, "categories", _taxonomy(spark))


@query("""
SELECT count(*) AS entries, sum(p_size % 4)::BIGINT AS links, sum(CASE WHEN p_size % 4 = 0 THEN 0 ELSE (p_size % 4 + p_partkey % 2) // 2 END)::BIGINT AS enriched_links, sum(p_size % 3)::BIGINT AS passwords, count(*) FILTER (p_size % 5 = 0) AS normalized_titles FROM part
""")
def catalog_stats(spark, sf):
    k = F.col("p_size")
    numbers = lambda n: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < k % n)
    links = F.transform(numbers(4), lambda i: F.struct(F.when((i + F.col("p_partkey")) % 2 == 1, F.struct(i.alias("size"))).alias("content")))
    rows = table(spark, sf, "part").select(links.alias("links"), numbers(3).alias("passwords"), F.when(k % 5 == 0, F.col("p_name")).alias("title_original"))
    return classify.catalog_stats(rows)


@query("""
SELECT 'brand' AS facet, p_brand AS value, count(*) AS count FROM part GROUP BY 2 UNION ALL SELECT 'type', w, count(*) FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) w FROM part) GROUP BY 2
UNION ALL SELECT 'year', CAST(p_size AS VARCHAR), count(*) FROM part WHERE p_size > 10 GROUP BY 2 UNION ALL SELECT 'has_password', CAST(p_retailprice > 1000 AS VARCHAR), count(*) FROM part GROUP BY 2
""")
def search_facets(spark, sf):
    rows = table(spark, sf, "part").select(F.array("p_brand").alias("brand"), F.split("p_type", " ").alias("type"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("year"), (F.col("p_retailprice") > 1000).alias("password"))
    return search.facet_values(rows, {"brand": "brand", "type": "type"}, "year", "password")


_STATUS = "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN CASE WHEN value > 5 THEN 404 ELSE 403 END WHEN 'error' THEN 503 WHEN 'purchase' THEN 200 ELSE 302 END"
_RULE = [{"rule_ord": 1, "dead_statuses": [302], "mismatch_body": ["gone\\d"], "required_body": []}]
_AUDIT = f"""
SELECT *, CASE WHEN err THEN 'transient' WHEN status = 404 THEN 'expired' WHEN rule_ord = 1 AND status = 302 THEN 'expired' WHEN status = 403 THEN 'blocked' WHEN status = 503 THEN 'transient' WHEN status = 200 AND rule_ord = 1 AND regexp_matches(body, 'gone\\d') THEN 'content_mismatch' WHEN status = 200 THEN 'live' ELSE 'unknown' END AS state,
CASE WHEN err THEN 'timeout' WHEN status = 404 THEN 'global_dead_status' WHEN rule_ord = 1 AND status = 302 THEN 'dead_status' WHEN status = 403 THEN 'blocked_status' WHEN status = 503 THEN 'server_status' WHEN status = 200 AND rule_ord = 1 AND regexp_matches(body, 'gone\\d') THEN 'mismatch_body' WHEN status = 200 THEN 'ok' ELSE 'unhandled_http_status' END AS reason
FROM (SELECT *, {_STATUS} AS status, event_id % 2 AS rule_ord, 'gone' || CASE WHEN user_id % 2 = 0 THEN '1' ELSE 'x' END AS body, event_id % 13 = 0 AS err FROM events)
"""


def _observed(spark, sf, events=None):
    e = table(spark, sf, "events") if events is None else events
    obs = e.withColumns(
        {
            "http_status": F.expr(_STATUS).cast("int"),
            "rule_ord": (F.col("event_id") % 2).cast("int"),
            "body": F.concat(F.lit("gone"), F.when(F.col("user_id") % 2 == 0, "1").otherwise("x")),
            "transport_error": F.when(F.col("event_id") % 13 == 0, "timeout"),
        }
    )
    return audit.classify(obs, _RULE)


@query(f"SELECT event_id, state, reason FROM ({_AUDIT})")
def audit_classify(spark, sf):
    return _observed(spark, sf).select("event_id", "state", "reason")


@query(f"SELECT state, count(*) AS count FROM ({_AUDIT}) GROUP BY 1")
def audit_state_counts(spark, sf):
    return audit.state_counts(_observed(spark, sf))


_STREAK = f"""
SELECT user_id, state, CASE WHEN state IN ('expired','content_mismatch') THEN run ELSE 0 END AS confirmations FROM (
  SELECT user_id, arg_max(state, (ts, event_id)) AS state, count(*) FILTER (island = top) AS run FROM (SELECT *, max(island) OVER (PARTITION BY user_id) AS top FROM (
    SELECT *, sum(CASE WHEN prev IS DISTINCT FROM state THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ({_AUDIT})))) GROUP BY 1)
"""


@query(_STREAK)
def confirmation_streak(spark, sf):
    return audit.streaks(_observed(spark, sf), "user_id", ["ts", "event_id"]).select("user_id", "state", "confirmations")


@query(f"SELECT user_id, state AS reason FROM ({_STREAK}) WHERE confirmations >= 2 AND user_id % 3 <> 0")
def new_tombstones(spark, sf):
    report = audit.streaks(_observed(spark, sf), "user_id", ["ts", "event_id"]).withColumns({"sha256": F.col("user_id").cast("string"), "checked_at": F.col("last_at.ts")})
    known = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("sha256")).unionByName(table(spark, sf, "events").filter("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("sha256")))
    return audit.new_tombstones(report, known, 2).select(F.col("sha256").cast("long").alias("user_id"), "reason")


@query(f"""
SELECT event_id, NOT err AND (again OR more) AS needs_get, CAST(CASE WHEN err THEN 0 WHEN more THEN 65536 WHEN again THEN 1 ELSE 0 END AS BIGINT) AS byte_limit FROM (
  SELECT *, rule_ord = 1 AND (again OR s BETWEEN 200 AND 299) AS more FROM (
    SELECT event_id, rule_ord, err, s, s IN (405, 501, 404, 410) OR (rule_ord = 0 AND s = 403) AS again FROM (SELECT *, CASE WHEN user_id % 10 = 0 THEN 405 WHEN user_id % 10 = 1 THEN 410 ELSE status END AS s FROM ({_AUDIT}))))
""")
def probe_plan(spark, sf):
    rules = spark.createDataFrame([(1, [], True, 65536), (0, [403], False, 0)], "rule_ord int, dead_statuses array<int>, needs_body boolean, body_limit long")
    k = F.col("user_id") % 10
    heads = _observed(spark, sf).select(F.col("event_id").alias("sha256"), F.when(k == 0, 405).when(k == 1, 410).otherwise(F.col("http_status")).alias("http_status"), "transport_error", "rule_ord")
    return audit.probe_plan(heads, rules).select(F.col("sha256").alias("event_id"), "needs_get", "byte_limit")


@query("""
SELECT chain, count(*) AS hops, CASE WHEN count(*) > 5 THEN 'too_many_hops' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'unsafe_target' WHEN count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) > 0 THEN 'foreign_host' ELSE 'follow' END AS verdict
FROM (SELECT o_orderstatus, o_orderpriority, o_custkey || '/' || (o_orderkey % 5) AS chain FROM orders) GROUP BY 1
""")
def redirect_verdict(spark, sf):
    # a few chains for each customer, so that their number grows with the table
    o = table(spark, sf, "orders").withColumn("chain", F.concat_ws("/", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 5).cast("string")))
    p = F.col("o_orderpriority")
    host = F.when(p == "1-URGENT", "a.test").when(p == "2-HIGH", "cdn.b.test").when(p == "3-MEDIUM", "b.test").otherwise("c.test")
    hops = o.select("chain", F.row_number().over(W.partitionBy("chain").orderBy("o_orderkey")).cast("long").alias("hop"), F.lit("a.test").alias("origin_host"), host.alias("host"), F.when(F.col("o_orderstatus") == "F", "local_target").alias("rejection"))
    return audit.redirect_verdict(hops, spark.createDataFrame([("a.test", "b.test")], "origin_host string, host_suffix string"))


_NOW = "2024-01-30 00:00:00"


@query(f"""
SELECT c_custkey, coalesce(TIMESTAMP '{_NOW}' < m + INTERVAL 2 DAY, false) AS fresh FROM customer LEFT JOIN (SELECT user_id, max(ts) m FROM events WHERE event_type = 'view' GROUP BY 1) ON user_id = c_custkey
""")
def fresh_split(spark, sf):
    cache = table(spark, sf, "events").filter("event_type = 'view'").select(F.col("user_id").alias("sha256"), F.col("ts").alias("checked_at"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("sha256"))
    return enrich.fresh_split(c, cache, F.lit(_NOW).cast("timestamp"), F.expr("INTERVAL 2 DAYS")).select(F.col("sha256").alias("c_custkey"), "fresh")


@query("""
WITH o AS (SELECT user_id, arg_max(event_type, (ts, event_id)) s, max(ts) t FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1), c AS (SELECT user_id, arg_max(event_type, (ts, event_id)) s, max(ts) t FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT user_id, CASE WHEN s IN ('view','purchase') THEN 'extracted' ELSE 'not_found' END AS state, t AS checked_at FROM o WHERE s <> 'error'
UNION ALL SELECT user_id, CASE WHEN s IN ('view','purchase') THEN 'extracted' WHEN s = 'error' THEN 'failed' ELSE 'not_found' END, t FROM c WHERE user_id NOT IN (SELECT user_id FROM o WHERE s <> 'error')
""")
def cache_upsert(spark, sf):
    e = table(spark, sf, "events")

    def last(rows):
        x = rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("s"), F.max("ts").alias("checked_at"))
        state = F.when(F.col("s").isin("view", "purchase"), "extracted").when(F.col("s") == "error", "failed").otherwise("not_found")
        return x.select(F.col("user_id").alias("sha256"), state.alias("state"), "checked_at")

    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    out = enrich.upsert_cache(last(e.filter(F.col("ts") < cut)), last(e.filter(F.col("ts") >= cut)))
    return out.withColumnRenamed("sha256", "user_id")


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not_found' ELSE 'extracted' END AS state, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS name, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS size_bytes,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN ['document', 'video'] ELSE ['video'] END AS material_types FROM events
""")
def embedded_json(spark, sf):
    e = table(spark, sf, "events")
    item = lambda n: F.struct(F.lit(n).alias("n"))
    items = F.when(F.col("event_id") % 2 == 0, F.array(item("a.mp4"), item("b.pdf"))).otherwise(F.array(item("a.MKV")))
    obj = F.to_json(F.struct(F.struct(F.col("event_type").alias("title"), F.floor(F.col("value") * 100).alias("size")).alias("meta"), items.alias("files")))
    body = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('<p>"payload": none</p>'), "event_type")).otherwise(F.concat(F.lit('<script>"payload": {bad "payload": '), obj, F.lit(", more</script>")))
    fields = {"name": "meta.title", "size_bytes": "meta.size", "items": "files", "item_name": "n"}
    rules = spark.createDataFrame([(0, ['"payload":'], fields)], "rule_ord int, markers array<string>, fields map<string,string>")
    out = enrich.extract(e.select(F.col("event_id").cast("string").alias("sha256"), F.lit(0).alias("rule_ord"), body.alias("body")), rules, 100, 1 << 20)
    return out.select(F.col("sha256").cast("long").alias("event_id"), "state", "content.name", "content.size_bytes", "content.material_types")


@query("""
SELECT page_id, list_filter([CASE WHEN page_id % 2 = 0 THEN 'document' END, CASE WHEN page_id % 3 = 0 THEN 'video' END], lambda x: x IS NOT NULL) AS types FROM pages
""")
def material_types(spark, sf):
    p, k = F.col("url"), F.col("page_id")
    names = F.array(F.concat(F.regexp_replace(p, "[?#].*$", ""), F.when(k % 2 == 0, "x.PDF").otherwise("x")), F.concat(F.md5(p), F.when(k % 3 == 0, ".mp4").otherwise(".zzz")))
    return table(spark, sf, "pages").select("page_id", enrich.material_types(names).alias("types"))


_TERMS = r"list_filter(regexp_split_to_array(lower({c}), '[\s\p{{P}}]+'), lambda x: x <> '')"


@query(f"""
SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT field, term, id, count(*) tf FROM (
  SELECT 'title' field, p_partkey id, unnest({_TERMS.format(c="p_name")}) term FROM part UNION ALL SELECT 'text', p_partkey, unnest({_TERMS.format(c="p_type")}) FROM part) GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def index_stats(spark, sf):
    return _index(spark, sf).postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _index(spark, sf):
    return search.build_index(table(spark, sf, "part"), "p_partkey", {"title": F.col("p_name"), "text": F.col("p_type")})


_SEARCH = """
WITH docs AS (SELECT 'title' f, p_partkey id, list_filter(regexp_split_to_array(lower(p_name), '[\\s\\p{P}]+'), lambda x: x <> '') w, 4.0 b FROM part UNION ALL SELECT 'text', p_partkey, list_filter(regexp_split_to_array(lower(p_type), '[\\s\\p{P}]+'), lambda x: x <> ''), 1.0 FROM part),
p AS (SELECT f, id, b, term, count(*) tf FROM (SELECT f, id, b, unnest(w) term FROM docs) GROUP BY 1, 2, 3, 4), l AS (SELECT f, id, len(w) len FROM docs), n AS (SELECT f, count(*) n, avg(len(w)) a FROM docs GROUP BY 1), d AS (SELECT f, term, count(*) df FROM p GROUP BY 1, 2),
q AS (SELECT DISTINCT query_id, unnest(string_split(regexp_replace(query, ' +', ' ', 'g'), ' ')) q, len(list_distinct(string_split(regexp_replace(query, ' +', ' ', 'g'), ' '))) k FROM ({queries})),
m AS (SELECT query_id, k, q, term, {weight} w FROM q JOIN (SELECT DISTINCT term FROM p) t ON {match})
SELECT query_id, id, round(sum(b * w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.7 + 0.7 * len / a))), 6) AS score FROM m JOIN p USING (term) JOIN d USING (f, term) JOIN n USING (f) JOIN l USING (f, id) GROUP BY query_id, id, k HAVING count(DISTINCT q) = k
"""
_SQL_QUERIES = "SELECT s_suppkey AS query_id, lower(p_name[1:4]) || ' ' || lower(string_split(p_name, ' ')[2]) AS query FROM supplier JOIN part ON p_partkey = s_suppkey"


def _queries(spark, sf, cut=False):
    s = table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    q = F.concat_ws(" ", F.substring(F.lower("p_name"), 1, 4), F.lower(F.split("p_name", " ")[1]))
    if cut:
        q = F.concat(F.lit("x"), F.substring(F.lower(F.split("p_name", " ")[1]), 2, 100))
    return s.select(F.col("s_suppkey").alias("query_id"), q.alias("query"))


@query(_SEARCH.replace("{queries}", _SQL_QUERIES).replace("{weight}", "CASE WHEN q = term THEN 1.0 ELSE 0.375 * len(term) / (len(term) + 0.3 * (len(term) - len(q))) END").replace("{match}", "starts_with(term, q)"))
def search_and_prefix(spark, sf):
    return search.search(_queries(spark, sf), _index(spark, sf))


@query(
    _SEARCH.replace("{queries}", "SELECT s_suppkey AS query_id, 'x' || lower(string_split(p_name, ' ')[2])[2:] AS query FROM supplier JOIN part ON p_partkey = s_suppkey")
    .replace("{weight}", "0.45 * len(term) / (len(term) + 1)")
    .replace("{match}", "levenshtein(q, term) = 1 AND len(q) >= 5")
)
def search_fuzzy(spark, sf):
    return search.search(_queries(spark, sf, True), _index(spark, sf))


@query("""
SELECT p_brand, p_partkey, position, total FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY y DESC NULLS LAST, p_name, p_partkey) AS position, count(*) OVER (PARTITION BY p_brand) AS total FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END y FROM part)) WHERE position > 5 AND position <= 15
""")
def search_page(spark, sf):
    hits = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("year"))
    out = search.page(hits, ["p_brand"], search.sort_key("year", True), 5, 10)
    return out.select("p_brand", F.col("id").alias("p_partkey"), "position", "total")


def _stream(spark, sf):
    e = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return _observed(spark, sf, e).select(F.col("user_id").cast("string").alias("key"), "state", F.col("ts").cast("timestamp").alias("checked_at"), F.col("event_id").alias("tie"))


@query(f"SELECT user_id, state, confirmations FROM ({_STREAK})")
def stream_confirmations(spark, sf):
    out = jobs.replay(jobs.confirmations(_stream(spark, sf), 2, "40 days"), "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("state", "confirmations"), "batch").alias("x"))
    return last.select(F.col("key").cast("long").alias("user_id"), "x.state", F.col("x.confirmations").cast("long").alias("confirmations"))


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS day, state, count(*) AS count FROM ({_AUDIT}) GROUP BY 1, 2")
def stream_counts(spark, sf):
    out = jobs.replay(jobs.state_counts(_stream(spark, sf), "40 days"), "update")
    return out.groupBy("day", "state").agg(F.max_by("count", "batch").alias("count"))


from heddle import content_queries, rule_queries, run_queries, version_queries  # noqa: E402, F401  (register more)

__all__ = ["QUERIES", "SQL"]
