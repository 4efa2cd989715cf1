"""Queries for contents, attachments, authors and formats, and the same in DuckDB SQL.

Texts that both sides build from the tables are written once, in SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import contents
from heddle.functions import text as T
from heddle.operators import classify, enrich, facets, merge, search
from heddle.registry import query, table
from heddle.sources import attachments

# --- contents embedded in pages

_SIZE = "CAST(length(coalesce(html, '')) AS STRING)"
_TITLE = """'{"meta":{"title":"' || %s || '"}}'"""
#: What each page embeds: good objects, and one of each kind that must not get through.
_OBJECT = f"""CASE page_id % 16
  WHEN 0 THEN '{{"meta":{{"title":"' || md5(url) || ' }}{{ ' || chr(92) || '" x"}},"size":' || {_SIZE} || '}}'
  WHEN 1 THEN '{{"size":' || {_SIZE} || CASE page_id % 3 WHEN 0 THEN '000000000000000000000' WHEN 1 THEN '.0' ELSE '' END || '}}'
  WHEN 2 THEN {_TITLE % "url"}
  WHEN 3 THEN {_TITLE % "replace(url, ':', chr(92) || 'u0001:')"}
  WHEN 4 THEN {_TITLE % "md5(url) || chr(92) || 'u0009end '"}
  WHEN 5 THEN '{{"files":[{{"n":"' || md5(url) || '.mp4"}},{{"n":"x.pdf","s":' || {_SIZE} || '}}' || CASE page_id % 3 WHEN 0 THEN ',7' ELSE '' END || ']}}'
  WHEN 6 THEN '{{}}'
  WHEN 7 THEN '{{"size":1,"meta":' || CASE page_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '3' ELSE '{{"title":null}}' END || '}}'
  WHEN 8 THEN '{{"files":[{{"n":"a.mkv"}},{{"n":"' || md5(url) || '.TXT"}},{{}},{{"n":"late.zip"}},5]}}'
  WHEN 9 THEN {_TITLE % "'Course data: ' || md5(url)"}
  WHEN 10 THEN {_TITLE % "'mailto:' || md5(url)"}
  WHEN 11 THEN {_TITLE % "repeat(md5(url), 128) || CASE page_id % 3 WHEN 0 THEN 'y' ELSE '' END"}
  WHEN 12 THEN '{{"meta":{{"title":"' || md5(url)
  WHEN 13 THEN NULL
  WHEN 14 THEN {_TITLE % "'<b>' || md5(url)"}
  ELSE '{{"size":"5","meta":{{"title":"' || md5(url) || '"}}}}' END"""
_BODY = f"""coalesce(html, '') || coalesce('DATA= ' || {_OBJECT} || ' ;{{', 'DATA') || CASE page_id % 16 WHEN 12 THEN 'DATA={{"size":1}}' ELSE '' END"""
_ITEMS, _BYTES = 3, 9000
_CONTROL = r"[\x00-\x1F\x7F-\x9F]"
_LOCATOR = f"contains({{c}}, '://') OR regexp_matches({{c}}, '^({'|'.join(contents.SCHEMES)}):')"


def _types(names: str) -> str:
    ext = f"list_transform({names}, lambda n: lower(regexp_extract(trim(n), '\\.([^./]+)$', 1)))"
    kinds = ", ".join(f"CASE WHEN list_has_any({ext}, [{', '.join(repr(x) for x in xs)}]) THEN '{t}' END" for t, xs in contents.MATERIALS.items())
    return f"list_sort(list_filter([{kinds}], lambda x: x IS NOT NULL))"


@query(rf"""
WITH p AS (SELECT page_id, CASE page_id % 16 WHEN 12 THEN '{{"size":1}}' ELSE {_OBJECT} END AS o, strlen({_BODY}) > {_BYTES} AS large FROM pages),
v AS (SELECT page_id, large, o, json_type(o, '$.meta') AS mt, json_type(o, '$.meta.title') AS tt, json_extract_string(o, '$.meta.title') AS raw, json_type(o, '$.size') AS st, json_extract_string(o, '$.size') AS sv,
  json_type(o, '$.files') AS ft, from_json(json_extract(o, '$.files'), '["JSON"]')[1:{_ITEMS}] AS items FROM p),
w AS (SELECT *, trim(regexp_replace(raw, '{_CONTROL}', ' ', 'g')) AS title, lower(trim(regexp_replace(raw, '{_CONTROL}', '', 'g'))) AS bare FROM v),
x AS (SELECT *, coalesce(mt <> 'OBJECT', false) OR coalesce(tt <> 'VARCHAR', false) OR coalesce(regexp_matches(raw, '{_CONTROL}') AND ({_LOCATOR.format(c="bare")}), false) OR coalesce(strlen(title) > 4096, false)
    OR coalesce(st <> 'UBIGINT' OR CAST(sv AS HUGEINT) > 9223372036854775807, false) OR coalesce(ft <> 'ARRAY', false) OR coalesce(len(list_filter(items, lambda i: json_type(i) <> 'OBJECT')) > 0, false) AS bad,
  coalesce(regexp_matches(title, '[<>]') OR {_LOCATOR.format(c="lower(title)")}, false) OR (coalesce(title, '') = '' AND sv IS NULL AND coalesce(len(items), 0) = 0) AS unfit,
  list_transform(items, lambda i: json_extract_string(i, '$.n')) AS names FROM w),
y AS (SELECT *, CASE WHEN large THEN 'failed' WHEN o IS NULL THEN 'not_found' WHEN bad OR unfit THEN 'failed' ELSE 'extracted' END AS state FROM x)
SELECT page_id, state, CASE WHEN state = 'extracted' THEN title END AS name, CASE WHEN state = 'extracted' THEN CAST(sv AS BIGINT) END AS size_bytes, CASE WHEN state = 'extracted' THEN names END AS items,
  CASE WHEN state = 'extracted' THEN {_types("list_concat([title], coalesce(names, []))")} END AS material_types FROM y
""")
def embedded_content(spark, sf):
    fields = {"name": "meta.title", "size_bytes": "size", "items": "files", "item_name": "n", "item_size_bytes": "s"}
    rules = spark.createDataFrame([(0, ["none", "DATA="], fields)], "rule_ord int, markers array<string>, fields map<string,string>")
    bodies = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("sha256"), F.lit(0).alias("rule_ord"), F.expr(_BODY).alias("body"))
    out = enrich.extract(bodies, rules, _ITEMS, _BYTES)
    return out.select(F.col("sha256").cast("long").alias("page_id"), "state", "content.name", "content.size_bytes", F.transform("content.items", lambda i: i["name"]).alias("items"), "content.material_types")


# --- which of several contents of a link is kept


@query("""
WITH i AS (SELECT l_suppkey, l_partkey, l_orderkey * 8 + l_linenumber AS o, l_returnflag AS f, CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linestatus END AS m FROM lineitem),
c AS (SELECT *, CAST(q % 3 AS BIGINT) AS size, CASE WHEN f = 'R' THEN ['audio'] WHEN f = 'N' THEN ['audio', 'video'] ELSE [] END AS t, list_transform(range(0, q % 4), lambda k: {'name': CASE WHEN f = 'A' AND k > 0 THEN NULL ELSE f || k END, 'size': (q + k) % 2}) AS items FROM i),
j AS (SELECT *, len(t) + (m IS NOT NULL)::INT + (size <> 0)::INT + len(items) + len(list_filter(items, lambda x: x.name IS NOT NULL)) + len(list_filter(items, lambda x: x.size <> 0)) AS score,
  '{' || concat_ws(',', CASE WHEN m IS NOT NULL THEN '"name":"' || m || '\\u0026"' END, CASE WHEN size <> 0 THEN '"size_bytes":' || size END,
    CASE WHEN len(items) > 0 THEN '"items":[' || array_to_string(list_transform(items, lambda x: '{' || concat_ws(',', CASE WHEN x.name IS NOT NULL THEN '"name":"' || x.name || '"' END, CASE WHEN x.size <> 0 THEN '"size_bytes":' || x.size END) || '}'), ',') || ']' END,
    CASE WHEN len(t) > 0 THEN '"material_types":["' || array_to_string(t, '","') || '"]' END) || '}' AS said FROM c)
SELECT l_suppkey, l_partkey, CAST(arg_max(score, (score, -r)) AS INT) AS score, arg_min(said, (-score, said)) AS content FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY said) AS r FROM j) GROUP BY 1, 2
""".replace("\\\\u", "\\u"))
def content_preference(spark, sf):
    q, f = F.col("l_quantity").cast("long"), F.col("l_returnflag")
    a = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    item = lambda k: F.struct(F.when((f == "A") & (k > 0), F.lit(None)).otherwise(F.concat(f, k.cast("string"))).alias("name"), F.lit(None).cast("string").alias("kind"), ((q + k) % 2).alias("size_bytes"))
    items = F.transform(F.when(q % 4 > 0, F.sequence(F.lit(0), (q % 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>")), item)
    name = F.when(F.col("l_linenumber") % 3 == 0, F.lit("")).otherwise(F.concat("l_linestatus", F.lit("&")))
    content = F.struct(
        name.alias("name"), F.lit("").alias("kind"), (q % 3).alias("size_bytes"), F.lit(None).cast("long").alias("file_count"), F.lit(0).cast("long").alias("folder_count"), items.alias("items"),
        F.when(f == "R", a("audio")).when(f == "N", a("audio", "video")).otherwise(a()).alias("material_types"),
    ).cast(contents.CONTENT)
    text = lambda v: F.lit(v).alias(v)
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", *[text(x) for x in ("url", "host", "provider", "kind", "role")], F.lit(False).alias("primary"), F.lit(None).cast("string").alias("label"), content.alias("content"))
    kept = merge.merge_links(rows, ["l_suppkey", "l_partkey"], F.lit("k"), ["l_orderkey", "l_linenumber"])
    return kept.select("l_suppkey", "l_partkey", merge.information("content").alias("score"), merge.written_out("content").alias("content"))


# --- attachments of messages

#: A message an order, a file a line of it: names with folders, letters and counts that vary, and a hash.
_MESSAGE = "CASE o_orderkey % 5 WHEN 0 THEN 'in/' ELSE ' ' END || CASE o_orderkey % 7 WHEN 0 THEN 'Doc ' ELSE 'doc ' END || CAST(o_custkey AS STRING) || CASE o_orderkey % 11 WHEN 0 THEN '.pdf' WHEN 1 THEN ' (2).torrent' ELSE '.torrent' END"
_FILE = "'files/' || CAST(l_orderkey * 8 + l_linenumber AS STRING) || '/DOC ' || CAST(o_custkey AS STRING) || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN ' (1)' WHEN 2 THEN ' (2)' ELSE '(3)' END || '.torrent'"
_HASH = "CASE WHEN o_custkey % 3 = 0 AND l_linenumber % 5 = 0 THEN NULL ELSE sha1(CAST(o_custkey % 100 * 10 + CASE WHEN o_custkey % 4 = 0 THEN l_linenumber % 2 ELSE 0 END AS STRING)) END"
_LAST = "lower(trim(regexp_extract({c}, '([^/]*)$', 1)))"


@query(f"""
WITH m AS (SELECT DISTINCT CAST(o_orderkey AS STRING) AS message_id, {_LAST.format(c=_MESSAGE)} AS name FROM orders WHERE o_orderkey % 11 <> 0), names AS (SELECT name, count(*) AS wanted FROM m GROUP BY 1),
f AS (SELECT {_FILE} AS path, {_LAST.format(c=_FILE)} AS own, {_HASH} AS h FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT path, h, CASE WHEN own IN (SELECT name FROM names) THEN own ELSE regexp_replace(own, ' \\([0-9]+\\)\\.torrent$', '.torrent') END AS name FROM f),
g AS (SELECT name, count(DISTINCT path) AS files, count(DISTINCT h) AS hashes, count(*) FILTER (h IS NULL) AS unread, min(h) AS h FROM p GROUP BY 1)
SELECT message_id, 'magnet:?xt=urn:btih:' || h AS url, 'magnet' AS provider, 'torrent' AS kind, 'mirror' AS role FROM m JOIN names USING (name) JOIN g USING (name) WHERE hashes = 1 AND unread = 0 AND (wanted = 1 OR files >= wanted)
""")
def attachment_links(spark, sf):
    orders = table(spark, sf, "orders")
    said = orders.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").cast("string").alias("message_id"), F.expr(_MESSAGE).alias("file_name"))
    lines = table(spark, sf, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    sha1 = F.expr(_HASH)
    files = lines.select(F.expr(_FILE).alias("path"), sha1.alias("info_sha1"), F.when(sha1.isNull(), "no dictionary").alias("error"))
    return attachments.magnet_links(attachments.match(files, said))


# --- authors, formats


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(source) WHEN 1 THEN source || '!' WHEN 2 THEN ' "' || source || '"  ' ELSE CASE doc_id % 3 WHEN 0 THEN '?!' ELSE source END END AS author,
  CASE WHEN quality IS NULL THEN ['other'] WHEN quality = 1 THEN ['metal'] WHEN doc_id % 11 = 0 THEN ['other', 'small'] ELSE ['small'] END AS c FROM documents LEFT JOIN labels USING (doc_id)),
a AS (SELECT *, trim(regexp_replace(lower(coalesce(author, '')), '[^\\p{L}\\p{N}+#]+', ' ', 'g')) AS k FROM d),
n AS (SELECT k, t, count(*) AS n FROM (SELECT k, CASE WHEN c[1] = 'other' THEN c[2] ELSE c[1] END AS t FROM a WHERE k <> '') WHERE t IS NOT NULL GROUP BY 1, 2), m AS (SELECT k, arg_max(t, (n, CASE t WHEN 'metal' THEN 0 ELSE -1 END)) AS main, max(n) AS top, sum(n) AS al FROM n GROUP BY 1)
SELECT doc_id, CASE WHEN c = ['other'] AND al >= 2 AND top * 100 >= al * 55 THEN [main] ELSE c END AS categories FROM a LEFT JOIN m USING (k)
""")
def author_majority(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    k, s = F.col("doc_id"), F.col("source")
    author = F.when(k % 4 == 0, F.upper(s)).when(k % 4 == 1, F.concat(s, F.lit("!"))).when(k % 4 == 2, F.concat(F.lit(' "'), s, F.lit('"  '))).otherwise(F.when(k % 3 == 0, "?!").otherwise(s))
    a = lambda *v: F.array(*[F.lit(x) for x in v])
    labels = F.when(F.col("quality").isNull(), a("other")).when(F.col("quality") == 1, a("metal")).when(k % 11 == 0, a("other", "small")).otherwise(a("small"))
    taxonomy = spark.createDataFrame([("metal", 0), ("small", 1), ("other", 2), ("service", 3)], "id string, ord int")
    out = classify.propagate_majority(d.select("doc_id", author.alias("author"), labels.alias("categories")), "author", "categories", taxonomy, percent=55)
    return out.select("doc_id", "categories")


_GUARDED = [
    classify.FormatRule("workshop", words=["ring"], unless=[(["bolt", "panel"], "red bolt")]),
    classify.FormatRule("book_guide", both=[(["anvil", "gear"], ["small", "large", "steel"])], phrases=["blue gear"]),
    classify.FormatRule("audio", words=["rod"]),
]
_FORMATS = """
SELECT *, CASE WHEN len(f) = 0 THEN ['unspecified'] ELSE f END AS formats FROM (SELECT p_partkey, list_filter([
  CASE WHEN regexp_matches(t, ' ring ') OR (regexp_matches(t, ' (bolt|panel) ') AND NOT contains(t, ' red bolt ')) THEN 'workshop' END, CASE WHEN (regexp_matches(t, ' (anvil|gear) ') AND regexp_matches(t, ' (small|large|steel) ')) OR contains(t, ' blue gear ') THEN 'book_guide' END,
  CASE WHEN contains(t, ' rod ') THEN 'audio' END, CASE WHEN p_size % 7 = 0 THEN 'torrent_attachment' END], lambda x: x IS NOT NULL) AS f FROM (SELECT *, ' ' || lower(p_name) || ' ' || lower(p_type) || ' ' AS t FROM part))
"""


def _formats(spark, sf):
    formats, source = classify.format_labels(T.tokens(T.normalize(F.concat_ws(" ", "p_name", "p_type"))), _GUARDED, F.col("p_size") % 7 == 0)
    return table(spark, sf, "part").select("p_partkey", formats.alias("formats"), source.alias("source"))


@query(f"SELECT p_partkey, formats, CASE WHEN len(f) = 0 THEN 'fallback' WHEN f[1] = 'torrent_attachment' THEN 'availability' ELSE 'title' END AS source FROM ({_FORMATS})")
def format_guards(spark, sf):
    return _formats(spark, sf)


@query(f"""
SELECT id, label, ord, coalesce(n, 0) AS count FROM (VALUES ('workshop', 'Workshop', 0), ('book_guide', 'Book', 1), ('audio', 'Audio', 2), ('torrent_attachment', 'Attachment', 3), ('unspecified', 'Other', 4), ('marathon', 'Marathon', 5)) t(id, label, ord)
LEFT JOIN (SELECT x AS id, count(*) AS n FROM (SELECT unnest(formats) AS x FROM ({_FORMATS})) GROUP BY 1) USING (id)
""")
def format_facets(spark, sf):
    names = ["Workshop", "Book", "Audio", "Attachment", "Other", "Marathon"]
    rows = [(i, n, k) for k, (i, n) in enumerate(zip([*classify.format_order(_GUARDED), "marathon"], names, strict=True))]
    return classify.facet_counts(_formats(spark, sf), "formats", spark.createDataFrame(rows, "id string, label string, ord int"))


# --- drill-down facets

_PART = """
SELECT p_partkey, list_filter([' ' || upper(split_part(p_name, ' ', 1)), CASE WHEN p_size % 9 = 0 THEN 'Service' END, CASE WHEN p_size % 4 = 0 THEN 'odd' END, CASE WHEN p_size % 6 = 0 THEN 'Secret' END], lambda x: x IS NOT NULL) AS categories, [p_type] AS formats, [p_brand] AS providers,
  CASE WHEN p_size % 5 > 0 THEN 2000 + p_size % 7 END AS year, p_retailprice > 1000 AS has_password FROM part
"""
_ASKED = """
SELECT s_suppkey AS request_id, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ['red', ' BLUE ', 'odd'] ELSE [' ', 'small'] END AS categories, CASE s_suppkey % 4 WHEN 0 THEN ['economy', 'nothing'] ELSE [] END AS formats,
  CASE s_suppkey % 5 WHEN 0 THEN ['brand#1', 'BRAND#3', 'brand#' || (s_suppkey % 25)] END AS providers, CASE s_suppkey % 2 WHEN 0 THEN [2001, 2003] ELSE [] END AS years, CASE WHEN s_suppkey % 7 < 2 THEN true WHEN s_suppkey % 7 < 4 THEN false END AS has_password FROM supplier
"""
_NAMED = [("categories", "RED", "Red things", False), ("categories", "Blue", "Blue", False), ("categories", " odd", "Odd ones ", False), ("categories", "secret", "Hidden", True), ("formats", "Economy", "Economy class", False)]
_DRILL = f"""
WITH p AS (SELECT p_partkey, list_transform(categories, lambda x: trim(lower(x))) AS c, list_transform(formats, lambda x: lower(x)) AS f, list_transform(providers, lambda x: lower(x)) AS b, year AS y, has_password AS h FROM ({_PART})),
v AS (SELECT * FROM p WHERE NOT list_contains(c, 'service')), names(facet, shown, label, hidden) AS (VALUES {", ".join(f"('{f}', '{i.strip()}', '{n.strip()}', {h})" for f, i, n, h in _NAMED)}),
r AS (SELECT request_id, list_filter(list_transform(coalesce(categories, []), lambda x: trim(lower(x))), lambda x: x <> '') AS rc, list_transform(formats, lambda x: lower(x)) AS rf, list_transform(coalesce(providers, []), lambda x: lower(x)) AS rb, years AS ry, has_password AS rh FROM ({_ASKED})),
m AS (SELECT *, len(rc) = 0 OR list_has_any(c, rc) AS oc, len(rf) = 0 OR list_has_any(f, rf) AS of, len(rb) = 0 OR list_has_any(b, rb) AS ob, len(ry) = 0 OR coalesce(list_contains(ry, y), false) AS oy, rh IS NULL OR rh = h AS oh FROM v, r),
e AS (SELECT request_id, 'categories' AS facet, unnest(list_distinct(c)) AS value FROM m WHERE of AND ob AND oy AND oh UNION ALL SELECT request_id, 'formats', unnest(f) FROM m WHERE oc AND ob AND oy AND oh UNION ALL SELECT request_id, 'providers', unnest(b) FROM m WHERE oc AND of AND oy AND oh
  UNION ALL SELECT request_id, 'year', CAST(y AS VARCHAR) FROM m WHERE oc AND of AND ob AND oh AND y IS NOT NULL UNION ALL SELECT request_id, 'has_password', CAST(h AS VARCHAR) FROM m WHERE oc AND of AND ob AND oy),
n AS (SELECT request_id, facet, value, count(*) AS count FROM e GROUP BY ALL UNION ALL SELECT request_id, 'has_password', w, 0 FROM r, (VALUES ('true'), ('false')) t(w) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.request_id = r.request_id AND facet = 'has_password' AND value = w)),
l AS (SELECT request_id, n.facet, coalesce(shown, value) AS value, CASE WHEN n.facet = 'providers' THEN 'host of ' || value ELSE coalesce(label, value) END AS label, count FROM n LEFT JOIN names ON names.facet = n.facet AND lower(shown) = value WHERE NOT coalesce(hidden, false))
SELECT *, CAST(row_number() OVER (PARTITION BY request_id, facet ORDER BY CASE WHEN facet = 'year' THEN -CAST(value AS INT) ELSE 0 END, lower(regexp_replace(label, '[0-9]+', '')), CAST(nullif(regexp_extract(label, '[0-9]+'), '') AS INT)) AS INT) AS position FROM l
"""


@query(_DRILL)
def facet_drill_down(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    odd = lambda n, word: F.when(size % n == 0, word)
    named = F.array_compact(F.array(F.concat(F.lit(" "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))), odd(9, "Service"), odd(4, "odd"), odd(6, "Secret")))
    rows = table(spark, sf, "part").select(k.alias("id"), named.alias("categories"), F.array("p_type").alias("formats"), F.array(F.struct(F.concat(F.lit("host of "), F.lower("p_brand")).alias("host"), F.col("p_brand").alias("provider"), F.lit("").alias("url"))).alias("links"), F.when(size % 5 > 0, 2000 + size % 7).alias("year"), (F.col("p_retailprice") > 1000).alias("has_password"))
    s, none = F.col("s_suppkey"), F.array().cast("array<string>")
    a = lambda *v: F.array(*[F.lit(x) if isinstance(x, str | int) else x for x in v])
    requests = table(spark, sf, "supplier").select(
        s.alias("request_id"), F.when(s % 3 == 1, a("red", " BLUE ", "odd")).when(s % 3 == 2, a(" ", "small")).alias("categories"), F.when(s % 4 == 0, a("economy", "nothing")).otherwise(none).alias("formats"),
        F.when(s % 5 == 0, a("brand#1", "BRAND#3", F.concat(F.lit("brand#"), s % 25))).alias("providers"), F.when(s % 2 == 0, a(2001, 2003)).otherwise(F.array().cast("array<int>")).alias("years"), F.when(s % 7 < 2, True).when(s % 7 < 4, False).alias("has_password"),
    )
    shown = search.visible(rows)
    definitions = {f: spark.createDataFrame([x[1:] for x in _NAMED if x[0] == f], "id string, label string, hidden boolean") for f in ("categories", "formats")}
    index = facets.build_index(shown.withColumn("providers", search.provider_set(F.col("links"))), definitions, search.provider_labels(shown))
    return facets.drill_down(requests, index)
