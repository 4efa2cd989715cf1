"""Queries that hold the rules for titles, sources, clusters, addresses and search against SQL
written from the rules."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import titles
from heddle.operators import audit, cluster, merge, search
from heddle.plans import build
from heddle.registry import query, table
from heddle.sources import exports

_BLANK = r"[\s\x0b\x{85}\x{a0}\p{Z}]"


@query(rf"""
WITH r AS (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN '- •  ' WHEN 1 THEN '’''[' WHEN 2 THEN '"[' ELSE '' END, text, CASE WHEN doc_id % 2 = 0 THEN ' (2024' ELSE '' END) AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, regexp_replace(t, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t FROM r),
q AS (SELECT doc_id, CASE WHEN regexp_matches(t, '^[''’]+\[') THEN ltrim(t, '''’') ELSE t END AS t FROM s),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^(?:[-—–•] {_BLANK}*)+', ''), '{_BLANK}+$', '') AS t FROM q)
SELECT doc_id, CASE WHEN regexp_matches(t, '\s\(2024$') THEN regexp_replace(left(t, length(t) - 5), '{_BLANK}+$', '') ELSE t END AS title FROM b
""")
def clean_titles(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "- •  ").when(k == 1, "’'[").when(k == 2, '"[').otherwise("")
    raw = F.concat(head, "text", F.when(F.col("doc_id") % 2 == 0, " (2024").otherwise(""))
    return d.select("doc_id", T.identity_title(T.clean_title(raw), F.lit(2024)).alias("title"))


_MALFORMED = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || ' ] ' || text WHEN 1 THEN '[' || source || '| ' || text WHEN 2 THEN '[x]' || source || '|]' || text WHEN 3 THEN '  ]' || text ELSE text END AS t FROM documents WHERE text IS NOT NULL"


@query(rf"""
WITH r AS ({_MALFORMED}), c AS (SELECT doc_id, t, CASE WHEN starts_with(t, '[') THEN instr(t, '|') ELSE instr(t, ']') END AS pos FROM r),
p AS (SELECT doc_id, t, pos, CASE WHEN starts_with(t, '[') THEN t[2:pos - 1] ELSE t[1:pos - 1] END AS a, CASE WHEN starts_with(t, '[') AND t[pos + 1] = ']' THEN t[pos + 2:] ELSE t[pos + 1:] END AS b FROM c WHERE pos > 0),
s AS (SELECT doc_id, t, regexp_replace(a, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS author, regexp_replace(b, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS title FROM p)
SELECT doc_id, author, title FROM s WHERE author <> '' AND title <> '' AND (starts_with(t, '[') OR NOT contains(author, '['))
""")
def malformed_authors(spark, sf):
    k, t = F.col("doc_id") % 5, F.lit
    said = F.when(k == 0, F.concat("source", t(" ] "), "text")).when(k == 1, F.concat(t("["), "source", t("| "), "text")).when(k == 2, F.concat(t("[x]"), "source", t("|]"), "text")).when(k == 3, F.concat(t("  ]"), "text")).otherwise(F.col("text"))
    found = table(spark, sf, "documents").select("doc_id", T.malformed_author(said).alias("m"))
    return found.filter("m IS NOT NULL").select("doc_id", "m.author", "m.title")


@query("""
SELECT o_orderkey, CASE WHEN fits THEN p END AS author, CASE WHEN fits THEN 'Trip ' || d || ' ― ' || e END AS title FROM (
  SELECT o_orderkey, substr(o_orderpriority, 3) AS p, strftime(o_orderdate, '%d.%m') AS d, strftime(o_orderdate, '%d/%m/%Y') AS e, o_custkey % 5 IN (0, 1, 2) AS fits FROM orders)
""")
def date_headings(spark, sf):
    o, k, t = table(spark, sf, "orders"), F.col("o_custkey") % 5, F.lit
    d, e = F.date_format("o_orderdate", "dd.MM"), F.date_format("o_orderdate", "dd/MM/yyyy")
    label, author = F.substring("o_orderpriority", 3, 100), F.concat(t("Trip  "), d)
    said = F.concat(t("Trip "), d, t(" ―  "), e)
    # with a year behind it, a doubled bracket, two labels; without a label, with an empty one
    line = F.when(k == 0, F.concat(t("["), label, t("] "), said, t(" (1999)\nmore"))).when(k == 1, F.concat(t("[["), label, t("]] "), said)).when(k == 2, F.concat(t("["), label, t("][x] "), said, t("\n"))).when(k == 3, said).otherwise(F.concat(t("[] "), said))
    found = o.select("o_orderkey", T.date_range_heading(e, author, line, F.when(k == 0, 1999)).alias("m"))
    return found.select("o_orderkey", "m.author", "m.title")


@query("SELECT page_id, CASE WHEN page_id % 3 = 2 THEN url ELSE 'See ' || CASE WHEN page_id % 3 = 0 THEN 'this' ELSE url || 'x this' END END AS title FROM pages")
def titles_without_urls(spark, sf):
    u, k = F.col("url"), F.col("page_id") % 3
    title = F.when(k == 0, F.concat(F.lit("See \t"), u, F.lit("  this"))).when(k == 1, F.concat(F.lit("See "), u, F.lit("x this"))).otherwise(u)
    return table(spark, sf, "pages").select("page_id", T.without_words(title, F.array("url")).alias("title"))


#: Titles with what the rules make of them; the rest of each title stands in brackets, which protect it.
_PAIRS = [
    ("Vyazanie kryuchkom dlya nachinayuschih", "Вязание крючком для начинайущих"), ("Zhivopis maslom s nulya", "Живопис маслом с нуля"), ("Plain English heading", "Plain English heading"), ("7.[Kanal] Zhizn dlya sebya", "[Kanal] Жизн для себя"),
    ("„[Kanal] Obuchenie onlayn", "[Kanal] Обучение онлайн"), ("Kurs dlya file_2024_FULL s nulya", "Курс для file_2024_FULL с нуля"), ("Fish &amp; chips", "Fish & chips"), ("Shkola dlya app.example s nulya", "Школа для app.example с нуля"),
]
_OPEN = r"[\[\]&_\p{Cf}]"


@query(rf"""
SELECT doc_id, want || ' [' || t || ']' AS title, raw || ' [' || t || ']' AS title_original, want <> raw AS title_changed
FROM (SELECT doc_id, regexp_replace(text, '{_OPEN}', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL) JOIN (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_PAIRS))}) p(i, raw, want) ON doc_id % {len(_PAIRS)} = i
""")
def title_translit(spark, sf):
    raw = F.element_at(F.array(*[F.lit(a) for a, _ in _PAIRS]), (F.col("doc_id") % len(_PAIRS) + 1).cast("int"))
    whole = F.concat(raw, F.lit(" ["), F.regexp_replace("text", _OPEN, " "), F.lit("]"))
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", whole.alias("title"))
    return titles.normalize_titles(d, "title")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 OR (p_size % 3 = 0 AND bool_or(p_size % 2 = 0) OVER k) THEN min(CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN p_partkey END) OVER k ELSE p_partkey END AS component FROM part WINDOW k AS (PARTITION BY p_name, p_brand)
""")
def repaired_clusters(spark, sf):
    p = table(spark, sf, "part").withColumn("node", F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    key = T.identity_key("p_name", "p_brand")
    same = cluster.key_edges(p, "node", F.when(F.col("p_size") % 2 == 0, key), "I")
    fixed = cluster.repaired_edges(p, "node", F.when((F.col("p_size") % 2 != 0) & (F.col("p_size") % 3 == 0), key), same, "I")
    return cluster.cluster(p, "node", [same, fixed]).select("p_partkey", F.col("component").cast("long").alias("component"))


@query("SELECT p_partkey, CASE WHEN bool_or(p_size % 7 = 0) OVER k THEN min(p_partkey) OVER k ELSE p_partkey END AS component FROM part WINDOW k AS (PARTITION BY p_name, p_brand)")
def converged_clusters(spark, sf):
    p = table(spark, sf, "part").withColumn("node", F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    edges = cluster.converged_edges(p, "node", T.identity_key("p_name", "p_brand"), F.col("p_size") % 7 == 0)
    return cluster.cluster(p, "node", [edges]).select("p_partkey", F.col("component").cast("long").alias("component"))


_HEADS = ("2001", "2002", "2620", "3fff", "fe80", "fc00", "2a00", "ff02", "0000", "4000", "2606", "2003")


def _ranges() -> str:
    """First and last address of each block, as 32 hex digits; IPv4 stands below 0000...ffff."""
    nets = map(ipaddress.ip_network, audit.unsafe_blocks())
    mapped = lambda n, a: int(a) + (0xFFFF << 32 if n.version == 4 else 0)
    return ", ".join(f"('{mapped(n, n[0]):032x}', '{mapped(n, n[-1]):032x}', {n.version})" for n in nets)


@query(f"""
WITH n AS (SELECT c_custkey, c_custkey % 4 AS k, (c_custkey * 2654435761) % 4294967296 AS n, [{", ".join(f"'{x}'" for x in _HEADS)}][1 + c_custkey // 4 % {len(_HEADS)}] || substr(md5(CAST(c_custkey AS VARCHAR)), 5) AS h FROM customer),
a AS (SELECT c_custkey, CASE WHEN k < 2 THEN '00000000000000000000ffff' || printf('%08x', n) WHEN k = 2 THEN h ELSE substr(h, 1, 4) || repeat('0', 24) || substr(h, 29) END AS x, CASE WHEN k < 2 THEN 4 ELSE 6 END AS v FROM n)
SELECT c_custkey, bool_or(lo IS NOT NULL) OR c_custkey % 50 = 7 AS unsafe FROM a LEFT JOIN (VALUES {_ranges()}) b(lo, hi, bv) ON v = bv AND x BETWEEN lo AND hi GROUP BY 1
""")
def unsafe_address(spark, sf):
    c = F.col("c_custkey")
    n, k = c * F.lit(2654435761) % F.lit(4294967296), c % 4
    dotted = F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    h = F.concat(F.element_at(F.array(*[F.lit(x) for x in _HEADS]), (F.floor(c / 4) % len(_HEADS) + 1).cast("int")), F.substring(F.md5(c.cast("string")), 5, 28))
    group = lambda i: F.regexp_replace(F.substring(h, 4 * i + 1, 4), "^0{1,3}", "")
    # plain, mapped, all groups and shortened by turns; some hosts have an address that is none besides
    ip = F.when(k == 0, dotted).when(k == 1, F.concat(F.lit("::FFFF:"), dotted)).when(k == 2, F.concat_ws(":", *[group(i) for i in range(8)])).otherwise(F.concat(group(0), F.lit("::"), group(7)))
    a = table(spark, sf, "customer").select(c.alias("host"), F.explode(F.when(c % 50 == 7, F.array(ip, F.lit("1:2:3"))).otherwise(F.array(ip))).alias("ip"))
    blocks = spark.createDataFrame([(b,) for b in audit.unsafe_blocks()], "block string")
    return audit.unsafe_addresses(a, blocks).withColumnRenamed("host", "c_custkey")


@query("""
SELECT p_partkey, position FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size % 7 = 0, p_size, CAST(regexp_extract(p_brand, '\\d+') AS INT), p_partkey) AS position FROM part) WHERE position <= 100
""")
def natural_order(spark, sf):
    said = F.concat(F.lit("Item "), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_brand"))
    # case and leading zeros say nothing; a blank author comes last
    title = F.when(F.col("p_partkey") % 2 == 0, F.upper(said)).otherwise(F.replace(said, F.lit("Item "), F.lit("Item 00")))
    hits = table(spark, sf, "part").select("p_type", F.col("p_partkey").alias("id"), title.alias("title"), F.when(F.col("p_size") % 7 != 0, title).otherwise(" ").alias("author"))
    return search.page(hits, ["p_type"], search.sort_key("author", False), 0, 100).select(F.col("id").alias("p_partkey"), "position")


def definitions(spark):
    return spark.createDataFrame([("metal", "Metal", False), ("color", "Colors", False), ("service", "Service", True)], "id string, label string, hidden boolean")


@query("""
SELECT p_partkey, p_name AS title, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS author, CASE WHEN p_size % 4 = 0 THEN p_size || '-' || (p_size + 1) WHEN p_size % 4 = 1 THEN '' ELSE CAST(p_size AS VARCHAR) END AS year, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS provider,
  CASE WHEN p_size % 2 = 0 THEN ['Colors', 'Metal'] ELSE ['Metal'] END AS labels FROM part
""")
def result_cards(spark, sf):
    n, t = F.col("p_size"), F.lit
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(n % 3 == 0, " ").otherwise(F.col("p_brand")).alias("author"), F.when(n % 4 > 1, n).alias("year"), F.when(n % 4 == 0, F.struct(n.alias("from"), (n + 1).alias("to"))).alias("year_range"),
        F.when(n % 5 != 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("providers"), F.when(n % 2 == 0, F.array(t("color"), t("service"), t("metal"))).otherwise(F.array(t("metal"))).alias("categories"),
    )
    return search.card(rows, definitions(spark)).withColumnRenamed("id", "p_partkey")


@query("""
SELECT p_partkey, concat_ws(' ', p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_name || '!' END, nullif(trim(p_brand), ''), p_size, p_size - 1, p_size + 1, 'first', 'last', 'origin', 'link', 'metal', 'course', 'title', 'pw' || p_size, 'note', 'Metal', 'Course', 'drive', 'h.test',
  'https://h.test/' || p_partkey, 'label', 'h.test', 'Drive', 'file', 'primary', 'name', 'folder', 'video', 'a.mp4', 'clip', 'e' || p_partkey, 'm', 7, 'u', 'first', 'origin', 'link', 'm', 'n') AS search_text FROM part
""")
def search_texts(spark, sf):
    p, t, c = table(spark, sf, "part"), F.lit, F.col
    key = c("p_partkey").cast("string")
    content = F.struct(t("name").alias("name"), t("folder").alias("kind"), F.array(t("video")).alias("material_types"), F.array(F.struct(t("a.mp4").alias("name"), t("clip").alias("kind"))).alias("items"))
    link = F.struct(F.concat(t("https://h.test/"), key).alias("url"), t(" label").alias("label"), t("h.test").alias("host"), t("Drive ").alias("provider"), t("file").alias("kind"), t("primary").alias("role"), content.alias("content"))
    source = F.struct(F.concat(t("e"), key).alias("entry_id"), t("m").alias("message_id"), t(7).alias("telegram_message_id"), t("u").alias("message_url"), F.array(t("m"), t("n")).alias("source_message_ids"), t("first").alias("added_at"), t("origin").alias("origin"), t("link").alias("availability"))
    one = lambda v, n: F.array(t(v)).alias(n)
    rows = p.select(
        c("p_partkey").alias("id"), c("p_name").alias("title"), F.when(c("p_size") % 2 == 0, F.concat("p_name", t("!"))).alias("title_original"), c("p_brand").alias("author"), c("p_size").alias("year"), F.struct((c("p_size") - 1).alias("from"), (c("p_size") + 1).alias("to")).alias("year_range"),
        t("first").alias("first_added_at"), t("last").alias("last_added_at"), one("origin", "origins"), one("link", "availability"), one("metal", "categories"), one("course", "formats"), one("title", "format_sources"),
        F.array(F.concat(t("pw"), c("p_size").cast("string"))).alias("passwords"), F.array(t("note"), t(" ")).alias("notes"), F.array(link).alias("links"), F.array(source).alias("sources"),
    )
    formats = spark.createDataFrame([("course", "Course", False)], "id string, label string, hidden boolean")
    return build.search_rows(rows, definitions(spark), formats).select(c("id").alias("p_partkey"), "search_text")


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_custkey, coalesce(n, 0) AS n, 1 + CAST(floor(o_totalprice) AS BIGINT) % 3 AS d FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
x AS (SELECT o_orderkey, 'exported_message_count' AS rule, d, n AS a FROM o UNION ALL SELECT o_orderkey, 'parsed_link_count', n, 2 * n FROM o UNION ALL SELECT o_orderkey, 'password_value_count', 1, n FROM o)
SELECT 'snapshots' AS "table", CAST(o_orderkey AS VARCHAR) AS key, rule, d || '<>' || a AS value FROM x WHERE d <> a
UNION ALL SELECT 'snapshots', CAST(o_orderkey AS VARCHAR), 'no_entries', CAST(o_orderkey AS VARCHAR) FROM o WHERE n = 0
UNION ALL SELECT 'snapshots', 'source', 'conflicting_source', count(DISTINCT o_custkey) FILTER (o_custkey <> 0) || '/0' FROM orders HAVING count(DISTINCT o_custkey) FILTER (o_custkey <> 0) > 1
""")
def source_faults(spark, sf):
    """Orders as snapshots, their items as entries, with counters that are often wrong."""
    t = F.lit
    link = F.array_repeat(F.struct(t("u").alias("url")), 2)
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("snapshot_ord"))
    # an item is a message and an entry; rows of their own, as ``read_snapshots`` gives them, not arrays of an order
    entries = lines.select("snapshot_ord", link.alias("links"), F.array(t("p")).alias("passwords"))
    count = lines.groupBy("snapshot_ord").agg(F.count("*").cast("int").alias("_n"))
    o = orders.join(count, F.col("o_orderkey") == F.col("snapshot_ord"), "left")
    n = F.coalesce("_n", t(0))
    stats = F.struct(F.struct((1 + F.floor("o_totalprice") % 3).alias("exported_message_count")).alias("retrieval"), F.struct(n.alias("catalog_entry_count"), n.alias("parsed_link_count"), t(1).alias("password_value_count")).alias("parsing"))
    source = F.struct(F.col("o_custkey").alias("channel_id"), t("").alias("web_url"))
    headers = o.select(F.col("o_orderkey").alias("snapshot_ord"), t("").alias("exported_at"), source.alias("source"), stats.alias("stats"))
    return build.source_violations(exports.Snapshots(headers, lines, entries))


@query("""
WITH l AS (SELECT l_suppkey, l_partkey % 50 AS p, (l_orderkey, l_linenumber) AS pos, l_returnflag, l_quantity, l_linestatus FROM lineitem),
s AS (SELECT l_suppkey, p, list(l_linestatus ORDER BY f) AS sources FROM (SELECT l_suppkey, p, l_linestatus, min(pos) AS f FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT l_suppkey, p, arg_min(l_quantity, pos) > 25 AS first_upper, bool_or(l_quantity > 49) AS "primary", arg_min(l_returnflag, pos) FILTER (l_returnflag <> 'N') AS label, any_value(sources) AS sources FROM l JOIN s USING (l_suppkey, p) GROUP BY 1, 2
""")
def source_link_merge(spark, sf):
    li, c = table(spark, sf, "lineitem"), F.col
    n = (c("l_partkey") % 50).cast("string")
    # one address in two spellings
    url = F.when(c("l_quantity") > 25, F.concat(F.lit(" HTTPS://H.test:443/"), n)).otherwise(F.concat(F.lit("https://h.test/"), n, F.lit("#x")))
    link = F.struct(url.alias("url"), (c("l_quantity") > 49).alias("primary"), F.when(c("l_returnflag") != "N", c("l_returnflag")).alias("label"), F.lit(None).cast("string").alias("normalized_from"), F.array("l_linestatus").alias("sources"))
    out = merge.merge_source_links(li.select("l_suppkey", "l_orderkey", "l_linenumber", F.array(link).alias("links")), "l_suppkey", ["l_orderkey", "l_linenumber"])
    x = out.select("l_suppkey", F.explode("links").alias("x"))
    return x.select("l_suppkey", F.regexp_extract("x.url", r"/(\d+)(?:#x)?$", 1).cast("long").alias("p"), F.col("x.url").contains("HTTPS").alias("first_upper"), "x.primary", "x.label", "x.sources")
