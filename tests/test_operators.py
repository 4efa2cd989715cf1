import datetime as dt
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from heddle.functions import addresses, contents
from heddle.operators import audit, classify, cluster, enrich, merge, quality, search
from heddle.plans import build
from heddle.plans.components import connected_components
from heddle.sources import attachments, exports, stores

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_upsert_is_idempotent(spark):
    rows = [(0, 0, "a", "old", ["x"]), (1, 0, "a", " ", ["y", "x"]), (2, 0, "a", "new", None), (0, 1, "b", None, [])]
    df = spark.createDataFrame(rows, "o int, p int, k string, v string, arr array<string>")
    fold = lambda d: sorted((r["k"], r["v"], r["arr"]) for r in merge.upsert(d, "k", ["o", "p"], arrays=["arr"]).collect())
    assert fold(df) == fold(df.unionByName(df)) == [("a", "new", ["x", "y"]), ("b", None, [])]


def test_long_chain_and_empty(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(chain.repartition(3)).agg(F.min("component"), F.max("component"), F.count("*")).first() == (1, 1, 200)
    assert connected_components(chain.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("rows", "n"),
    [
        ([("1", "u", "some writer knitting patterns", 2024), ("2", "u", "knitting patterns", None)], 1),
        ([("1", "u", "art", None), ("2", "u", "cartography", None)], 2),
        ([("1", "u", "x course", 2023), ("2", "u", "course", 2024)], 2),
        ([("1", "u", "a b", 2023), ("2", "u", "a", None), ("3", "u", "a c", 2024)], 1),
        ([("1", "u", "a", None), ("2", "v", "a", None)], 2),
    ],
)
def test_affix_clusters(spark, rows, n):
    df = spark.createDataFrame(rows, "id string, link string, title string, year int")
    edges = [cluster.key_edges(df, "id", cluster.title_link_key("link", "title"), "TL"), cluster.affix_edges(df, "link", "title", "year")]
    assert cluster.cluster(df, "id", edges).select("component").distinct().count() == n


def test_keywords(spark):
    words = spark.createDataFrame([("a", "go"), ("b", "golang"), ("c", "data science"), ("d", "фото съемк*"), ("e", "дизайн*"), ("service", "how to download")], "id string, keyword string")
    tax = spark.createDataFrame([(x, x, False, i) for i, x in enumerate(["a", "b", "c", "d", "e", "other", "service"])], "id string, label string, hidden boolean, ord int")
    docs = spark.createDataFrame([(1, "go data science"), (2, "google golangs"), (3, "фото съемка дизайнер"), (4, "nothing"), (5, "go how to download"), (6, "")], "k int, t string")
    got = {r["k"]: r["categories"] for r in classify.classify(docs, "k", F.col("t"), tax, words).collect()}
    assert got == {1: ["a", "c"], 2: ["b"], 3: ["e"], 4: ["other"], 5: ["service"], 6: ["other"]}


def test_guards(spark):
    docs = spark.createDataFrame([(1, "video course x"), (2, "video course photographer")], "k int, t string")
    blocks = spark.createDataFrame([("p", "video", "photographer*")], "id string, phrase string, unless string")
    assert [tuple(r) for r in classify.blocked(docs, "k", F.col("t"), blocks).collect()] == [(1, "p")]


def test_audit_precedence_and_streak(spark):
    rules = [{"rule_ord": 0, "dead_statuses": [418], "dead_body": ["gone"], "mismatch_body": ["(?i)не найден"], "required_body": ["file"]}]
    rows = [
        (200, "file", None, 0, "live"), (200, "nothing", None, 0, "content_mismatch"), (200, "НЕ НАЙДЕН file", None, 0, "content_mismatch"), (200, "gone", None, 0, "expired"), (418, "", None, 0, "expired"), (418, "", None, None, "unknown"),
        (404, "", None, None, "expired"), (410, "", "timeout", 0, "transient"), (403, "", None, 0, "blocked"), (503, "", None, None, "transient"), (302, "", None, 0, "unknown"), (None, None, None, None, "unknown"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, http_status int, body string, transport_error string, rule_ord int, want string")
    assert audit.classify(df, rules).filter("not (state <=> want)").collect() == []
    now = spark.createDataFrame([("x", "expired"), ("y", "expired"), ("z", "blocked")], "sha256 string, state string")
    old = spark.createDataFrame([("x", "expired", 1), ("y", "content_mismatch", 4), ("gone", "expired", 3)], "sha256 string, state string, confirmations int")
    assert {r["sha256"]: r["confirmations"] for r in audit.advance(now, old).collect()} == {"x": 2, "y": 1, "z": 0}


def test_host_rules(spark):
    rows = spark.createDataFrame([("a.example.com",), ("badexample.com",), ("example.com",), (None,)], "host string")
    rules = spark.createDataFrame([(1, "example.com"), (0, "a.example.com")], "rule_ord int, host_suffix string")
    assert {r["host"]: r["rule_ord"] for r in audit.match_rule(rows, rules).collect()} == {"a.example.com": 0, "badexample.com": None, "example.com": 1, None: None}


def test_enrichment(spark):
    fields = {"name": "meta.name", "items": "files", "item_name": "n", "size_bytes": "size"}
    rules = spark.createDataFrame([(0, ['"p":'], fields)], "rule_ord int, markers array<string>, fields map<string,string>")
    good = 'x "p": {broken "p": {"meta":{"name":"A\\u0001b"},"files":[{"n":"a.mp4"},{"n":"b.pdf"},{"n":"c.zip"}],"size":3} tail'
    rows = [("1", 0, good), ("2", 0, "nothing"), ("3", 0, '"p": {"size":-1}'), ("4", 0, '"p": {"meta":{"name":"see https://x"}}'), ("5", None, good), ("6", 0, None)]
    got = {r["sha256"]: r for r in enrich.extract(spark.createDataFrame(rows, "sha256 string, rule_ord int, body string"), rules, 2, 1 << 20).collect()}
    assert {k: r["state"] for k, r in got.items()} == {"1": "extracted", "2": "not_found", "3": "failed", "4": "failed", "5": "not_found", "6": "not_found"}
    assert got["1"]["content"]["name"] == "A b" and got["1"]["content"]["material_types"] == ["document", "video"] and len(got["1"]["content"]["items"]) == 2


def test_search(spark):
    docs = spark.createDataFrame([("1", "Ёлка праздник", "a"), ("4", "prefixation tools", "b"), ("5", "alpha", None)], "id string, title string, author string")
    index = search.build_index(docs, "id", {"title": F.col("title"), "author": F.col("author")})
    assert search.search(spark.createDataFrame([], "query_id int, query string"), index).count() == 0
    asked = spark.createDataFrame([(1, "елка"), (2, "pref"), (3, "prefexation"), (4, "alpa"), (5, "елка missing"), (6, "")], "query_id int, query string")
    assert sorted((r["query_id"], r["id"]) for r in search.search(asked, index).collect()) == [(1, "1"), (2, "4"), (3, "4")]


def test_equal_queries_are_scored_once(spark, monkeypatch):
    docs = spark.createDataFrame([("1", "red bolt"), ("2", "red gear")], "id string, title string")
    index = search.build_index(docs, "id", {"title": F.col("title")})
    scored, seen = search._scored, []
    monkeypatch.setattr(search, "_scored", lambda rated, *more: seen.append(rated.select("query_id").distinct().count()) or scored(rated, *more))
    asked = spark.createDataFrame([(1, "red bolt"), (2, "BOLT  red"), (3, "bolt red red"), (4, "gear"), (5, "gexr"), (6, "boltt"), (7, "Boltt"), (None, "gear")], "query_id int, query string")
    found = sorted((r["query_id"] or 0, r["id"]) for r in search.search(asked, index).collect())
    assert found == [(0, "2"), (1, "1"), (2, "1"), (3, "1"), (4, "2"), (6, "1"), (7, "1")] and seen == [2, 1]


def test_answers_of_equal_queries_are_small_when_stored(spark, tmp_path):
    words = ["plate", "anvil", "gizmo", "widget", "bracket", "spring", "washer", "handle"]
    docs = spark.range(1000).select("id", F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("id") % 8 + 1).cast("int")).alias("title"))
    asked = spark.range(8000).select(F.col("id").alias("query_id"), F.concat(F.lit("x"), F.element_at(F.array(*[F.lit(w[1:]) for w in words]), (F.xxhash64("id") % 4 + 5).cast("int"))).alias("query"))
    found = search.search(asked, search.build_index(docs, "id", {"title": F.col("title")}))
    found.write.parquet(f"{tmp_path}/found")
    rows = spark.read.parquet(f"{tmp_path}/found")
    assert rows.count() == 8000 * 125 == rows.distinct().count()
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < 0.6 * 8000 * 125


def test_scores_of_queries_meet_where_the_document_is(spark):
    index = search.build_index(spark.createDataFrame([("1", "red bolt"), ("2", "red gear")], "id string, title string"), "id", {"title": F.col("title")})
    asked = spark.createDataFrame([("bolt red", 2, "bolt"), ("bolt red", 2, "red"), ("gea", 1, "gea")], "query_id string, n_terms int, q string")
    scored = search._scored(search._rated(asked, index.dictionary, False), index, search.BOOSTS)
    assert sorted((r["query_id"], r["id"]) for r in scored.collect()) == [("bolt red", "1"), ("gea", "2")]
    assert not re.search(r"hashpartitioning\(query_id#\d+, id#", scored._jdf.queryExecution().executedPlan().toString())


def test_cells_hand_out_every_answer_to_every_query(spark, monkeypatch):
    for n, v in (("CELL", 8), ("ANSWERS", 2), ("ASKING", 4), ("LEAST_ROWS", 50)):
        monkeypatch.setattr(search, n, v)
    named = [(None if i == 3 else i // 2, "a" if i < 37 else "b c", i) for i in range(40)] + [(99, "unanswered", 40)]
    found = [("a", f"d{i}", i / 4) for i in range(21)] + [("b c", None, 0.5), ("b c", "d1", 0.25), ("never asked", "d2", 1.0)]
    out = search._handed_out(spark.createDataFrame(named, "query_id int, said string, n long"), spark.createDataFrame(found, "said string, id string, score double"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((q, i, x)) for q, said, _ in named for told, i, x in found if said == told)
    assert out.columns == ["query_id", "id", "score"] and out.rdd.getNumPartitions() > 1


def test_quality(spark):
    bad = spark.createDataFrame([(H("a"), "expired", "2024-01-01T00:00:00Z"), (H("a"), "odd", "nope"), ("x", None, None)], "sha256 string, reason string, confirmed_at string")
    got = sorted((r["rule"]) for r in quality.tombstone_rules(bad).collect())
    assert got == ["confirmed_at", "confirmed_at", "duplicate_key", "hash", "reason", "reason"]
    rules = spark.createDataFrame([(0, "example.com"), (1, "a.example.com"), (2, "Bad_")], "rule_ord int, host_suffix string")
    assert sorted(r["rule"] for r in quality.policy_rules(rules).collect()) == ["host_suffix", "lower_case", "shadowed_rule"]


def bencode(x):
    if isinstance(x, int):
        return b"i%de" % x
    if isinstance(x, bytes):
        return b"%d:%s" % (len(x), x)
    return b"d" + b"".join(bencode(k) + bencode(v) for k, v in sorted(x.items())) + b"e"


def sha(x):
    return hashlib.sha1(bencode(x[b"info"])).hexdigest()


def test_attachments(spark, tmp_path):
    red, blue = ({b"info": {b"name": n, b"length": 1}} for n in (b"a", b"b"))
    files = {
        # a name of one message, also with the count of a browser, and in other letters
        "own.torrent": red, "counted (12).torrent": blue, "Loud.TORRENT": red,
        # a file and its copy: alike, and not alike
        "same.torrent": red, "same (1).torrent": red, "differ.torrent": red, "differ (1).torrent": blue,
        # names that two messages bear, with one file and with two
        "scarce.torrent": red, "plenty.torrent": blue, "plenty (3).torrent": blue,
        # what only looks like a count; a counted name that a message bears itself
        "near(1).torrent": red, "letters (x).torrent": red, "full (2).torrent": blue, "full.torrent": red, "other.pdf": red,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(bencode(data))
    (tmp_path / "junk.torrent").write_bytes(b"junk")
    (tmp_path / "large.torrent").write_bytes(b"d4:info" + b"x" * (16 << 20))
    hashed = attachments.hashes(attachments.read_files(spark, str(tmp_path)))
    names = ["own", "counted", " LOUD", "same", "differ", "scarce", "scarce", "plenty", "plenty", "near", "letters", "full (2)", "full", "junk", "missing", "large"]
    rows = [(str(i), f"some/folder/{n}.torrent") for i, n in enumerate(names)] + [("pdf", "other.pdf"), ("none", None), ("own", "own (1).torrent")]
    said = spark.createDataFrame([*rows, rows[0]], "message_id string, file_name string")
    want = {"0": red, "1": blue, "2": red, "3": red, "7": blue, "8": blue, "11": blue, "12": red}
    assert {tuple(r) for r in attachments.match(hashed, said).collect()} == {(k, sha(v)) for k, v in want.items()}
    assert sorted((r["key"].rsplit("/", 1)[1], r["value"]) for r in attachments.unreadable(hashed, said).collect()) == [("junk.torrent", "no dictionary"), ("large.torrent", "too large")]
    link = attachments.magnet_links(attachments.match(hashed, said)).filter("message_id = '0'").first()
    assert tuple(link)[1:] == (f"magnet:?xt=urn:btih:{sha(red)}", "magnet", "torrent", "mirror")


def entry(i, title, link, added="2024-01-01T00:00:00Z", year=None, author=None, message="m"):
    x = {"url": link, "host": "example.test", "provider": "p", "kind": "file_host", "role": "primary", "primary": True, "label": None, "normalized_from": link, "sources": ["text"]}
    return {"entry_id": i, "message_id": message, "source_message_ids": [], "added_at": added, "origin": "text_block", "title": title, "year": year, "availability": "download_link", "passwords": [], "notes": f"note {i}", "raw_block": title, "credit": {"author": author}, "links": [x]}


def snapshot(entries, channel=1, **counts):
    stats = {"retrieval": {"exported_message_count": 1}, "parsing": {"catalog_entry_count": len(entries), "parsed_link_count": sum(len(e["links"]) for e in entries), "password_value_count": sum(len(e["passwords"]) for e in entries)} | counts}
    message = {"message_id": "m", "telegram_message_id": 5, "url": "https://t.test/5", "media": {"type": "messageMediaDocument", "document": {"file_name": "x.torrent", "mime_type": "application/x-bittorrent"}}}
    return {"schema_version": "3", "exported_at": "2024-03-01T00:00:00Z", "source": {"channel_id": channel, "title": "C"}, "stats": stats, "messages": [message], "catalog_entries": entries}


def saved(spark, path, *documents):
    path.mkdir()
    for n, doc in enumerate(documents):
        (path / f"{n}.json").write_text(json.dumps(doc))
    return exports.read_exports(spark, str(path))


@pytest.fixture
def controls(spark):
    tax = spark.createDataFrame([("development", "D", False, 0), ("other", "O", False, 1), ("service", "S", True, 2)], "id string, label string, hidden boolean, ord int")
    words = spark.createDataFrame([("development", "weaving")], "id string, keyword string")
    dead = spark.createDataFrame([(H("https://dead.test/x"), "manual", dt.datetime(2024, 1, 1))], "sha256 string, reason string, confirmed_at timestamp")
    return build.Controls(tax, words, tombstones=dead)


def test_catalog_build(spark, tmp_path, controls):
    a, b = "https://example.test/a", "https://example.test/b"
    first = [
        entry("1", "Practical weaving", a), entry("2", "• Practical weaving", b, "2024-02-01T00:00:00Z"), entry("3", "Other thing", "https://dead.test/x"), entry("4", "", a),
        entry("5", "Ann Lee] Knots", "https://example.test/t", "2024-01-02T00:00:00Z"), entry("6", "Knots", "https://example.test/u", author="Ann Lee"), entry("7", "[Other| Knots", "https://example.test/v"), entry("8", "Far thing", a, message="none"),
    ]
    made = build.build_catalog(saved(spark, tmp_path / "in", snapshot(first), snapshot([first[0] | {"notes": "later", "links": [first[0]["links"][0] | {"url": a + "#again", "label": "L"}]}])), controls, strict=False)
    rows = {r["entry_id"]: r for r in made.entries.collect()}
    # an author in the title joins only an entry of that author and title
    assert set(rows) == {"1", "6", "7"} and rows["6"]["members"] == 2 and {s["entry_id"] for s in rows["6"]["sources"]} == {"5", "6"}
    assert [s["entry_id"] for s in rows["1"]["sources"]] == ["1", "2"] and [(x["url"], x["label"]) for x in rows["1"]["links"]] == [(a, "L"), (b, None)] and rows["1"]["notes"] == ["later", "note 2"]
    assert rows["1"]["categories"] == ["development"] and rows["1"]["formats"] == ["torrent_attachment"] and rows["1"]["origins"] == ["text_block"] and rows["1"]["primary_category"] == "development"
    assert sorted(r["rule"] for r in made.violations.collect()) == ["blank_title", "orphan"]
    assert {r["id"]: r["count"] for r in made.facets.collect()} == {"development": 1, "other": 2, "service": 0}
    stats = made.stats.first()
    assert (stats["tombstoned"], stats["dropped"], stats["kept"]) == (1, 1, 3) and made.source.first()["channel_id"] == 1
    root = str(tmp_path / "store")
    assert build.activate(made.entries, controls.taxonomy, root, "v1", "2024-03-01 00:00:00").collect() == []
    assert stores.active_version(spark, root) == "v1" and stores.read_active(spark, root).count() == 3
    broken = made.entries.withColumns({"title": F.lit(" "), "origins": F.array().cast("array<string>"), "primary_format": F.lit("none")})
    assert {r["rule"] for r in build.activate(broken, controls.taxonomy, root, "v2", "2024-03-02 00:00:00").collect()} == {"title", "origins", "primary_format"}
    assert stores.active_version(spark, root) == "v1"
    stores.write_catalog(made.entries.select("id", "title", "links"), str(tmp_path / "json"))
    back = stores.read_catalog(spark, str(tmp_path / "json"), made.entries.select("id", "title", "links").schema)
    assert back.count() == 3
    found = search.search(spark.createDataFrame([(1, "later"), (2, "torrent_attachment"), (3, "t.test"), (4, "zzz")], "query_id int, query string"), build_search(made.entries, controls))
    assert sorted({r["query_id"] for r in found.collect()}) == [1, 2, 3]


def build_search(entries, controls):
    return search.build_index(build.search_rows(entries, controls.taxonomy), "id", {"text": F.col("search_text")})


def test_attached_links_do_not_cluster(spark, tmp_path, controls):
    one = {b"info": {b"name": b"a", b"length": 1}}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.torrent").write_bytes(bencode(one))
    read = saved(spark, tmp_path / "in", snapshot([entry("1", "Red roof", "https://example.test/a"), entry("2", "Red roof tiles", "https://example.test/b")]))
    made = build.build_catalog(read, controls, attachments.read_files(spark, str(tmp_path / "files")))
    assert [[(x["kind"], x["role"]) for x in r["links"]] for r in made.entries.collect()] == [[("file_host", "primary"), ("torrent", "mirror")]] * 2
    assert {r["id"]: r["count"] for r in made.format_facets.collect()} == {"torrent_attachment": 2, "unspecified": 0}
    (tmp_path / "files" / "x.torrent").write_bytes(b"junk")
    with pytest.raises(quality.Broken, match="unreadable_file"):
        build.build_catalog(read, controls, attachments.read_files(spark, str(tmp_path / "files")))


def test_members_unite_in_the_order_of_definitions(spark, tmp_path, controls):
    # the first member says "book", the second "course"; the definitions have them the other way round
    controls.formats = [("course", ["course"]), classify.FormatRule("book", ["book"])]
    controls.format_labels = spark.createDataFrame([("course", "Course")], "id string, label string")
    link = "https://example.test/a"
    rows = [entry("1", "Blue sky book", link), entry("2", "Blue sky book course", link, "2024-02-01T00:00:00Z", author="ann")]
    rows[0]["passwords"], rows[1]["passwords"] = ["x", "y"], ["y", "z"]
    first = snapshot(rows)
    first["messages"][0]["media"]["type"] = "text"
    content = ("n", None, 1, None, None, [("i", None, None)], [])
    controls.cache = spark.createDataFrame([(H(link), "extracted", dt.datetime(2024, 1, 1), content)], stores.SIDECARS["cache"])
    made = build.build_catalog(saved(spark, tmp_path / "in", first), controls)
    one = made.entries.first()
    assert (one["members"], one["formats"], one["primary_format"], one["passwords"]) == (2, ["course", "book"], "course", ["x", "y", "z"])
    assert [tuple(r) for r in made.format_facets.orderBy("ord").collect()] == [("course", "Course", 0, 1), ("book", "book", 1, 1), ("torrent_attachment", "torrent_attachment", 2, 0), ("unspecified", "unspecified", 3, 0)]
    stats = made.stats.first()
    assert (stats["entries"], stats["links"], stats["enriched_links"], stats["passwords"], stats["normalized_titles"]) == (1, 1, 1, 3, 0)


def test_richer_content_wins(spark):
    kind = f"k int, o int, url string, host string, provider string, kind string, role string, primary boolean, label string, content {contents.CONTENT}"
    item = lambda *x: x + (None,) * (3 - len(x))
    name = lambda n, items=None, types=None, size=None: (n, None, size, None, None, items, types)
    cases = [
        # two items that say little against one that says more
        (name("a", [item("x"), item("y")]), name("b", [item("x", "k", 5), item(None, None, 1)]), 1), (name("a", [item(None)] * 4), name("b", [item("x", "k", 9)]), 0),
        # equal amounts: the smaller text, not the shorter one
        (name("b"), name("aaaa"), 1), (name("z&"), name("z'"), 1), (name("z~"), name("z&"), 0 + 1), (name("a", size=10), name("a", size=9), 0), (name("a", [], []), name("a", None, None), 0),
    ]
    rows = [(k, o, "u", "h", "p", "k", "r", False, None, c) for k, case in enumerate(cases) for o, c in enumerate(case[:2])]
    for order in (["o"], ["back"]):
        df = spark.createDataFrame(rows, kind).withColumn("back", -F.col("o"))
        got = {r["k"]: tuple(r["content"])[0] for r in merge.merge_links(df, ["k"], F.lit("x"), order).collect()}
        assert got == {k: case[case[2]][0] for k, case in enumerate(cases)}


def test_authors_are_the_same_by_normalized_name(spark):
    tax = spark.createDataFrame([("dev", 0), ("art", 1), ("other", 2), ("service", 3)], "id string, ord int")
    rows = [(1, "Ann B", ["dev"]), (2, "ann  b!", ["dev", "art"]), (3, "ANN B", ["other"]), (4, "ann b", ["other", "dev"]), (5, "ann b", ["other"]), (6, "?", ["other"]), (7, "!", ["dev"]), (8, "?!", ["dev"]), (9, None, ["other"]), (10, "Bo", ["dev"]), (11, "bo", ["art"]), (12, "BO", ["other"])]
    out = classify.propagate_majority(spark.createDataFrame(rows, "k int, author string, categories array<string>"), "author", "categories", tax)
    assert {r["k"]: r["categories"] for r in out.collect() if r["inherited"]} == {3: ["dev"], 5: ["dev"]}


def test_format_guards(spark):
    rules = [classify.FormatRule("w", unless=[(["practice"], "big practice")], words=["camp"]), classify.FormatRule("b", both=[(["book"], ["all", "set"])], phrases=["check list"])]
    titles = {"practice": ["w"], "a big practice": [], "big practice camp": ["w"], "book": [], "all the book": ["b"], "check list": ["b"], "check the list": [], "set book practice": ["w", "b"]}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    formats, source = classify.format_labels(F.split("t", " "), rules, F.lit(False))
    got = {r["t"]: (r["f"], r["s"]) for r in df.select("t", formats.alias("f"), source.alias("s")).collect()}
    assert got == {t: (f or ["unspecified"], "title" if f else "fallback") for t, f in titles.items()}


LIMITS = "max_body_bytes long, max_items int, stale_after_seconds long"
ENRICH = "rule_ord int, host_suffixes array<string>, markers array<string>, fields map<string,string>"


def test_embedded_objects(spark):
    fields = {"name": "meta.name", "kind": "k-1", "size_bytes": "size", "file_count": "files", "folder_count": "meta.folders", "items": "list", "item_name": "n", "item_kind": "t.u", "item_size_bytes": "s"}
    rules = spark.createDataFrame([(0, ["P:", "Q\\E{"], fields), (1, ["{"], {"name": "a"})], "rule_ord int, markers array<string>, fields map<string,string>")
    long = "x" * 4096
    cases = {
        # texts
        'P: {"meta":{"name":"a}{\\"b"}} }': ("extracted", 'a}{"b'), 'P:{"k-1":"Course data: 2024"}': ("extracted", None), f'P:{{"meta":{{"name":"{long}"}}}}': ("extracted", long), f'P:{{"meta":{{"name":"{long}y"}}}}': ("failed", None),
        'P:{"meta":{"name":"https\\u0001://x"}}': ("failed", None), 'P:{"meta":{"name":"\\u0002mail\\u0003to:x"}}': ("failed", None), 'P:{"meta":{"name":"mailto:x"}}': ("failed", None), 'P:{"meta":{"name":"sftp://h"}}': ("failed", None), 'P:{"meta":{"name":"a <b>"}}': ("failed", None),
        'P:{"meta":{"name":" a\\u0009b "}}': ("extracted", "a b"), 'P:{"meta":{"name":7}}': ("failed", None), 'P:{"meta":{"name":null}}': ("failed", None), 'P:{"meta":{"name":"x","name":"y"}}': ("extracted", "y"),
        # numbers
        'P:{"size":1e24}': ("failed", None), 'P:{"files":3000000000}': ("extracted", None), 'P:{"size":9223372036854775808}': ("failed", None), 'P:{"size":9223372036854775807}': ("extracted", None), 'P:{"size":5.0}': ("failed", None), 'P:{"size":"5"}': ("failed", None), 'P:{"size":-1}': ("failed", None),
        # objects and items
        'P:{"list":[{"n":"a"},3]}': ("failed", None), 'P:{"list":[{}, {"s":1}]}': ("extracted", None), 'P:{"list":{"n":"a"}}': ("failed", None), 'P:{"list":[{"n":"a"},{"n":"b"},{"n":"c"},3]}': ("extracted", None), 'P:{"list":[{"t":3}]}': ("failed", None), 'P:{"meta":3}': ("failed", None),
        'P:{}': ("failed", None), 'P:{"list":[]}': ("failed", None), 'P:{"size":0}': ("failed", None),
        # places
        'P:{"size":"x"} P: {"size":1}': ("extracted", None), 'P: [1] Q\\E{{"size":1}': ("extracted", None), 'P:{"size": P:': ("failed", None), 'P: nothing P:': ("not_found", None), 'P:{"meta":{"name":"P:{"}} P:{"size":1}': ("extracted", "P:{"), 'p:{"size":1}': ("not_found", None),
    }
    rows = [(str(i), 0, body) for i, body in enumerate(cases)] + [("brace", 1, '{{"a":"in"}'), ("long", 0, 'P:{"size":1}' + " " * 9000), ("bytes", 0, 'P:{"size":1}' + "é" * 4400), ("empty", 0, ""), ("none", 9, "P:{}")]
    got = {r["sha256"]: r for r in enrich.extract(spark.createDataFrame(rows, "sha256 string, rule_ord int, body string").repartition(3), rules, 3, 8800).collect()}
    assert {body: (got[str(i)]["state"], got[str(i)]["content"] and got[str(i)]["content"]["name"]) for i, body in enumerate(cases)} == cases
    assert [got[k]["state"] for k in ("brace", "long", "bytes", "empty", "none")] == ["extracted", "failed", "failed", "not_found", "not_found"]
    at = lambda body: got[str(list(cases).index(body))]["content"]
    assert at('P:{"files":3000000000}')["file_count"] == 3_000_000_000 and [i["name"] for i in at('P:{"list":[{"n":"a"},{"n":"b"},{"n":"c"},3]}')["items"]] == ["a", "b", "c"]
    assert [tuple(i) for i in at('P:{"list":[{}, {"s":1}]}')["items"]] == [(None, None, None), (None, None, 1)]


def test_runs_check_their_policies_first(spark):
    rules = spark.createDataFrame([(0, ["a.test"], ["P:"], {"items": "l", "item_name": "n"})], ENRICH)
    many = "P:" + json.dumps({"l": [{"n": f"f{i}.pdf"} for i in range(300)]})
    bodies = spark.createDataFrame([(H("x"), "www.a.test", many), (H("y"), "b.test", many), (H("z"), "a.test", many), (H("w"), "a.test", "none")], "sha256 string, host string, body string")
    at = dt.datetime(2024, 1, 1)
    cache = spark.createDataFrame([(H("z"), "not_found", at, None), (H("old"), "not_found", at, None)], stores.SIDECARS["cache"])
    now = lambda s: F.lit(s).cast("timestamp")
    limits = spark.createDataFrame([(1 << 20, 250, 3600)], LIMITS)
    after, counts = build.enrich_links(bodies, limits, rules, cache, now("2024-01-01 00:59:59"))
    assert counts.first().asDict() == {"candidates": 3, "fresh": 1, "fetched": 2, "extracted": 1, "not_found": 1, "failed": 0}
    assert {r["sha256"]: r["content"] and len(r["content"]["items"]) for r in after.collect()} == {H("x"): 250, H("w"): None, H("z"): None, H("old"): None}
    assert build.enrich_links(bodies, limits, rules, cache, now("2024-01-01 01:00:00"))[1].first()["fresh"] == 0
    assert build.enrich_links(bodies, limits, rules, cache, now("2024-01-01 00:00:01"), refresh=True)[1].first()["fresh"] == 0
    with pytest.raises(quality.Broken, match="max_items"):
        build.enrich_links(bodies, limits.withColumn("max_items", F.lit(1001)), rules, cache, now("2024-01-01"))
    with pytest.raises(quality.Broken, match="content_by_state"):
        build.enrich_links(bodies, limits, rules, cache.withColumn("state", F.lit("extracted")), now("2024-01-01"))
    policy = spark.createDataFrame([(5, 1, 64, 2)], "timeout_seconds int, max_body_bytes long, concurrency int, confirmations_required int")
    hosts = "rule_ord int, host_suffixes array<string>, dead_statuses array<int>, dead_body array<string>, mismatch_body array<string>, required_body array<string>, allowed_redirects array<string>"
    audited = spark.createDataFrame([(1, ["a.test"], [418], ["gone"], [], [], [])], hosts)
    seen = spark.createDataFrame([(H("x"), "a.test", 418, "", None, at), (H("y"), "b.test", 418, "", None, at)], "sha256 string, host string, http_status int, body string, transport_error string, checked_at timestamp")
    before = spark.createDataFrame([(H("x"), "expired", "dead_status", 418, at, 1)], stores.SIDECARS["report"])
    none = spark.createDataFrame([], stores.SIDECARS["tombstones"])
    report, dead = build.audit_links(seen, policy, audited, before, none)
    assert {r["sha256"]: (r["state"], r["confirmations"]) for r in report.collect()} == {H("x"): ("expired", 2), H("y"): ("unknown", 0)} and [r["sha256"] for r in dead.collect()] == [H("x")]
    with pytest.raises(quality.Broken, match="confirmations_required"):
        build.audit_links(seen, policy.withColumn("confirmations_required", F.lit(0)), audited, before, none)
    with pytest.raises(quality.Broken, match="state"):
        build.audit_links(seen, policy, audited, before.withColumn("state", F.lit("odd")), none)


@pytest.mark.parametrize(
    ("rule", "change"),
    [
        ("parsed_link_count", lambda e: [snapshot(e, parsed_link_count=9)]), ("password_value_count", lambda e: [snapshot(e, password_value_count=1)]), ("catalog_entry_count", lambda e: [snapshot(e, catalog_entry_count=0)]), ("no_entries", lambda e: [snapshot([])]),
        ("conflicting_source", lambda e: [snapshot(e), snapshot(e, channel=2)]), ("blank_entry", lambda e: [snapshot([e[0] | {"entry_id": " "}])]), ("added_at", lambda e: [snapshot([e[0] | {"added_at": "soon"}])]), ("orphan", lambda e: [snapshot([e[0] | {"message_id": "z"}])]),
    ],
)
def test_broken_sources_stop_the_build(spark, tmp_path, controls, rule, change):
    read = saved(spark, tmp_path / "in", *change([entry("1", "Title", "https://example.test/a")]))
    with pytest.raises(quality.Broken, match=rule):
        build.build_catalog(read, controls)


def test_broken_controls_stop_the_build(spark, tmp_path, controls):
    read = saved(spark, tmp_path / "in", snapshot([entry("1", "Title", "https://example.test/a")]))
    controls.tombstones = controls.tombstones.withColumn("reason", F.lit("odd"))
    with pytest.raises(quality.Broken, match="reason"):
        build.build_catalog(read, controls)


def test_policies(spark):
    limits = "timeout_seconds int, max_body_bytes long, concurrency int, confirmations_required int"
    rules = "rule_ord int, host_suffixes array<string>, dead_statuses array<int>, dead_body array<string>, mismatch_body array<string>, required_body array<string>, allowed_redirects array<string>"
    good = spark.createDataFrame([(1, ["a.test"], [418], ["gone"], ["x+"], [], [])], rules)
    assert quality.audit_policy_rules(spark.createDataFrame([(5, 1, 64, 10)], limits), good).collect() == []
    bad = spark.createDataFrame([(1, [], [200], ["gone"], ["gone", "("], None, ["A.test", "-x"])], rules)
    got = {r["rule"] for r in quality.audit_policy_rules(spark.createDataFrame([(0, 0, 65, 11)], limits), bad).collect()}
    assert got == {"timeout_seconds", "max_body_bytes", "concurrency", "confirmations_required", "no_host_suffix", "dead_status", "duplicate_pattern", "pattern_compiles", "required_body_missing", "lower_case", "host_suffix"}
    limits, rules = "max_body_bytes long, max_items int, stale_after_seconds long", "rule_ord int, host_suffixes array<string>, markers array<string>, fields map<string,string>"
    good = spark.createDataFrame([(1, ["a.test"], ["m:"], {"name": "a.b", "items": "c", "item_name": "n"})], rules)
    assert quality.enrichment_policy_rules(spark.createDataFrame([(1, 1, 1)], limits), good).collect() == []
    bad = spark.createDataFrame([(1, ["localhost"], [" m", "n", "n"], {"item_name": "a..b", "odd": "x"})], rules)
    got = {r["rule"] for r in quality.enrichment_policy_rules(spark.createDataFrame([(0, 0, 0)], limits), bad).collect()}
    assert got == {"max_body_bytes", "max_items", "stale_after", "no_root_path", "item_fields_need_items", "unknown_field", "marker", "duplicate_marker", "path", "local_host"}


def test_long_phrases_and_numbers(spark):
    phrase = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(1, f"a {phrase} b"), (2, phrase[:-1])], "k int, t string")
    words = spark.createDataFrame([("p", phrase)], "id string, keyword string")
    assert [tuple(r) for r in classify.matches(docs, "k", F.col("t"), words).collect()] == [(1, "p")]
    big = "1" + "0" * 30
    rows = spark.createDataFrame([("v 9",), (f"V {big}",), ("v 0010",), ("б",), ("А",), ("v",)], "t string")
    assert [r["t"] for r in rows.orderBy(search.natural_key("t")).collect()] == ["А", "б", "v", "v 9", "v 0010", f"V {big}"]


def test_sidecars_may_be_missing(spark, tmp_path):
    assert stores.read_sidecar(spark, str(tmp_path / "none"), "tombstones").count() == 0
    df = spark.createDataFrame([(H("b"), "manual", None), (H("a"), "manual", None)], stores.SIDECARS["tombstones"])
    stores.write_sidecar(df, str(tmp_path / "t"), "tombstones")
    back = stores.read_sidecar(spark, str(tmp_path / "t"), "tombstones")
    assert back.count() == 2 and stores.version_of(df) == stores.version_of(back.repartition(2))


def test_addresses_and_redirects(spark):
    want = {
        "2001:db8::1": True, "2001:db9::1": False, "fe80::1": True, "::1": True, "2606:4700::1111": False, "2001:2::7": True, "2002:808:808::1": True, "2620:4f:8000::9": True, "3fff:fff::1": True, "64:ff9b::808:808": True, "::ffff:10.1.1.1": True, "::ffff:8.8.8.8": False,
        "fe80::1%eth0": True, "8.8.8.8": False, "192.31.196.5": True, "192.52.193.1": True, "192.175.48.200": True, "255.255.255.255": True, "192.88.98.1": False, "nonsense": True,
    }
    ips = spark.createDataFrame([(x,) for x in want], "host string").withColumn("ip", F.col("host"))
    found = audit.unsafe_addresses(ips, spark.createDataFrame([(b,) for b in audit.unsafe_blocks()], "block string"))
    assert {r["host"]: r["unsafe"] for r in found.collect()} == want
    hops = [(c, n, "a.test", h, None) for c, hs in {1: ["a.test", "x.b.test"], 2: ["b.test.evil"], 3: ["a.test"] * 6}.items() for n, h in enumerate(hs, 1)]
    df = spark.createDataFrame([*hops, (4, 1, "a.test", "a.test", "local_target")], "chain int, hop int, origin_host string, host string, rejection string")
    allowed = spark.createDataFrame([("a.test", "b.test")], "origin_host string, host_suffix string")
    assert {r["chain"]: r["verdict"] for r in audit.redirect_verdict(df, allowed).collect()} == {1: "follow", 2: "foreign_host", 3: "too_many_hops", 4: "unsafe_target"}


def test_header_rules(spark):
    probes = [(200, None, 0, True, 99), (200, None, 1, False, 0), (404, None, 1, True, 1), (410, None, 0, True, 99), (405, None, None, True, 1), (501, "dns", 0, False, 0), (418, None, 1, True, 1), (418, None, 0, False, 0), (400, None, 0, False, 0), (416, None, None, False, 0), (None, None, 0, False, 0)]
    plan = audit.probe_plan(spark.createDataFrame([(str(i), s, e, r) for i, (s, e, r, _, _) in enumerate(probes)], "sha256 string, http_status int, transport_error string, rule_ord int"), spark.createDataFrame([(0, [], True, 99), (1, [418], False, None)], "rule_ord int, dead_statuses array<int>, needs_body boolean, body_limit long"))
    assert {int(r["sha256"]): (r["needs_get"], r["byte_limit"]) for r in plan.collect()} == {i: (g, n) for i, (_, _, _, g, n) in enumerate(probes)}
    heads = spark.createDataFrame([(0, 1, "A", "u"), (1, 0, " ", "v"), (2, 1, None, None)], "o int, channel_id long, title string, web_url string")
    assert merge.same_source(heads).count() == 0
    assert merge.same_source(heads.withColumn("channel_id", F.lit(0))).count() == 1
    assert merge.fold_header(heads, ["o"]).first()["title"] == "A"
    declared = spark.createDataFrame([(2, 5)], "catalog_entry_count int, parsed_link_count int")
    actual = spark.createDataFrame([(2, 4, 9)], "catalog_entry_count long, parsed_link_count long, password_value_count long")
    assert [tuple(r) for r in quality.reconcile(declared, actual, "export").collect()] == [("export", "parsed_link_count", "count_mismatch", "5<>4")]


def test_small_rules_and_lookups(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    quiet = spark.createDataFrame([("e", H("a"), "manual", at), (" ", "x", "expired", None), ("e", H("a"), "manual", at)], stores.SIDECARS["suppressions"])
    assert {r["rule"] for r in quality.suppression_rules(quiet).collect()} == {"entry", "hash", "reason", "confirmed_at", "duplicate_key"}
    cache = spark.createDataFrame([(H("a"), "extracted", at, ("n", None, 1, 2, 3, [("i", None, None)], ["audio", "video"])), (H("b"), "extracted", at, None), (H("c"), "not_found", at, None), ("d", "odd", at, ("n", None, -1, -2, -3, [(" ", None, None)] * 3, ["video", "audio"]))], stores.SIDECARS["cache"])
    got = sorted((r["key"][:1], r["rule"]) for r in quality.content_rules(cache, max_items=2).collect())
    assert [r for k, r in got if k == "d"] == sorted(["hash", "state", "content_by_state", "size", "file_count", "folder_count", "items", "item_text", "material_types"]) and ("3", "content_by_state") in got and len(got) == 10
    report = spark.createDataFrame([(H("a"), "live", "ok", 200, at, 0), (H("b"), "odd", "ok", 99, None, -1)], stores.SIDECARS["report"])
    assert {r["rule"] for r in quality.report_rules(report).collect()} == {"state", "http_status", "checked_at", "confirmations"}
    assert {r["rule"] for r in quality.identifiers(spark.createDataFrame([("a",), ("a",), (" ",), (None,)], "id string"), "t", "id").collect()} == {"blank_key", "duplicate_key"}
    assert [r["value"] for r in quality.closed_keys(spark.createDataFrame([("1", '{"a":1,"zz":2}')], "id string, doc string"), "t", "id", "doc", ["a"]).collect()] == ["zz"]
    tax = spark.createDataFrame([("a", "A", True)], "id string, label string, hidden boolean")
    assert sorted((r["category"], r["label"], r["hidden"]) for r in search.label_lookup(spark.createDataFrame([("a",), ("b",)], "category string"), tax).collect()) == [("a", "A", True), ("b", "b", False)]
    links = spark.createDataFrame([([("http://me@www.Y.test:8/p", None, " X "), ("http://z.test/", None, None), ("http://z.test/", "Z.test", ""), ("mailto:x", None, None)],)], "links array<struct<url:string,host:string,provider:string>>")
    assert links.select(search.provider_set(F.col("links")).alias("p")).first()["p"] == ["x", "z.test"]
    rows = spark.createDataFrame([(1, ["a", "b"], 2020, True), (2, ["c"], None, False)], "id int, cats array<string>, year int, pw boolean")
    match = lambda cats, years, pw: [r["id"] for r in rows.filter(search.matches_filters({"cats": F.lit(cats).cast("array<string>") if cats is None else F.array(*[F.lit(c) for c in cats])}, F.array(*[F.lit(y) for y in years]).cast("array<int>"), F.col("year"), F.lit(pw).cast("boolean"), F.col("pw"))).collect()]
    assert (match(["b", "c"], [], None), match(None, [2020], None), match([], [], False), match(["a"], [1999], None)) == ([1, 2], [1], [2], [])
    sorts = spark.createDataFrame([("q", 0.5, at), (" ", 0.5, at)], "q string, s double, at timestamp").select(search.default_sort(F.col("q"), F.col("s"), F.col("at")).alias("k")).collect()
    assert sorts[0]["k"] == 0.5 and sorts[1]["k"] > 1e15
    root = str(tmp_path / "store")
    for n in (1, 2):
        stores.publish(tax, root, f"v{n}", f"2024-01-0{n} 00:00:00")
    published = spark.createDataFrame([("v1",), ("v2",)], "version string")
    assert [r["version"] for r in stores.unprocessed(published, published.filter("version = 'v1'")).collect()] == ["v2"]
    assert stores.drop_inactive(spark, root) == 1 and stores.read_active(spark, root).count() == 1
    (tmp_path / "f.bin").write_bytes(b"abc")
    meta = stores.file_meta(spark, str(tmp_path / "f.bin")).first()
    assert (meta["bytes"], meta["version"]) == (3, hashlib.sha256(b"abc").hexdigest())
    seen = audit.candidates(spark.createDataFrame([(("https", "h", "https://h/", None),), (("https", "h", "https://h/", None),), (("magnet", "", "magnet:x", None),), ((None, None, None, "empty"),)], "link struct<scheme:string,host:string,canonical:string,rejection:string>"))
    assert [tuple(r) for r in seen.collect()] == [(H("https://h/"), "h", "https://h/")]


def test_addresses_are_parsed_as_elsewhere(spark):
    import ipaddress
    import random

    rng = random.Random(2)
    group = lambda: rng.choice(["0", "1", "ffff", f"{rng.randrange(65536):x}", f"{rng.randrange(65536):04X}"])
    texts = [":".join(group() for _ in range(rng.randrange(6, 10))) for _ in range(150)] + [":".join(group() for _ in range(rng.randrange(4))) + "::" + ":".join(group() for _ in range(rng.randrange(5))) for _ in range(250)]
    texts += [":".join(group() for _ in range(rng.choice([5, 6, 7]))) + ":1.2.3.4" for _ in range(30)] + [".".join(str(rng.randrange(300)) for _ in range(rng.choice([3, 4, 4, 4, 5]))) for _ in range(80)]
    texts += ["::", "::1", "1::", ":::", "1::2::3", ":1", "1:", "12345::", "g::", "::ffff:1.2.3.4", "::ffff:01.2.3.4", "01.2.3.4", "1.2.3.4.", "", "x", "fe80::1%eth0", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "::1.2.3.4", "::1.2.3.256"]

    def want(t):
        try:
            ip = ipaddress.ip_address(t.split("%")[0])
        except ValueError:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return (ip.version, int(ip) << (96 if ip.version == 4 else 0))

    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string")
    unsigned = lambda x: x & ((1 << 64) - 1)
    got = {r["t"]: r["a"] and (r["a"]["v"], unsigned(r["a"]["hi"]) << 64 | unsigned(r["a"]["lo"])) for r in df.select("t", addresses.parse("t").alias("a")).collect()}
    assert got == {t: want(t) for t in got} and sum(v is not None for v in got.values()) > 200
    # blocks of every length, longer than a long too
    for bits in (0, 1, 33, 63, 64, 65, 100, 127, 128):
        cut = df.filter(addresses.parse("t").isNotNull()).select(addresses.parse("t").alias("a")).filter("a.v = 6").select("a", addresses.head(F.col("a"), bits).alias("h")).collect()
        mask = ((1 << bits) - 1) << (128 - bits)
        assert all(unsigned(r["h"]["hi"]) << 64 | unsigned(r["h"]["lo"]) == (unsigned(r["a"]["hi"]) << 64 | unsigned(r["a"]["lo"])) & mask for r in cut)
    hosts = spark.createDataFrame([("a", "2001:db8:0:0:0:0:1:2"), ("b", "2001:db8::1:3"), ("c", "9.9.9.9")], "host string, ip string")
    blocks = spark.createDataFrame([("2001:db8::1:2/127",), ("9.9.9.8/31",), ("nonsense",), ("1.2.3.4/33",)], "block string")
    assert {r["host"]: r["unsafe"] for r in audit.unsafe_addresses(hosts, blocks).collect()} == {"a": True, "b": True, "c": True}
    assert not audit.unsafe_addresses(hosts, blocks.limit(0)).filter("unsafe").count()


def test_probe_tells_whether_bodies_are_read(spark):
    rules = spark.createDataFrame([(0, [418], True, True, 9), (1, [418], False, True, 9), (2, [418], False, False, 9)], "rule_ord int, dead_statuses array<int>, dead_body boolean, success_body boolean, body_limit long")
    heads = spark.createDataFrame([(f"{r}-{s}", s, None, r) for r in (0, 1, 2, None) for s in (200, 404, 418, 405, 302)] + [("lost", None, "dns", 0)], "sha256 string, http_status int, transport_error string, rule_ord int")
    got = {r["sha256"]: (r["needs_get"], r["byte_limit"], r["read_body"]) for r in audit.probe_plan(heads, rules).collect()}
    assert {got[f"0-{s}"] for s in (200, 404, 418, 405)} == {(True, 9, "always")} and {got[f"1-{s}"] for s in (200, 404, 418, 405)} == {(True, 9, "on_success")}
    assert [got[k] for k in ("2-200", "2-404", "2-418", "None-404", "None-418", "0-302", "lost")] == [(False, 0, "never"), (True, 1, "never"), (True, 1, "never"), (True, 1, "never"), (False, 0, "never"), (False, 0, "never"), (False, 0, "never")]


def test_files_of_messages_take_no_null_keys_and_no_copies(spark):
    said = spark.createDataFrame([("1", "a.torrent"), ("2", "b.torrent"), ("3", "b.torrent"), ("4", "c.torrent")], "message_id string, file_name string")
    rows = [("x/a.torrent", "h1", None), ("y/a (1).torrent", "h1", None), ("x/b.torrent", "h2", None), ("x/b.torrent", "h2", None), ("x/c.torrent", None, "bad"), ("y/c (2).torrent", "h3", None), ("z/d.torrent", "h4", None)]
    found = attachments.match(spark.createDataFrame(rows, "path string, info_sha1 string, error string"), said)
    assert [tuple(r) for r in found.collect()] == [("1", "h1")]  # b: one file, two messages
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_address_is_parsed_once(spark, monkeypatch):
    kind = "o string, n int, links array<struct<url:string,primary:boolean,label:string,normalized_from:string,sources:array<string>>>"
    link = lambda u: (u, False, None, None, ["s"])
    rows = [(o, n, [link("https://h.test/a"), link(None), link(" odd ")]) for o in "xyz" for n in range(3)]
    parsed, seen = merge.with_link, []
    monkeypatch.setattr(merge, "with_link", lambda df, *more: seen.append(df.count()) or parsed(df, *more))
    found = {r["o"]: [x["url"] for x in r["links"]] for r in merge.merge_source_links(spark.createDataFrame(rows, kind), "o", ["n"]).collect()}
    assert found == {o: ["https://h.test/a", None, " odd "] for o in "xyz"} and seen == [3]
