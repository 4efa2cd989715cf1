"""Licenses, neighbours, WARC, secrets, shards, mixing, chat, language, pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.llm import chat, decontaminate, jaccard, language, licenses, mixing, neighbours, queries, secrets, sharding, warc

from .conftest import SF

DOC = "doc_id long, text string"


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- licenses ---


def test_license_scan_finds_every_notice(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    known = [(n, cut(low(t))) for n, ts in licenses.all_templates().items() for t in ts]
    rng = random.Random(2)
    noise = lambda n: " ".join(f"n{rng.randrange(999)}" for _ in range(n))
    docs = documents(spark)
    for i, (name, texts) in enumerate(licenses.all_templates().items()):
        for j, t in enumerate(texts):
            docs.append((9000 + 10 * i + j, f"{noise(33 * j + 7)} {t} {noise(50)}"))
    docs += [(1, None), (2, ""), (None, "Released under the MIT License.")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(docs, DOC), licenses.templates(spark)).collect()}
    want = {(d, n) for d, t in docs for n, s in known if s <= cut(low(t))}
    assert want <= got
    assert {n for d, n in got if d and d >= 9000} == set(licenses.all_templates())
    # and nothing without three quarters of a template
    assert all(any(len(s & cut(low(t))) >= 0.75 * len(s) for d, t in docs if d == x for n, s in known if n == y) for x, y in got)


def test_license_scan_of_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], DOC), licenses.templates(spark)).count() == 0


# --- neighbours ---


def brute(ids, x, k=10, step=100):
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d))[:k] if d[j] < np.inf]
    return out


def test_recall_and_scores(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    want = brute(v.vec_id.to_numpy(), np.array(v.embedding.tolist(), np.float64))
    got = queries.op3_posting_list_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10 * len(want)
    found = sum((r["vec_id"], r["score"]) in want[r["query_id"]] for r in got)
    assert found >= 0.9 * len(got)


def test_ratio_alone_decides_which_lists_are_read():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(500, 64))
    q = np.concatenate([rng.normal(size=(20, 64)) * 0.1, c[:5] + 1e-3])
    row, to, first = neighbours.within_reach(neighbours.Graph(c), q, 0.35)
    assert (np.bincount(row[first], minlength=len(q)) == neighbours.LEAST_LISTS).all()
    d = np.sqrt(((q[:, None] - c) ** 2).sum(2))
    want = d <= d.min(1, keepdims=True) * 1.35
    assert (want.sum(1) > neighbours.PROBES).sum() >= 20
    got = list(zip(row.tolist(), to.tolist(), strict=True))
    assert len(got) == len(set(got)) and set(map(tuple, np.argwhere(want).tolist())) <= set(got)
    assert np.bincount(row, minlength=len(q)).min() >= neighbours.LEAST_LISTS


def test_lists_are_balanced_and_reach_is_fitted():
    rng = np.random.default_rng(3)
    # one dense cluster holds a third, the rest lies in clusters of very different sizes
    centres = rng.normal(size=(40, 16)) * 3
    which = np.concatenate([np.zeros(4000, int), rng.choice(40, 8000, p=(w := 1 / np.arange(1, 41)) / w.sum())])
    x = (centres[which] + rng.normal(size=(12000, 16))).astype(np.float32)
    c = neighbours.k_means(x, 90)
    share = np.bincount(neighbours._nearest_of(x, c), minlength=len(c))
    assert share.max() <= 4 * len(x) / 90 and (share > len(x) / 90 / 6).mean() > 0.9
    graph = neighbours.Graph(c.astype(np.float64))
    q = x[::50].astype(np.float64)
    far = ((q[:, None] - x) ** 2).sum(2)
    far[np.arange(len(q)), np.arange(0, len(x), 50)] = np.inf
    near = np.argsort(far, 1)[:, :10]
    some = np.repeat(np.arange(0, len(q), 4), 10)
    reach = neighbours.fitted_reach(graph, q, some, x[near[::4].ravel()].astype(np.float64))
    row, to, _ = neighbours.within_reach(graph, q, reach)
    reads = np.zeros((len(q), len(c)), bool)
    reads[row, to] = True
    prow, plist = neighbours.posted(graph, x.astype(np.float64))
    enters = np.zeros((len(x), len(c)), bool)
    enters[prow, plist] = True
    found = np.mean([(enters[near[i]] & reads[i]).any(1).mean() for i in range(len(q))])
    assert found >= 0.9 and reads.mean() < 0.6


def test_query_with_too_few_answers_searches_everywhere(spark):
    # a far cluster of three vectors, of which one asks: its lists alone hold no ten answers
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(900, 8)), 1000 + rng.normal(size=(3, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, "x") for i, r in enumerate(x)], "vec_id long, embedding array<float>, score int, list string")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id").isin(100, 900), least_lists=1).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[900] == brute(np.arange(903), x.astype(np.float64))[900] and len(got[100]) == 10


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:200] = x[0]
    rows = [(i, [float(y) for y in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] + [1.0] * 7), (1300, [None] + [1.0] * 7), (1400, [float("inf")] + [1.0] * 7), (1500, []), (None, [1.0] * 8), (1600, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(np.arange(300), x.astype(np.float64))
    few = neighbours.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


# --- clashing columns and long texts ---


def test_clashing_columns_and_long_texts(spark):
    long = "word " * 300_000  # of more bytes than a slice
    notice = licenses.NOTICES["BSD-3-Clause"][0]
    docs = spark.createDataFrame([(1, f"{long}{notice} token=abcdefgh"), (2, None), (3, "")], DOC)
    odd = docs
    for c in ("version", "hits", "n_words", "items", "hash", "length", "blob", "found", "path", "license", "key", "shingle", "node", "n", "component", "place"):
        odd = odd.withColumn(c, F.lit(f"own {c}"))
    assert {tuple(r) for r in licenses.scan(odd, licenses.templates(spark)).collect()} == {tuple(r) for r in licenses.scan(docs, licenses.templates(spark)).collect()} != set()
    items = spark.createDataFrame([("i", notice, "own", 1)], "item_id string, text string, hash string, length int")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.report(odd, items).collect()}
    n = len(notice.replace(",", "").split())
    assert got == {1: (300_000 + n + 2, n, True), 2: (0, 0, False), 3: (0, 0, False)}
    assert {(r["doc_id"], r["spans"]) for r in secrets.document_secrets(odd).collect()} == {(1, f"assign:{len(long) + len(notice) + 1}:{len(long) + len(notice) + 15}"), (2, ""), (3, "")}
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(odd).collect()} == {(1, 1 + 4 + n + 1 - 4, 1), (2, 0, 2), (3, 0, 3)}
    pages = spark.createDataFrame([(1, "u", "x" * 2000, "own", 5), (2, "u", "x" * 2000, "own", 5)], "page_id long, url string, html string, record_type string, n int")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()) == [(1, "revisit", 2), (2, "response", None)]


# --- WARC ---


def test_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, "http://a\r\nb", big), (3, None, big), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", "\r\n\r\n"), (None, "u", big), (8, "u", "y" * 3_000_000), (9, "u", "y" * 3_000_000)]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 3, 2: 3, None: 3, 8: 9}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_large_files_are_cut_at_members(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [(i, "u", "".join(chr(rng.randrange(33, 127)) for _ in range(20000))) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("own")).coalesce(1)
    path = warc.archive(pages)
    parts = warc.WarcReader({"path": path, "tasks": "64"}).partitions()
    assert len(parts) > 2 and len({p[0] for x in parts for p in x.paths}) == 1
    assert warc.read(spark, path).filter("record_type = 'response'").select("record_id").distinct().count() == 600


def test_foreign_archives_and_pushdown(spark, tmp_path):
    one = warc.record([("WARC-Type", "response"), ("WARC-Target-URI", "http://x/1"), ("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody")
    two = warc.record([("WARC-Type", "request"), ("WARC-Target-URI", "http://x/2")], b"GET / HTTP/1.1\r\n\r\n" * 999)
    (tmp_path / "a.warc").write_bytes(one + two + one)
    pack = lambda r: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(r) + c.flush()
    (tmp_path / "b.warc.gz").write_bytes(pack(two) + pack(one))
    (tmp_path / "c.warc.gz").write_bytes(warc.member(two) + warc.member(one))
    read = lambda **k: warc.read(spark, str(tmp_path), **k)
    assert read().groupBy("record_type").count().orderBy("record_type").collect() == [("request", 3), ("response", 4)]
    assert {bytes(r["payload"]) for r in read().filter("record_type = 'response'").collect()} == {b"body"}
    assert read(payload=False).filter("target_uri like 'http://x/2%' and record_type in ('request', 'x')").count() == 3
    reader = warc.WarcReader({"path": "x"})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("offset",), 1)])) == [warc.EqualTo(("offset",), 1)]


# --- secrets ---


def test_spans(spark):
    docs = [*documents(spark), (-1, None), (-2, ""), (-3, "é API_KEY : 'abcdefgh' Kpassword=12345678 ſecret=abcdefgh"), (-4, "AKIA" + "A" * 12 + " " + "0" * 32), (-5, "AKIA" + "A" * 12 + " " + "0" * 32), (-5, "token=short"), (-6, "-----BEGIN RSA PRIVATE KEY-----")]
    got = {(r["doc_id"], r["base_sha256"], r["spans"]) for r in secrets.document_secrets(spark.createDataFrame(docs, DOC)).collect()}

    def base(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))

    assert {(d, hashlib.sha256(base(t or "").encode()).hexdigest()) for d, t in docs} == {x[:2] for x in got}
    assert {s for d, _, s in got if d == -3} == {"assign:2:21,assign:24:41"} and {s for d, _, s in got if d == -6} == {"pem:0:31"}


def test_runs_over_several_texts(spark):
    # one batch, so that the texts are neighbours
    digests = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(6)]
    docs = spark.createDataFrame([*enumerate(digests), (6, "x"), (7, "eyJa"), (8, "bc-eyJabcd-eyJab.eyJcd.ef"), (9, "eyJz")], DOC).coalesce(1)
    located, _ = secrets.scan(docs, "doc_id", "text")
    assert {r["path"] for r in located.filter(F.size("found") > 0).collect()} == {*range(6), 8}
    texts = [*digests[:4], "x", "token" , " ", "=abcdefgh", "eyja", "a.b" * 3, "eyJ", "eyJx.eyJy.z", "a"]
    assert secrets._suspects(pa.array(digests[:4])).all()
    for n in range(len(texts)):
        marked = secrets._suspects(pa.array(texts[n:]))
        assert all(marked[i] for i, t in enumerate(texts[n:]) if secrets.scan_text(t))


def test_ledger_scans_only_unseen(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "x")], DOC)
    _, first = secrets.scan(docs, "doc_id", "text")
    assert first.count() == 1
    located, added = secrets.scan(docs.unionByName(spark.createDataFrame([(4, "token=zzzzzzzz")], DOC)), "doc_id", "text", first)
    assert added.count() == 1 and located.filter(F.size("found") > 0).count() == 3
    _, again = secrets.scan(docs, "doc_id", "text", first, rule_version=2)
    assert again.count() == 1


def test_ledger_remembers_clean_blobs(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "x"), (3, "x"), (4, None), (5, "")], DOC)
    _, first = secrets.scan_unseen(docs, "doc_id", "text")
    blob = lambda t: hashlib.sha256(t.encode()).digest()
    assert sorted((bytes(r["blob"]), r["rule_version"], len(r["found"])) for r in first.collect()) == sorted((blob(t), 1, n) for t, n in [("token=abcdefgh", 1), ("x", 0), ("", 0)])
    more = docs.unionByName(spark.createDataFrame([(6, "token=zzzzzzzz"), (7, "y")], DOC))
    located, added = secrets.scan_unseen(more, "doc_id", "text", first)
    assert {bytes(r["blob"]) for r in added.collect()} == {blob("token=zzzzzzzz"), blob("y")}
    assert sorted(r["path"] for r in located.filter(F.size("found") > 0).collect()) == [1, 2, 6] and located.count() == 8
    assert secrets.scan_unseen(more, "doc_id", "text", first.unionByName(added))[1].count() == 0
    assert secrets.scan_unseen(docs, "doc_id", "text", first, rule_version=2)[1].count() == 3


# --- shards ---


def test_shards(spark):
    docs = [*documents(spark), (None, None), (1, "copy"), (1, "copy")]
    got = sharding.shard_documents(spark.createDataFrame(docs, DOC)).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    for s in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in got}) == len({r["doc_id"] for r in got})
    own = spark.createDataFrame([(1, "a", 5, 6, 7)] * 40, "doc_id long, text string, shard int, slot int, size int")
    placed = sharding.number_slots(sharding.place(own, "doc_id", [1.0, 1.0]), ["doc_id"])
    assert sorted(r["slot"] for r in placed.collect()) == list(range(40)) and {(r["input_shard"], r["input_slot"], r["size"]) for r in placed.collect()} == {(5, 6, 7)}
    assert sharding.shard_documents(spark.createDataFrame([], DOC)).count() == 0


def test_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("k"))
    n = {r["shard"]: r["count"] for r in sharding.place(df, "k", [1.0, 0.0, 3.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 2} and 0.7 < n[2] / 4000 < 0.8


# --- mixing ---


def mix_brute(rows, levels, weights, share, epochs, seed):
    """Budgets by water filling, then whole epochs and a prefix of the last one."""
    supply = {}
    for r in rows:
        if r[-1] > 0:
            supply[r[1:-1]] = supply.get(r[1:-1], 0) + r[-1]
    budget = {(): int(sum(supply.values()) * share)}
    for depth in range(len(levels)):
        for parent in [p for p in budget if len(p) == depth]:
            kids = {}
            for leaf, s in supply.items():
                if leaf[:depth] == parent:
                    kids[leaf[: depth + 1]] = kids.get(leaf[: depth + 1], 0) + s * epochs
            w = {k: weights.get(levels[depth], {}).get(k[-1], 1.0) for k in kids}
            left, open_ = budget[parent], set(kids)
            while True:
                rate = left / sum(w[k] for k in open_) if open_ else 0
                full = {k for k in open_ if kids[k] <= w[k] * rate}
                if not full:
                    break
                for k in full:
                    budget[k] = kids[k]
                    left -= kids[k]
                open_ -= full
            for k in open_:
                budget[k] = int(w[k] * rate + 1e-6)
    out = []
    for leaf, s in supply.items():
        whole, rest = divmod(budget[leaf], s)
        mine = [r for r in rows if r[1:-1] == leaf and r[-1] > 0]
        out += [(r[0], e) for r in mine for e in range(whole)]
        h = lambda r: int(hashlib.md5(f"{seed}:{whole}:{r[0]}".encode()).hexdigest()[:15], 16)  # noqa: E731,B023
        for r in sorted(mine, key=h):
            rest -= r[-1]
            if rest < 0:
                break
            out.append((r[0], whole))
    return sorted(out)


@pytest.mark.parametrize(("share", "epochs"), [(0.4, 1), (1.0, 1), (1.7, 3)])
def test_mix(spark, share, epochs):
    rows = [tuple(r) for r in queries.mix_rows(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", *queries.MIX_LEVELS, "tokens").collect()]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")
    got = mixing.mix(df, "doc_id", queries.MIX_LEVELS, queries.MIX_WEIGHTS, budget_share=share, max_epochs=epochs, seed=17).collect()
    assert sorted((r["doc_id"], r["epoch"]) for r in got) == mix_brute(rows, queries.MIX_LEVELS, queries.MIX_WEIGHTS, share, epochs, 17)
    assert mixing.mix(df.limit(0), "doc_id", queries.MIX_LEVELS, {}).count() == 0


def test_mix_of_many_sources_null_keys_and_ties(spark):
    rng = random.Random(12)
    rows = [(None if i % 50 == 0 else i // 2, "web", "en", f"s{rng.randrange(400)}", rng.randrange(1, 30)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")
    budgets = {r["source"]: r["budget"] for r in mixing.leaf_budgets(df, queries.MIX_LEVELS, {}, budget_share=0.6, max_epochs=1).collect()}
    supply = {}
    for *_, s, t in rows:
        supply[s] = supply.get(s, 0) + t
    total = int(sum(supply.values()) * 0.6)
    low, high = 0.0, float(total)
    for _ in range(200):  # the common rate by bisection
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(c, rate) for c in supply.values()) <= total else (low, rate)
    assert all(abs(budgets[s] - min(c, low)) <= 1 for s, c in supply.items())
    take = lambda d: sorted((r["doc_id"] or -1, r["source"], r["tokens"], r["epoch"]) for r in mixing.mix(d, "doc_id", queries.MIX_LEVELS, {}, budget_share=0.6, max_epochs=2).collect())
    assert take(df) == take(df.repartition(7)) and any(x[0] == -1 for x in take(df))


# --- chat ---


def check_packs(packs):
    emitted = []
    for p in packs.collect():
        for s in p["segments"]:
            chain, at = [], s["node"]
            while at >= 0:
                chain.append(p["segments"][at])
                at = chain[-1]["parent"]
            assert s["position"] == sum(x["length"] for x in chain[1:])
            here = [x for x in chain if x["begin"] >= 0]
            assert sum(x["stop"] - x["begin"] for x in s["attends"]) == sum(x["length"] for x in here)
            inside = {i for x in s["attends"] for i in range(x["begin"], x["stop"])}
            assert inside == {i for x in here for i in range(x["begin"], x["stop"])}
            if s["begin"] >= 0:
                assert s["stop"] - s["begin"] == s["length"]
                emitted.append(bytes(s["digest"]))
            else:
                assert s["loss_begin"] == -1
    assert len(emitted) == len(set(emitted))
    return emitted


def test_trees_larger_than_a_pack(spark):
    # one tree over many packs and partitions: every turn is emitted once, and all can be read back
    rng = random.Random(8)
    rows, said = [], {}
    for c in range(120):
        turns = [("system", "common start")] + [(("user", "assistant")[i % 2], f"t{rng.randrange(3)} " * 5) for i in range(rng.randrange(0, 6))]
        said[c] = turns
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pack", F.lit("own")).repartition(4)
    packs, members = chat.pack(df, 400)
    emitted = check_packs(packs)
    assert len(emitted) == len({tuple(t[: i + 1]) for t in said.values() for i in range(len(t))}) and packs.count() > 5
    for r in chat.read_back(packs, members).collect():
        turns = said[r["conv_id"]]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256("".join(b for a, b in turns if a == "assistant").encode()).hexdigest()


def test_chat(spark):
    odd = "<|im_end|>\\ <\\| \\\\<| \n<|im_start|>user\n"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", odd), (2, 0, "user", "hi"), (2, 1, "assistant", "b"), (2, 2, "user", None), (3, 0, "user", "hi"), (4, 5, None, "x"), (4, None, "assistant", ""), (5, 1, "a\n<|b", odd), (5, 1, "a\n<|b", odd), (None, 0, "assistant", "z"), (6, 0, "user", "hi"), (6, 1, "assistant", odd)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    packs, members = chat.pack(df)
    got = {r["conv_id"]: r for r in chat.read_back(packs, members).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        full = sum(len(chat.render(r, x)[0]) for _, r, x in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["formatted_chars"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), full)
    check_packs(packs)
    # shared turns are there once
    assert sum(p["tokens"].count("user\nhi<|im_end|>") for p in packs.collect()) == 1
    assert chat.read_back(*chat.pack(df.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|", "\\<|", "<\\|", "<<||", "\\\\n", "<|im_end|>\n<|im_start|>"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.parse(chat.render(text, text)[0] * 2) == [(text, text)] * 2


# --- language ---


def test_language(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_ecoc_language(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang is not null")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 2000 and right / n > 0.97


def test_language_edges(spark):
    rows = [(i, t, lang) for i in range(0, 60, 2) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))] + [(100, None, "en"), (101, "", None), (102, "123 !?", "de"), (103, "é" * 5, None), (103, "the the", None), (104, "the cat " * 90000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict_documents(df.withColumn("held_out", F.lit(3))).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for *_, s in got)
    assert {d for d, p, _ in got if p == "und"} == {100, 101, 102} and {p for d, p, _ in got if d == 104} == {"en"}
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predict_documents(none).collect()} == {"und"}
    kept = language.keep_known(df.withColumns({"score": F.lit(1), "ambiguous": F.lit(2), "_lang_pred": F.lit(3)}))
    assert kept.columns == ["doc_id", "text", "lang", "score", "ambiguous", "_lang_pred"] and {r["lang"] for r in kept.collect()} == {"en", "de"}
    # without labels nothing can be told, so texts with a letter stay as they are
    assert sorted((r["doc_id"], r["lang"]) for r in language.keep_known(none).collect()) == sorted((d, None) for d, *_ in rows if d not in (100, 101, 102))
    assert language.predict_documents(df.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = pa.array(["".join(chr(97 + i * i % 23) for i in range(1000)), "ab", "é"])
    whole = language.features(text)
    monkeypatch.setattr(language, "_PIECE", 7)
    assert np.allclose(language.features(text), whole) and np.allclose(whole.sum(1), 1)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 150])
def test_codewords_and_decoding(n):
    codes = language.codewords(n)
    assert len(np.unique(codes, axis=0)) == n and (n == 1 or (np.abs(codes.sum(0)) < n).all())
    far = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
    model = language.Model([str(i) for i in range(n)], codes, None, np.full(codes.shape[1], 1 / codes.shape[1]))
    # fewer than half of the least distance in wrong bits still give the right word
    wrong = codes.copy()
    wrong[:, : (min(far, default=1) - 1) // 2] *= -1
    best, score, unsure = model.decode(wrong)
    assert (best == np.arange(n)).all() and not unsure.any() and (score > 1 / n - 1e-9).all()


def test_many_languages():
    rng = np.random.default_rng(5)
    held = rng.dirichlet(np.full(language.BUCKETS, 0.05), 150)
    model = language.fit(held * 10, np.full(150, 10), [str(i) for i in range(150)])
    seen = np.array([rng.multinomial(600, p) / 600 for p in held])
    best, _, _ = model.decode(model.margins(seen))
    assert (best == np.arange(150)).mean() > 0.97


# --- pipeline ---


def test_pipeline(spark):
    import corpus_pipeline as c

    from .test_decontaminate import brute as contaminated
    from .test_jaccard import brute as linked

    docs = documents(spark)
    meta = {r["doc_id"]: r for r in queries.mix_rows(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    known = {r["doc_id"]: r["lang"] for r in language.keep_known(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(known) <= {d for d, t in docs if any(x.isalpha() for x in t or "")} and len(known) >= 0.99 * len(docs)
    assert sum(known[d] == meta[d]["lang"] for d in known if meta[d]["lang"]) >= 0.99 * len(known)
    docs = [(d, t) for d, t in docs if d in known]
    first = {d for d, _, k in linked(docs) if d == k}
    docs = [x for x in docs if x[0] in first]
    bad = {r[0] for r in contaminated(docs, items) if r[-1]}
    rows = [(d, *[known[d] if x == "lang" else meta[d][x] for x in queries.MIX_LEVELS], meta[d]["tokens"]) for d, _ in docs if d not in bad]
    want = mix_brute(rows, queries.MIX_LEVELS, queries.MIX_WEIGHTS, c.BUDGET_SHARE, 1, 17)
    got = c.run(spark, SF)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "grown_shard"]
    assert sorted(r["doc_id"] for r in got.collect()) == [d for d, _ in want]


def test_mix_stage_keeps_clashing_columns(spark):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7, "own"), (2, None, None, None, None, None)], "doc_id long, text string, lang string, source string, tokens int, domain string")
    got = c.mix_sources(spark, docs.unionByName(docs), SF)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= {tuple(docs.first())}
    assert c.shards(spark, docs, SF).count() == 2 and c.mix_sources(spark, docs.limit(0), SF).count() == 0
