"""JSON by byte ranges against whole reads."""

import json
import random

import pytest

from heddle.sources import exports, json_ranges


def made(rng, n, pretty):
    odd = ['a"b', "\\", "\\\\", '\\"', "}{][,:", '"messages":[', "é日🙂", "\n\t", "", '[{"x', "\\u0022", "x" * 70]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(4)))
    entry = lambda i: {"entry_id": f"{i}", "title": text(), "passwords": [text() for _ in range(rng.randrange(3))], "links": [{"url": text(), "primary": True, "sources": [text()]}] * rng.randrange(3), "credit": {"author": text()}, "other": {"deep": [[text()], {"a": [1, 2]}]}}
    message = lambda i: {"message_id": f"{i}", "url": text(), "media": {"type": text(), "document": {"file_name": text()}}}
    parts = {
        "schema_version": "3", "source": {"channel_id": 7, "title": text(), "tags": ["x", {"y": [1]}]}, "messages": [message(i) for i in range(n)], "unknown": [1, "a,b", [2, 3], {"k": text()}, True], "exported_at": text(),
        "catalog_entries": [entry(i) for i in range(n // 2)], "empty": [], "stats": {"parsing": {"catalog_entry_count": n // 2}},
    }
    keys = list(parts)
    rng.shuffle(keys)
    return json.dumps({k: parts[k] for k in keys}, indent=pretty, ensure_ascii=bool(pretty), separators=(" , ", " : ") if pretty == 1 else None)


def rows(df, *drop):
    return sorted((json.dumps(r.asDict(True), sort_keys=True) for r in df.drop(*drop).collect()))


@pytest.mark.parametrize(("range_bytes", "block"), [(37, 11), (64, 500), (1000, 64), (1 << 20, 4 << 20)])
def test_same_as_whole_reads(spark, tmp_path, range_bytes, block):
    rng = random.Random(range_bytes)
    # the text of the large one is cut everywhere: in strings, escapes, characters and names
    for name, doc in {"a": made(rng, 6, None), "B": made(rng, 3, 2), "c": made(rng, 0, 1), "d": made(rng, 12, 1)}.items():
        (tmp_path / f"{name}.json").write_text(doc)
    (tmp_path / "e.txt").write_text("no json")
    read = json_ranges.read(spark, str(tmp_path), range_bytes=range_bytes, block_bytes=block)
    got = {}
    for r in read.filter("kind = 'element'").collect():
        got.setdefault((r["snapshot_ord"], r["key"]), []).append((r["pos"], json.loads(bytes(r["data"]))))
    want = {}
    for order, name in enumerate(["B", "a", "c", "d"]):
        for k, v in json.loads((tmp_path / f"{name}.json").read_text()).items():
            if isinstance(v, list) and v:
                want[order, k] = list(enumerate(v))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == want


def test_snapshots_are_those_of_the_whole_read(spark, tmp_path):
    rng = random.Random(1)
    for name in ("1", "2"):
        (tmp_path / f"{name}.json").write_text(made(rng, 20, None))
    whole = exports.as_snapshots(exports.read_exports(spark, str(tmp_path)))
    part = exports.read_snapshots(spark, str(tmp_path), range_bytes=200)
    for name in ("headers", "messages", "entries"):
        a, b = getattr(whole, name), getattr(part, name)
        shift = a.withColumn("snapshot_ord", a["snapshot_ord"] - 1)
        assert rows(shift, "file") == rows(b)


def test_broken_documents_stop_the_job(spark, tmp_path):
    def read(doc, name):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(doc)
        got = exports.read_snapshots(spark, str(tmp_path / name), range_bytes=16)
        return got.headers.collect(), got.messages.collect(), got.entries.collect()

    good = '{"schema_version":"3","messages":[{"message_id":"a"} , {"message_id":"b"}],"catalog_entries":[ ]}'
    headers, messages, entries = read(good, "good")
    assert [m["message_id"] for m in sorted(messages, key=lambda m: m["pos"])] == ["a", "b"] and not entries and headers[0]["schema_version"] == "3"
    for name, doc in {
        "version": good.replace('"3"', '"2"'), "cut": good[:-9], "string": good.replace('b"}', "b}"), "comma": good.replace(" , ", ",,"), "trailing": good.replace('"b"}]', '"b"},]'), "element": good.replace('{"message_id":"b"}', '{"message_id":}'), "kind": good.replace('{"message_id":"b"}', "7"),
    }.items():
        with pytest.raises(Exception, match="(?i)version|broken|empty element|malformed|ends too early|without a name"):
            read(doc, name)
    (tmp_path / "none").mkdir()
    assert exports.read_snapshots(spark, str(tmp_path / "none")).messages.count() == 0


def test_an_exported_source_is_one_file(spark):
    from heddle.version_queries import _export

    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        path = _export(spark, "/root/testdata/sf0.01")
    finally:
        for k in changed:
            spark.conf.unset(k)
    files = [f for f, _ in json_ranges.documents(path, ".txt")]
    assert len(files) == len({f.rsplit("/", 1)[0] for f in files}) > 1
