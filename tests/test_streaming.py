import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from heddle.operators import merge, search
from heddle.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def batches(spark, path, parts, schema):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))


def test_snapshots_arrive_one_by_one(spark, tmp_path):
    schema = "k string, v string, arr array<string>, o int, p int"
    parts = [[("a", "x", ["1"], 0, 0), ("b", None, [], 0, 1)], [("a", " ", ["2"], 1, 0)], [("a", " ", ["2"], 1, 0), ("b", "y", None, 2, 0)], [("c", "z", ["3"], 3, 0), ("b", "w", ["9"], 1, 5)], [("a", "q", ["1", "4"], 4, 0)]]
    mark = str(tmp_path / "mark")
    held = jobs.upsert_into(str(tmp_path / "out"), "k", ["o", "p"], ["arr"], every=2)
    whole = lambda n: sorted((r["k"], r["v"], r["arr"]) for r in merge.upsert(spark.createDataFrame([r for p in parts[:n] for r in p], schema), "k", ["o", "p"], arrays=["arr"]).collect())
    rows = lambda: sorted((r["k"], r["v"], r["arr"]) for r in held.read(spark).collect())
    jobs.replay(batches(spark, tmp_path / "in", parts[:2], schema), "append", held.write, checkpoint=mark)
    assert rows() == whole(2)
    # a second run goes on where the first one stopped
    for n, p in enumerate(parts[2:], 2):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.replay(stream, "append", held.write, checkpoint=mark)
    assert rows() == whole(5) and len(list((tmp_path / "out" / "base").glob("n=*"))) == 2
    # another checkpoint over the same table, and a lost batch, are errors
    with pytest.raises(Exception, match="another checkpoint"):
        jobs.replay(stream, "append", held.write)
    shutil.rmtree(tmp_path / "out" / "batch" / "n=3")
    shutil.rmtree(tmp_path / "out" / "base" / "n=4")
    with pytest.raises(RuntimeError, match="missing"):
        held.read(spark)


def test_cache_stream(spark, tmp_path):
    day = lambda n: T0 + dt.timedelta(days=n)
    schema = "sha256 string, state string, checked_at timestamp, content string"
    parts = [[("a", "extracted", day(0), "A"), ("b", "extracted", day(5), "B"), ("old", "extracted", day(-40), "O")], [("a", "not_found", day(2), None), ("b", "failed", day(9), None)]]
    held = jobs.cache_into(str(tmp_path / "out"), F.expr("INTERVAL 30 DAYS"))
    jobs.replay(batches(spark, tmp_path / "in", parts, schema), "append", held.write)
    assert sorted((r["sha256"], r["state"]) for r in held.read(spark).collect()) == [("a", "not_found"), ("b", "extracted")]


def test_late_rows_are_counted(spark, tmp_path):
    schema = "key string, state string, checked_at timestamp, tie long"
    row = lambda d, n: ("k", "live", T0 + dt.timedelta(days=d), n)
    parts = [[row(0, 0), row(10, 1)], [row(0, 2), row(11, 3)], [row(1, 4), row(12, 5)]]
    lost: list[int] = []
    jobs.replay(jobs.state_counts(batches(spark, tmp_path / "in", parts, schema), "1 day"), "update", dropped=lost)
    # rows are held against the watermark of the batch before
    assert lost == [1]
    out = jobs.replay(jobs.confirmations(batches(spark, tmp_path / "in2", parts, schema), 2), "update")
    assert [r["late"] for r in out.orderBy("batch").collect()] == [0, 1, 1]


def test_tombstone_is_emitted_once(spark, tmp_path):
    row = lambda n, s: ("k", s, T0 + dt.timedelta(hours=n), n)
    parts = [[row(0, "expired")], [row(1, "expired")], [row(2, "expired"), row(1, "expired")], [row(3, "live")]]
    out = jobs.replay(jobs.confirmations(batches(spark, tmp_path / "in", parts, "key string, state string, checked_at timestamp, tie long"), 2), "update")
    got = [(r["confirmations"], r["tombstone"]) for r in out.orderBy("batch").collect()]
    assert sum(t for _, t in got) == 1 and got[-1] == (0, False) and max(n for n, _ in got) == 3


def test_cards(spark):
    rows = spark.createDataFrame([("1", "t", " ", None, (2020, 2021), ["p"], ["b", "a", "hid"]), ("2", "u", "x", 2024, None, [], [])], "id string, title string, author string, year int, year_range struct<from:int,to:int>, providers array<string>, categories array<string>")
    tax = spark.createDataFrame([("a", "A", False), ("b", "B", False), ("hid", "H", True)], "id string, label string, hidden boolean")
    assert sorted(tuple(r) for r in search.card(rows, tax).collect()) == [("1", "t", "", "2020-2021", "p", ["B", "A"]), ("2", "u", "x", "2024", "", [])]
    assert search.snapshot_meta(rows.withColumn("links", F.array()), "v", F.lit(None)).first()["visible"] == 2
