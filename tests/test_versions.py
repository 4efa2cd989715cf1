"""Versioned tables: unchanged buckets stay, one of two writers fails, pins, streams exactly once."""

import glob
import json
import os
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heddle.sources import versions as V

AT = "2024-01-01"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def numbers(spark, n, shift=()):
    return spark.range(n).select("id", (F.col("id") * 2 + F.when(F.col("id").isin(*shift), 1).otherwise(0) if shift else F.col("id") * 2).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("s"))


def test_only_changed_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "t")
    one = V.publish(numbers(spark, 500), root, ["id"], AT, buckets=40)
    assert V.publish(numbers(spark, 500).repartition(7), root, ["id"], AT)["version"] == 1
    two = V.publish(numbers(spark, 500, (3, 77)), root, ["id"], AT)
    differ = [b for b in one["buckets"] if one["buckets"][b]["files"] != two["buckets"][b]["files"]]
    assert V.changed(one, two) == sorted(map(int, differ)) and 1 <= len(differ) <= 2
    assert rows(V.read(spark, root, 1)) == rows(numbers(spark, 500)) and rows(V.read(spark, root)) == rows(numbers(spark, 500, (3, 77)))
    assert rows(V.differences(spark, root, 1, 2).select("id", "v", "change")) == [(3, 6, "removed"), (3, 7, "added"), (77, 154, "removed"), (77, 155, "added")]
    # rows that go, also all of a bucket, repeated rows, and an empty table
    three = V.publish(numbers(spark, 20).unionByName(numbers(spark, 20)), root, ["id"], AT)
    assert rows(V.read(spark, root)) == sorted(rows(numbers(spark, 20)) * 2) and len(three["buckets"]) < len(two["buckets"])
    assert V.differences(spark, root, 2, 3).filter("change = 'removed'").count() == 481
    V.publish(numbers(spark, 0), root, ["id"], AT)
    assert V.read(spark, root).count() == 0 and V.read(spark, root).columns == ["id", "v", "s"]
    # other columns write everything anew
    V.publish(numbers(spark, 5).withColumn("x", F.lit(1)), root, ["id"], AT)
    assert V.read(spark, root).columns == ["id", "v", "s", "x"]


def test_tree_goes_down_where_hashes_differ():
    entry = lambda x: {"rows": 1, "h1": str(x), "h2": "0", "files": []}
    n = 300
    a = {str(i): entry(i) for i in range(n)}
    b = {k: v for k, v in (a | {"17": entry(-1), "299": entry(-2)}).items() if k != "150"}
    told = [{"of": n, "tree": V.tree(x, n), "buckets": x} for x in (a, b)]
    assert [len(level) for level in told[0]["tree"]] == [300, 19, 2, 1]
    assert V.changed(*told) == V.changed(*told[::-1]) == [17, 150, 299] and V.changed(told[0], told[0]) == []
    assert V.changed(None, told[1])[:2] == [0, 1] and len(V.changed(None, told[1])) == 299


def test_one_of_two_writers_fails_and_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    V.publish(numbers(spark, 50), root, ["id"], AT, buckets=8)
    V.publish(numbers(spark, 50, (1,)), root, ["id"], AT, parent=1)
    before = set(os.listdir(f"{root}/data"))
    with pytest.raises(V.Conflict):
        V.publish(numbers(spark, 50, (2,)), root, ["id"], AT, parent=1)
    assert V.versions(root) == [1, 2] and set(os.listdir(f"{root}/data")) == before and not [n for n in os.listdir(f"{root}/log") if n.startswith(".") and not n.endswith(".crc")]
    odd = numbers(spark, 50).withColumn("v", F.udf(lambda: uuid.uuid4().int >> 70, "long").asNondeterministic()())
    with pytest.raises(ValueError, match="other rows"):
        V.publish(odd, root, ["id"], AT)
    assert V.versions(root) == [1, 2]


def test_pinned_versions_stay(spark, tmp_path):
    root = str(tmp_path / "t")
    for k in range(4):
        V.publish(numbers(spark, 50, (k,)), root, ["id"], AT, buckets=8)
    V.pin(root, "report", 2)
    with pytest.raises(V.Conflict):
        V.pin(root, "report", 3)
    lost = f"{root}/data/lost"
    os.makedirs(lost)
    assert V.prune(root) == [1, 3] and os.path.isdir(lost)
    V.prune(root, older_than_seconds=-5)
    assert not os.path.isdir(lost) and rows(V.read(spark, root, 2)) == rows(numbers(spark, 50, (1,))) and rows(V.read(spark, root)) == rows(numbers(spark, 50, (3,)))
    V.unpin(root, "report")
    assert V.prune(root, older_than_seconds=-5) == [2] and V.versions(root) == [4] and rows(V.read(spark, root)) == rows(numbers(spark, 50, (3,)))
    with pytest.raises(FileNotFoundError):
        V.pin(root, "late", 2)


def run(query, check):
    q = query.option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()


def test_versions_as_a_stream(spark, tmp_path):
    root, check, seen = str(tmp_path / "t"), str(tmp_path / "c"), []
    V.publish(numbers(spark, 60), root, ["id"], AT, buckets=8)
    V.publish(numbers(spark, 60, (5,)), root, ["id"], AT)
    each = lambda df, n: seen.append(rows(df.select("version", "id", "v")))
    run(V.stream(spark, root).writeStream.foreachBatch(each), check)
    got = [r for b in seen for r in b]
    assert [r for r in got if r[0] == 1] == [(1, i, v) for i, v, _ in rows(numbers(spark, 60))]
    bucket = {r[0] for r in rows(V.read(spark, root, 2).withColumn("b", V.bucket_of(["id"], 8)).filter("b = (select pmod(xxhash64(5L), 8))"))}
    assert {r[1] for r in got if r[0] == 2} == bucket and (2, 5, 11) in got
    seen.clear()
    V.publish(numbers(spark, 60, (5, 6)), root, ["id"], AT)
    run(V.stream(spark, root).writeStream.foreachBatch(each), check)
    assert {r[0] for b in seen for r in b} == {3} and any((3, 6, 13) in b for b in seen)


def test_batches_become_versions_once(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("s", "t", "c"))
    schema = "id long, v long, s string"
    whole = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for k in range(3):
        numbers(spark, 10).withColumn("v", F.col("v") + k * 100).coalesce(1).write.mode("append").parquet(source)
    run(V.append_stream(whole(), root, ["id"], "a", buckets=4), check)
    want = sorted(r for k in range(3) for r in rows(numbers(spark, 10).withColumn("v", F.col("v") + k * 100)))
    assert V.versions(root) == [1, 2, 3] and rows(V.read(spark, root)) == want
    # a fault after the version was there and before the stream knew it: the last batch comes again
    for f in glob.glob(f"{check}/commits/*2*"):
        os.remove(f)
    for f in glob.glob(f"{check}/commits/.*2*"):
        os.remove(f)
    run(V.append_stream(whole(), root, ["id"], "a", buckets=4), check)
    assert V.versions(root) == [1, 2, 3] and rows(V.read(spark, root)) == want
    # the hash of what was appended is that of the same rows published at once
    other = str(tmp_path / "o")
    assert V.publish(spark.createDataFrame(want, schema), other, ["id"], AT, buckets=4)["root"] == V.manifest(root)["root"]
    assert len(os.listdir(f"{root}/data")) == len({f.split("/data/")[1].split("/")[0] for b in V.manifest(root)["buckets"].values() for f in b["files"]})


def test_a_fault_before_the_commit_shows_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    fields = StructType.fromDDL("id long, _bucket int, _h1 long, _h2 long")
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2]), "_bucket": pa.array([0, 3], pa.int32()), "_h1": pa.array([5, 6]), "_h2": pa.array([7, 8])})
    make = lambda: V.VersionWriter({"path": root, "stream": "x", "key": json.dumps(["id"]), "buckets": "4"}, fields)
    make().write(iter([batch]))  # and the task's host is lost
    assert V.manifest(root) is None
    again = make()
    told = again.write(iter([batch]))
    again.commit([told, None][:1], 0)
    again.commit([again.write(iter([batch]))], 0)
    assert V.versions(root) == [1] and rows(V.read(spark, root)) == [(1,), (2,)]
    V.prune(root, older_than_seconds=-5)
    assert rows(V.read(spark, root)) == [(1,), (2,)] and len(os.listdir(f"{root}/data")) == 1
