"""A table in versions: a log of manifests, each a hash tree over the table's buckets.

A row's bucket is a hash of its key.  A bucket's hash is made of the number of its rows and of two sums of
their hashes, so the order of rows does not matter and appended rows are added to it; a node's hash is
made of those of its children.  Two versions are compared from the root down, and only buckets
whose hashes differ are written, read or passed on.

A version is there once its manifest is: it is put at the next number only if nobody has put one
there.  Of two writers that saw the same version one fails (``Conflict``) and leaves nothing.  A
manifest lists the files of every bucket, so readers of a version are not disturbed by later ones,
and ``prune`` keeps what a pinned version lists.

Streams take versions as offsets (``stream``), and write batches as versions (``append_stream``): a batch that is
written again after a fault finds its number in the log and is left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

BUCKETS, FANOUT = 256, 16
#: What a task of a stream reads at least, if there is as much.
PART_BYTES = 32 << 20
_BUCKET, _FIRST, _SECOND = "_bucket", "_h1", "_h2"


class Conflict(RuntimeError):
    """Another writer has put the version first."""


# --- files


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _names(path: str) -> list[str]:
    from pyarrow import fs

    system, where = _system(path)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(where, allow_not_found=True)) if not f.base_name.startswith("."))


def _put(path: str, data: bytes) -> None:
    """Write a file that must not be there yet."""
    from pyarrow import fs

    system, where = _system(path)
    parent = where.rsplit("/", 1)[0]
    system.create_dir(parent, recursive=True)
    aside = f"{parent}/.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(data)
    try:
        if isinstance(system, fs.LocalFileSystem):
            os.link(aside, where)  # fails if it is there, in one step
            return
        if system.get_file_info(where).type != fs.FileType.NotFound:
            raise FileExistsError(where)
        system.move(aside, where)  # file systems of clusters don't rename onto a file that is there
    except OSError as e:
        raise Conflict(f"{path} is there already") from e
    finally:
        if system.get_file_info(aside).type != fs.FileType.NotFound:
            system.delete_file(aside)


def _get(path: str) -> dict:
    system, where = _system(path)
    with system.open_input_file(where) as f:
        return json.loads(f.read())


def _drop(path: str) -> None:
    from pyarrow import fs

    system, where = _system(path)
    if system.get_file_info(where).type == fs.FileType.Directory:
        system.delete_dir(where)
    elif system.get_file_info(where).type == fs.FileType.File:
        system.delete_file(where)


# --- manifests and their trees


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/log/{version:020d}.json"


def versions(root: str) -> list[int]:
    return [int(n[:-5]) for n in _names(f"{root}/log") if n.endswith(".json")]


def manifest(root: str, version: int | None = None) -> dict | None:
    """A version's manifest; of the last one unless said otherwise, None if there is none."""
    if version is None:
        known = versions(root)
        if not known:
            return None
        version = known[-1]
    return _get(_manifest_path(root, version))


def _leaf(bucket: dict | None) -> str:
    return hashlib.sha256(f"{bucket['rows']}|{bucket['h1']}|{bucket['h2']}".encode()).hexdigest() if bucket else ""


def tree(buckets: dict[str, dict], n: int) -> list[list[str]]:
    """Hashes level by level, from the buckets up to the root."""
    level = [_leaf(buckets.get(str(i))) for i in range(n)]
    levels = [level]
    while len(level) > 1:
        level = [hashlib.sha256("|".join(level[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(level), FANOUT)]
        levels.append(level)
    return levels


def changed(old: dict | None, new: dict) -> list[int]:
    """Buckets that differ, found from the roots down: equal subtrees are not looked into."""
    if old is None or old["of"] != new["of"]:
        return [int(b) for b in sorted(new["buckets"], key=int)]
    a, b = old["tree"], new["tree"]
    open_ = [0] if a[-1] != b[-1] else []
    for level in range(len(a) - 2, -1, -1):
        open_ = [i for p in open_ for i in range(p * FANOUT, min((p + 1) * FANOUT, len(a[level]))) if a[level][i] != b[level][i]]
    return open_


def _commit(root: str, parent: dict | None, buckets: dict, n: int, schema: str, key: Sequence[str], at: str, **more) -> dict:
    version = parent["version"] + 1 if parent else 1
    levels = tree(buckets, n)
    told = {"version": version, "at": at, "key": list(key), "of": n, "schema": schema, "root": levels[-1][0], "tree": levels, "buckets": buckets, **more}
    _put(_manifest_path(root, version), json.dumps(told).encode())
    return told


# --- batches


def bucket_of(key: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _hashes(df: DataFrame) -> list[Column]:
    # JSON tells null from the empty text and lists fields by name, so that equal rows are equal texts
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return [F.xxhash64(row).alias(_FIRST), F.xxhash64(row, F.lit(1)).alias(_SECOND)]


def _sums(df: DataFrame, key: Sequence[str], n: int) -> dict[str, dict]:
    """A row a bucket: rows and sums of hashes, which are what reaches the driver."""
    each = df.select(bucket_of(key, n).alias(_BUCKET), *_hashes(df)).groupBy(_BUCKET)
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
    return {str(r[_BUCKET]): {"rows": r["rows"], "h1": r[_FIRST], "h2": r[_SECOND]} for r in each.agg(F.count("*").alias("rows"), total(_FIRST), total(_SECOND)).collect()}


def publish(df: DataFrame, root: str, key: Sequence[str], at: str, *, buckets: int = BUCKETS, parent: int | None = None) -> dict:
    """Make ``df`` the next version after ``parent`` (the last one unless given) and return its manifest;
    if nothing differs the parent's.  Buckets that are as before keep their files.  ``df`` must give the
    same rows when it is computed again."""
    spark = df.sparkSession
    before = manifest(root, parent)
    n = before["of"] if before else buckets
    sums = _sums(df, key, n)
    known = (before or {"buckets": {}})["buckets"]
    differ = sorted(int(b) for b, s in sums.items() if _leaf(s) != _leaf(known.get(b)))
    if before and not differ and set(known) == set(sums) and before["schema"] == df.schema.json():
        return before
    if before and before["schema"] != df.schema.json():
        differ = sorted(map(int, sums))  # other columns: nothing can stay
    folder = f"{root}/data/{uuid.uuid4().hex}"
    if differ:
        rows = df.withColumn(_BUCKET, bucket_of(key, n))
        if len(differ) < len(sums):
            rows = rows.join(F.broadcast(spark.createDataFrame([(b,) for b in differ], f"{_BUCKET} int")), _BUCKET, "left_semi")  # buckets, a bounded number
        # buckets stay together, but for those that hold much, as when a key has a third of all rows
        rows.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        there = spark.read.schema(df.schema).parquet(*[f"{folder}/{_BUCKET}={b}" for b in differ])
        if _sums(there, key, n) != {str(b): sums[str(b)] for b in differ}:
            _drop(folder)
            raise ValueError("the table gave other rows when it was computed again")
    entries = {b: s | {"files": [f"{folder}/{_BUCKET}={b}"] if int(b) in set(differ) else known[b]["files"]} for b, s in sums.items()}
    try:
        return _commit(root, before, entries, n, df.schema.json(), key, at)
    except Conflict:
        _drop(folder)
        raise


def _read_buckets(spark: SparkSession, told: dict, buckets: Sequence[int | str]) -> DataFrame:
    files = [f for b in buckets if (x := told["buckets"].get(str(b))) for f in x["files"]]
    schema = StructType.fromJson(json.loads(told["schema"]))
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    told = manifest(root, version)
    if told is None:
        raise ValueError(f"no version in {root}")
    return _read_buckets(spark, told, list(told["buckets"]))


def differences(spark: SparkSession, root: str, old: int, new: int) -> DataFrame:
    """Rows that differ between two versions, with ``change``: added or removed.  Only buckets
    that differ are read."""
    a, b = manifest(root, old), manifest(root, new)
    which = sorted({*changed(a, b), *changed(b, a)})
    was, now = _read_buckets(spark, a, which), _read_buckets(spark, b, which)
    return now.exceptAll(was).withColumn("change", F.lit("added")).unionByName(was.exceptAll(now).withColumn("change", F.lit("removed")))


def pin(root: str, name: str, version: int) -> None:
    """Let a version stay until it is unpinned; the name is taken once."""
    manifest(root, version)
    _put(f"{root}/pins/{name}.json", json.dumps({"version": version}).encode())


def unpin(root: str, name: str) -> None:
    _drop(f"{root}/pins/{name}.json")


def prune(root: str, *, keep: int = 1, older_than_seconds: float = 86_400) -> list[int]:
    """Drop all but the last ``keep`` versions and pinned ones, and data that no version lists.  Data
    younger than ``older_than_seconds`` stays, as its version may be on its way."""
    import time

    from pyarrow import fs

    known = versions(root)
    pinned = {_get(f"{root}/pins/{n}")["version"] for n in _names(f"{root}/pins")}
    gone = [v for v in known[: max(0, len(known) - keep)] if v not in pinned]
    listed = {f.split("/data/")[-1].split("/")[0] for v in known if v not in gone for b in manifest(root, v)["buckets"].values() for f in b["files"]}
    for v in gone:
        _drop(_manifest_path(root, v))
    system, where = _system(f"{root}/data")
    for f in system.get_file_info(fs.FileSelector(where, allow_not_found=True)):
        if f.base_name not in listed and (f.mtime_ns or 0) / 1e9 <= time.time() - older_than_seconds:
            _drop(f"{root}/data/{f.base_name}")
    return gone


# --- versions as a stream


@dataclass
class Files(InputPartition):
    version: int
    paths: list[str]


class VersionReader(DataSourceStreamReader):
    """Offsets are versions; a batch has the rows of the buckets that each of its versions changed."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.root, self.since, self.fields = options["path"], int(options.get("since", 0)), [f.name for f in schema if f.name != "version"]

    def initialOffset(self):
        return {"version": self.since}

    def latestOffset(self):
        known = versions(self.root)
        return {"version": max([self.since, *known])}

    def partitions(self, start, end):
        from pyarrow import fs

        out, known = [], set(versions(self.root))
        # what a dropped version changed comes with the next one, of which all buckets are taken
        for v in (v for v in range(start["version"] + 1, end["version"] + 1) if v in known):
            now, was = manifest(self.root, v), manifest(self.root, v - 1) if v - 1 in known else None
            paths, size = [], 0
            for b in changed(was, now):
                held = set(was["buckets"].get(str(b), {"files": []})["files"]) if was else set()
                for folder in now["buckets"].get(str(b), {"files": []})["files"]:
                    if folder in held:
                        continue
                    system, where = _system(folder)
                    info = system.get_file_info(where)
                    head = folder[: len(folder) - len(where)]
                    for f in system.get_file_info(fs.FileSelector(where)) if info.type == fs.FileType.Directory else [info]:
                        if f.path.endswith(".parquet"):
                            paths, size = [*paths, head + f.path], size + f.size
                            if size >= PART_BYTES:
                                out.append(Files(v, paths))
                                paths, size = [], 0
            if paths:
                out.append(Files(v, paths))
        return out

    def read(self, partition):
        import pyarrow.parquet as pq

        for path in partition.paths:
            system, where = _system(path)
            with system.open_input_file(where) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=self.fields):
                    yield pa.RecordBatch.from_arrays([pa.array([partition.version] * batch.num_rows, pa.int64()), *[batch.column(c) for c in self.fields]], ["version", *self.fields])

    def commit(self, end):
        pass


@dataclass
class Appended(WriterCommitMessage):
    buckets: dict


class VersionWriter(DataSourceStreamArrowWriter):
    """Each batch is a version that adds files to buckets."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.root, self.name, self.at = options["path"], options["stream"], options.get("at", "")
        self.key, self.n = json.loads(options["key"]), int(options.get("buckets", BUCKETS))
        self.schema = json.dumps(StructType([f for f in schema if f.name not in (_BUCKET, _FIRST, _SECOND)]).jsonValue())

    def write(self, iterator: Iterator[pa.RecordBatch]):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        folder, out, files = f"{self.root}/data/{uuid.uuid4().hex}", {}, {}
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                for b in pc.unique(table[_BUCKET]).to_pylist():
                    mine = table.filter(pc.equal(table[_BUCKET], b))
                    told = out.setdefault(str(b), {"rows": 0, "h1": 0, "h2": 0, "files": [f"{folder}/{b}.parquet"]})
                    told["rows"] += mine.num_rows
                    told["h1"] += sum(mine[_FIRST].to_pylist())
                    told["h2"] += sum(mine[_SECOND].to_pylist())
                    rows = mine.drop_columns([_BUCKET, _FIRST, _SECOND])
                    if b not in files:
                        system, where = _system(f"{folder}/{b}.parquet")
                        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
                        files[b] = pq.ParquetWriter(where, rows.schema, filesystem=system)
                    files[b].write_table(rows)
        finally:
            for f in files.values():
                f.close()
        return Appended(out)

    def commit(self, messages, batchId):  # noqa: N803
        while True:
            before = manifest(self.root)
            done = (before or {}).get("streams", {}).get(self.name, -1)
            if batchId <= done:  # written before a fault; what was written again is listed nowhere
                return self.abort(messages, batchId)
            buckets = dict((before or {"buckets": {}})["buckets"])
            for m in messages:
                for b, x in m.buckets.items():
                    old = buckets.get(b, {"rows": 0, "h1": "0", "h2": "0", "files": []})
                    buckets[b] = {"rows": old["rows"] + x["rows"], "h1": str(int(old["h1"]) + x["h1"]), "h2": str(int(old["h2"]) + x["h2"]), "files": old["files"] + x["files"]}
            try:
                streams = (before or {}).get("streams", {}) | {self.name: batchId}
                _commit(self.root, before, buckets, before["of"] if before else self.n, self.schema, self.key, self.at, streams=streams)
                return None
            except Conflict:
                continue  # appending goes with whatever came between

    def abort(self, messages, batchId):  # noqa: N803
        for folder in {f.rsplit("/", 1)[0] for m in messages if m for x in m.buckets.values() for f in x["files"]}:
            _drop(folder)


class VersionedTable(DataSource):
    @classmethod
    def name(cls):
        return "versioned_table"

    def schema(self):
        told = manifest(self.options["path"])
        own = [] if told is None else StructType.fromJson(json.loads(told["schema"])).fields
        return StructType([StructField("version", LongType()), *own])

    def streamReader(self, schema):
        return VersionReader(self.options, schema)

    def streamWriter(self, schema, overwrite):
        return VersionWriter(self.options, schema)


def stream(spark: SparkSession, root: str, since: int = 0) -> DataFrame:
    """A stream of ``version`` and the rows of each bucket that it changed, as they are then."""
    spark.dataSource.register(VersionedTable)
    return spark.readStream.format("versioned_table").option("since", since).load(root)


def append_stream(rows: DataFrame, root: str, key: Sequence[str], name: str, *, buckets: int = BUCKETS, at: str = ""):
    """A writer (still to be started) that appends each batch of a stream as a version, once."""
    spark = rows.sparkSession
    spark.dataSource.register(VersionedTable)
    told = manifest(root)
    n = told["of"] if told else buckets
    marked = rows.withColumn(_BUCKET, bucket_of(key, n)).select("*", *_hashes(rows))
    writer = marked.writeStream.format("versioned_table").option("path", root).option("stream", name).option("key", json.dumps(list(key))).option("buckets", n).option("at", at)
    return writer.outputMode("append")
