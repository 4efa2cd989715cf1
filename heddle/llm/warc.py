"""WARC files as a Spark data source (``format("warc")``), for reading and writing.

Reading plans partitions over pieces of files by size (files of this writer are cut at the
member offsets that its manifest lists, others are read whole), parses each record's header first, and holds
the pushed predicates against it; the content of other records is not decoded: in plain
files it is skipped by its length, in compressed ones by the ``sl`` (skip-lengths) field
of the gzip header, where the writer of the file put one.

Writing makes one compressed member a record and rolls files at a bounded size.  A task
writes files of its own names; only those that a committed job lists in its manifest are
read, so that failed and repeated tasks leave no records.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from heddle.llm.shared import fresh_path, written

SCHEMA = (
    "file string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_sha1 string, "
    "content_length long, headers map<string,string>, payload binary"
)
ROLL_BYTES, SPLIT_BYTES = 64 << 20, 128 << 20
#: How far apart the offsets are that a manifest lists, and the least that a partition reads.
MARK_BYTES, LEAST_SPLIT = 4 << 20, 1 << 20
_PUSHED = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To"}


def _files(path: str):
    """The file system that holds ``path``, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# --- records -----------------------------------------------------------------------------


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member with the lengths needed to skip it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 10 + 14 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    head = struct.pack("<BBBBIBBH", 31, 139, 8, 4, 0, 0, 255, len(extra))
    return head + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {_value(v)}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


class _Source:
    """Bytes of a file from an offset on, read in pieces."""

    def __init__(self, stream, size: int) -> None:
        self.stream, self.size = stream, size

    def at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(max(0, min(n, self.size - offset)))


def _plain(source: _Source, offset: int, wanted) -> tuple[int, dict | None, bytes | None]:
    """(offset of the next record, headers or None if not wanted, block or None)."""
    head, n = b"", 4096
    while b"\r\n\r\n" not in head:
        head = source.at(offset, n)
        if len(head) < n and b"\r\n\r\n" not in head:
            return source.size, None, None
        n *= 2
    cut = head.index(b"\r\n\r\n") + 4
    fields = parse_head(head[:cut])
    length = int(fields.get("Content-Length", 0))
    after = offset + cut + length + 4
    match wanted(fields):
        case None:
            return after, None, None
        case False:
            return after, fields, None
    return after, fields, source.at(offset + cut, length)


def _compressed(source: _Source, offset: int, wanted) -> tuple[int, dict | None, bytes | None]:
    start = source.at(offset, 24)
    skip = 0
    if len(start) >= 24 and start[3] & 4 and start[12:14] == b"sl":
        skip = struct.unpack("<I", start[16:20])[0]
    inflate = zlib.decompressobj(31)
    at, out, fields, decode = offset, b"", None, None
    pieces: list[bytes] = []
    cut = held = 0
    while not inflate.eof:
        piece = source.at(at, 4096 if fields is None else 1 << 20)
        if not piece:
            break
        at += len(piece)
        got = inflate.decompress(piece)
        if fields is None:
            out += got
            if b"\r\n\r\n" in out:
                cut = out.index(b"\r\n\r\n") + 4
                fields = parse_head(out[:cut])
                decode = wanted(fields)
                if not decode and skip:
                    return offset + skip, (None if decode is None else fields), None
                pieces, held = [out[cut:]], len(out) - cut
        elif decode:
            pieces.append(got)
            held += len(got)
    after = at - len(inflate.unused_data)
    if fields is None or decode is None:
        return max(after, offset + 1), None, None
    return after, fields, b"".join(pieces)[: int(fields.get("Content-Length", 0))] if decode else None


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The content of an HTTP response without its own headers; else the whole block."""
    if fields.get("Content-Type", "").startswith("application/http"):
        _, found, rest = block.partition(b"\r\n\r\n")
        return rest if found else b""
    return block


def sha1_of(fields: dict[str, str]) -> str | None:
    kind, _, digest = fields.get("WARC-Payload-Digest", "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return digest.lower() if len(digest) == 40 else base64.b32decode(digest).hex()
    except ValueError:
        return None


# --- reading -----------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tasks = int(options.get("tasks", 1))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = _PUSHED.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and isinstance(f, EqualTo):
                self.tests.append((name, "in", {f.value}))
            elif name and isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "has", None))
            else:
                yield f

    def wanted(self, fields: dict[str, str]) -> bool | None:
        """None: leave the record out; else whether to decode its content."""
        for name, kind, value in self.tests:
            own = fields.get(name)
            if own is None or kind == "in" and own not in value or kind == "starts" and not own.startswith(value):
                return None
        return self.payload

    def partitions(self):
        from pyarrow import fs

        files, root = _files(self.path)
        found = [x for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file]
        listed: dict[str, list[int]] | None = None
        for x in found:
            if x.base_name.startswith("_manifest-"):
                with files.open_input_stream(x.path) as s:
                    listed = (listed or {}) | json.loads(s.read())
        mine = sorted((x for x in found if x.base_name.endswith((".warc", ".warc.gz")) and (listed is None or x.base_name in listed)), key=lambda x: x.path)
        pieces = []
        for x in mine:
            marks = sorted({0, *(listed or {}).get(x.base_name, [])})
            pieces += [(x.path, x.size, a, b) for a, b in zip(marks, [*marks[1:], x.size], strict=True)]
        # about ``tasks`` partitions, but neither tiny nor huge ones
        most = min(SPLIT_BYTES, max(LEAST_SPLIT, sum(x.size for x in mine) // self.tasks))
        out, size = [[]], 0
        for piece in pieces:
            long = piece[3] - piece[2]
            if out[-1] and size + long > most:
                out.append([])
                size = 0
            out[-1].append(piece)
            size += long
        return [Files(p) for p in out]

    def read(self, partition):
        files, _ = _files(self.path)
        rows, size = [], 0
        for path, total, begin, end in partition.paths:
            with files.open_input_file(path) as stream:
                source, offset = _Source(stream, total), begin
                step = _compressed if source.at(begin, 2) == b"\x1f\x8b" else _plain
                while offset < end:
                    after, fields, block = step(source, offset, self.wanted)
                    if fields is not None:
                        payload = None if block is None else payload_of(fields, block)
                        get = fields.get
                        rows.append((path, offset, get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Target-URI"), get("WARC-Refers-To"), sha1_of(fields), int(get("Content-Length", 0)), list(fields.items()), payload))
                        size += len(payload or b"") + 1000
                    offset = after
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema(
    [("file", pa.string()), ("offset", pa.int64())]
    + [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "refers_to", "payload_sha1")]
    + [("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


# --- writing -----------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    marks: dict  #: by file name, offsets of members that a reader may begin at


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_type, record_id, target_uri, refers_to, payload_sha1 (all strings), headers
    (map) and payload (of responses; revisits have none)."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.date = options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]):
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        marks: dict[str, list[int]] = {}
        out, size, name = None, 0, ""
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    info = member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    size, marks[name] = len(info), [0]
                if size - marks[name][-1] > MARK_BYTES:
                    marks[name].append(size)
                data = member(self.one(row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(marks)

    def one(self, row: dict) -> bytes:
        sha1 = row.get("payload_sha1")
        fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", self.date)]
        if row.get("target_uri") is not None:
            fields.append(("WARC-Target-URI", row["target_uri"]))
        if sha1:
            fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()))
        if row.get("refers_to") is not None:
            fields += [("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        fields += [(k, v) for k, v in dict(row.get("headers") or {}).items() if v is not None]
        payload = row.get("payload")
        head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        block = head.encode() + b"\r\n" if payload is None else f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        return record([*fields, ("Content-Type", "application/http; msgtype=response")], block)

    def commit(self, messages):
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as s:
            s.write(json.dumps({n: at for m in messages if m for n, at in sorted(m.marks.items())}).encode())

    def abort(self, messages):
        files, root = _files(self.path)
        for name in (n for m in messages if m for n in m.marks):
            files.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in ``path``.  With ``payload`` off no content is decoded."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("tasks", 2 * spark.sparkContext.defaultParallelism).load(path)


# --- pages -------------------------------------------------------------------------------

LEAST_REVISIT = 1000


def page_records(pages: DataFrame) -> DataFrame:
    """One record a row of ``pages`` (page_id, url, html), as the writer takes them.

    Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes that with the largest
    page_id is the response and the others revisit it; rows that repeat its page_id are
    responses too, and so are pages without page_id if no other page has their payload.  A
    null html is an empty payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_sha1": F.sha1("payload"), "n": F.length("payload").cast("long")})
    kept = rows.filter(F.col("n") >= LEAST_REVISIT).groupBy("payload_sha1", "n").agg(F.max("page_id").alias("kept"), F.count("*").alias("times"))
    kept = written(kept.filter(F.col("times") > 1).select("payload_sha1", "n", "kept"), "kept-pages")
    joined = rows.join(kept, ["payload_sha1", "n"], "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    name = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.lit("page:"), text(c))), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    own = F.create_map(F.lit("X-Payload-Length"), F.col("n").cast("string"), F.lit("X-Page-Id"), F.col("page_id").cast("string"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        name(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(again, name(F.col("kept"))).alias("refers_to"),
        "payload_sha1",
        own.alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame) -> str:
    """Write ``pages`` as WARC files in the shared folder; returns the folder."""
    spark = pages.sparkSession
    register(spark)
    path = fresh_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    return path


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` and read the archives back.  Per page: page_id, payload_bytes,
    payload_digest (from the content of responses, from the header of revisits),
    record_type, refers_to (the page_id of the record that a revisit names)."""
    spark, path = pages.sparkSession, archive(pages)
    kind = pages.schema["page_id"].dataType
    page = F.col("headers")["X-Page-Id"].cast(kind)
    full = read(spark, path).filter(F.col("record_type") == "response")
    responses = full.select(page.alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    # headers of all records in one pass, without content; a relation remembers the predicates
    # pushed into it, so it is not the one above
    heads = read(spark, path, payload=False).filter(F.col("record_type").isin("response", "revisit"))
    heads = written(heads.select("record_type", "record_id", "refers_to", page.alias("page_id"), F.col("headers")["X-Payload-Length"].cast("long").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest")), "warc-heads")
    names = heads.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to")).distinct()
    revisits = heads.filter("record_type = 'revisit'").drop("record_id")
    found = revisits.join(names, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("to").alias("refers_to"))
    return responses.unionByName(found)
