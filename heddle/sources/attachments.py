"""Binary attachments: the content hash of a bencoded file's ``info``, and its matching to
messages by file name."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import strip

MAX_BYTES = 16 << 20


def read_files(spark: SparkSession, path: str, pattern: str = "*.[tT][oO][rR][rR][eE][nN][tT]") -> DataFrame:
    """Files in a folder; those beyond ``MAX_BYTES`` come without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    large = files.filter(F.col("length") > MAX_BYTES).drop("content").withColumn("content", F.lit(None).cast("binary"))
    return files.filter(F.col("length") <= MAX_BYTES).unionByName(large)


def _skip(data: bytes, at: int, depth: int = 0) -> int:
    """Where the value that begins at ``at`` ends."""
    if depth > 64:
        raise ValueError("too deep")
    kind = data[at : at + 1]
    if kind == b"i":
        end = data.index(b"e", at)
        int(data[at + 1 : end])
        return end + 1
    if kind in (b"l", b"d"):
        at += 1
        while data[at : at + 1] != b"e":
            if at >= len(data):
                raise ValueError("open list")
            at = _skip(data, at, depth + 1)
        return at + 1
    colon = data.index(b":", at)
    end = colon + 1 + int(data[at:colon])
    if end > len(data):
        raise ValueError("cut text")
    return end


def info_hash(data: bytes) -> str:
    """SHA-1 of the raw ``info`` value of a bencoded dictionary that is the whole file."""
    if data[:1] != b"d":
        raise ValueError("no dictionary")
    at, found = 1, None
    while data[at : at + 1] != b"e":
        key_end = _skip(data, at)
        key = data[data.index(b":", at) + 1 : key_end]
        value_end = _skip(data, key_end)
        if key == b"info":
            if found is not None or data[key_end : key_end + 1] != b"d":
                raise ValueError("bad info")
            found = hashlib.sha1(data[key_end:value_end]).hexdigest()
        at = value_end
    if at + 1 != len(data) or found is None:
        raise ValueError("no info or trailing bytes")
    return found


def hashes(files: DataFrame) -> DataFrame:
    """(path, info_sha1, error); files that do not parse are rows with an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    if content is None:
                        raise ValueError("too large")
                    out.append((path, info_hash(bytes(content)), None))
                except (ValueError, IndexError) as e:
                    out.append((path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "info_sha1", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, info_sha1 string, error string")


def _name(c: Column) -> Column:
    """The last part of a path, trimmed, in lower case, if it is a torrent's; else null."""
    base = F.lower(strip(F.regexp_extract(F.regexp_replace(c, "/+$", ""), "([^/]*)$", 1)))
    return F.when(base.endswith(".torrent"), base)


def _without_count(name: Column) -> Column:
    """The name without the `` (n)`` that browsers add; null if it has none."""
    bare = F.regexp_extract(name, r"(?s)^(.*) \([0-9]+\)\.torrent$", 1)
    return F.when(name.rlike(r" \([0-9]+\)\.torrent$"), F.concat(bare, F.lit(".torrent")))


def is_torrent(media_type: Column | str = "media_type", mime_type: Column | str = "mime_type") -> Column:
    """A message whose attachment is a torrent."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce((col(media_type) == "messageMediaDocument") & (F.lower(col(mime_type)) == "application/x-bittorrent"), F.lit(False))


def _pooled(hashed: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files under the message name they belong to, messages by name).  A file belongs to the messages
    of its own name, or else to those of its name without the browser's count."""
    named = messages.select("message_id", _name(F.col("file_name")).alias("name")).filter(F.col("name").isNotNull()).distinct()
    files = hashed.select("path", "info_sha1", "error", _name(F.col("path")).alias("own")).filter(F.col("own").isNotNull())
    names = named.select("name").distinct()
    told = files.join(names.withColumnRenamed("name", "_own"), F.col("own") == F.col("_own"), "left").withColumn("_bare", F.when(F.col("_own").isNull(), _without_count(F.col("own"))))
    # a file without a second name is told by its own, which finds nothing new: keys that are null would all meet in one task
    told = told.withColumn("_bare", F.coalesce("_bare", "own")).join(names.withColumnRenamed("name", "_second"), F.col("_bare") == F.col("_second"), "left")
    return told.select(F.coalesce("_own", "_second").alias("name"), "path", "info_sha1", "error").filter(F.col("name").isNotNull()), named


def match(hashed: DataFrame, messages: DataFrame) -> DataFrame:
    """(message_id, info_sha1): messages (message_id, file_name), all of them with torrents, whose content
    is known.

    A name counts if all its files, own and counted ones, have one hash, and if one message bears it
    or there are as many files as messages.  A name with a file that does not parse has none."""
    files, named = _pooled(hashed, messages)
    h = F.col("info_sha1")
    each = files.groupBy("name", "path").agg(F.min(h).alias("least"), F.max(h).alias("most"), F.count_if(h.isNull()).alias("unread"))
    one = each.groupBy("name").agg(F.count("path").alias("files"), F.min("least").alias("info_sha1"), F.max("most").alias("most"), F.sum("unread").alias("unread"))
    want = named.groupBy("name").agg(F.count("*").alias("wanted"))
    known = one.join(want, "name").filter((F.col("info_sha1") == F.col("most")) & (F.col("unread") == 0) & ((F.col("wanted") == 1) | (F.col("files") >= F.col("wanted"))))
    return named.join(known.select("name", "info_sha1"), "name").select("message_id", "info_sha1")


def unreadable(hashed: DataFrame, messages: DataFrame) -> DataFrame:
    """Violations: files of messages that do not parse."""
    files, _ = _pooled(hashed, messages)
    bad = files.filter(F.col("info_sha1").isNull())
    return bad.select(F.lit("attachments").alias("table"), F.col("path").alias("key"), F.lit("unreadable_file").alias("rule"), F.col("error").alias("value"))


def magnet_links(matched: DataFrame) -> DataFrame:
    """The link of each message's attachment, with the fields of a catalog link."""
    return matched.select("message_id", F.concat(F.lit("magnet:?xt=urn:btih:"), "info_sha1").alias("url"), F.lit("magnet").alias("provider"), F.lit("torrent").alias("kind"), F.lit("mirror").alias("role"))
