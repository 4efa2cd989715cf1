"""Benchmark decontamination by winnowing.

Of each window of ``window`` consecutive words the k-gram with the smallest hash is kept
(the rightmost of equals).  Texts that share a window keep the same k-gram of it, so
joining the kept hashes of documents and items misses no shared window; each hit is then
extended, word by word, to the item's whole window.

Items of fewer words than a window are windows of their own length; document windows of
just those lengths (fewer than ten) are fingerprinted as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import bloom
from heddle.llm.bytewords import ALNUM, Words, grams, slices, words, mix
from heddle.llm.shared import written

WINDOW, GRAM = 10, 5


def fingerprints(found: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``length`` words within one text: its first word, the first word
    of its kept k-gram, and that k-gram's hash (salted by the length)."""
    k = min(gram, length)
    n = len(found.hashes) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64)
    doc = found.doc_of()
    h = mix(grams(found.hashes, k) + np.uint64(length))
    best, at = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, length - k + 1):
        other = h[j : j + n]
        less = other <= best
        best[less] = other[less]
        at[less] = j
    begin = np.flatnonzero(doc[:n] == doc[length - 1 : length - 1 + n])
    return begin, begin + at[begin], best[begin]


def _item_windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"), ALNUM)
                owner = found.doc_of()
                size = np.diff(found.first)[owner] if len(owner) else owner
                ids = part.column("item_id")
                for n in sorted({*np.minimum(size, window).tolist()}):
                    begin, kept, h = fingerprints(found, n, gram)
                    mine = np.minimum(size[begin], window) == n
                    begin, kept, h = begin[mine], kept[mine], h[mine]
                    text = [" ".join(found.word(i) for i in range(b, b + n)) for b in begin.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(owner[begin])), pa.array(np.full(len(begin), n, np.int32)), pa.array((kept - begin).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(text, pa.string())],
                        ["item_id", "length", "offset", "hash", "window"],
                    )

    return run


HIT = pa.struct([("hash", pa.int64()), ("length", pa.int32()), ("gram", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.string()))])


def _document_hits(lengths: list[int], gram: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"), ALNUM)
                first = found.first
                hits: list[list[dict]] = [[] for _ in range(part.num_rows)]
                owner = found.doc_of()
                for n in lengths:
                    _, kept, h = fingerprints(found, n, gram)
                    # neighbouring windows keep the same k-gram: winnowing lists it once
                    kept, one = np.unique(kept, return_index=True)
                    h = h[one]
                    likely = bloom.holds(filled, h)
                    k = min(gram, n)
                    for p, x in zip(kept[likely].tolist(), h[likely].view(np.int64).tolist(), strict=True):
                        d = int(owner[p])
                        a, b = max(int(first[d]), p - (n - k)), min(int(first[d + 1]), p + n)
                        hits[d].append({"hash": x, "length": n, "gram": p - int(first[d]), "first": a - int(first[d]), "words": [found.word(i) for i in range(a, b)]})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"), pa.array(np.diff(first)), pa.array(hits, pa.list_(HIT))], ["doc_id", "version", "n_words", "hits"]
                )

    return run


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, gram: int = GRAM, bits: int = bloom.BITS) -> DataFrame:
    """Hold ``docs`` (doc_id, text) against ``items`` (item_id, text).

    Returns for each row of ``docs``: doc_id, version (a hash of the text), n_words, n_hit
    (words inside an occurrence of an item's window), items (ids of items with occurring
    windows, as strings, sorted).  Null and empty texts have no words; repeated rows get
    equal results; without items nothing is hit."""
    named = items.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    cut = named.mapInArrow(_item_windows(window, gram), f"item_id {items.schema['item_id'].dataType.simpleString()}, length int, offset int, hash long, window string")
    cut = written(cut.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null"))), "windows")
    # a window that several items have is one row
    known = cut.groupBy("hash", "length", "offset", "window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    lengths = sorted(r[0] for r in cut.select("length").distinct().collect())  # at most ``window`` rows
    sent = docs.sparkSession.sparkContext.broadcast(bloom.build(cut.select("hash").distinct(), "hash", bits))
    read = docs.select("doc_id", F.xxhash64("text").alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = "array<struct<hash:bigint,length:int,gram:bigint,first:bigint,words:array<string>>>"
    marked = written(read.mapInArrow(_document_hits(lengths, gram, sent), f"doc_id {kind}, version long, n_words long, hits {hit}"), "hits")
    likely = marked.filter(F.size("hits") > 0).select("doc_id", "version", F.explode("hits").alias("h")).select("doc_id", "version", "h.*")
    joined = likely.join(known, ["hash", "length"])
    begin = F.col("gram") - F.col("offset") - F.col("first")
    inside = (begin >= 0) & (begin + F.col("length") <= F.size("words"))
    same = F.array_join(F.slice("words", (begin + 1).cast("int"), F.col("length")), " ") == F.col("window")
    spans = joined.filter(inside).filter(same).select("doc_id", "version", (F.col("gram") - F.col("offset")).alias("begin"), "length", "items")
    # equal documents give equal spans; a set of them is bounded by the document's words
    per_doc = spans.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("length")).alias("stop")))).alias("spans"), F.collect_set("items").alias("sets")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["upto"], x["begin"]))).alias("n"), F.greatest(s["upto"], x["stop"]).alias("upto")),
        lambda s: s["n"],
    )
    per_doc = per_doc.select(
        F.col("doc_id").alias("_d"), F.col("version").alias("_v"), covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items")
    )
    rows = marked.select("doc_id", "version", "n_words")
    out = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["_d"]) & (rows["version"] == per_doc["_v"]), "left")
    return out.select("doc_id", "version", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no window with an item."""
    bad = contamination(docs, items).filter(F.col("n_hit") > 0).select(F.col("doc_id").alias("_d"), F.col("version").alias("_v")).distinct()
    bad = written(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_v"]), "left_anti")
