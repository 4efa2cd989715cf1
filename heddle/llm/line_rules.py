"""Quality rules, and lines that too many documents of a host share.

Each line is normalised (its words, A-Z in lower case, with one space between) and hashed; a document sends each of
its lines once, and counts of distinct documents for (host, line) are combined before the shuffle.
Lines above the limit go from every document of the host, and documents with too little left are
rejected.  The limit is a share of the host's documents, so it means the same at every size, but
never less than ``LEAST_DOCUMENTS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm import bloom, transducer
from heddle.llm.bytewords import LOWER, grams, mix, slices, utf8
from heddle.llm.shared import small_batches, written

# What is counted, and the limits of the base rules.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30
#: A line is above the limits in more documents of its host than this, and than this percentage of them.
LEAST_DOCUMENTS, MOST_SHARE = 20, 1
#: A document with less left is depleted: words, and percentage of its words.
LEAST_LEFT, LEAST_LEFT_SHARE = 20, 30

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Lines:
    """Lines with a word, in order: the text each is in, its bytes, and its words by number."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray


def cut_lines(raw: np.ndarray, at: np.ndarray, found: transducer.Counted) -> Lines:
    breaks = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
    begin = begin[begin < len(raw)]
    # a break that ends a text begins no line there; the next text's own beginning is listed anyway
    end = np.append(begin[1:], len(raw))
    end = end - ((end > begin) & (raw[end - 1] == 10)) if len(begin) else end
    first, last = np.searchsorted(found.starts, begin), np.searchsorted(found.starts, end)
    full = last > first
    begin, end, first, last = begin[full], end[full], first[full], last[full]
    return Lines(np.searchsorted(at, begin, "right") - 1, begin, end, first, last)


def _run_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return upto[last] - upto[first]


def line_keys(word_hashes: np.ndarray, lines: Lines) -> np.ndarray:
    """A hash of each line's words: the sum of a random value for each word at each place."""
    place = np.arange(len(word_hashes)) - np.repeat(lines.first, lines.last - lines.first)
    return mix(_run_sums(mix(word_hashes + _ODD * (place + 1).astype(np.uint64)), lines.first, lines.last) + (lines.last - lines.first).astype(np.uint64))


def _later_equals(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which rows repeat an earlier one of the same text."""
    order = np.lexsort((np.arange(len(key)), key, text))
    same = np.zeros(len(key), bool)
    same[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    return same


def _repeated_words(hashes: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Of each text, words in a run of ``WINDOW`` that the text holds twice or more."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(docs, np.int64)
    begin = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    key = mix(grams(hashes, WINDOW)[begin] + owner[begin].astype(np.uint64) * _ODD)
    order = np.argsort(key)
    sorted_key = key[order]
    twin = np.zeros(len(key), bool)
    alike = sorted_key[1:] == sorted_key[:-1]
    twin[order[1:][alike]] = twin[order[:-1][alike]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, begin[twin], 1)
    np.add.at(edge, begin[twin] + WINDOW, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=docs)


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The counts of each text; and its distinct lines: text, key, words in all its lines of that key."""
    raw, at = utf8(texts)
    docs = len(texts)
    found = transducer.run(raw, at, transducer.classes(SYMBOLS))
    owner, words = found.owner(), np.diff(found.first)
    hashes = transducer.hashes(raw, found.starts, found.ends)
    lines = cut_lines(raw, at, found)
    whole = transducer.hashes(raw, lines.begin, lines.end)
    # only words with a capital have another hash in lower case
    capital = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    high = capital[found.ends] > capital[found.starts]
    low = hashes.copy()
    low[high] = transducer.hashes(LOWER[raw], found.starts[high], found.ends[high])
    key = line_keys(low, lines)
    size = lines.last - lines.first
    order = np.lexsort((key, lines.text))
    one = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]) | (lines.text[order][1:] != lines.text[order][:-1]))) if len(key) else np.zeros(0, np.int64)
    counts = {
        "n_words": words,
        "word_chars": found.points - found.blanks,
        "n_symbols": found.symbols,
        "n_dup_lines": np.bincount(lines.text[_later_equals(lines.text, whole)], minlength=docs),
        "n_repeat_words": _repeated_words(hashes, owner, docs),
    }
    return counts, lines.text[order][one], key[order][one], np.add.reduceat(size[order], one) if len(one) else size


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in slices(batch, "text"):
            counts, text, key, size = measure(part.column("text"))
            first = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
            fields = [part.column("doc_id"), part.column("host"), part.column("version"), pa.array(np.arange(row, row + part.num_rows)), *[pa.array(counts[c], pa.int64()) for c in COUNTS]]
            fields += [pa.ListArray.from_arrays(first, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(first, pa.array(size, pa.int32()))]
            row += part.num_rows
            yield pa.RecordBatch.from_arrays(fields, ["doc_id", "host", "version", "row", *COUNTS, "lines", "sizes"])


def _likely(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = sent.value
        for batch in batches:
            lists = batch.column("lines")
            key = np.asarray(lists.flatten(), np.int64)
            at = np.flatnonzero(bloom.holds(filled, key.view(np.uint64)))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths(), np.int64))[at]
            size = np.asarray(batch.column("sizes").flatten(), np.int32)[at]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("host").take(take), pa.array(key[at]), pa.array(size)], ["row", "host", "line", "size"])

    return run


def measured(docs: DataFrame, host: Column) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its counts and its distinct lines.  Written."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.xxhash64("text").alias("version"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return written(read.mapInArrow(_measured, f"doc_id {kind}, host string, version long, row long, {counts}, lines array<long>, sizes array<int>"), "lines")


def frequent_lines(rows: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, most_share: int = MOST_SHARE) -> DataFrame:
    """host, line and documents of the lines above the limits, from ``measured`` rows.

    Rows of one doc_id are one document, whose lines and hosts are those of all its rows; rows without
    doc_id are documents of their own."""
    several = written(rows.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again")), "again")
    again = F.col("doc_id") == F.col("_again")
    once = rows.join(several, again, "left_anti").select("host", "lines")
    more = rows.join(several, again, "left_semi").select("doc_id", "host", "lines")
    each = once.select("host", F.explode("lines").alias("line")).unionByName(more.select("doc_id", "host", F.explode("lines").alias("line")).distinct().drop("doc_id"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("documents")).filter(F.col("documents") > least_documents)
    hosts = once.select("host").unionByName(more.select("doc_id", "host").distinct().drop("doc_id")).groupBy("host").agg(F.count("*").alias("of"))
    return counts.join(hosts, "host").filter(F.col("documents") * 100 > F.col("of") * most_share).select("host", "line", "documents")


def _removed(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """row, line and size of the lines of ``rows`` that are in ``frequent``."""
    sent = rows.sparkSession.sparkContext.broadcast(bloom.build(frequent.select("line").distinct(), "line"))
    likely = rows.filter(F.size("lines") > 0).select("row", "host", "lines", "sizes").mapInArrow(_likely(sent), "row long, host string, line long, size int")
    return likely.join(frequent.select("host", "line"), ["host", "line"]).select("row", "line", "size")


def judged(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` with n_removed (words in lines above the limits), base_failed and kept."""
    gone = _removed(rows, frequent).groupBy("row").agg(F.sum("size").alias("n_removed"))
    out = rows.join(gone, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed")
    depleted = (left < LEAST_LEFT) | (left * 100 < F.col("n_words") * LEAST_LEFT_SHARE)
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def rules(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and n_removed; ``host`` is the source unless given, a null one ''.

    Null and empty texts have no words and fail; repeated rows count as one document and get the
    same result; an empty table gives no rows.  Lines and windows are compared by 64-bit hashes."""
    rows = measured(docs, F.col("source") if host is None else host)
    return judged(rows, written(frequent_lines(rows), "frequent")).select("doc_id", *COUNTS, "base_failed", "kept", "n_removed")


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column("_gone").to_pylist()
        texts = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if gone[i]:
                bad = set(gone[i])
                parts = pa.array(text.split("\n"), pa.large_string())
                raw, at = utf8(parts)
                found = transducer.run(raw, at, transducer.classes(SYMBOLS))
                lines = Lines(np.flatnonzero(np.diff(found.first)), *[np.zeros(0)] * 2, *(lambda f: (f[:-1][np.diff(f) > 0], f[1:][np.diff(f) > 0]))(found.first))
                key = line_keys(transducer.hashes(LOWER[raw], found.starts, found.ends), lines).view(np.int64)
                drop = {int(t) for t, k in zip(lines.text, key.tolist(), strict=True) if k in bad}
                text = "\n".join(p for n, p in enumerate(text.split("\n")) if n not in drop)
            texts.append(text)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns(["_gone"])


def clean(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """The kept rows of ``docs``, all columns, their texts without the lines above the limits."""
    rows = measured(docs, F.col("source") if host is None else host)
    frequent = written(frequent_lines(rows), "frequent")
    kept = judged(rows, frequent).filter("kept").select("row", "doc_id", "version", F.col("host").alias("_host"))
    gone = _removed(rows, frequent).groupBy("row").agg(F.collect_set("line").alias("_gone"))
    marks = kept.join(gone, "row", "left").select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "_host", "_gone").dropDuplicates(["_doc", "_version", "_host"])
    of = F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit(""))
    met = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_version")) & (of == F.col("_host"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.join(marks, met).select(*docs.columns, "_gone").mapInArrow(_stripped, fields)
