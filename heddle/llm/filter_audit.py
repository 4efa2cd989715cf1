"""How quality filters act on one another: every order of five filters, audited from one pass.

The texts are read once, by the byte transducer; a document is then five bits, one for each filter
that it fails.  Whatever the order, a filter removes what fails it and no earlier one, so all
orders follow from how many documents of a part have which bits: 32 numbers at most.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm import transducer
from heddle.llm.bytewords import slices, utf8
from heddle.llm.shared import small_batches, written

LETTERS = "ABCDE"
# The limits of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"


def own_failures(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Bits of the filters A to D that each text fails, and its SHA-256."""
    raw, at = utf8(texts)
    found = transducer.run(raw, at, transducer.classes(SYMBOLS))
    words = np.diff(found.first)
    new = np.concatenate([[0], np.cumsum(transducer.first_of_kind(raw, found))])
    distinct = np.diff(new[found.first])
    failed = (words < LEAST_WORDS) * 1 + (100 * distinct < LEAST_DISTINCT * words) * 2
    failed += (100 * found.capitals > MOST_CAPITALS * found.points) * 4 + (found.symbols > 0) * 8
    held = raw.tobytes()
    return failed, [hashlib.sha256(held[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            failed, digest = own_failures(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(digest, pa.binary()), pa.array(failed, pa.int32())], ["doc_id", "part", "digest", "failed"])


def failures(docs: DataFrame, part: Column) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, part, failed (a bit for each filter, A the lowest).

    The smallest doc_id of each text is found by an aggregate that combines before its shuffle, and
    met again by digest and doc_id, so that a group of copies is spread by its members.  A null text is
    empty; rows without doc_id have no smaller one and fail E for none; repeated rows of the
    smallest doc_id don't fail it either."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", F.coalesce(part.cast("string"), F.lit("")).alias("part"))
    rows = written(read.mapInArrow(_run, f"doc_id {kind}, part string, digest binary, failed int"), "failures")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("_first")).select(F.col("digest").alias("_digest"), "_first")
    joined = rows.join(first, (F.col("doc_id") == F.col("_first")) & (F.col("digest") == F.col("_digest")), "left")
    late = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return joined.select("doc_id", "part", (F.col("failed") + F.when(late, 16).otherwise(0)).alias("failed"))


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``cells``: part, failed (bits of ``letters``), n, good, toxic, a row each at most.  A row for each part, order
    of the letters and step, with the counts of that step within that part; they are taken from the part's
    cells, 2 ** len(letters) of them at most."""
    steps = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            steps.append({"filter_order": "".join(order), "step": step, "before": before, "bit": bit})
            before |= bit
    of_part = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,bit:int>>")
    rows = of_part.select("part", "cells", F.explode(table).alias("s")).select("part", "cells", "s.*")
    zero = F.lit(0).cast("long")

    def total(count, where) -> Column:
        return F.aggregate("cells", zero, lambda s, c: s + F.when(where(c["failed"]), count(c)).otherwise(zero))

    n = lambda c: c["n"]
    fails = lambda f: f.bitwiseAND(F.col("bit")) != 0
    past = lambda f: f.bitwiseAND(F.col("before")) == 0
    here = lambda f: fails(f) & past(f)
    # the first of the filters that a document fails removes it: each is that in an equal share of the orders
    orders = F.lit(factorial(len(letters)))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda f: f.bitwiseAND(F.col("before") + F.col("bit")) == 0).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda f: fails(f) & ~past(f)).alias("redundant"),
        total(n, lambda f: f == F.col("bit")).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        total(lambda c: (c["n"] * orders / F.bit_count(c["failed"])).cast("long"), fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """Five filters in all 120 orders, per part (``source`` unless given) of ``docs``, with what ``labels``
    (doc_id, quality, toxic) say of the removed.

    A document is good or toxic if any of its labels says so; labels of no document count
    nowhere.  Parts that are null are the empty string's; an empty table gives no rows."""
    failed = failures(docs, F.col("source") if part is None else part)
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    told = failed.join(known, F.col("doc_id") == F.col("_labelled"), "left")
    cells = told.groupBy("part", "failed").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in ("good", "toxic")])
    return interactions(cells)
