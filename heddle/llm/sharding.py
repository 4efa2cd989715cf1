"""Weighted rendezvous hashing of stable record keys onto shards (native).

Each record scores every shard by ``-weight / ln(u)``, where ``u`` in (0, 1) is a hash
of (key, shard); the largest score wins.  A score depends on the key and that one shard
alone, so a new shard takes records only into itself and a removed one gives up its own.

Slots are numbered in two steps (blocks of a shard, then rows of a block), so no task
ever holds a whole shard.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.shared import md5_uint60

_SPAN = float(1 << 60)


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (md5_uint60(key, F.lit(str(shard))) + F.lit(0.5)) / F.lit(_SPAN)
    return F.lit(-float(weight)) / F.ln(u)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    while base in df.columns:
        base = f"_{base}"
    return base


def aside(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` whose columns of ``names`` are called ``input_<name>``, to make room."""
    for n in names:
        if n in df.columns:
            df = df.withColumnRenamed(n, free_name(df, f"input_{n}"))
    return df


def place(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """``df`` with ``shard``, from 0 (and ``grown_shard`` under the weights ``grown``, which must
    extend ``weights``).  Both come from one pass over the scores: beyond the first shards
    only the added ones are scored, and win only if they beat the old winner.

    Shards of weight zero take nothing; ties go to the smaller shard.  A null key is hashed as
    the text ``null``; repeated keys go to one shard; an empty table stays empty.  Columns of
    ``df`` that are called like the new ones become ``input_<name>``."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    df = aside(df, ["shard", *["grown_shard"] * (grown is not None)])
    best_ = free_name(df, "_best")
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    scores = F.transform(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w > 0]),
        lambda s: F.struct(
            (-s["w"] / F.ln((md5_uint60(text, s["i"].cast("string")) + F.lit(0.5)) / F.lit(_SPAN))).alias("s"),
            (-s["i"]).alias("i"),
        ),
    )
    out = df.withColumn(best_, F.array_max(scores)).withColumn("shard", (-F.col(best_)["i"]).cast("int"))
    if grown is not None:
        if list(grown[: len(weights)]) != list(weights):
            raise ValueError("grown must extend weights")
        added = [F.struct(_score(text, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(grown) if i >= len(weights) and w > 0]
        best = functools.reduce(lambda a, b: F.greatest(a, b), added, F.col(best_))
        out = out.withColumn("grown_shard", (-best["i"]).cast("int"))
    return out.drop(best_)


def number_slots(df: DataFrame, order: Sequence[str], blocks: int = 256) -> DataFrame:
    """``df`` (with ``shard``) plus ``slot``, gapless from 0 within each shard, ordered by a
    hash block of ``order`` and then by all columns; an own ``slot`` becomes ``input_slot``.

    Wholly repeated rows are one row with a count until the end, when each gets a slot of its
    own; so no key, however often it comes, is numbered row by row.  Only counts of shards x
    blocks meet again; that table has a fixed size."""
    df = aside(df, ["slot"])
    times, block, upto, before = (free_name(df, n) for n in ("_times", "_block", "_upto", "_before"))
    own = (md5_uint60(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order]) % blocks).cast("int")
    once = df.groupBy(*df.columns).agg(F.count("*").alias(times)).withColumn(block, own)
    sums = once.groupBy("shard", block).agg(F.sum(times).alias(before))
    sums = sums.select("shard", block, (F.sum(before).over(W.partitionBy("shard").orderBy(block)) - F.col(before)).alias(before))
    rest = [c for c in df.columns if c not in {*order, "shard"}]
    inner = F.sum(times).over(W.partitionBy("shard", block).orderBy(*order, *rest).rowsBetween(W.unboundedPreceding, 0))
    placed = once.withColumn(upto, inner).join(F.broadcast(sums), ["shard", block])
    first = F.col(before) + F.col(upto) - F.col(times)
    return placed.select(*df.columns, F.explode(F.sequence(first, first + F.col(times) - 1)).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Assign whole documents to ``n_shards`` shards of equal weight under the law ``key``.

    Returns doc_id, size (UTF-8 bytes of the text, none if null, plus 16), text_crc32 (of
    no bytes if null), law, shard, slot and grown_shard (with one shard more).  Null
    doc_ids share one shard; repeated rows share a shard and get their own slots."""
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = place(rows, "doc_id", [1.0] * n_shards, [1.0] * (n_shards + 1))
    numbered = number_slots(placed, ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
