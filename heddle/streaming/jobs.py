"""Streaming twins of the audit's and the cache's state: confirmations, upserts, counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.audit import CONFIRMABLE
from heddle.operators.merge import distinct_in_order, says_something, with_arrays
from heddle.plans.stored import drop_path, fresh_path
from heddle.sources.stores import children, exists

STATE = "state string, streak int, at timestamp, tie long, emitted boolean"
OUT = "key string, state string, confirmations int, tombstone boolean, late long"
#: Batches between two compactions of a table that a stream upserts into.
COMPACT_EVERY = 16


def confirmations(observed: DataFrame, required: int, late: str = "30 days") -> DataFrame:
    """Stream of (key, state, confirmations, tombstone, late) after each batch: ``observed`` has
    key, state, checked_at and tie (orders equal times).  A tombstone is emitted once, when a
    state was confirmed ``required`` times in a row; ``late`` counts the batch's rows that are
    not newer than what was seen before, which change nothing.

    State is a few values a key; of a key's rows in a batch a worker holds 17 bytes each."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, streak, at, tie, emitted = held.get if held.exists else (None, 0, None, -1, False)
        names: dict[str, int] = {} if state is None else {state: 0}
        since = None if at is None else pd.Timestamp(at).value
        codes, times, ties, n_late = [], [], [], 0
        for part in parts:
            t, n = part["checked_at"].astype("datetime64[ns]").to_numpy().astype(np.int64), part["tie"].to_numpy(np.int64)
            new = np.ones(len(part), bool) if since is None else (t > since) | ((t == since) & (n > tie))
            n_late += int((~new).sum())
            codes.append(np.array([names.setdefault(s, len(names)) for s in part["state"][new]], np.int8))
            times.append(t[new])
            ties.append(n[new])
        t, n, c = np.concatenate(times), np.concatenate(ties), np.concatenate(codes)
        due = False
        if len(t):
            order = np.lexsort((n, t))
            t, n, c = t[order], n[order], c[order]
            said = list(names)
            starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            lengths = np.diff(np.append(starts, len(c)))
            if state is not None and said[c[0]] == state:
                lengths[0] += streak
            confirmable = np.array([s in CONFIRMABLE for s in said])[c[starts]]
            if not emitted and (lengths[confirmable] >= required).any():
                due = emitted = True
            state, streak = said[c[-1]], int(lengths[-1]) if confirmable[-1] else 0
            at, tie = pd.Timestamp(int(t[-1])), int(n[-1])
        held.update((state, int(streak), pd.Timestamp(at).to_pydatetime(), int(tie), bool(emitted)))
        yield pd.DataFrame({"key": [key[0]], "state": [state], "confirmations": [streak], "tombstone": [due], "late": [n_late]})

    keyed = observed.withWatermark("checked_at", late).groupBy("key")
    return keyed.applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")


def state_counts(observed: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Counts a window and state; observations that come twice count once.  Rows behind the
    watermark are dropped; ``replay`` tells how many."""
    once = observed.withWatermark("checked_at", late).dropDuplicatesWithinWatermark(["key", "checked_at", "tie"])
    return once.groupBy(F.window("checked_at", window), "state").count().select(F.col("window.start").alias("day"), "state", "count")


def replay(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None = None, *, checkpoint: str | None = None, out: str | None = None, dropped: list[int] | None = None) -> DataFrame | None:
    """Run a stream over what there is and stop.  Without ``each`` the emitted rows are returned
    with the batch that emitted them.

    ``checkpoint`` is where the stream's progress and state stay: a run that is given that of
    an earlier one goes on where it stopped (with ``out``, emitted rows of both are
    returned).  Without it, the run is on its own.  ``dropped`` gets the number of rows that
    came too late for the watermark."""
    spark = stream.sparkSession
    mark, into = checkpoint or fresh_path(spark, "stream-checkpoint"), out or fresh_path(spark, "stream-out")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{into}/n={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(each or keep).start()
    query.awaitTermination()
    if dropped is not None:
        dropped.append(sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]))
    if checkpoint is None:
        drop_path(spark, mark)
    return None if each else spark.read.parquet(into).drop("n")


def run_once(writer, checkpoint: str) -> None:
    """Run a stream's writer over what there is and stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Table:
    """A table that a stream upserts into: each batch's rows lie in a folder of their own, and
    every ``COMPACT_EVERY`` batches all rows so far are folded into a base.  A batch that is
    replayed writes the same again; a missing batch stops the stream.

    ``fold`` makes one row a key of the rows of bases and batches, whatever their order."""

    def __init__(self, path: str, fold: Callable[[DataFrame], DataFrame], every: int = COMPACT_EVERY) -> None:
        self.path, self.fold, self.every = path, fold, every

    def _done(self, spark: SparkSession, kind: str) -> list[int]:
        return sorted(int(c.split("=")[1]) for c in children(spark, f"{self.path}/{kind}") if exists(spark, f"{self.path}/{kind}/{c}/_SUCCESS"))

    def _rows(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        batches = [b for b in self._done(spark, "batch") if upto is None or b <= upto]
        if not batches:
            return None
        last = batches[-1] if upto is None else upto
        bases = [b for b in self._done(spark, "base") if b <= last]
        begin = bases[-1] + 1 if bases else 0
        wanted = range(begin, last + 1)
        if gaps := sorted(set(wanted) - set(batches)):
            raise RuntimeError(f"batches {gaps} of {self.path} are missing")
        parts = [spark.read.parquet(f"{self.path}/batch/n={b}") for b in wanted]
        if bases:
            parts.append(spark.read.parquet(f"{self.path}/base/n={bases[-1]}"))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        return rows

    def write(self, batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n == 0 and len(self._done(spark, "batch")) > 1:
            raise RuntimeError(f"{self.path} has batches of another checkpoint")
        self.fold(batch).write.mode("overwrite").parquet(f"{self.path}/batch/n={n}")
        if n and n % self.every == 0:
            self.fold(self._rows(spark, n)).write.mode("overwrite").parquet(f"{self.path}/base/n={n}")

    def read(self, spark: SparkSession) -> DataFrame:
        rows = self._rows(spark)
        if rows is None:
            raise RuntimeError(f"nothing was written to {self.path} yet")
        return self.fold(rows)


def upsert_into(path: str, key: str, order: list[str], arrays: list[str] = [], every: int = COMPACT_EVERY) -> Table:  # noqa: B006
    """Later values that say something win."""

    def fold(rows: DataFrame) -> DataFrame:
        # the position of each value goes along, so that folds can be folded again
        scalars = [c for c in rows.columns if c not in {key, *order, *arrays} and not c.startswith("_at_")]
        at = F.struct(*order)
        for c in scalars:
            if f"_at_{c}" not in rows.columns:
                rows = rows.withColumn(f"_at_{c}", at)
        told = {c: says_something(F.col(c), rows.schema[c].dataType.simpleString()) for c in scalars}
        when = {c: F.when(told[c], F.coalesce(F.col(f"_at_{c}"), at)) for c in scalars}
        out = rows.groupBy(key).agg(*[F.max_by(F.when(told[c], F.col(c)), when[c]).alias(c) for c in scalars], *[F.max(when[c]).alias(f"_at_{c}") for c in scalars], F.min(at).alias("_first"))
        if arrays:
            types = {a: rows.schema[a].dataType for a in arrays}
            out = with_arrays(out, distinct_in_order(rows, [key], arrays, at), [key], arrays, types)
        return out.select(*[c for c in out.columns if c != "_first"], *[F.col(f"_first.{o}").alias(o) for o in order])

    return Table(path, fold, every)


def cache_into(path: str, stale_after: Column, every: int = COMPACT_EVERY) -> Table:
    """Outcomes (sha256, state, checked_at, content) that say something replace rows; rows older
    than ``stale_after`` before the newest outcome go."""

    def fold(rows: DataFrame) -> DataFrame:
        told = rows.filter(F.col("state").isin("extracted", "not_found"))
        cols = [c for c in told.columns if c != "sha256"]
        newest = told.groupBy("sha256").agg(F.max_by(F.struct(*cols), F.struct("checked_at", F.to_json(F.struct(*cols)))).alias("x")).select("sha256", "x.*")
        top = told.agg(F.max("checked_at").alias("_now"))
        return newest.join(F.broadcast(top), F.lit(True)).filter(F.col("checked_at") + stale_after >= F.col("_now")).drop("_now")

    return Table(path, fold, every)
