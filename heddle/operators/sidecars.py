"""Joins of links with the control tables: tombstones, suppressions, cached content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dispositions(links: DataFrame, tombstones: DataFrame, suppressions: DataFrame, entry: str = "entry_id", key: str = "sha256", rejection: str = "rejection") -> DataFrame:
    """``links`` with ``disposition``: structural, tombstoned, suppressed or kept; the first
    that holds.  Spark broadcasts a control table if its size allows."""
    dead = tombstones.select(F.col("sha256").alias("_t")).distinct()
    quiet = suppressions.select(F.col("source_entry_id").alias("_e"), F.col("sha256").alias("_s")).distinct()
    out = links.join(dead, links[key] == F.col("_t"), "left").join(quiet, (links[entry] == F.col("_e")) & (links[key] == F.col("_s")), "left")
    why = F.when(F.col(rejection).isNotNull(), "structural").when(F.col("_t").isNotNull(), "tombstoned").when(F.col("_s").isNotNull(), "suppressed").otherwise("kept")
    return out.select(*[links[c] for c in links.columns], why.alias("disposition"))


def disposition_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("disposition").count()


def tombstone_filter(links: DataFrame, tombstones: DataFrame, key: str = "sha256") -> DataFrame:
    return links.join(tombstones.select(F.col("sha256").alias(key)).distinct(), key, "left_anti")


def suppression_filter(links: DataFrame, suppressions: DataFrame, entry: str, key: str = "sha256") -> DataFrame:
    quiet = suppressions.select(F.col("source_entry_id").alias(entry), F.col("sha256").alias(key)).distinct()
    return links.join(quiet, [entry, key], "left_anti")


def attach_content(links: DataFrame, cache: DataFrame, key: str = "sha256") -> DataFrame:
    """Left join of the cached content that was extracted."""
    known = cache.filter(F.col("state") == "extracted").select(F.col("sha256").alias(key), "content")
    return links.join(known, key, "left")


def rejection_profile(links: DataFrame, rejection: str = "rejection") -> DataFrame:
    return links.groupBy(F.coalesce(F.col(rejection), F.lit("accepted")).alias("rejection")).count()
