"""A corpus pipeline: language ID, near duplicates, decontamination, mixing, shards.

Each stage takes what the one before kept, as Parquet, and returns the columns of
``documents``; the last one adds where each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import decontaminate, jaccard, language, mixing, sharding
from heddle.llm.queries import MIX_LEVELS, MIX_WEIGHTS, mix_rows
from heddle.llm.shared import written

BUDGET_SHARE, SHARDS = 0.9, 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language, with the predicted one as ``lang``; those without a
    text or a letter go, and those whose language is ambiguous and has less than half of the
    score (``language.LEAST_SCORE``)."""
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, the one of smallest doc_id."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, each once at most."""
    # the whole row goes along as one value, whatever its columns are called
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = mix_rows(docs.select("doc_id", "text", "lang", "source", whole)).drop("text")
    return mixing.mix(rows, "doc_id", MIX_LEVELS, MIX_WEIGHTS, budget_share=BUDGET_SHARE, max_epochs=1, seed=17).select("_row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, size (bytes of the text plus 16), shard, and the shard with one more;
    columns of the documents that are called like these become ``input_<name>``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    return sharding.place(sharding.aside(docs, ["size"]).withColumn("size", size), "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID is a trained model and the components are iterative; see tests/llm.
ORACLE_SQL = None
