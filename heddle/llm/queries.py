"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import alignment, chat, decontaminate, filter_audit, jaccard, language, licenses, line_rules, mixing, neighbours, secrets, sharding, sql, warc
from heddle.llm.shared import md5_uint60


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.templates(spark))


def op2_winnowed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_posting_list_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.document_secrets(_table(spark, sf_dir, "documents"))


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)


#: Weights of the tree's levels; names that are not listed weigh 1.
MIX_WEIGHTS = {"domain": {"web": 3.0, "books": 2.0, "code": 1.0}, "lang": {"en": 4.0}, "source": {"src0": 2.0}}
MIX = {"budget_share": 0.6, "max_epochs": 3, "seed": 17}
MIX_LEVELS = ("domain", "lang", "source")


def mix_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with domain (dealt by a hash of the source) and tokens."""
    n = md5_uint60(F.coalesce("source", F.lit(""))) % 3
    domain = F.when(n == 0, "web").when(n == 1, "books").otherwise("code")
    return docs.withColumns({"domain": domain, "tokens": mixing.text_tokens("text")})


def op7_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_rows(_table(spark, sf_dir, "documents")).select("doc_id", *MIX_LEVELS, "tokens")
    return mixing.mix(rows, "doc_id", MIX_LEVELS, MIX_WEIGHTS, **MIX)


def op8_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(*chat.pack(turns.unionByName(extra)))


def op9_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_documents(_table(spark, sf_dir, "documents"))


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_table(spark, sf_dir, "documents"))


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.rules(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_winnowed_decontamination,
        op3_posting_list_neighbours,
        op4_warc_round_trip,
        op5_secret_ledger,
        op6_rendezvous_shards,
        op7_hierarchical_mix,
        op8_prefix_tree_chat,
        op9_ecoc_language,
        op10_jaccard_components,
        op11_filter_audit,
        op12_lockstep_alignment,
        op13_line_rules,
    )
}

_DOMAIN = "CASE ('0x' || md5(coalesce(source, ''))[1:15])::BIGINT % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END"

SQL: dict[str, str] = {
    "op2_winnowed_decontamination": sql.DECONTAMINATION,
    "op4_warc_round_trip": sql.WARC,
    "op5_secret_ledger": sql.SECRETS,
    "op6_rendezvous_shards": sql.shards_sql(40),
    "op7_hierarchical_mix": sql.mix_sql(MIX_LEVELS, MIX_WEIGHTS, _DOMAIN, **MIX),
    "op8_prefix_tree_chat": sql.CHAT,
    "op10_jaccard_components": sql.JACCARD,
    "op11_filter_audit": sql.FILTER_AUDIT,
    "op13_line_rules": sql.LINE_RULES,
}
