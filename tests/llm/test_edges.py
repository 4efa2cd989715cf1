"""Clashing names and dirty labels."""

import pytest
from pyspark.sql import functions as F

from heddle.llm import language, mixing


def test_mix_with_columns_of_its_own_names(spark):
    rows = [(i, f"d{i % 2}", f"s{i % 3}", 1 + i % 4) for i in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, domain string, source string, tokens long")
    names = ["_h", "_block", "_whole", "_rest", "_last", "_left", "_run", "_sum", "_leaf_domain", "_leaf_source_e", "epoch", "input_epoch"]
    odd = plain.withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id")) for n in names})
    mixed = lambda d: mixing.mix(d, "doc_id", ("domain", "source"), {"domain": {"d0": 2.0}}, budget_share=0.7, max_epochs=2)
    want = sorted((r["doc_id"], r["epoch"]) for r in mixed(plain).collect())
    got = mixed(odd)
    assert set(got.columns) == {*plain.columns, *names, "epoch"} | {"_input_epoch"} and len(got.columns) == len(set(got.columns))
    held = got.collect()
    assert sorted((r["doc_id"], r["epoch"]) for r in held) == want
    moved = "_input_epoch"
    assert all(r[n] == f"{n} {r['doc_id']}" for r in held for n in names if n != "epoch") and all(r[moved] == f"epoch {r['doc_id']}" for r in held)
    with pytest.raises(ValueError, match="may not be called"):
        mixing.mix(plain.withColumnRenamed("domain", "_h"), "doc_id", ("_h", "source"), {})


def test_too_many_labels_are_an_error(spark):
    rows = spark.range(language.MOST_LANGUAGES + 5).select(F.lit("some text").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError, match="different labels"):
        language.train(rows)
