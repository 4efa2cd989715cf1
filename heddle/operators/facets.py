"""Drill-down facets from a bitmap index: how many visible entries each value of a facet would leave under
a request's filters on the other facets.

Entries are numbered; for each value of a facet the index holds bitmaps of 32 768 numbers.  A
request's filter on one facet is the union of its values' bitmaps, filters on several are intersected, and a
value's count is what is left of its bitmap.  All of it goes bucket by bucket, so no task sees more
of a value than one bucket, and a request costs what its values hold, not a pass over the entries.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from heddle.functions.text import search_text
from heddle.operators.search import natural_key
from heddle.plans.stored import written

LISTS = ("categories", "formats", "providers")
FACETS = (*LISTS, "year", "has_password")


@dataclass
class Index:
    bits: DataFrame  #: facet, value, bucket, bits
    counts: DataFrame  #: facet, value, count over all entries
    labels: DataFrame  #: facet, value, shown, label, hidden


def _values(categories: Column, formats: Column, providers: Column, year: Column, has_password: Column) -> Column:
    told = lambda f: lambda v: F.struct(F.lit(f).alias("facet"), v.cast("string").alias("value"))
    norm = lambda x: F.array_distinct(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: search_text(v)))
    parts = [F.transform(norm(x), told(f)) for f, x in zip(LISTS, (categories, formats, providers), strict=True)]
    return F.concat(*parts, F.array(told("year")(year)), F.array(told("has_password")(has_password)))


def build_index(rows: DataFrame, definitions: Mapping[str, DataFrame], provider_labels: DataFrame | None = None) -> Index:
    """``rows``: visible entries with categories, formats, providers (arrays), year and has_password;
    ``definitions``: id, label, hidden of categories and formats; ``provider_labels``: value, label.
    Values are compared as searches compare texts; one that no definition knows is its own label."""
    # numbers are dense in each task's rows and cost no shuffle; positions begin at 1
    numbered = rows.withColumn("_n", F.monotonically_increasing_id() + 1)
    each = numbered.select("_n", F.explode(_values(*[F.col(c) for c in FACETS])).alias("x")).select("_n", "x.*").filter(F.coalesce("value", F.lit("")) != "")
    bits = written(each.groupBy("facet", "value", F.bitmap_bucket_number("_n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("bits")), "bitmaps")
    counts = bits.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("count"))
    named = [d.select(F.lit(f).alias("facet"), search_text("id").alias("value"), F.trim("id").alias("shown"), F.trim("label").alias("label"), F.coalesce("hidden", F.lit(False)).alias("hidden")) for f, d in definitions.items()]
    if provider_labels is not None:
        named.append(provider_labels.select(F.lit("providers").alias("facet"), search_text("value").alias("value"), search_text("value").alias("shown"), "label", F.lit(False).alias("hidden")))
    labels = named[0]
    for more in named[1:]:
        labels = labels.unionByName(more)
    return Index(bits, counts, labels)


def wanted(requests: DataFrame) -> DataFrame:
    """(request_id, facet, value) of a table of requests: categories, formats, providers, years (arrays)
    and has_password; null and empty filters, and blank values, let everything through."""
    own = [F.col(c) for c in LISTS]
    years = F.transform(F.coalesce("years", F.array().cast("array<int>")), lambda y: F.struct(F.lit("year").alias("facet"), y.cast("string").alias("value")))
    each = F.concat(_values(*own, F.lit(None).cast("int"), F.col("has_password")), years)
    return requests.select("request_id", F.explode(each).alias("x")).select("request_id", "x.*").filter(F.coalesce("value", F.lit("")) != "").distinct()


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many bits two bitmaps have in common."""
    return pd.Series([int(np.bitwise_count(np.frombuffer(x, np.uint64) & np.frombuffer(y, np.uint64)).sum()) for x, y in zip(a, b, strict=True)], dtype="int64")


def drill_down(requests: DataFrame, index: Index) -> DataFrame:
    """(request_id, facet, value, label, count, position) for every request (its id is unique): values that
    keep an entry, as their definitions write them; hidden ones are out; with and without
    password are always there.  Lists are ordered by label, years by themselves, newest first.

    Equal filters are united once and equal sets of filters intersected once, whichever requests and
    facets ask for them; bitmaps travel by those, and only counts by requests."""
    ids = requests.select("request_id").distinct()
    # a request's filters, and for each facet those on all others
    filters = wanted(requests).groupBy("request_id", "facet").agg(F.array_sort(F.collect_set("value")).alias("values"))
    active = filters.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("facet", "values"))).alias("_active"))  # five at most
    every = ids.join(active, "request_id", "left").select("request_id", F.explode(F.array(*[F.lit(f) for f in FACETS])).alias("facet"), F.coalesce("_active", F.array().cast("array<struct<facet:string,values:array<string>>>")).alias("_active"))
    held = F.filter("_active", lambda x: x["facet"] != F.col("facet"))
    each = written(every.select("request_id", "facet", held.alias("held")).withColumn("base", F.sha2(F.to_json("held"), 256)), "held")
    named = written(each.groupBy("base").agg(F.first("held").alias("held")).select("base", F.size("held").alias("need"), F.explode("held").alias("x")).select("base", "need", "x.*").withColumn("filter", F.sha2(F.to_json(F.struct("facet", "values")), 256)), "sets")
    asked = named.groupBy("filter").agg(F.first("facet").alias("facet"), F.first("values").alias("values")).select("filter", "facet", F.explode("values").alias("value"))
    # what each filter lets through, and each set of them; sets of a bucket meet in the tasks that hold it
    own = written(asked.join(index.bits, ["facet", "value"]).groupBy("filter", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")), "filters")
    base = named.select("base", "need", "filter").join(own.repartition("bucket"), "filter").groupBy("base", "need", "bucket").agg(F.bitmap_and_agg("bits").alias("_base"), F.count("*").alias("_met")).filter("_met = need")
    asks = written(each.select("base", "facet", F.size("held").alias("need")).distinct(), "asks")
    pairs = base.drop("need").join(asks.filter("need > 0").drop("need"), "base").join(index.bits, ["facet", "bucket"])
    left = pairs.select("base", "facet", "value", _common("_base", "bits").alias("count")).groupBy("base", "facet", "value").agg(F.sum("count").alias("count"))
    # facets that no other filter holds back have the counts over all entries
    free = asks.filter("need = 0").join(index.counts, "facet")
    both = asks.filter("facet = 'has_password'").select("base", "facet", F.explode(F.array(F.lit("true"), F.lit("false"))).alias("value"), F.lit(0).cast("long").alias("count"))
    counted = left.unionByName(free.select(*left.columns)).unionByName(both).groupBy("base", "facet", "value").agg(F.sum("count").alias("count"))
    counted = counted.filter((F.col("count") > 0) | (F.col("facet") == "has_password"))
    shown = counted.join(index.labels, ["facet", "value"], "left").filter(~F.coalesce("hidden", F.lit(False)))
    label = F.coalesce("label", "value")
    year = F.when(F.col("facet") == "year", F.col("value").try_cast("int"))
    order = W.partitionBy("base", "facet").orderBy(year.desc(), natural_key(label), "value")
    answers = written(shown.select("base", "facet", F.coalesce("shown", "value").alias("value"), label.alias("label"), "count", F.row_number().over(order).alias("position")), "answers")
    return each.select("request_id", "facet", "base").join(answers, ["base", "facet"]).select("request_id", "facet", "value", "label", "count", "position")
