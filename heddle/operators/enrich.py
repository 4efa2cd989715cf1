"""Link enrichment: metadata from JSON objects embedded in page bodies, and its cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.contents import CONTENT, bound, content_at, content_rules, material_types
from heddle.plans.stored import written

__all__ = ["CONTENT", "extract", "first_content", "fresh_split", "material_types", "run_counts", "upsert_cache"]

#: Of names that an object repeats the last counts, as with JSON readers elsewhere.
_REPEATED = "spark.sql.variant.allowDuplicateKeys"
_BLANKS = " \t\r\n"


def first_content(body: Column, markers: Column, fields: Column, max_items: int) -> Column:
    """struct(content, found, failed): the content of the first object that begins right after a
    marker and decodes; markers one after the other, and each one's places in order.  ``failed`` if
    objects were there but none decodes.

    A body is cut at the marker; what follows a cut is parsed only if it begins with a brace, and only
    until one decodes.  Parsing stops at the end of the object."""
    none = F.struct(F.lit(None).cast(CONTENT).alias("content"), F.lit(False).alias("found"), F.lit(False).alias("failed"))

    def decoded(text: Column, failed: Column) -> Column:
        got = lambda v: F.when(v.isNull(), F.struct(F.lit(None).cast(CONTENT).alias("content"), F.lit(True).alias("bad"))).otherwise(content_at(v, fields, max_items))
        put = lambda x: F.struct(x["content"].cast(CONTENT).alias("content"), (~x["bad"]).alias("found"), (failed | x["bad"]).alias("failed"))
        return bound(bound(F.try_parse_json(text), got), put)

    def of_marker(state: Column, marker: Column) -> Column:
        literal = F.concat(F.lit(r"\Q"), F.replace(marker, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

        def places(parts: Column) -> Column:
            n = F.size(parts)
            begins = lambda i: F.ltrim(F.when(i < n, F.concat(F.get(parts, i - 1), marker)).otherwise(F.get(parts, i - 1)), F.lit(_BLANKS)).startswith("{")
            return F.filter(F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>")), begins)

        def one(parts: Column) -> Column:
            rest = lambda i: F.ltrim(F.call_function("array_join", F.slice(parts, i, F.size(parts)), marker), F.lit(_BLANKS))
            return F.aggregate(places(parts), state, lambda s, i: F.when(s["found"], s).otherwise(decoded(rest(i), s["failed"])))

        return F.when(state["found"], state).otherwise(bound(F.split(body, literal, -1), one))

    return F.aggregate(markers, none, of_marker)


def extract(bodies: DataFrame, rules: DataFrame, max_items: int, max_body_bytes: int) -> DataFrame:
    """``bodies`` (sha256, rule_ord, body) as (sha256, state, content); ``rules`` have rule_ord, markers
    (array) and fields (map from field to dotted path) and are a policy's, 64 at most.

    ``not_found`` without a rule, a body or an object behind a marker; ``failed`` for bodies beyond the
    limit, if no object decodes, or if the one that does breaks a rule for contents, whatever
    comes after it.  Written, as repeated names are let through while it is."""
    spark = bodies.sparkSession
    before = spark.conf.get(_REPEATED, None)
    spark.conf.set(_REPEATED, "true")
    try:
        return written(_outcomes(bodies, rules, max_items, max_body_bytes), "outcomes")
    finally:
        if before is None:
            spark.conf.unset(_REPEATED)
        else:
            spark.conf.set(_REPEATED, before)


def _outcomes(bodies: DataFrame, rules: DataFrame, max_items: int, max_body_bytes: int) -> DataFrame:
    limited = rules.select(F.col("rule_ord").alias("_rule"), "markers", "fields")
    rows = bodies.select("sha256", "rule_ord", "body").join(F.broadcast(limited), F.col("rule_ord") == F.col("_rule"), "left")
    asked = F.col("body").isNotNull() & F.col("_rule").isNotNull()
    large = F.octet_length("body") > max_body_bytes
    found = rows.select("sha256", asked.alias("asked"), large.alias("large"), F.when(asked & ~large, first_content(F.col("body"), F.col("markers"), F.col("fields"), max_items)).alias("x"))
    fits = F.lit(True)
    for ok in content_rules(F.col("x.content")).values():
        fits = fits & ok
    state = (
        F.when(~F.col("asked"), "not_found").when(F.col("large"), "failed").when(F.col("x.found") & fits, "extracted")
        .when(F.col("x.found") | F.col("x.failed"), "failed").otherwise("not_found")
    )
    return found.select("sha256", state.alias("state"), F.col("x.content").alias("content")).select("sha256", "state", F.when(F.col("state") == "extracted", F.col("content")).alias("content"))


def fresh_split(candidates: DataFrame, cache: DataFrame, now: Column, stale_after: Column, refresh: bool = False) -> DataFrame:
    """``candidates`` with ``fresh``: its cache row was checked less than ``stale_after`` ago."""
    known = cache.select(F.col("sha256").alias("_k"), F.col("checked_at").alias("_at")).groupBy("_k").agg(F.max("_at").alias("_at"))
    out = candidates.join(known, candidates["sha256"] == F.col("_k"), "left")
    fresh = F.lit(False) if refresh else F.coalesce(now < F.col("_at") + stale_after, F.lit(False))
    return out.select(*[candidates[c] for c in candidates.columns], fresh.alias("fresh"))


def upsert_cache(cache: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes that say something (extracted, not_found) replace cache rows; failures leave
    the old row; other rows stay."""
    told = outcomes.filter(F.col("state").isin("extracted", "not_found"))
    return cache.join(told.select("sha256"), "sha256", "left_anti").unionByName(told.select(*cache.columns))


def run_counts(split: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: candidates, fresh, fetched, extracted, not_found, failed."""
    a = split.agg(F.count("*").alias("candidates"), F.count_if("fresh").alias("fresh"))
    b = outcomes.agg(F.count("*").alias("fetched"), *[F.count_if(F.col("state") == s).alias(s) for s in ("extracted", "not_found", "failed")])
    return a.join(F.broadcast(b), F.lit(True))
