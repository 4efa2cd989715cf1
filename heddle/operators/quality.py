"""Declarative constraints: each rule gives rows (table, key, rule, value) that break it."""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import contents
from heddle.functions.links import host_suffixes, is_local

VIOLATION = "table string, key string, rule string, value string"

HASH = r"^[0-9a-f]{64}$"
HOST_SUFFIX = r"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9-]{2,}$"
PATH = r"^[A-Za-z_][A-Za-z0-9_-]*(?:\.[A-Za-z_][A-Za-z0-9_-]*)*$"


def _row(table: str, key: Column, rule: str, value: Column) -> list[Column]:
    return [F.lit(table).alias("table"), key.cast("string").alias("key"), F.lit(rule).alias("rule"), value.cast("string").alias("value")]


def check(df: DataFrame, table: str, key: str, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Violations of row rules: name -> (what must hold, the value to report).  Null counts as
    broken.  All rules share one pass."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("rule"), v.cast("string").alias("value"))) for n, (ok, v) in rules.items()]))
    each = df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("f"))
    return each.select(F.lit(table).alias("table"), "key", "f.rule", "f.value")


def unique(df: DataFrame, table: str, key: Sequence[str], rule: str = "duplicate_key") -> DataFrame:
    again = df.groupBy(*key).count().filter("count > 1")
    return again.select(*_row(table, F.concat_ws("|", *[F.col(k).cast("string") for k in key]), rule, F.col("count")))


def references(child: DataFrame, parent: DataFrame, table: str, key: str, column: str, target: str, rule: str = "orphan") -> DataFrame:
    lost = child.join(parent.select(F.col(target).alias(column)).distinct(), column, "left_anti")
    return lost.select(*_row(table, F.col(key), rule, F.col(column)))


def shadowed(rules: DataFrame, table: str, order: str = "rule_ord", suffix: str = "host_suffix") -> DataFrame:
    """Suffix rules that never fire, as an earlier rule has the suffix or a parent of it."""
    own = rules.select(F.col(order).alias("o"), F.col(suffix).alias("s"), F.explode(host_suffixes(suffix)).alias("p"))
    earlier = rules.select(F.col(order).alias("o2"), F.col(suffix).alias("p"))
    return own.join(earlier, "p").filter("o2 < o").select("o", "s").distinct().select(*_row(table, F.col("o"), "shadowed_rule", F.col("s")))


def reconcile(declared: DataFrame, actual: DataFrame, table: str) -> DataFrame:
    """Counters of one-row tables that differ, by name."""
    names = [c for c in declared.columns if c in actual.columns]
    both = declared.select(*[F.col(c).alias(f"d_{c}") for c in names]).join(F.broadcast(actual.select(*names)), F.lit(True))
    found = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"d_{c}")), F.struct(F.lit(c).alias("key"), F.concat_ws("<>", F.col(f"d_{c}").cast("string"), F.col(c).cast("string")).alias("value"))) for c in names]))
    return both.select(F.explode(found).alias("f")).select(F.lit(table).alias("table"), "f.key", F.lit("count_mismatch").alias("rule"), "f.value")


def collisions(df: DataFrame, table: str, identifier: str, key: str) -> DataFrame:
    """Identifiers that stand for more than one key."""
    n = df.groupBy(identifier).agg(F.count_distinct(key).alias("n")).filter("n > 1")
    return n.select(*_row(table, F.col(identifier), "id_collision", F.col("n")))


def closed_keys(df: DataFrame, table: str, key: str, document: str, allowed: Sequence[str]) -> DataFrame:
    """Keys of a JSON object that are not allowed."""
    extra = F.array_except(F.json_object_keys(document), F.array(*[F.lit(a) for a in allowed]))
    return df.select(key, F.explode(extra).alias("extra")).select(*_row(table, F.col(key), "unknown_key", F.col("extra")))


def all_of(*found: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, found)


def tombstone_rules(df: DataFrame) -> DataFrame:
    rules = {
        "hash": (F.col("sha256").rlike(HASH), F.col("sha256")),
        "reason": (F.col("reason").isin("expired", "content_mismatch", "manual"), F.col("reason")),
        "confirmed_at": (F.try_to_timestamp(F.col("confirmed_at").cast("string")).isNotNull(), F.col("confirmed_at")),
    }
    return all_of(check(df, "tombstones", "sha256", rules), unique(df, "tombstones", ["sha256"]))


def suppression_rules(df: DataFrame) -> DataFrame:
    rules = {
        "entry": (F.trim("source_entry_id") != "", F.col("source_entry_id")),
        "hash": (F.col("sha256").rlike(HASH), F.col("sha256")),
        "reason": (F.col("reason").isin("content_mismatch", "manual"), F.col("reason")),
        "confirmed_at": (F.try_to_timestamp(F.col("confirmed_at").cast("string")).isNotNull(), F.col("confirmed_at")),
    }
    return all_of(check(df, "suppressions", "sha256", rules), unique(df, "suppressions", ["source_entry_id", "sha256"]))


def _trimmed(c: Column) -> Column:
    return (c != "") & (c == F.trim(c))


def suffix_rules(s: Column) -> dict[str, tuple[Column, Column]]:
    """What a host suffix must be: trimmed, in lower case, labels of 63 characters at most and 253
    in all."""
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return {"lower_case": (s == F.lower(F.trim(s)), s), "host_suffix": (s.rlike(rf"^{label}(?:\.{label})*$") & (F.length(s) <= 253), s)}


def policy_rules(df: DataFrame) -> DataFrame:
    """``df``: rule_ord, host_suffix."""
    return all_of(check(df, "audit_rules", "rule_ord", suffix_rules(F.col("host_suffix"))), unique(df, "audit_rules", ["host_suffix"]), shadowed(df, "audit_rules"))


def _compiles(patterns: pd.Series) -> pd.Series:
    def one(p):
        try:
            re.compile(p)
        except (re.error, TypeError):
            return False
        return True

    return patterns.map(one)


#: Rules of an enrichment policy.
MOST_RULES = 64


def audit_policy_rules(policy: DataFrame, rules: DataFrame) -> DataFrame:
    """``policy``: timeout_seconds, max_body_bytes, concurrency, confirmations_required (one row);
    ``rules``: rule_ord, host_suffixes, dead_statuses, dead_body, mismatch_body,
    required_body, allowed_redirects (arrays)."""
    c, limits = F.col, {"timeout_seconds": (0, 120, False), "max_body_bytes": (1, 1 << 20, True), "concurrency": (1, 64, True), "confirmations_required": (1, 10, True)}
    own = {n: ((c(n) >= lo if closed else c(n) > lo) & (c(n) <= hi), c(n)) for n, (lo, hi, closed) in limits.items()}
    lists = ("host_suffixes", "dead_statuses", "dead_body", "mismatch_body", "required_body", "allowed_redirects")
    whole = {f"{n}_missing": (c(n).isNotNull(), F.lit(n)) for n in lists} | {"no_host_suffix": (F.size("host_suffixes") > 0, c("rule_ord"))}
    each = lambda kind, *names: rules.select("rule_ord", F.explode(F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in names])).alias("v")).withColumn("kind", F.lit(kind))
    hosts, redirects, patterns = each("host_suffixes", "host_suffixes"), each("allowed_redirects", "allowed_redirects"), each("patterns", "dead_body", "mismatch_body", "required_body")
    statuses = rules.select("rule_ord", F.explode("dead_statuses").alias("v"))
    pattern = {"pattern_trimmed": (_trimmed(c("v")), c("v")), "pattern_compiles": (F.pandas_udf(_compiles, "boolean")(c("v")), c("v"))}
    name = "audit_policy"
    return all_of(
        check(policy.withColumn("key", F.lit("policy")), name, "key", own), check(rules, name, "rule_ord", whole), check(hosts.unionByName(redirects), name, "rule_ord", suffix_rules(c("v"))), check(patterns, name, "rule_ord", pattern),
        check(statuses, name, "rule_ord", {"dead_status": (c("v").between(400, 599), c("v"))}), *[unique(x, name, ["rule_ord", "v"], f"duplicate_{n}") for n, x in (("host_suffix", hosts), ("redirect", redirects), ("pattern", patterns), ("status", statuses))],
    )


ROOT_FIELDS, ITEM_FIELDS = ("name", "kind", "size_bytes", "file_count", "folder_count", "items"), ("item_name", "item_kind", "item_size_bytes")


def enrichment_policy_rules(policy: DataFrame, rules: DataFrame, *, most_rules: int = MOST_RULES, most_markers: int = 32, most_bytes: int = 8 << 20, most_items: int = 1000) -> DataFrame:
    """``policy``: max_body_bytes, max_items, stale_after_seconds (one row); ``rules``: rule_ord,
    host_suffixes, markers (arrays), fields (map from field to path)."""
    c, name = F.col, "enrichment_policy"
    own = {"max_body_bytes": (c("max_body_bytes").between(1, most_bytes), c("max_body_bytes")), "max_items": (c("max_items").between(1, most_items), c("max_items")), "stale_after": (c("stale_after_seconds") > 0, c("stale_after_seconds"))}
    told = lambda names: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(c("fields")[n], F.lit("")) != "")
    has_items = F.coalesce(c("fields")["items"], F.lit("")) != ""
    whole = {
        "no_host_suffix": (F.size("host_suffixes") > 0, c("rule_ord")), "markers": (F.size("markers").between(1, most_markers), F.size("markers")), "no_root_path": (told(ROOT_FIELDS), F.to_json("fields")),
        "item_fields_need_items": (has_items == told(ITEM_FIELDS), F.to_json("fields")), "unknown_field": (F.size(F.array_except(F.map_keys("fields"), F.array(*[F.lit(x) for x in ROOT_FIELDS + ITEM_FIELDS]))) == 0, F.to_json("fields")),
    }
    hosts = rules.select("rule_ord", F.explode("host_suffixes").alias("v"))
    markers = rules.select("rule_ord", F.explode("markers").alias("v"))
    paths = rules.select("rule_ord", F.explode("fields").alias("f", "v")).filter("v <> ''")
    path = {"path": (c("v").rlike(r"^[A-Za-z0-9_-]{1,128}(?:\.[A-Za-z0-9_-]{1,128})*$"), c("v"))}
    count = rules.agg(F.count("*").alias("n")).withColumn("key", F.lit("rules"))
    return all_of(
        check(policy.withColumn("key", F.lit("policy")), name, "key", own), check(count, name, "key", {"rules": (c("n").between(1, most_rules), c("n"))}), check(rules, name, "rule_ord", whole),
        check(hosts, name, "rule_ord", suffix_rules(c("v")) | {"local_host": (~is_local(c("v")), c("v"))}), check(markers, name, "rule_ord", {"marker": (_trimmed(c("v")) & (F.length("v") <= 256), c("v"))}), check(paths, name, "rule_ord", path),
        unique(hosts, name, ["v"], "duplicate_host_suffix"), unique(markers, name, ["rule_ord", "v"], "duplicate_marker"),
    )


TITLE_WORD = r"^(?:[\p{L}\p{N}_@:/]|(?<=[A-Za-z])'(?=[A-Za-z]))+$"
TITLE_KINDS = ("protected_ci", "protected_exact", "protected_substring", "force_token", "force_phrase")


def title_rule_rules(df: DataFrame) -> DataFrame:
    """``df``: kind (of ``TITLE_KINDS``), value.  Values are trimmed, each once (whatever their case,
    but for exact tokens); forced tokens and the words of forced phrases are title words that
    no protection holds back."""
    c, name = F.col, "title_rules"
    kind, value = c("kind"), c("value")
    words = F.split(value, r"\s+")
    forced = df.filter(kind.isin("force_token", "force_phrase")).select("value", F.explode(F.when(kind == "force_token", F.array(value)).otherwise(words)).alias("word"))
    rules = {"kind": (kind.isin(*TITLE_KINDS), kind), "trimmed": (_trimmed(value), value), "phrase_of_one_word": ((kind != "force_phrase") | (F.size(words) > 1), value)}
    word = {"title_word": (c("word").rlike(TITLE_WORD), c("word")), "protected_word": (~c("word").rlike("[0-9_@/:]"), c("word"))}
    low = lambda k: df.filter(kind == k).select(F.lower("value").alias("low")).distinct()
    whole = low("protected_ci").unionByName(low("protected_exact")).distinct()
    held = forced.join(whole, F.lower("word") == c("low"), "left_semi").select("value", "word")
    inside = forced.join(low("protected_substring"), F.lower("word").contains(c("low")), "left_semi").select("value", "word")
    shadowed_ = held.unionByName(inside).distinct().select(*_row(name, c("value"), "shadowed_by_protection", c("word")))
    both = low("protected_ci").intersect(low("protected_exact")).select(*_row(name, c("low"), "exact_and_ci", c("low")))
    once = df.select("kind", F.when(kind == "protected_exact", value).when(kind == "force_phrase", F.lower(F.array_join(words, " "))).otherwise(F.lower(value)).alias("said"))
    return all_of(check(df, name, "value", rules), check(forced, name, "value", word), unique(once, name, ["kind", "said"], "duplicate_value"), shadowed_, both)


def report_rules(df: DataFrame) -> DataFrame:
    """An audit report: hashes, states, statuses, times, confirmations."""
    c = F.col
    rules = {
        "hash": (c("sha256").rlike(HASH), c("sha256")), "state": (c("state").isin("live", "expired", "content_mismatch", "blocked", "transient", "unknown"), c("state")), "http_status": (F.coalesce(c("http_status").between(100, 599), F.lit(True)), c("http_status")),
        "checked_at": (c("checked_at").isNotNull(), c("checked_at")), "confirmations": (c("confirmations") >= 0, c("confirmations")),
    }
    return all_of(check(df, "report", "sha256", rules), unique(df, "report", ["sha256"]))


def content_rules(df: DataFrame, max_items: int = 1000) -> DataFrame:
    """Cached contents: a state and what goes with it, and the rules that extracted contents keep to as
    well (``contents.content_rules``)."""
    c = F.col("content")
    rules = {
        "hash": (F.col("sha256").rlike(HASH), F.col("sha256")),
        "state": (F.col("state").isin("extracted", "not_found"), F.col("state")),
        "content_by_state": ((F.col("state") == "extracted") == c.isNotNull(), F.col("state")),
        **{name: (c.isNull() | ok, F.to_json(c)) for name, ok in contents.content_rules(c, max_items).items()},
    }
    return all_of(check(df, "cache", "sha256", rules), unique(df, "cache", ["sha256"]))


def definition_rules(df: DataFrame, table: str) -> DataFrame:
    """``df``: id, label, hidden."""
    rules = {"id": (F.trim("id") != "", F.col("id")), "label": (F.trim("label") != "", F.col("label")), "hidden": (F.col("hidden").isNotNull(), F.col("id"))}
    return all_of(check(df, table, "id", rules), unique(df.select(F.lower(F.trim("id")).alias("id")), table, ["id"]))


def catalog_rules(entries: DataFrame, taxonomy: DataFrame, formats: DataFrame | None = None, *, max_items: int = 1000, material_types: Sequence[str] = tuple(contents.MATERIALS)) -> DataFrame:
    """Catalog entries before activation: every field that a reader relies on."""
    c = F.col
    time = lambda x: F.try_to_timestamp(x.cast("string")).isNotNull()
    filled = lambda x: F.coalesce(F.forall(x, lambda v: F.trim(v) != ""), F.lit(False))
    some = lambda n: (filled(c(n)) & (F.size(n) > 0), F.to_json(n))
    every = lambda arr, ok: F.coalesce(F.forall(arr, lambda x: F.coalesce(ok(x), F.lit(False))), F.lit(False))
    said = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    maybe = lambda x: x.isNull() | ((x != "") & (x == F.trim(x)))
    count = lambda x: x.isNull() | x.between(0, (1 << 53) - 1)
    in_links = lambda ok: (every(c("links"), ok), F.to_json("links"))
    in_content = lambda ok: in_links(lambda x: x["content"].isNull() | F.coalesce(ok(x["content"]), F.lit(False)))
    in_sources = lambda ok: (every(c("sources"), ok), F.to_json("sources"))
    rules = {
        "id": (said(c("id")), c("id")), "title": (said(c("title")), c("title")), "first_added_at": (time(c("first_added_at")), c("first_added_at")), "last_added_at": (time(c("last_added_at")), c("last_added_at")),
        "year_range": (c("year_range").isNull() | (c("year_range.from").isNotNull() & c("year_range.to").isNotNull()), F.to_json("year_range")),
        **{n: some(n) for n in ("origins", "availability", "categories", "formats", "format_sources")}, **{n: (filled(c(n)), F.to_json(n)) for n in ("passwords", "notes")},
        "primary_category": (F.array_contains("categories", c("primary_category")), c("primary_category")), "primary_format": (F.array_contains("formats", c("primary_format")), c("primary_format")),
        "link_url": in_links(lambda x: said(x["url"])), "link_provider": in_links(lambda x: said(x["provider"])), "link_kind": in_links(lambda x: said(x["kind"])), "link_role": in_links(lambda x: said(x["role"])), "link_primary": in_links(lambda x: x["primary"].isNotNull()),
        "content_text": in_content(lambda x: maybe(x["name"]) & maybe(x["kind"])), "content_counts": in_content(lambda x: count(x["size_bytes"]) & count(x["file_count"]) & count(x["folder_count"])),
        "content_items": in_content(lambda x: x["items"].isNull() | ((F.size(x["items"]) <= max_items) & F.forall(x["items"], lambda i: maybe(i["name"]) & maybe(i["kind"]) & count(i["size_bytes"])))),
        "material_types": in_content(lambda x: x["material_types"].isNull() | ((x["material_types"] == F.array_sort(F.array_distinct(x["material_types"]))) & (F.size(F.array_except(x["material_types"], F.array(*[F.lit(m) for m in material_types]))) == 0))),
        "sources": (F.size("sources") > 0, F.to_json("sources")), "source_entry": in_sources(lambda x: said(x["entry_id"])), "source_message": in_sources(lambda x: said(x["message_id"]) & x["telegram_message_id"].isNotNull() & said(x["message_url"])),
        "source_message_ids": in_sources(lambda x: (F.size(x["source_message_ids"]) > 0) & filled(x["source_message_ids"])), "source_added_at": in_sources(lambda x: time(x["added_at"])), "source_origin": in_sources(lambda x: said(x["origin"]) & said(x["availability"])),
    }
    named = entries.select("id", F.explode("categories").alias("category"))
    found = [check(entries, "catalog", "id", rules), unique(entries, "catalog", ["id"]), references(named, taxonomy, "catalog", "id", "category", "id", "unknown_category"), definition_rules(taxonomy, "categories")]
    if formats is not None:
        found.append(definition_rules(formats, "formats"))
    empty = entries.limit(1).agg(F.count("*").alias("n")).withColumn("key", F.lit("entries"))
    return all_of(*found, check(empty, "catalog", "key", {"no_entries": (F.col("n") > 0, F.col("n"))}))


def identifiers(df: DataFrame, table: str, key: str) -> DataFrame:
    """Blank and duplicate keys."""
    rules = {"blank_key": (F.trim(F.col(key).cast("string")) != "", F.col(key))}
    return all_of(check(df, table, key, rules), unique(df, table, [key]))


class Broken(ValueError):
    """Data that breaks a rule; the message shows the first violations."""


def require(found: DataFrame, what: str, show: int = 5) -> None:
    """Stop if there are violations.  A few rows reach the driver."""
    rows = found.limit(show).collect()
    if rows:
        raise Broken(f"{what}: " + "; ".join(f"{r['table']}[{r['key']}] {r['rule']} {r['value']}" for r in rows))
