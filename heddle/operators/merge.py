"""Upsert of versions: later values that say something win, arrays unite, blanks never
overwrite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.links import with_link
from heddle.plans.stored import written


def says_something(c: Column, kind: str) -> Column:
    """Not null, and not blank if it is text."""
    return c.isNotNull() & ~c.rlike(r"(?U)^\s*$") if kind == "string" else c.isNotNull()


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def latest(df: DataFrame, name: str, order: Column) -> Column:
    """The last value of a column that says something."""
    return F.max_by(F.when(says_something(F.col(name), _kind(df, name)), F.col(name)), F.when(says_something(F.col(name), _kind(df, name)), order)).alias(name)


def distinct_in_order(rows: DataFrame, keys: Sequence[str], arrays: Sequence[str], order: Column) -> DataFrame:
    """For each key the values of the array columns in order of first sight, each once.

    Values combine before they are collected, so a key with very many rows costs a row for
    each distinct value and task."""
    types = {a: rows.schema[a].dataType.elementType for a in arrays}

    def values(a: str) -> Column:
        own = lambda v, b: v if b == a else F.lit(None).cast(types[b])
        return F.transform(F.coalesce(F.col(a), F.array().cast(rows.schema[a].dataType)), lambda v, i: F.struct(F.lit(a).alias("which"), F.struct(order.alias("o"), i.alias("i")).alias("at"), F.struct(*[own(v, b).alias(b) for b in arrays]).alias("v")))

    each = rows.select(*keys, F.explode(F.concat(*[values(a) for a in arrays])).alias("x")).select(*keys, "x.*")
    first = each.groupBy(*keys, "which", "v").agg(F.min("at").alias("at"))
    listed = lambda a: F.transform(F.array_sort(F.collect_list(F.when(F.col("which") == a, F.struct("at", F.col(f"v.{a}").alias("v"))))), lambda x: x["v"]).alias(a)
    return first.groupBy(*keys).agg(*[listed(a) for a in arrays])


def with_arrays(folded: DataFrame, listed: DataFrame, keys: Sequence[str], arrays: Sequence[str], types: dict) -> DataFrame:
    """``folded`` with the array columns of ``listed``; keys without values get empty arrays."""
    named = listed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(a).alias(f"_a{i}") for i, a in enumerate(arrays)])
    same = [folded[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)]
    filled = [F.coalesce(F.col(f"_a{i}"), F.array().cast(types[a])).alias(a) for i, a in enumerate(arrays)]
    return folded.join(named, same, "left").select(*folded.columns, *filled)


def upsert(versions: DataFrame, key: str | Sequence[str], order: Sequence[str], *, arrays: Sequence[str] = (), scalars: Sequence[str] | None = None) -> DataFrame:
    """One row a key, folded over ``order`` (say snapshot and position); ``first_seen`` is the
    smallest order, which keeps the input's sequence.  Idempotent: a version seen twice
    changes nothing.

    Everything combines before its shuffle, so no task holds all versions of a key."""
    keys = [key] if isinstance(key, str) else list(key)
    at = F.struct(*[F.col(c) for c in order])
    if scalars is None:
        scalars = [c for c in versions.columns if c not in {*keys, *order, *arrays}]
    out = versions.groupBy(*keys).agg(*[latest(versions, c, at) for c in scalars], F.min(at).alias("first_seen"))
    if arrays:
        types = {a: versions.schema[a].dataType for a in arrays}
        out = with_arrays(out, distinct_in_order(versions, keys, arrays, at), keys, arrays, types)
    return out


def merge_source_links(versions: DataFrame, owner: str, order: Sequence[str], links: str = "links") -> DataFrame:
    """(owner, links): the links of all versions of an entry, one for each canonical form (or
    trimmed address, if it has none): the first one's fields, primary if any is, the first
    label and origin that say something, all sources."""
    each = versions.select(owner, *order, F.posexplode(links).alias("_lpos", "_x"))
    # an address is parsed once, however many versions and owners have it
    urls = with_link(each.select(F.col("_x.url").alias("_url")).distinct(), "_url", "_link")
    known = written(urls.select("_url", F.coalesce("_link.canonical", F.trim("_url")).alias("_key")), "addresses")
    each = each.join(known, F.col("_x.url") == F.col("_url"), "left").drop("_url")
    at = F.struct(*[F.col(c) for c in order], F.col("_lpos"))
    told = F.nullif(F.trim("_x.normalized_from"), F.lit(""))
    heads = each.groupBy(owner, "_key").agg(
        F.min_by("_x", at).alias("_x"), F.max(F.coalesce("_x.primary", F.lit(False))).alias("primary"), F.min_by("_x.label", F.when(F.col("_x.label").isNotNull(), at)).alias("label"),
        F.min_by("_x.normalized_from", F.when(told.isNotNull(), at)).alias("normalized_from"), F.min(at).alias("at"),
    )
    sources = distinct_in_order(each.select(owner, "_key", F.col("_x.sources").alias("sources"), at.alias("at")), [owner, "_key"], ["sources"], F.col("at"))
    whole = with_arrays(heads, sources, [owner, "_key"], ["sources"], {"sources": "array<string>"})
    fields = versions.schema[links].dataType.elementType.names
    merged = {"primary", "label", "normalized_from", "sources"}
    link = F.struct(*[(F.col(f) if f in merged else F.col(f"_x.{f}")).alias(f) for f in fields])
    listed = whole.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("at", "_key", link.alias("link")))).alias("l"))
    return listed.select(owner, F.transform("l", lambda x: x["link"]).alias(links))


def merge_links(links: DataFrame, owner: Sequence[str], key: Column, order: Sequence[str]) -> DataFrame:
    """Fold links (url, host, provider, kind, role, primary, label, content) of one owner and
    key: identity from the first, primary if any is, the first label, the richest content."""
    at = F.struct(*[F.col(c) for c in order])
    first = F.min_by(F.struct("url", "host", "provider", "kind", "role"), at).alias("first")
    label = F.min_by("label", F.when(F.col("label").isNotNull(), at)).alias("label")
    content = [F.min_by("content", F.when(F.col("content").isNotNull(), F.struct((-information("content")).alias("s"), written_out("content").alias("j")))).alias("content")] if "content" in links.columns else []
    out = links.withColumn("link_key", key).groupBy(*owner, "link_key").agg(first, F.max(F.coalesce("primary", F.lit(False))).alias("primary"), label, *content, F.min(at).alias("first_seen"))
    return out.select(*owner, "link_key", "first.*", "primary", "label", *(["content"] if content else []), "first_seen")


def _told(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(False)), 1).otherwise(0)


def information(content: str) -> Column:
    """How much a cached content says: its filled fields and types, and for each item one more than
    its filled fields."""
    c = F.col(content)
    text, count = (lambda x: _told(x != "")), (lambda x: _told(x != 0))
    items = F.transform(F.coalesce(c["items"], F.array()), lambda i: 1 + text(i["name"]) + text(i["kind"]) + count(i["size_bytes"]))
    return (
        text(c["name"]) + text(c["kind"]) + count(c["size_bytes"]) + count(c["file_count"]) + count(c["folder_count"])
        + F.aggregate(items, F.lit(0), lambda n, i: n + i) + F.greatest(F.lit(0), F.size(F.coalesce(c["material_types"], F.array())))
    )


def written_out(content: str) -> Column:
    """A content as JSON without empty fields, in which equal amounts of information are told apart; some
    signs are escaped, as they count by their escapes."""
    c = F.col(content)
    text = lambda x: F.nullif(x, F.lit(""))
    count = lambda x: F.nullif(x, F.lit(0).cast("bigint"))
    some = lambda x: F.when(F.size(x) > 0, x)
    item = lambda i: F.struct(text(i["name"]).alias("name"), text(i["kind"]).alias("kind"), count(i["size_bytes"]).alias("size_bytes"))
    whole = F.struct(
        text(c["name"]).alias("name"), text(c["kind"]).alias("kind"), count(c["size_bytes"]).alias("size_bytes"), count(c["file_count"]).alias("file_count"), count(c["folder_count"]).alias("folder_count"),
        some(F.transform(c["items"], item)).alias("items"), some(c["material_types"]).alias("material_types"),
    )
    out = F.to_json(whole)
    for sign in "&<>\u2028\u2029":
        out = F.replace(out, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return out


def same_source(headers: DataFrame) -> DataFrame:
    """Rows that speak against all snapshots being of one channel: ids that differ, or, where
    no snapshot has an id, addresses that do."""
    ids = headers.filter(F.col("channel_id") != 0).agg(F.count_distinct("channel_id").alias("ids"), F.count("*").alias("with_id"))
    urls = headers.agg(F.count_distinct(F.nullif("web_url", F.lit(""))).alias("urls"))
    return ids.join(F.broadcast(urls), F.lit(True)).filter((F.col("ids") > 1) | ((F.col("with_id") == 0) & (F.col("urls") > 1)))


def fold_header(headers: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: each field's last value that says something."""
    at = F.struct(*[F.col(c) for c in order])
    return headers.agg(*[latest(headers, c, at) for c in headers.columns if c not in order])


def source_counts(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """The counters that a source declares, from its rows."""
    mine = entries.agg(
        F.count("*").alias("catalog_entry_count"),
        F.coalesce(F.sum(F.size(F.coalesce("links", F.array()))), F.lit(0)).alias("parsed_link_count"),
        F.coalesce(F.sum(F.size(F.coalesce("passwords", F.array()))), F.lit(0)).alias("password_value_count"),
    )
    return mine.join(F.broadcast(messages.agg(F.count("*").alias("exported_message_count"))), F.lit(True))
