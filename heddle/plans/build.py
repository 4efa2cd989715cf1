"""The batch jobs: catalog build, link audit, link enrichment, index activation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import links as L
from heddle.functions import text as T
from heddle.functions import titles
from heddle.operators import audit, classify, cluster, enrich, merge, quality, search, sidecars
from heddle.plans.stored import written
from heddle.sources import attachments, exports, stores


@dataclass
class Controls:
    """Control tables and rules; those left out are empty.  ``format_labels`` (id, label) names the
    formats; without it they are called by their ids."""

    taxonomy: DataFrame
    keywords: DataFrame
    blocks: DataFrame | None = None
    formats: Sequence[classify.FormatRule | tuple] = ()
    format_labels: DataFrame | None = None
    tombstones: DataFrame | None = None
    suppressions: DataFrame | None = None
    cache: DataFrame | None = None
    title_rules: titles.Rules = field(default_factory=titles.Rules)


@dataclass
class Catalog:
    entries: DataFrame
    facets: DataFrame
    format_facets: DataFrame
    stats: DataFrame
    violations: DataFrame
    source: DataFrame


def source_violations(snapshots: DataFrame | exports.Snapshots) -> DataFrame:
    """What speaks against the snapshots before they are merged: counters that differ from the
    rows, no entries, more than one channel."""
    tables = exports.as_snapshots(snapshots)
    size = lambda c: F.size(F.coalesce(c, F.array()))
    of = F.col("snapshot_ord").alias("_ord")
    said = tables.messages.groupBy(of).agg(F.count("*").alias("n_messages")).withColumnRenamed("_ord", "_said")
    held = tables.entries.groupBy(of).agg(F.count("*").alias("n_entries"), F.sum(size(F.col("links"))).alias("n_links"), F.sum(size(F.col("passwords"))).alias("n_passwords"))
    whole = tables.headers.join(said, F.col("snapshot_ord") == F.col("_said"), "left").join(held, F.col("snapshot_ord") == F.col("_ord"), "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    actual = {"retrieval.exported_message_count": "n_messages", "parsing.catalog_entry_count": "n_entries", "parsing.parsed_link_count": "n_links", "parsing.password_value_count": "n_passwords"}
    declared = lambda n: F.coalesce(F.col(f"stats.{n}"), F.lit(0))
    rules = {n.split(".")[1]: (declared(n) == none(a), F.concat_ws("<>", declared(n).cast("string"), none(a).cast("string"))) for n, a in actual.items()}
    rules["no_entries"] = (none("n_entries") > 0, F.col("snapshot_ord"))
    channels = merge.same_source(exports.headers(snapshots)).select(F.lit("snapshots").alias("table"), F.lit("source").alias("key"), F.lit("conflicting_source").alias("rule"), F.concat_ws("/", F.col("ids").cast("string"), F.col("urls").cast("string")).alias("value"))
    return quality.check(whole, "snapshots", "snapshot_ord", rules).unionByName(channels)


def control_violations(controls: Controls) -> DataFrame:
    """Rows of the control tables that no build may use."""
    found = [quality.definition_rules(controls.taxonomy, "taxonomy")]
    for table, rules in ((controls.tombstones, quality.tombstone_rules), (controls.suppressions, quality.suppression_rules), (controls.cache, quality.content_rules)):
        if table is not None:
            found.append(rules(table))
    return quality.all_of(*found)


def build_catalog(snapshots: DataFrame | exports.Snapshots, controls: Controls, files: DataFrame | None = None, *, strict: bool = True) -> Catalog:
    """Snapshots (``exports.read_snapshots`` or ``read_exports``) to a catalog: upsert, link hygiene, clusters, titles,
    categories, facets.

    Snapshots whose counters are wrong, of several channels, or without entries stop the
    build (``quality.Broken``) before anything is written, and so do broken control tables.
    Entries without an id, title, readable time or message stop it as well; if it is not
    ``strict``, they are left out and listed in ``violations``."""
    spark = controls.taxonomy.sparkSession
    quality.require(source_violations(snapshots), "snapshots")
    quality.require(control_violations(controls), "control tables")
    tombstones = controls.tombstones if controls.tombstones is not None else stores.read_sidecar(spark, None, "tombstones")
    suppressions = controls.suppressions if controls.suppressions is not None else stores.read_sidecar(spark, None, "suppressions")
    cache = controls.cache if controls.cache is not None else stores.read_sidecar(spark, None, "cache")
    order = ["snapshot_ord", "pos"]

    source = written(merge.fold_header(exports.headers(snapshots), ["snapshot_ord"]), "source")
    said_messages = exports.messages(snapshots).withColumns({"media_type": F.col("media.type"), "file_name": F.col("media.document.file_name"), "mime_type": F.col("media.document.mime_type")}).drop("media")
    messages = written(merge.upsert(said_messages, "message_id", order), "messages")
    raw = exports.entries(snapshots).withColumn("author", T.optional("credit.author"))
    raw = raw.withColumns({"passwords": F.coalesce("passwords", F.array().cast("array<string>")), "links": F.coalesce("links", F.array().cast(f"array<{exports.LINK}>"))})
    versions = written(raw.drop("credit"), "versions")
    folded = merge.upsert(versions.drop("links"), "entry_id", order, arrays=["passwords", "source_message_ids"])
    own = merge.merge_source_links(versions.select("entry_id", *order, "links"), "entry_id", order).select(F.col("entry_id").alias("_e"), "links")
    entries = folded.join(own, folded["entry_id"].eqNullSafe(own["_e"]), "left").drop("_e")
    entries = written(entries.withColumns({"links": F.coalesce("links", F.array().cast(f"array<{exports.LINK}>")), "note_list": F.array_compact(F.array(T.optional("notes")))}).drop("notes"), "entries")

    said = lambda c: T.strip(F.coalesce(c, F.lit(""))) != ""
    checks = {"blank_entry": (said(F.col("entry_id")), F.col("entry_id")), "blank_title": (said(F.col("title")), F.col("title")), "added_at": (F.try_to_timestamp("added_at").isNotNull(), F.col("added_at"))}
    broken = quality.all_of(quality.check(entries, "entries", "entry_id", checks), quality.references(entries, messages, "entries", "entry_id", "message_id", "message_id"), quality.check(messages, "messages", "message_id", {"blank_message": (said(F.col("message_id")), F.col("message_id"))}))
    hashed = attached = None
    if files is not None:
        hashed = written(attachments.hashes(files), "hashes")
        attached = messages.filter(attachments.is_torrent()).select("message_id", "file_name")
        broken = broken.unionByName(attachments.unreadable(hashed, attached))
    broken = written(broken, "violations")
    if strict:
        quality.require(broken, "entries")
    entries = entries.join(broken.filter("table = 'entries'").select(F.col("key").alias("entry_id")).distinct(), "entry_id", "left_anti").filter(F.col("entry_id").isNotNull())

    # links: one row each
    linked = entries.select("entry_id", "title", "raw_block", "author", F.transform("links", lambda x: x["label"]).alias("labels"), F.posexplode("links").alias("pos", "x"))
    linked = L.with_link(linked, F.col("x.url")).withColumn("useful", L.actionable(F.col("title"), F.col("raw_block"), F.col("author"), F.col("x"), F.col("labels")))
    flat = linked.select("entry_id", "pos", "useful", F.trim("x.url").alias("url"), "x.host", "x.provider", "x.kind", "x.role", "x.primary", "x.label", "link.canonical", "link.rejection")
    marked = lambda rows: sidecars.dispositions(rows.withColumn("sha256", L.link_hash("canonical")), tombstones, suppressions)
    flat = written(marked(flat), "links")
    stated = flat.filter("disposition = 'kept'")
    if files is not None:
        # links of attachments belong to entries, but say nothing about which are the same
        found = attachments.magnet_links(attachments.match(hashed, attached))
        extra = entries.select("entry_id", "message_id").join(found, "message_id")
        null = F.lit(None).cast("string")
        extra = extra.select("entry_id", F.lit(1 << 20).alias("pos"), F.lit(True).alias("useful"), "url", null.alias("host"), "provider", "kind", "role", F.lit(False).alias("primary"), null.alias("label"), F.col("url").alias("canonical"), null.alias("rejection"))
        flat = flat.unionByName(written(marked(extra), "attached-links"))
    kept = flat.filter("disposition = 'kept'")

    # titles
    shown = entries.withColumn("_range", T.date_range_heading("title", "author", "raw_block", "year"))
    shown = shown.withColumns({"_given": T.clean_title("title"), "_title": T.clean_title(F.coalesce("_range.title", "title")), "_author": F.coalesce("_range.author", "author")})
    addresses = shown.select("entry_id", F.explode(F.array_distinct(T.url_words("_title"))).alias("word"))
    addresses = L.with_link(addresses, F.col("word"), "said").select("entry_id", "word", F.col("said.canonical").alias("canonical"))
    own_links = linked.filter(F.col("link.scheme").isin("http", "https")).select("entry_id", F.col("link.canonical").alias("canonical")).distinct()
    cut = addresses.join(own_links, ["entry_id", "canonical"], "left_semi").groupBy("entry_id").agg(F.collect_set("word").alias("_cut"))
    shown = shown.join(cut, "entry_id", "left").withColumn("_source", T.without_words("_title", F.coalesce("_cut", F.array().cast("array<string>"))))
    shown = titles.normalize_titles(shown.drop("title").withColumnRenamed("_source", "title"), "title", controls.title_rules)
    moved = F.col("_range").isNotNull() | (F.col("title_original") != F.col("_title"))
    first = F.when(moved, F.col("_given")).when(F.col("title_changed"), F.col("title_original"))

    # clusters
    year, span = F.concat(F.lit("year:"), F.col("year").cast("string")), F.concat(F.lit("range:"), F.col("year_range.from").cast("string"), F.lit("-"), F.col("year_range.to").cast("string"))
    channel = F.concat(F.lit("channel:"), F.coalesce(F.col("_channel").cast("string"), F.lit("0")))
    key = lambda title, author: T.identity_key(channel, T.normalize(title), author, year, span)
    credit = lambda c: T.normalize(F.coalesce(c, F.lit("")))
    fixed = T.malformed_author("_given")
    rows = shown.join(F.broadcast(source.select(F.col("channel_id").alias("_channel"))), F.lit(True))
    rows = rows.select(
        *[c for c in shown.columns if c not in ("author", "title_original", "_title", "_author", "_range", "_cut", "_given")], F.col("_author").alias("author"), first.alias("title_original"), T.normalize("_given").alias("given"),
        key(T.identity_title(F.col("_given"), "year"), credit(F.col("author"))).alias("key"), F.when(fixed.isNotNull(), key(fixed["title"], T.normalize(fixed["author"]))).alias("repaired"), key(F.col("title"), credit(F.col("_author"))).alias("after"),
        T.instant("added_at").alias("at"), F.struct("first_seen.snapshot_ord", "first_seen.pos").alias("ord"),
    )
    rows = written(rows, "rows")
    by_link = rows.select("entry_id", "given", "year").join(stated.select("entry_id", "sha256").distinct(), "entry_id")
    same = cluster.key_edges(rows, "entry_id", F.col("key"), "I")
    edges = [
        same,
        cluster.key_edges(by_link, "entry_id", cluster.title_link_key("sha256", "given"), "TL"),
        cluster.repaired_edges(rows, "entry_id", F.col("repaired"), same, "I"),
        cluster.affix_edges(by_link, "sha256", "given", "year"),
        cluster.converged_edges(rows, "entry_id", F.col("after"), F.col("title_changed")),
    ]
    grouped = written(cluster.cluster(rows, "entry_id", edges), "clusters")

    # labels of members, then entities
    about = T.normalize(F.concat_ws(" ", "title", "author", "raw_block"))
    labels = classify.classify(grouped.withColumn("about", about), "entry_id", F.col("about"), controls.taxonomy, controls.keywords, controls.blocks)
    carried = messages.select("message_id", F.col("telegram_message_id"), F.col("url").alias("message_url"), attachments.is_torrent().alias("attached"))
    member = grouped.join(labels, "entry_id").join(carried, "message_id", "left")
    formats, format_source = classify.format_labels(T.tokens(T.normalize("title")), controls.formats, F.coalesce("attached", F.lit(False)))
    told = lambda c: F.array_compact(F.array(T.optional(c)))
    ids = T.distinct_text(F.coalesce("source_message_ids", F.array().cast("array<string>")))
    member = member.withColumns({"formats": formats, "format_sources": F.array(format_source), "origins": told("origin"), "availabilities": told("availability"), "source_message_ids": F.when(F.size(ids) > 0, ids).otherwise(F.array("message_id"))})
    member = member.withColumn("sources", F.array(F.struct("entry_id", "message_id", "telegram_message_id", "message_url", "source_message_ids", "added_at", "origin", "availability")))
    arrays = ["categories", "formats", "format_sources", "passwords", "note_list", "origins", "availabilities", "sources"]
    whole = cluster.fold(member, "component", ["at", "entry_id"], ["entry_id", "title", "title_original", "author", "year", "year_range", "key"], arrays, "at", "ord")
    owned = sidecars.attach_content(kept.filter("useful"), cache).join(grouped.select("entry_id", "component", "ord"), "entry_id")
    merged = merge.merge_links(owned, ["component"], F.col("sha256"), ["ord", "pos"])
    link = F.struct("first_seen", "link_key", "url", "host", "provider", "kind", "role", "primary", "label", "content")
    listed = merged.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("first_seen", "link_key"))).alias("o"), F.map_from_entries(F.collect_list(F.struct("link_key", link.alias("v")))).alias("m"))
    listed = listed.select("component", F.transform("o", lambda x: F.col("m")[x["link_key"]]).alias("links"))
    in_order = lambda names, rank: F.transform(F.array_sort(F.transform(names, lambda c: F.struct(F.coalesce(rank[c], F.lit(1 << 20)).alias("o"), c.alias("c")))), lambda x: x["c"])
    format_ids = classify.format_order(controls.formats)
    format_rank = F.create_map(*[x for i, name in enumerate(format_ids) for x in (F.lit(name), F.lit(i))])
    rank = controls.taxonomy.agg(F.map_from_entries(F.collect_list(F.struct("id", "ord"))).alias("_rank"))  # one entry a definition
    whole = whole.join(listed, "component", "left").join(F.broadcast(rank), F.lit(True)).withColumns({"categories": in_order("categories", F.col("_rank")), "formats": in_order("formats", format_rank)}).drop("_rank").withColumn("id", T.stable_id("key"))
    keep, dropped = cluster.with_links(whole)
    final = classify.propagate_majority(keep, "author", "categories", controls.taxonomy)
    final = final.withColumnsRenamed({"first_at": "first_added_at", "last_at": "last_added_at", "note_list": "notes", "availabilities": "availability"}).withColumns({"primary_category": F.col("categories")[0], "primary_format": F.col("formats")[0]})
    final = written(final, "catalog")
    counters = classify.catalog_stats(final).join(F.broadcast(final.agg(F.count_if("inherited").alias("inherited_topics"))), F.lit(True))
    stats = counters.join(F.broadcast(dropped), F.lit(True))
    removed = flat.agg(*[F.count_if(F.col("disposition") == name).alias(name) for name in ("structural", "tombstoned", "suppressed")])
    stats = stats.join(F.broadcast(removed), F.lit(True)).join(F.broadcast(merge.source_counts(entries, messages)), F.lit(True))
    quality.require(quality.collisions(final, "catalog", "id", "key"), "catalog")
    names = spark.createDataFrame([(name, i) for i, name in enumerate(format_ids)], "id string, ord int")
    named = controls.format_labels.select("id", "label") if controls.format_labels is not None else names.select("id", F.col("id").alias("label"))
    definitions = names.join(F.broadcast(named), "id", "left").withColumn("label", F.coalesce("label", "id"))
    facets = classify.facet_counts(final, "categories", controls.taxonomy, fields=("id", "label", "hidden", "ord"))
    return Catalog(final, facets, classify.facet_counts(final, "formats", definitions), stats, broken, source)


def _suffixes(rules: DataFrame) -> DataFrame:
    """(rule_ord, host_suffix) of rules with their host_suffixes."""
    return rules.select("rule_ord", F.explode("host_suffixes").alias("host_suffix"))


def audit_links(observations: DataFrame, policy: DataFrame, rules: DataFrame, previous: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, new tombstones) of a run: ``observations`` has sha256, host, http_status, body,
    transport_error, checked_at; ``policy`` and ``rules`` are as ``quality.audit_policy_rules`` takes
    them.  A policy, report or tombstone that breaks a rule stops the run (``quality.Broken``) before
    anything is written."""
    quality.require(quality.audit_policy_rules(policy, rules), "audit policy")
    quality.require(quality.all_of(quality.report_rules(previous), quality.tombstone_rules(tombstones)), "control tables")
    limits = policy.first()  # one row
    listed = [r.asDict() for r in rules.orderBy("rule_ord").collect()]  # a policy's rules: their patterns become literals
    judged = audit.classify(audit.match_rule(observations, _suffixes(rules)), listed)
    report = written(audit.advance(judged.select("sha256", "state", "reason", "http_status", "checked_at"), previous), "report")
    return report, audit.new_tombstones(report, tombstones, limits["confirmations_required"])


def enrich_links(bodies: DataFrame, policy: DataFrame, rules: DataFrame, cache: DataFrame, now: Column, *, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cache, counts) of a run over ``bodies`` (sha256, host, body): those whose host has a rule
    and whose cache row is stale.  ``policy`` and ``rules`` are as ``quality.enrichment_policy_rules``
    takes them, and its limits hold; a policy or cache that breaks a rule stops the run
    (``quality.Broken``) before anything is written."""
    quality.require(quality.enrichment_policy_rules(policy, rules), "enrichment policy")
    quality.require(quality.content_rules(cache), "cache")
    limits = policy.first()  # one row
    stale_after = F.make_dt_interval(secs=F.lit(float(limits["stale_after_seconds"])).cast("decimal(18,6)"))
    split = enrich.fresh_split(audit.match_rule(bodies, _suffixes(rules), how="inner"), cache, now, stale_after, refresh)
    split = written(split, "candidates")
    found = enrich.extract(split.filter("not fresh"), rules, limits["max_items"], limits["max_body_bytes"]).withColumn("checked_at", now)
    return enrich.upsert_cache(cache, found), enrich.run_counts(split, found)


def search_rows(catalog: DataFrame, taxonomy: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Visible entries with what searches filter and sort by: ``providers``, ``has_password``,
    ``search_text``; labels come from the definitions (id, label, hidden), which are small."""
    shown = search.visible(catalog)

    def labelled(rows: DataFrame, names: str, definitions: DataFrame | None, out: str) -> DataFrame:
        if definitions is None:
            return rows.withColumn(out, F.col(names))
        known = definitions.agg(F.map_from_entries(F.collect_list(F.struct("id", "label"))).alias("_known"))  # one entry a definition
        return rows.join(F.broadcast(known), F.lit(True)).withColumn(out, F.transform(names, lambda n: F.coalesce(F.col("_known")[n], n))).drop("_known")

    shown = labelled(labelled(shown, "categories", taxonomy, "_categories"), "formats", formats, "_formats")
    return shown.withColumns(
        {"providers": search.provider_set(F.col("links")), "has_password": F.size("passwords") > 0, "added_at": F.col("last_added_at"), "search_text": search.document_text(F.col("_categories"), F.col("_formats"))}
    ).drop("_categories", "_formats")


def activate(catalog: DataFrame, taxonomy: DataFrame, root: str, version: str, at: str, formats: DataFrame | None = None) -> DataFrame:
    """Publish a catalog with its search index, if it breaks no rule and the index holds every
    visible entry; returns the violations."""
    bad = written(quality.catalog_rules(catalog, taxonomy, formats), "violations")
    if bad.limit(1).count():
        return bad
    shown = search_rows(catalog, taxonomy, formats)
    fields = {"title": F.col("title"), "author": F.coalesce("author", F.lit("")), "text": F.col("search_text")}
    index = search.build_index(shown, "id", fields)
    held = index.fields.agg(F.min("n").alias("n")).first()["n"]
    if held != shown.count():
        raise RuntimeError("the index does not hold every visible entry")
    for name in ("postings", "dictionary", "fields"):
        getattr(index, name).write.mode("overwrite").parquet(f"{root}/index/version={version}/{name}")
    stores.publish(catalog, root, version, at)
    return bad
