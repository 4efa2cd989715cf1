"""Keyword classification against a taxonomy table, format rules, majority labels, facets.

A taxonomy is two tables: ``taxonomy(id, label, hidden, ord)`` and ``keywords(id,
keyword)``; blocks are ``blocks(id, phrase)``.  Nothing of a taxonomy is code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.text import normalize, tokens
from heddle.plans.stored import written

OTHER, SERVICE = "other", "service"


def keyword_kinds(keywords: DataFrame) -> DataFrame:
    """Keywords with their kind: ``prefix`` (a star at the end, or one word of more than
    four characters), ``exact`` (a shorter word) or ``phrase``.

    A starred keyword of several words is a prefix of single words and so never matches."""
    k = normalize(F.regexp_replace("keyword", r"\*$", ""))
    starred = F.col("keyword").endswith("*")
    kind = F.when(starred, "prefix").when(k.contains(" "), "phrase").when(F.char_length(k) <= 4, "exact").otherwise("prefix")
    return keywords.select("id", k.alias("keyword"), kind.alias("kind")).filter(F.col("keyword") != "").distinct()


def _lengths(kinds: DataFrame, kind: str, of: Column) -> list[int]:
    """The lengths that occur among keywords of a kind; a few rows."""
    return sorted(r[0] for r in kinds.filter(F.col("kind") == kind).select(of.alias("n")).distinct().collect())


def _said(kind: str, values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("keyword")))


def _beginnings(n: int) -> Column:
    """The first ``n`` characters of the words that have as many."""
    return F.transform(F.filter("w", lambda x: F.char_length(x) >= n), lambda x: F.substring(x, 1, n))


def _runs(n: int) -> Column:
    """All runs of ``n`` words."""
    starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))


def matches(docs: DataFrame, key: str, text: Column, keywords: DataFrame) -> DataFrame:
    """Distinct (key, id) of taxonomy ids that match a normalized text.

    Words, their beginnings and runs of words meet keywords by equality, at the lengths that
    occur among the keywords.  So the join is by key, however long the keyword list is, and a
    text costs a row for each distinct word and run."""
    kinds = written(keyword_kinds(keywords), "keywords")
    begins, runs = _lengths(kinds, "prefix", F.char_length("keyword")), _lengths(kinds, "phrase", F.size(F.split("keyword", " ")))
    said = [_said("exact", F.array_distinct("w"))] + [_said("prefix", _beginnings(n)) for n in begins] + [_said("phrase", _runs(n)) for n in runs]
    each = docs.select(F.col(key), tokens(text).alias("w")).select(key, F.explode(F.concat(*said)).alias("x")).select(key, "x.*")
    return each.join(kinds, ["kind", "keyword"]).select(key, "id").distinct()


def blocked(docs: DataFrame, key: str, text: Column, blocks: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """(key, id) that a guard forbids: the phrase (or any of its words, for rows of kind
    ``word``) is in the text and none of the keywords in ``unless`` (a text list) matches."""
    found = matches(docs, key, text, blocks.select(F.concat("id", F.lit("\u001f"), F.coalesce("unless", F.lit(""))).alias("id"), F.col("phrase").alias("keyword")))
    split = F.split("id", "\u001f")
    hit = found.select(key, split[0].alias("id"), split[1].alias("unless"))
    always = hit.filter("unless = ''").select(key, "id")
    guarded = hit.filter("unless <> ''")
    words = blocks.filter(F.coalesce("unless", F.lit("")) != "").select(F.col("unless").alias("id"), F.explode(F.split("unless", ",")).alias("keyword"))
    excused = matches(docs, key, text, words).select(key, F.col("id").alias("unless"))
    return always.unionByName(guarded.join(excused, [key, "unless"], "left_anti").select(key, "id")).distinct()


def classify(docs: DataFrame, key: str, text: Column, taxonomy: DataFrame, keywords: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(key, categories): all that match in taxonomy order; ``service`` alone where it
    matches; ``other`` where nothing does."""
    found = matches(docs, key, text, keywords)
    if blocks is not None:
        found = found.join(blocked(docs, key, text, blocks), [key, "id"], "left_anti")
    ranked = found.join(taxonomy.select("id", "ord"), "id")
    listed = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    out = docs.select(key).distinct().join(listed, key, "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(key, F.when(F.array_contains(ids, SERVICE), F.array(F.lit(SERVICE))).when(F.size(ids) == 0, F.array(F.lit(OTHER))).otherwise(ids).alias("categories"))


@dataclass(frozen=True)
class FormatRule:
    """A format and what a title must hold for it: any of ``words``, any of ``phrases``, a word of both
    lists of one of ``both``, or a word of one of ``unless`` while its phrase is not there."""

    id: str
    words: Sequence[str] = ()
    phrases: Sequence[str] = ()
    both: Sequence[tuple[Sequence[str], Sequence[str]]] = ()
    unless: Sequence[tuple[Sequence[str], str]] = ()


ATTACHMENT, UNSPECIFIED = "torrent_attachment", "unspecified"


def format_order(rules: Sequence[FormatRule | tuple]) -> list[str]:
    """The order in which formats are listed."""
    return [_rule(r).id for r in rules] + [ATTACHMENT, UNSPECIFIED]


def _rule(rule: FormatRule | tuple) -> FormatRule:
    return rule if isinstance(rule, FormatRule) else FormatRule(*rule)


def format_labels(words: Column, rules: Sequence[FormatRule | tuple], attachment: Column | None = None) -> tuple[Column, Column]:
    """(formats, source) by ``rules`` (or tuples of their fields), in order.  ``attachment`` adds
    ``torrent_attachment``.  Source: ``title``, ``availability`` (by the attachment alone) or
    ``fallback`` (``unspecified``)."""
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    any_of = lambda some: F.arrays_overlap(words, F.array(*[F.lit(w) for w in some])) if some else F.lit(False)
    said = lambda phrase: text.contains(f" {phrase} ")
    one = []
    for rule in map(_rule, rules):
        hit = any_of(rule.words)
        for p in rule.phrases:
            hit = hit | said(p)
        for left, right in rule.both:
            hit = hit | (any_of(left) & any_of(right))
        for some, phrase in rule.unless:
            hit = hit | (any_of(some) & ~said(phrase))
        one.append(F.when(hit, F.lit(rule.id)))
    if attachment is not None:
        one.append(F.when(attachment, F.lit(ATTACHMENT)))
    found = F.array_compact(F.array(*one))
    source = F.when(F.size(found) == 0, "fallback").when(found[0] == ATTACHMENT, "availability").otherwise("title")
    return F.when(F.size(found) == 0, F.array(F.lit(UNSPECIFIED))).otherwise(found), source


def propagate_majority(rows: DataFrame, author: str, categories: str, taxonomy: DataFrame, *, least: int = 2, percent: int = 70) -> DataFrame:
    """``rows`` with ``categories`` of rows that are exactly ``[other]`` replaced by their
    author's main topic: that of at least ``percent`` of the author's classified rows (by their
    first topic that is not ``other``), of which there are ``least`` or more; ties by taxonomy
    order.  Authors are the same if their normalized names are; those without a letter or digit have
    no majority.  ``inherited`` marks the rows."""
    rows = rows.withColumn("_author", normalize(F.coalesce(F.col(author), F.lit(""))))
    first = F.try_element_at(F.filter(categories, lambda c: ~c.isin(OTHER, SERVICE)), F.lit(1))
    counted = rows.filter(F.col("_author") != "").select(F.col("_author").alias("_a"), first.alias("_topic")).filter(F.col("_topic").isNotNull()).groupBy("_a", "_topic").count()
    ranked = counted.join(taxonomy.select(F.col("id").alias("_topic"), "ord"), "_topic")
    top = ranked.groupBy("_a").agg(F.max_by("_topic", F.struct("count", (-F.col("ord")).alias("o"))).alias("_main"), F.max("count").alias("_n"), F.sum("count").alias("_all"))
    top = top.filter((F.col("_all") >= least) & (F.col("_n") * 100 >= F.col("_all") * percent)).select("_a", "_main")
    out = rows.join(top, F.col("_author") == F.col("_a"), "left")
    moves = (F.size(categories) == 1) & (F.col(categories)[0] == OTHER) & F.col("_main").isNotNull()
    rest = [rows[c] for c in rows.columns if c not in (categories, "_author")]
    return out.select(*rest, F.when(moves, F.array("_main")).otherwise(F.col(categories)).alias(categories), F.coalesce(moves, F.lit(False)).alias("inherited"))


def facet_counts(rows: DataFrame, values: str, definitions: DataFrame, *, fields: Sequence[str] = ("id", "label", "ord")) -> DataFrame:
    """``fields`` and count for every definition, those without rows too."""
    n = rows.select(F.explode(values).alias("id")).groupBy("id").count()
    return definitions.join(n, "id", "left").select(*fields, F.coalesce("count", F.lit(0)).alias("count"))


def catalog_stats(rows: DataFrame) -> DataFrame:
    """One row of counters over a catalog (links with their content, passwords, title_original), in one
    pass."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    size = lambda c: F.size(F.coalesce(c, F.array()))
    return rows.agg(
        F.count("*").alias("entries"),
        total(size(F.col("links"))).alias("links"),
        total(size(F.filter("links", lambda x: x["content"].isNotNull()))).alias("enriched_links"),
        total(size(F.col("passwords"))).alias("passwords"),
        F.count_if(F.col("title_original").isNotNull()).alias("normalized_titles"),
    )
