"""Entity resolution: match rules as edges, components, canonical members, folded entities.

Rules that say "equal key" become edges between a row and its key, never between rows, so a
key that many rows share costs a row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.text import token_affix, years_fit
from heddle.operators.merge import distinct_in_order, with_arrays
from heddle.plans.components import connected_components


def key_edges(rows: DataFrame, node: str, key: Column, kind: str) -> DataFrame:
    """(node, key) for rows whose key says something; keys of different kinds never meet."""
    return rows.select(F.col(node).cast("string").alias("node"), F.concat(F.lit(f"{kind}|"), key).alias("key")).filter(F.col("key").isNotNull()).distinct()


def repaired_edges(rows: DataFrame, node: str, repaired: Column, identity: DataFrame, kind: str) -> DataFrame:
    """Edges from repaired keys, only to keys that ``identity`` (edges) has already."""
    own = key_edges(rows, node, repaired, kind)
    return own.join(identity.select("key").distinct(), "key", "left_semi").select("node", "key")


def affix_edges(nodes: DataFrame, link: str, title: str, year: str) -> DataFrame:
    """Pairs of titles under one link of which one begins or ends with the other's words and
    whose years fit: (node, key) edges between distinct (link, title) nodes.

    The comparison of all titles of a link is an equi-join: each title is exploded into
    hashes of the word runs that begin or end it, and meets titles that are such a run.
    Equal titles under a link are one node, with their years as a set."""
    distinct = nodes.groupBy(link, title).agg(F.collect_set(year).alias("years"), F.max(F.col(year).isNull()).alias("open")).filter(F.col(title) != "")
    words = F.split(F.col(title), " ")
    chain = lambda w: F.aggregate(w, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.xxhash64(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint")), x))))
    # running hashes of the words from the front and from the back: a run is told by one number
    hashed = distinct.select(F.col(link).alias("l"), F.col(title).alias("t"), "years", "open", chain(words).alias("front"), chain(F.reverse(words)).alias("back"))
    shorter_than = lambda c, kind: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda h, i: F.struct(F.lit(kind).alias("side"), (i + 1).alias("n"), h.alias("h")))
    runs = F.concat(shorter_than(F.col("front"), "front"), shorter_than(F.col("back"), "back"))
    longer = hashed.select("l", F.col("t").alias("longer"), "years", "open", F.explode(runs).alias("run")).select("l", "longer", "years", "open", "run.*")
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.element_at(s, -1).alias("h")) for s in ("front", "back")]))
    shorter = hashed.select("l", F.col("t").alias("shorter"), F.col("years").alias("years2"), F.col("open").alias("open2"), F.size("front").alias("n"), ends.alias("e")).select("l", "shorter", "years2", "open2", "n", "e.*")
    met = longer.join(shorter, ["l", "side", "n", "h"]).filter(token_affix(F.col("longer"), F.col("shorter")))
    fits = F.col("open") | F.col("open2") | F.arrays_overlap("years", "years2")
    name = lambda t: F.concat(F.lit("TL|"), F.col("l").cast("string"), F.lit("|"), F.col(t))
    return met.filter(fits).select(name("longer").alias("node"), name("shorter").alias("key"))


def title_link_key(link: str, title: str) -> Column:
    """The key of ``affix_edges``' nodes, without its kind."""
    return F.concat(F.col(link).cast("string"), F.lit("|"), F.col(title))


def converged_edges(rows: DataFrame, node: str, key: Column, changed: Column) -> DataFrame:
    """Rows that share ``key`` only after normalization: groups in which at least one row was
    changed."""
    keyed = rows.select(F.col(node).cast("string").alias("node"), F.concat(F.lit("PN|"), key).alias("key"), changed.alias("changed"))
    moved = keyed.groupBy("key").agg(F.max("changed").alias("any")).filter("any").select("key")
    return keyed.join(moved, "key", "left_semi").select("node", "key").distinct()


def _id(kind: int, text: str) -> Column:
    """128 bits that stand for a node (0) or a key (1) in all rounds."""
    return F.concat(F.lit(str(kind)), F.md5(text))


def cluster(rows: DataFrame, node: str, edges: Sequence[DataFrame]) -> DataFrame:
    """``rows`` with ``component``: the smallest node (as text) of those linked through any
    of the edges; rows without edges are alone.

    Rounds see hashes of nodes and keys, however long those are."""
    everything = edges[0]
    for e in edges[1:]:
        everything = everything.unionByName(e)
    # keys of one kind may be the nodes of another rule's edges
    marked = everything.select(F.when(F.col("node").startswith("TL|"), _id(1, "node")).otherwise(_id(0, "node")).alias("a"), _id(1, "key").alias("b"))
    found = connected_components(marked).filter(F.col("node").startswith("0")).select(F.col("node").alias("_h"), F.col("component").alias("_c"))
    nodes = rows.select(F.col(node).cast("string").alias("_node")).filter(F.col("_node").isNotNull()).distinct().withColumn("_h", _id(0, "_node"))
    placed = nodes.join(found, "_h")
    least = placed.groupBy("_c").agg(F.min("_node").alias("component"))
    named = placed.join(least, "_c").select("_node", "component")
    out = rows.join(named, rows[node].cast("string") == F.col("_node"), "left")
    return out.select(*rows.columns, F.coalesce("component", F.col(node).cast("string")).alias("component"))


def canonical(rows: DataFrame, component: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a component: the columns of its first member in ``order``."""
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("x")
    return rows.groupBy(component).agg(best).select(component, "x.*")


def fold(rows: DataFrame, component: str, order: Sequence[str], scalars: Sequence[str], arrays: Sequence[str], at: str, position: str) -> DataFrame:
    """Fold the members of each component: scalars of the canonical member (first in
    ``order``), arrays as the canonical member's and then the others' by ``position``, each
    value once; first and last ``at``; ``members``; ``first_position``.

    Members combine before each shuffle, so no row or task holds a whole component."""
    head = rows.groupBy(component).agg(
        F.min_by(F.struct(*scalars, F.col(position).alias("_head")), F.struct(*order)).alias("h"),
        F.min(at).alias(f"first_{at}"),
        F.max(at).alias(f"last_{at}"),
        F.count("*").alias("members"),
        F.min(position).alias("first_position"),
    )
    out = head.select(component, *[F.col(f"h.{s}").alias(s) for s in scalars], f"first_{at}", f"last_{at}", "members", "first_position")
    if not arrays:
        return out
    heads = head.select(F.col(component).alias("_c"), F.col("h._head").alias("_head"))
    marked = rows.join(heads, rows[component].eqNullSafe(heads["_c"])).select(component, *arrays, F.struct((F.col(position) != F.col("_head")).alias("other"), F.col(position).alias("p")).alias("_at"))
    types = {a: rows.schema[a].dataType for a in arrays}
    return with_arrays(out, distinct_in_order(marked, [component], arrays, F.col("_at")), [component], arrays, types)


def with_links(entities: DataFrame, links: str = "links") -> tuple[DataFrame, DataFrame]:
    """Entities that have links, and a row that counts both kinds."""
    has = F.size(F.coalesce(F.col(links), F.array())) > 0
    return entities.filter(has), entities.agg(F.count_if(has).alias("kept"), F.count_if(~has).alias("dropped"))


__all__ = ["affix_edges", "canonical", "cluster", "converged_edges", "fold", "key_edges", "repaired_edges", "title_link_key", "with_links", "years_fit"]
