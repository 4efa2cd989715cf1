"""Mixing sources to target weights by hierarchical budgeting (native).

A tree of domain, language and source is cut from the corpus.  The token budget flows
from the root: at each node the children share it by their weights, none takes more than
its subtree holds (its tokens times the most epochs), and what a child cannot take goes
to its siblings.  A node's own budget never exceeds what it holds, so a shortage reaches
the level above only when all siblings are full.

Each leaf then takes whole seeded epochs of its documents, and of the last epoch the
longest prefix, in that epoch's hash order, that stays within its budget.  The prefix is
found over hash blocks first; rows are summed only within the one block it ends in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.shared import md5_uint60, written
from heddle.llm.sharding import free_name

BLOCKS = 4096
_BLOCK_SPAN = (1 << 60) // BLOCKS


def text_tokens(text: str = "text") -> Column:
    """Estimated tokens of a text: a quarter of its UTF-8 bytes, rounded up; null has none."""
    return F.coalesce(F.ceil(F.octet_length(text) / F.lit(4.0)), F.lit(0)).cast("long")


#: Steps that capacities per weight are cut into, of a 64th of a doubling each.
_STEPS = 64


def fill_siblings(children: DataFrame, parent: Sequence[str], budget: str) -> DataFrame:
    """Share each parent's ``budget`` among its children by ``weight``, each at most its
    ``capacity``; adds ``share`` (whole tokens).

    In rising order of capacity / weight a child is full if its fair part of what the
    children before it left is at least its capacity; the others share the rest by weight.
    Since fullness goes with that order, the order is looked at in steps first (a few
    thousand a parent at most), and children are ordered only within the one step in which it
    ends; so a parent may have any number of children."""
    by = [F.col(f"_p{i}") for i in range(len(parent))]
    rows = children.withColumns({f"_p{i}": F.col(p) for i, p in enumerate(parent)}) if parent else children.withColumn("_p0", F.lit(0))
    by = by or [F.col("_p0")]
    keys = [f"_p{i}" for i in range(max(1, len(parent)))]
    full_at = F.col("capacity") / F.col("weight")
    rows = rows.withColumns({"_full_at": full_at, "_step": F.floor(F.log2(full_at) * _STEPS).cast("int")})
    steps = rows.groupBy(*keys, "_step").agg(F.sum("capacity").alias("_cap"), F.sum("weight").alias("_w"), F.max("_full_at").alias("_top"), F.first(budget).alias("_b"))
    over = W.partitionBy(*keys)
    upto = over.orderBy("_step").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumns({"_used": F.coalesce(F.sum("_cap").over(upto), F.lit(0)), "_gone": F.coalesce(F.sum("_w").over(upto), F.lit(0.0)), "_all": F.sum("_w").over(over)})
    # a step is full as a whole if its last child is, with all before it full
    last = (F.col("_b") - F.col("_used") - F.col("_cap")) >= F.col("_top") * (F.col("_all") - F.col("_gone") - F.col("_w"))
    ends = steps.withColumn("_whole", last).filter(~F.col("_whole")).groupBy(*keys).agg(F.min(F.struct("_step", "_used", "_gone", "_all", "_b")).alias("_e"))
    ends = written(ends.select(*[F.col(k).alias(f"{k}e") for k in keys], *[F.col(f"_e.{c}").alias(f"_e{c}") for c in ("_step", "_used", "_gone", "_all", "_b")]), "fill-ends")
    placed = rows.join(ends, [F.col(k).eqNullSafe(F.col(f"{k}e")) for k in keys], "left")
    inside = placed.filter(F.col("_step") == F.col("_e_step"))
    before = W.partitionBy(*keys).orderBy("_full_at", "_child").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumns({"_u": F.col("_e_used") + F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_g": F.col("_e_gone") + F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    inside = inside.withColumn("_rate", (F.col("_e_b") - F.col("_u")) / F.greatest(F.col("_e_all") - F.col("_g"), F.lit(1e-300)))
    # the rate of the first child that is not full is common to all that are not; if all of the
    # step are full after all (its last one's test is rounded), that of the next step
    open_ = F.col("_full_at") > F.col("_rate")
    none = (F.col("_e_b") - F.max(F.col("_u") + F.col("capacity")).over(over)) / F.greatest(F.col("_e_all") - F.max(F.col("_g") + F.col("weight")).over(over), F.lit(1e-300))
    rates = inside.withColumn("_none", none).groupBy(*keys).agg(F.coalesce(F.max(F.when(open_, F.col("_rate"))), F.first("_none")).alias("_common"))
    rates = written(rates.select(*[F.col(k).alias(f"{k}r") for k in keys], "_common"), "fill-rates")
    out = rows.join(rates, [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys], "left")
    share = F.when(F.col("_common").isNull() | (F.col("_full_at") <= F.col("_common")), F.col("capacity")).otherwise(F.floor(F.col("weight") * F.col("_common") + F.lit(1e-6)))
    return out.withColumn("share", F.greatest(F.lit(0), F.least(F.col("capacity"), share)).cast("long")).select(*children.columns, "share")


def _weight(level: Column, weights: Mapping[str, float], default: float) -> Column:
    w = F.lit(float(default))
    for name, value in weights.items():
        w = F.when(level == F.lit(name), F.lit(float(value))).otherwise(w)
    return w


def leaf_budgets(
    rows: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, float]],
    *,
    budget_share: float = 0.5,
    max_epochs: int = 4,
) -> DataFrame:
    """One row a leaf: the levels, ``supply``, ``budget``.  ``rows`` has the levels and
    ``tokens``.  Weights are by level and name; names that are not listed weigh 1.

    The total is ``budget_share`` of all tokens.  The tree has one row for each source, so
    it is small, but it is never collected."""
    tree = rows.groupBy(*levels).agg(F.sum("tokens").alias("supply")).filter(F.col("supply") > 0)
    tree = tree.withColumn("capacity", F.col("supply") * max_epochs)
    tree = written(tree, "leaves")
    total = tree.agg(F.sum("supply").alias("n")).first()["n"] or 0  # one number
    nodes = tree.withColumn("_budget", F.floor(F.lit(total) * F.lit(float(budget_share))).cast("long"))
    for depth, level in enumerate(levels):
        last = depth == len(levels) - 1
        keys = list(levels[: depth + 1])
        own = nodes.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.first("_budget").alias("_budget"))
        own = own.withColumn("weight", _weight(F.col(level), weights.get(level, {}), 1.0)).filter(F.col("weight") > 0)
        own = own.withColumn("_child", F.coalesce(F.col(level), F.lit("")))
        shared = fill_siblings(own, list(levels[:depth]), "_budget")
        shared = shared.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("share").alias("_share"))
        joined = nodes.join(shared, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        nodes = joined.select(*levels, "supply", "capacity", F.col("_share").alias("budget" if last else "_budget"))
    return nodes.select(*levels, "supply", "budget")


def mix(
    rows: DataFrame,
    key: str,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, float]],
    *,
    budget_share: float = 0.5,
    max_epochs: int = 4,
    seed: int = 0,
) -> DataFrame:
    """Choose documents to the target weights: each row of ``rows`` (columns ``key``, the
    levels and ``tokens``; ``key`` stays stable between runs) as often as it is drawn, with
    ``epoch`` (from 0), in the columns of ``rows``; one of theirs that is called so becomes
    ``input_epoch``.

    Rows without tokens are never drawn.  Null levels are names of their own; a null key is
    hashed as the text ``null``.  Rows with equal hash order (repeated keys) are in or out
    together only as far as the running sum allows; their order then is by tokens, then by a
    hash of the whole row, so that equal runs give equal results."""
    used = {"epoch", "_h", "_block", "_whole", "_rest", "_last", "_left", "_run", "_sum", "_upto", "_end", *[f"_leaf_{c}{e}" for c in levels for e in ("", "_e")]}
    if not used & set(rows.columns):
        return _mixed(rows, key, levels, weights, budget_share, max_epochs, seed)
    # columns of names that are used here step aside until the end
    own = {key, "tokens", *levels}
    if clash := own & used:
        raise ValueError(f"key and levels may not be called {sorted(clash)}")
    apart = {c: f"_apart{i}" for i, c in enumerate(sorted(used & set(rows.columns)))}
    out = _mixed(rows.withColumnsRenamed(apart), key, levels, weights, budget_share, max_epochs, seed)
    back = {a: c for c, a in apart.items() if c != "epoch"}
    if "epoch" in apart:
        back[apart["epoch"]] = free_name(rows, "input_epoch")
    return out.withColumnsRenamed(back)


def _mixed(rows: DataFrame, key: str, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    rows = rows.filter(F.col("tokens") > 0)
    leaves = leaf_budgets(rows, levels, weights, budget_share=budget_share, max_epochs=max_epochs)
    leaves = leaves.withColumn("_whole", F.floor(F.col("budget") / F.col("supply")).cast("int"))
    leaves = leaves.withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("supply"))
    # written, so that its size is known and Spark itself decides whether to broadcast it
    leaves = written(leaves.select(*[F.col(c).alias(f"_leaf_{c}") for c in levels], "_whole", "_rest"), "leaves")
    same = [F.col(c).eqNullSafe(F.col(f"_leaf_{c}")) for c in levels]
    names = [f"_leaf_{c}" for c in levels]
    hashed = rows.join(leaves, same).withColumn("_h", md5_uint60(F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    hashed = hashed.withColumn("_block", F.floor(F.col("_h") / F.lit(_BLOCK_SPAN)).cast("int"))
    sums = hashed.groupBy(*names, "_block").agg(F.sum("tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = F.sum("_sum").over(W.partitionBy(*names).orderBy("_block"))
    # the block in which each leaf's prefix ends, and what is left of the budget there
    ends = (
        sums.withColumn("_upto", upto)
        .filter(F.col("_upto") > F.col("_rest"))
        .groupBy(*names)
        .agg(F.min(F.struct("_block", (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_left"))).alias("_end"))
    )
    ends = written(ends.select(*[F.col(n).alias(f"{n}_e") for n in names], F.col("_end._block").alias("_last"), F.col("_end._left").alias("_left")), "prefix-ends")
    placed = hashed.join(ends, [F.col(n).eqNullSafe(F.col(f"{n}_e")) for n in names], "left")
    kept = [F.col(c) for c in rows.columns]
    inside = placed.filter(F.col("_last").isNull() | (F.col("_block") <= F.col("_last")))
    edge = F.col("_last").isNotNull() & (F.col("_block") == F.col("_last"))
    running = F.sum("tokens").over(W.partitionBy(*names, "_block").orderBy("_h", "tokens", F.xxhash64(*kept)).rowsBetween(W.unboundedPreceding, 0))
    final = inside.filter(edge).withColumn("_run", running).filter(F.col("_run") <= F.col("_left"))
    prefix = inside.filter(~edge).select(*kept, F.col("_whole").alias("epoch")).unionByName(final.select(*kept, F.col("_whole").alias("epoch")))
    whole = hashed.filter(F.col("_whole") > 0).select(*kept, F.explode(F.sequence(F.lit(0), F.col("_whole") - 1)).alias("epoch"))
    return whole.unionByName(prefix)
