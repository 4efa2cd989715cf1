"""All pairs of documents with a shingle-set similarity of 0.75 or more, as components.

Exact: pairs are found by prefix filtering under several global orders of the shingles.
If two sets are that similar, then under *any* order each one's prefix (its first
``n - ceil(0.75 n) + 1`` shingles) holds a shingle of the other's prefix.

1. Equal sets are one node from the start.
2. Under one order, with shingles that many documents hold last, all prefixes are indexed.
   Prefixes of two similar sets share not just one shingle but a number that follows from
   their sizes (``_needed``), so pairs are counted, not only found.
3. The first shingle under each of ``ORDERS`` hash orders groups the nodes; each node is held
   against the smallest node of its groups.  That links most near copies with a few pairs
   a node, and never all pairs of a group.
4. What is left are pairs in different components so far that share enough of their indexed
   prefixes.  A round against the smallest component of each shingle comes first, so that
   large groups have become one component before pairs are listed.

Candidates are intersected with those of further orders.  The prefix under a second, independent
order travels as a map of ``BITS`` bits with each document, and pairs whose maps have no bit in
common are dropped in the join itself; of what is left, the prefixes under each order of
``FURTHER`` must have as many shingles in common as those of the index (``meet_under``), before
texts travel.  What passes is compared exactly, shingles told apart by 128 bits.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm import bloom
from heddle.llm.bytewords import SOLID, grams, mix, salted, shingle_sets, slices, words
from heddle.llm.shared import drop_table, written
from heddle.plans.components import connected_components

SHINGLE = 5
PERCENT = 75
ORDERS = 6
#: Most shingles that the index's order puts last, and the most a task reports of its own.
COMMON, COMMON_OF_TASK = 1 << 16, 1 << 14
_SLOTS, _FRESH = 1 << 20, 1 << 17
#: Of the map of a prefix under the second order.
BITS = 256
_MAPS = tuple(f"m{i}" for i in range(BITS // 64))
#: Further orders, under each of which the prefixes of a candidate must share enough.
FURTHER = (ORDERS + 2, ORDERS + 3)
_FURTHER = tuple(f"p{j}" for j in FURTHER)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


class _Counter:
    """Shingles that many of a task's documents hold, in a table of ``_SLOTS`` places.

    A place holds one shingle and a count; the same shingle adds to it, others of that place
    take from it, and who brings it below zero takes it over.  So a shingle stays that comes
    more often than all others of its place."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.fresh: list[np.ndarray] = []
        self.held = 0

    def add(self, s: np.ndarray) -> None:
        for a in range(0, len(s), _FRESH):
            self.fresh.append(s[a : a + _FRESH].copy())
            self.held += len(self.fresh[-1])
            if self.held >= _FRESH:
                self.merge()

    def merge(self) -> None:
        if not self.fresh:
            return
        keys, counts = np.unique(np.concatenate(self.fresh), return_counts=True)
        self.fresh, self.held = [], 0
        counts = counts.astype(np.int32)
        slot = (mix(keys) % np.uint64(_SLOTS)).astype(np.int32)
        # shingles of one place take turns
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            k, c, at = keys[first], counts[first], slot[first]
            left = self.counts[at] + np.where(self.keys[at] == k, c, -c)
            taken = left < 0
            self.keys[at[taken]] = k[taken]
            self.counts[at] = np.abs(left)
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, counts, slot = keys[rest], counts[rest], slot[rest]

    def most(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        often = np.flatnonzero(self.counts > 1)
        top = often[np.argsort(-self.counts[often], kind="stable")][:COMMON_OF_TASK]
        return self.keys[top], self.counts[top].astype(np.int64)


def prefix(s: np.ndarray, order: int) -> np.ndarray:
    """The prefix of a set of shingles under a hash order."""
    p = prefix_length(len(s)) if len(s) else 0
    return s[np.argpartition(salted(s, order), p - 1)[:p]] if p < len(s) else s


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


_SEEN = "doc_id long, n_shingles long, set_key binary, firsts array<long>, " + "".join(f"{m} long, " for m in _MAPS) + "shingle long, held long"


def _longs(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _map(s: np.ndarray) -> list[int]:
    """The prefix of a set under the second order, as a map of bits."""
    order, head = salted(s, ORDERS + 1), prefix_length(len(s))
    low = np.partition(order, head - 1)[:head] if len(s) else order
    bits = np.zeros(BITS, bool)
    bits[(mix(low) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (size, digest of the set, first shingles under the hash
    orders, map of the second order's prefix); at the end a row for each common shingle of
    this task."""
    names = ["doc_id", "n_shingles", "set_key", "firsts", *_MAPS, "shingle", "held"]
    arrays = pa.list_(pa.int64())
    common = _Counter()
    for batch in batches:
        for part in slices(batch, "text"):
            size, key, firsts, maps = [], [], [], []
            for s in shingle_sets(words(part.column("text"), SOLID), SHINGLE):
                size.append(len(s))
                key.append(_digest(s) if len(s) else None)
                firsts.append(_longs(np.array([s[np.argmin(salted(s, j))] for j in range(ORDERS)], np.uint64)) if len(s) else [])
                maps.append(_map(s))
                common.add(s)
            none = pa.nulls(part.num_rows, pa.int64())
            columns = [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(firsts, arrays), *[pa.array([m[i] for m in maps], pa.int64()) for i in range(len(_MAPS))], none, none]
            yield pa.RecordBatch.from_arrays(columns, names)
    keys, counts = common.most()
    n = len(keys)
    nothing = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary(), arrays, *[pa.int64()] * len(_MAPS))]
    yield pa.RecordBatch.from_arrays([*nothing, pa.array(keys.view(np.int64)), pa.array(counts)], names)


def _prefixes(sent, keyed: bool = False):
    """(shingle, doc_id, place) for the prefix of each text: rare shingles in hash order
    first, then the common ones, the commonest last; place counts from 1.  With ``keyed``
    the digest of the set as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                ids = np.asarray(part.column("doc_id"), np.int64)
                tokens, docs, places, digests = [], [], [], []
                for d, s in zip(ids, shingle_sets(words(part.column("text"), SOLID), SHINGLE), strict=True):
                    if not len(s):
                        continue
                    at = salted(s, ORDERS) >> np.uint64(1)
                    if len(keys):
                        near = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        late = keys[near] == s
                        at[late] = rank[near[late]]
                    p = prefix_length(len(s))
                    head = np.argpartition(at, p - 1)[:p] if p < len(s) else np.arange(len(s))
                    tokens.append(s[head[np.argsort(at[head])]])
                    docs.append(np.full(p, d, np.int64))
                    places.append(np.arange(1, p + 1, dtype=np.int32))
                    if keyed:
                        digests += [_digest(s)] * p
                if tokens:
                    columns = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(places))]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(digests, pa.binary())] * keyed], ["shingle", "doc_id", "place", *["set_key"] * keyed])

    return run


def _listed(sent):
    """The rows whose doc_id may be in the filter, with the size of their sets and their prefixes under
    the further orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = mix(np.asarray(batch.column("doc_id"), np.int64).view(np.uint64))
            held = batch.filter(pa.array(bloom.holds(sent.value, ids)))
            for part in slices(held, "text"):
                sets = list(shingle_sets(words(part.column("text"), SOLID), SHINGLE))
                prefixes = [pa.array([_longs(prefix(s, j)) for s in sets], pa.list_(pa.int64())) for j in FURTHER]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array([len(s) for s in sets], pa.int64()), *prefixes], ["doc_id", "text", "n", *_FURTHER])

    return run


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _wide_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text its distinct shingles by two hashes, as one array of 16-byte items."""
    column = pa.array(texts, pa.large_string())
    one, two = (words(column, SOLID, which) for which in (0, 1))
    out = []
    for a, b in zip(one.first[:-1].tolist(), one.first[1:].tolist(), strict=True):
        k = min(SHINGLE, b - a)
        both = np.stack([grams(x.hashes[a:b], k) for x in (one, two)], 1) if k else np.zeros((0, 2), np.uint64)
        out.append(np.unique(np.ascontiguousarray(both).view("V16").ravel()))
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose texts are similar enough.  Pairs of one text a follow each other, so
    its set is made once."""
    for batch in batches:
        for whole in slices(batch, "text_a"):
            for part in slices(whole, "text_b"):
                texts, where = {}, []
                for t in part.column("text_a").to_pylist():
                    where.append(texts.setdefault(t, len(texts)))
                left = list(shingle_sets(words(pa.array(list(texts), pa.large_string()), SOLID), SHINGLE))
                right = shingle_sets(words(part.column("text_b"), SOLID), SHINGLE)
                keep = np.array([_similar(left[i], y) for i, y in zip(where, right, strict=True)], bool)
                out = part.filter(pa.array(keep, pa.bool_()))
                # what 64 bits call similar is looked at with 128
                sure = [_similar(*_wide_sets([x, y])) for x, y in zip(out.column("text_a").to_pylist(), out.column("text_b").to_pylist(), strict=True)]
                yield out.select(["a", "b"]).filter(pa.array(sure, pa.bool_()))


def meet_under(pairs: DataFrame, sets: DataFrame, orders: Sequence[str] = _FURTHER) -> DataFrame:
    """Those of ``pairs`` whose prefixes share enough under each of ``orders``; ``sets``: doc_id, n, and
    the prefix under each order.  Several rows of a doc_id are versions, of which any may meet."""
    a, b = (sets.select(F.col("doc_id").alias(f"doc_{x}"), F.col("n").alias(f"n{x}"), *[F.col(o).alias(f"{o}{x}") for o in orders]) for x in "ab")
    # a is the least of many, so it is met first: what comes after needs pairs together by b only
    met = pairs.join(a, F.col("a") == F.col("doc_a")).join(b, F.col("b") == F.col("doc_b")).filter(_sizes_fit("na", "nb"))
    for o in orders:
        met = met.filter(F.size(F.array_intersect(f"{o}a", f"{o}b")) >= _needed("na", "nb"))
    return met.select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a table of a, b: ids in ``docs``) that are similar enough, written.

    Only documents in pairs are taken; a filter of fixed size leaves out the rest at the scan.  Pairs
    must meet under all further orders before texts travel."""
    spark = docs.sparkSession
    members = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    hashed = members.mapInArrow(_hash_ids, "key long")
    sent = spark.sparkContext.broadcast(bloom.build(hashed, "key"))
    # written, so that no task runs Python for both sides and for the comparison at once
    held = docs.select("doc_id", "text").mapInArrow(_listed(sent), "doc_id long, text string, n long, " + ", ".join(f"{o} array<long>" for o in _FURTHER))
    texts = written(held, "pair-texts")
    met = written(meet_under(pairs, texts), "met")
    a, b = (texts.select(F.col("doc_id").alias(f"doc_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    with_b = met.join(b, F.col("b") == F.col("doc_b")).select("a", "b", "text_b")
    with_both = with_b.join(a, F.col("a") == F.col("doc_a")).select("a", "b", "text_a", "text_b")
    links = written(with_both.mapInArrow(_linked, "a long, b long").distinct(), "links")
    drop_table(texts)
    return links


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(np.asarray(batch.column(0), np.int64).view(np.uint64)).view(np.int64))], ["key"])


def _sizes_fit(n: str, m: str) -> F.Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _needed(n: str, m: str) -> F.Column:
    """How many shingles the prefixes of two similar enough sets have in common at least.

    The sets share ``o = ceil(3 (n + m) / 7)`` shingles or more.  The k-th of those, in the
    index's order, stands at place ``k + n - o`` of a set of n at the latest, so both
    prefixes hold the first k for every k up to ``o - (n - prefix)``."""
    return F.expr(f"(3 * ({n} + {m}) + 6) div 7 - (3 * greatest({n}, {m}) + 3) div 4 + 1")


def _maps_meet(a: str, b: str) -> F.Column:
    """Whether two maps, with columns named by ``a`` and ``b``, have a bit in common."""
    both = [F.col(f"{a}{m}").bitwiseAND(F.col(f"{b}{m}")) for m in _MAPS]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), both) != 0


def _prefixes_meet(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose prefixes share enough under the index's order, and whose maps
    meet; ``heads``: doc_id, n, maps, head."""
    a, b = (heads.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("head").alias(f"h{x}"), *[F.col(m).alias(f"{x}{m}") for m in _MAPS]) for x in "ab")
    met = pairs.join(a, "a").join(b, "b")
    return met.filter(_sizes_fit("na", "nb") & _maps_meet("a", "b") & (F.size(F.array_intersect("ha", "hb")) >= _needed("na", "nb"))).select("a", "b")


def _cross(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct pairs of a node of ``rows`` and one of ``others``, in different components, that
    share a shingle early enough: of sets that share ``o`` shingles or more, the first one
    stands at place ``n - o + 1`` at the latest in a set of n.

    The smaller set of a pair comes from its first seventh, and sizes are cut in steps of
    somewhat more than a third, so that a common shingle is joined only within two steps."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT + 0.01))).cast("int")
    early = F.greatest(F.col("pa") - F.col("na"), F.col("pb") - F.col("nb")) <= F.expr("1 - (3 * (na + nb) + 6) div 7")

    def half(small: DataFrame, large: DataFrame) -> DataFrame:
        x = small.filter(F.expr("place <= n - (6 * n + 6) div 7 + 1")).select("shingle", step.alias("step"), F.col("doc_id").alias("da"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("place").alias("pa"), *[F.col(m).alias(f"a{m}") for m in _MAPS])
        y = large.select("shingle", F.explode(F.array(step, step - 1)).alias("step"), F.col("doc_id").alias("db"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"), *[F.col(m).alias(f"b{m}") for m in _MAPS])
        met = x.join(y, ["shingle", "step"]).filter((F.col("ca") != F.col("cb")) & F.expr("struct(na, da) < struct(nb, db)") & _sizes_fit("na", "nb") & early & _maps_meet("a", "b"))
        return met.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"))

    pairs = half(rows, others) if rows is others else half(rows, others).unionByName(half(others, rows))
    return pairs.distinct()


def _commonest(held: DataFrame) -> np.ndarray:
    """Of ``held`` (shingle, held) the shingles of the largest counts, ``COMMON`` at most, the
    commonest first.  Counts are cut in steps, so that no more than that reach the driver."""
    step = F.floor(F.log2("held") * 8).cast("int")
    steps = sorted(((r[0], r[1]) for r in held.groupBy(step.alias("s")).count().collect()), reverse=True)  # 64 * 8 rows at most
    least, room = None, COMMON
    for s, n in steps:
        if n > room:
            break
        least, room = s, room - n
    if least is None:
        return np.zeros(0, np.uint64)
    top = held.filter(step >= least).toPandas().sort_values(["held", "shingle"], ascending=[False, True])
    return top["shingle"].to_numpy(np.int64).view(np.uint64)


def components(docs: DataFrame, *, rounds: int = 1) -> DataFrame:
    """For each row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id.

    Null and empty texts and texts without words have no shingles and are linked with
    nothing.  Rows of one doc_id count as one document whose versions are linked.  Rows
    without doc_id take no part; their component_id is null.  An empty table gives an
    empty result."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = written(texts.mapInArrow(_profile, _SEEN), "profile")
    seen_rows = seen.filter(F.col("shingle").isNull())
    rows = written(seen_rows.select("doc_id", "n_shingles"), "sizes")
    # 1. equal sets
    nodes = seen_rows.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    # written first, so that the join deals out a set with very many copies anew
    held = written(nodes.groupBy("set_key").agg(F.min("doc_id").alias("node")), "sets")
    member = written(nodes.join(held, "set_key").select("doc_id", "node", F.col("n_shingles").alias("n"), "firsts", *_MAPS, "set_key"), "members")
    copies = member.filter("doc_id <> node").select("doc_id", "node")
    first = member.filter("doc_id = node").drop("node")
    unique = texts.filter(F.col("doc_id").isNotNull())
    # 2. the index
    common = seen.filter(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("held").alias("held"))
    keys = _commonest(written(common, "common"))
    drop_table(seen)
    rank = np.uint64((1 << 64) - 1) - np.arange(len(keys), dtype=np.uint64)
    at = np.argsort(keys)
    sent = docs.sparkSession.sparkContext.broadcast((keys[at], rank[at]))
    copied = written(copies.select("doc_id").distinct(), "copies")
    columns = "shingle long, doc_id long, place int"
    index = unique.join(copied, "doc_id", "left_anti").mapInArrow(_prefixes(sent), columns)
    # documents that are a copy in one version and the node of another: only the latter
    owned = written(first.join(copied, "doc_id", "left_semi").select("doc_id", "set_key").distinct(), "owned")
    mixed = unique.join(owned.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_prefixes(sent, True), f"{columns}, set_key binary")
    index = index.unionByName(mixed.join(owned, ["doc_id", "set_key"], "left_semi").drop("set_key"))
    index = written(index, "index")
    # counts combine before the shuffle, so a shingle of very many documents is a row a task
    several = written(index.groupBy("shingle").count().filter("count > 1").select("shingle"), "several")
    shared = written(index.join(several, "shingle", "left_semi"), "shared")
    drop_table(index)
    # a document may be the node of several of its versions
    sizes = first.select("doc_id", "n", *_MAPS).distinct()
    heads = written(shared.groupBy("doc_id").agg(F.collect_set("shingle").alias("head")).join(sizes, "doc_id"), "heads")
    # 3. first shingles under several orders
    spread = first.select("doc_id", F.posexplode("firsts").alias("order", "shingle"))
    least = spread.groupBy("order", "shingle").agg(F.min("doc_id").alias("a"), F.count("*").alias("count")).filter("count > 1")
    pairs = spread.join(least, ["order", "shingle"]).filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    links = verified(written(_prefixes_meet(pairs, heads), "pairs"), unique)
    # 4. what is left between components
    for left in range(rounds, -1, -1):
        found = connected_components(links)
        placed = shared.join(sizes, "doc_id").join(found, F.col("doc_id") == F.col("node"), "left").select("shingle", "doc_id", "n", "place", *_MAPS, F.coalesce("component", "doc_id").alias("component"))
        open_ = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("shingle", "lo")
        placed = written(placed.join(open_, "shingle"), "open")
        if left:
            # one node of each component, against one of the shingle's smallest component
            per = placed.groupBy("shingle", "lo", "component").agg(F.min(F.struct("doc_id", "n", "place", *_MAPS)).alias("x")).select("shingle", "lo", "component", "x.*")
            pairs = _cross(per.filter("component = lo"), per.filter("component <> lo"))
        else:
            pairs = _cross(placed, placed)
        pairs = _prefixes_meet(pairs, heads)
        links = written(links.unionByName(verified(written(pairs, "pairs"), unique)), "links")
    versions = member.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    # versions of one doc_id, and copies, hang together through the node
    found = connected_components(links.unionByName(versions))
    out = rows.join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest document of their group; texts that link
    with nothing stay.  Of wholly repeated rows one stays."""
    gone = components(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(written(gone, "near-copies"), "doc_id", "left_anti").select(*docs.columns)
    again = left.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = written(again, "repeated")
    once = left.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates())
