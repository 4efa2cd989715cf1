"""Approximate nearest neighbours over balanced posting lists.

Centroids come from k-means on a bounded sample; lists that get much more than their share of
it are split and those that get little are given up, until they are about even.  Every vector
enters the list of its nearest centroid; a vector near the boundary (other centroids within
``1 + CLOSE`` of the nearest distance) also enters up to ``REPLICAS - 1`` more lists.  Lists are
cut into pages of about ``PAGE`` vectors, so a full list is many small groups.

Centroids are searched by a neighbour graph in memory; a query reads all lists whose centroids
are within a ratio of its nearest.  That ratio is fitted: ``TRIALS`` vectors are held against
the whole table in one pass, and the ratio lets ``TARGET`` of their true neighbours through, so
recall is the same at every size.  The graph gives the first ``PROBES`` lists; where the last of
those is still within reach, the query is held against all centroids, so that their number is
never cut.  A query that finds too few answers is held against all lists.

Equal vectors are indexed once, with their smallest ids, and equal queries search once.
Distances of what is found are exact, in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.shared import written

#: Vectors that centroids and reach are fitted on: ``SAMPLE``, or ``A_LIST`` for each list.
SAMPLE, A_LIST = 20_000, 8
#: Vectors of a list, and the most lists; beyond their product lists grow with the table.
LIST, MOST_LISTS = 128, 16_384
REPLICAS, CLOSE = 3, 0.02
PROBES, LEAST_LISTS = 96, 8
#: Share of true neighbours that the fitted reach lets through, and how many vectors tell.
TARGET, TRIALS = 0.955, 256
PAGE, BLOCK = 1024, 512
DEGREE, ENTRIES = 24, 32
SALTS = 64


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    norm = (c * c).sum(1)
    return np.concatenate([np.argmin(norm - 2 * part @ c.T, 1) for part in np.array_split(x, max(1, len(x) * len(c) // (1 << 22)))])


def k_means(x: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """About ``n`` centroids with about equal shares of ``x``.  In each round but the last, the
    centroids with the smallest shares (below a third of the mean) move into the lists with the
    largest (above twice the mean), which they split."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for r in range(rounds):
        near = _nearest_of(x, c)
        count = np.bincount(near, minlength=n)
        order = np.argsort(near, kind="stable")
        begin = np.cumsum(count) - count
        full = np.flatnonzero(count)
        c[full] = np.add.reduceat(x[order], begin[full]) / count[full, None]
        if r == rounds - 1:
            break
        mean = len(x) / n
        large = np.flatnonzero(count > 2 * mean)
        large = large[np.argsort(-count[large], kind="stable")]
        small = np.flatnonzero(count < mean / 3)
        small = small[np.argsort(count[small], kind="stable")]
        for a, b in zip(small, large, strict=False):
            # a member far from the centroid takes half of its list
            own = order[begin[b] : begin[b] + count[b]]
            c[a] = x[own[((x[own] - c[b]) ** 2).sum(1).argmax()]]
        lost = small[len(large) :]
        lost = lost[count[lost] == 0]
        c[lost] = x[rng.choice(len(x), len(lost))]
    return np.unique(c, axis=0)


class Graph:
    """A graph of the centroids' nearest neighbours, with links both ways and a few fixed
    entries, searched best-first for many vectors at once."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids
        self.norm = (centroids * centroids).sum(1)
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        rng = np.random.default_rng(11)
        links: list[set[int]] = [set() for _ in range(n)]
        for a in range(0, n, 1024):
            d = self.norm - 2 * centroids[a : a + 1024] @ centroids.T
            near = np.argsort(d, 1)[:, : degree + 1]
            for i, row in enumerate(near.tolist()):
                links[a + i].update(j for j in row if j != a + i)
                links[a + i].add(int(rng.integers(n)))
        most = 2 * DEGREE
        for i in range(n):
            for j in list(links[i]):
                if len(links[j]) < most:
                    links[j].add(i)
        self.links = np.full((n, most), -1, np.int64)
        for i, own in enumerate(links):
            row = sorted(own - {i})[:most]
            self.links[i, : len(row)] = row
        self.entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.c, self.norm, self.links, self.entries

    @classmethod
    def of(cls, parts: tuple[np.ndarray, ...]) -> Graph:
        """A graph from its parts, which unlike the class itself can be broadcast anywhere."""
        out = cls.__new__(cls)
        out.c, out.norm, out.links, out.entries = parts
        return out

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found for each row of ``q`` (-1: none) and their
        distances, nearest first."""
        m, n = len(q), len(self.c)
        width = min(width, n)
        seen = np.zeros((m, n + 1), bool)
        rows = np.arange(m)[:, None]
        own = (q * q).sum(1)[:, None]

        def distances(ids: np.ndarray) -> np.ndarray:
            d = own + self.norm[ids] - 2 * np.einsum("md,mkd->mk", q, self.c[ids])
            d[ids < 0] = np.inf
            return d

        first = np.broadcast_to(self.entries, (m, len(self.entries)))
        seen[rows, first] = True
        ids = np.full((m, width + 1), -1, np.int64)
        dist = np.full((m, width + 1), np.inf)
        done = np.ones((m, width + 1), bool)

        def add(new: np.ndarray, d: np.ndarray) -> None:
            nonlocal ids, dist, done
            all_ids, all_d = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1)
            all_done = np.concatenate([done, new < 0], 1)
            top = np.argsort(all_d, 1, kind="stable")[:, :width]
            ids, dist, done = all_ids[rows, top], all_d[rows, top], all_done[rows, top]

        add(first, distances(first))
        while not done.all():
            # up to four open entries of each row at once
            open_ = np.where(done, np.inf, dist)
            take = np.argsort(open_, 1, kind="stable")[:, :4]
            real = ~done[rows, take]
            done[rows, take] = True
            new = self.links[np.where(real, ids[rows, take], 0)].reshape(m, -1)
            new = np.where(np.repeat(real, self.links.shape[1], 1), new, -1)
            new[seen[rows, new]] = -1
            # one row may be offered a centroid twice
            new = np.sort(new, 1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            seen[rows, new] = True
            seen[:, -1] = False
            new = new[:, np.any(new >= 0, 0)] if (new >= 0).any() else new[:, :1]
            add(new, distances(new))
        return ids, np.sqrt(np.maximum(dist, 0))


def posted(graph: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``x``, list) for each list that a vector enters."""
    ids, dist = graph.search(x, max(REPLICAS, 8))
    enters = (ids[:, :REPLICAS] >= 0) & (dist[:, :REPLICAS] <= dist[:, :1] * (1 + CLOSE) + 1e-12)
    row, at = np.nonzero(enters)
    return row, ids[row, at]


def fitted_reach(graph: Graph, q: np.ndarray, row: np.ndarray, near: np.ndarray, target: float = TARGET) -> float:
    """The least reach with which ``target`` of the true neighbours ``near`` (of the vectors ``row`` of
    ``q``) stand in a list that is read."""
    if not len(near):
        return 0.0
    which, to = posted(graph, near)
    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + graph.norm - 2 * q @ graph.c.T, 0))
    ratio = d / np.maximum(d.min(1, keepdims=True), 1e-12)
    own = np.full(len(near), np.inf)
    np.minimum.at(own, which, ratio[row[which], to])
    return float(np.quantile(own, target, method="higher")) - 1


def _nearest_to(sent, k: int):
    """(trial, key, score, embedding) of the ``k`` nearest in this task to each trial vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = sent.value
        held: list[tuple] = [(np.zeros(0), np.zeros((0, q.shape[1])), np.zeros(0, object))] * len(q)
        for batch in batches:
            for part in _parts(batch, 4096):
                x, keys = _matrix(part.column("embedding")), np.array(part.column("key").to_pylist(), object)
                far = (x * x).sum(1) - 2 * q @ x.T
                for i in range(len(q)):
                    far[i][keys == names[i]] = np.inf
                    top = np.argpartition(far[i], k - 1)[:k] if len(x) > k else np.arange(len(x))
                    top = top[far[i][top] < np.inf]
                    d, v, n = (np.concatenate([a, b]) for a, b in zip(held[i], (far[i][top], x[top], keys[top]), strict=True))
                    best = np.argsort(d, kind="stable")[:k]
                    held[i] = (d[best], v[best], n[best])
        for i, (d, v, n) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i, np.int32)), pa.array(n.tolist(), pa.string()), pa.array(d), _bytes(v)], ["trial", "key", "score", "embedding"])

    return run


def within_reach(graph: Graph, q: np.ndarray, reach: float, least: int = LEAST_LISTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, list, whether it is one of the row's ``least`` nearest) for each list that a
    query reads: those within ``1 + reach`` of its nearest, however many, and ``least`` of them,
    to hold an answer at all."""
    ids, dist = graph.search(q, PROBES)
    near = (ids >= 0) & (dist <= dist[:, :1] * (1 + reach) + 1e-12)
    more = np.flatnonzero(near[:, -1]) if ids.shape[1] < len(graph.c) else np.zeros(0, np.int64)
    near[:, :least] = ids[:, :least] >= 0
    near[more] = False
    row, at = np.nonzero(near)
    # MOST_LISTS distances a row at most
    d = (q[more] * q[more]).sum(1)[:, None] + graph.norm - 2 * q[more] @ graph.c.T
    d = np.sqrt(np.maximum(d, 0))
    far, to = np.nonzero(d <= d.min(1, keepdims=True) * (1 + reach) + 1e-12) if len(more) else (more, more)
    nearest = np.partition(d, least - 1, 1)[:, least - 1] if len(more) and d.shape[1] > least else np.full(len(more), np.inf)
    return np.concatenate([row, more[far]]), np.concatenate([ids[row, at], to]), np.concatenate([at < least, d[far, to] <= nearest[far]])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _parts(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _bytes(x: np.ndarray) -> pa.Array:
    """Vectors as bytes, which are read back without a value at a time."""
    return pa.array([r.tobytes() for r in x], pa.binary())


def _listed(sent, to, rows: int):
    """(list, first, and the columns given) for each list that ``to`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, reach = sent.value
        graph = Graph.of(parts)
        for batch in batches:
            for part in _parts(batch, rows):
                x = _matrix(part.column("embedding"))
                row, lists, first = to(graph, x, reach)
                part = part.set_column(part.schema.get_field_index("embedding"), "embedding", _bytes(x))
                # pieces, as a vector may be in very many lists
                for a in range(0, len(row), 8192):
                    b = slice(a, a + 8192)
                    out = part.take(pa.array(row[b]))
                    yield pa.RecordBatch.from_arrays([pa.array(lists[b].astype(np.int32)), pa.array(first[b]), *out.columns], ["list", "first", *out.schema.names])

    return run


def _enters(graph: Graph, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, to = posted(graph, x)
    return row, to, np.ones(len(row), bool)


_FOUND = "q_key string, key string, least long, score double"


def _compare(k: int):
    def run(queries: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(page):
            x = np.frombuffer(b"".join(page["embedding"]), np.float64).reshape(len(page), -1)
            q = np.frombuffer(b"".join(queries["q_embedding"]), np.float64).reshape(len(queries), -1)
            least = page["least"].to_numpy(np.int64)
            keys, asked = page["key"].to_numpy(), queries["q_key"].to_numpy()
            bound_of = queries["bound"].to_numpy(np.float64)
            rough = (x * x).sum(1) - 2 * q @ x.T
            for i in range(len(q)):
                some = np.arange(len(x))
                if len(x) > 4 * k:
                    bound = np.partition(rough[i], k - 1)[k - 1]
                    some = np.flatnonzero(rough[i] <= bound + 1e-9 * (1 + abs(bound)))
                exact = np.sqrt(((x[some] - q[i]) ** 2).sum(1))
                fine = exact <= bound_of[i]
                some, exact = some[fine], exact[fine]
                top = np.lexsort((least[some], exact))[:k]
                out.append((np.full(len(top), i), some[top], exact[top]))
        if not out:
            return pd.DataFrame({"q_key": [], "key": [], "least": np.zeros(0, np.int64), "score": np.zeros(0)})
        row, at, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"q_key": asked[row], "key": keys[at], "least": least[at], "score": score})

    return run


def _smallest(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def _answers(probes: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query (q_key) among the lists of ``probes``, as far as they are within
    its ``bound``."""
    # one row for each list, of which there are MOST_LISTS at most
    pages = posts.groupBy("list").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("pages"))
    blocks = probes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    plan = F.broadcast(written(pages.join(blocks, "list"), "lists"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(plan, "list").select("list", each("pages").alias("page"), F.pmod(F.xxhash64("q_key"), F.col("blocks")).cast("int").alias("block"), "q_key", "q_embedding", "bound")
    right = posts.join(plan, "list").select("list", F.pmod(F.xxhash64("key"), F.col("pages")).cast("int").alias("page"), each("blocks").alias("block"), "key", "embedding", "least")
    by = ["list", "page", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_compare(k), _FOUND)
    return written(_smallest(found.distinct(), ["q_key"], ["score", "least"], k), "answers")


def _best(probes: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query.  Its nearest lists come first; of the others only what is
    nearer than the last of those answers is reported at all."""
    endless = F.lit(float("inf"))
    first = _answers(probes.filter("first").withColumn("bound", endless), posts, k)
    bound = first.groupBy("q_key").agg(F.count("*").alias("n"), F.max("score").alias("bound")).filter(F.col("n") >= k).select("q_key", "bound")
    rest = probes.filter("not first").join(bound, "q_key", "left").withColumn("bound", F.coalesce("bound", endless))
    return written(_smallest(first.unionByName(_answers(rest, posts, k)).distinct(), ["q_key"], ["score", "least"], k), "answers")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, least_lists: int = LEAST_LISTS) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` (vec_id long, embedding array) to each row that
    ``is_query`` selects, but itself: query_id, rank (from 1), vec_id, score (Euclidean).

    Ties go to the smaller vec_id.  Null and zero vectors and those with null or non-finite
    components take no part, nor do rows without vec_id or vectors of another length than
    most.  Fewer candidates than ``k`` are all returned; an empty table gives no rows.  Other
    columns of ``vectors`` are not looked at."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == lengths[0]["n"])
    key = F.concat(F.hex(F.xxhash64("embedding")), F.lit("-"), F.hex(F.xxhash64(F.lit(7), "embedding")))
    keyed = written(rows.withColumn("key", key), "vectors")
    base = written(keyed.groupBy("key").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least")), "distinct")
    # the smallest ids of each distinct vector, in two steps against one very common vector
    salted = keyed.select("key", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).distinct()
    ids = _smallest(_smallest(salted, ["key", "salt"], ["vec_id"], k + 1), ["key"], ["vec_id"], k + 1).select("key", "vec_id")
    n = base.count()
    lists = int(min(MOST_LISTS, max(1, n // LIST)))
    wanted = max(SAMPLE, A_LIST * lists)
    # a share of the vectors by hash, somewhat more than is needed
    h = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    some = base.select("embedding", h.alias("h"), "key").filter(F.col("h") < F.lit(int(min(1.0, 1.2 * wanted / n + 0.001) * (1 << 30)))).orderBy("h", "key").limit(wanted).select("embedding").toArrow()
    sample = _matrix(some.column("embedding"))
    graph = Graph(k_means(sample.astype(np.float32), min(lists, max(1, len(sample) // 4))).astype(np.float64))
    # trials by another hash: of the sample as often as any vector is, since lists lie closer to its vectors
    h = F.xxhash64(F.lit(13), "key")
    trial = base.select("embedding", "key").orderBy(h, "key").limit(TRIALS).toArrow()
    trials, told = _matrix(trial.column("embedding")), trial.column("key").to_pylist()
    true = base.mapInArrow(_nearest_to(spark.sparkContext.broadcast((trials, told)), k), "trial int, key string, score double, embedding binary")
    true = _smallest(true, ["trial"], ["score", "key"], k).toPandas()  # TRIALS x k rows
    near = np.frombuffer(b"".join(true["embedding"]), np.float64).reshape(len(true), -1)
    reach = fitted_reach(graph, trials, true["trial"].to_numpy(np.int64), near)
    sent = spark.sparkContext.broadcast((graph.parts(), reach))
    posts = written(base.mapInArrow(_listed(sent, _enters, 1024), "list int, first boolean, key string, embedding binary, least long"), "postings")
    asked = keyed.filter("asks").groupBy("key").agg(F.first("embedding").alias("embedding"))
    named_query = lambda p: p.select("list", "first", F.col("key").alias("q_key"), F.col("embedding").alias("q_embedding"))
    probes = named_query(written(asked.mapInArrow(_listed(sent, lambda g, x, r: within_reach(g, x, r, least_lists), 256), "list int, first boolean, key string, embedding binary"), "probes"))
    best = _best(probes, posts, k + 1)
    enough = min(k + 1, n)
    met = best.groupBy("q_key").count().filter(F.col("count") >= enough)
    lacking = written(asked.join(met.select(F.col("q_key").alias("key")), "key", "left_anti"), "lacking")
    if not lacking.isEmpty():
        everywhere = named_query(lacking.mapInArrow(_listed(sent, _everywhere, 16), "list int, first boolean, key string, embedding binary"))
        rest = _best(written(everywhere, "probes"), posts, k + 1)
        best = best.join(lacking.select(F.col("key").alias("q_key")), "q_key", "left_anti").unionByName(rest)
    named = best.join(ids, "key").select("q_key", "vec_id", "score")
    named = _smallest(named, ["q_key"], ["score", "vec_id"], k + 1)
    queries = keyed.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("key").alias("q_key")).distinct()
    answers = queries.join(named, "q_key").filter("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _everywhere(graph: Graph, q: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(graph.c)
    return np.repeat(np.arange(len(q)), n), np.tile(np.arange(n), len(q)), np.zeros(len(q) * n, bool)
