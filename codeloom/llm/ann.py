"""Approximate nearest neighbours by inner product, with balanced posting lists.

Vectors get one component more, so that the largest inner product is the least
distance; queries are stretched to the greatest length, which changes no order.
Balanced splits of a bounded sample give the centroids. A graph links each
centroid to near ones and to some far ones; a walk starts at a few and goes on
from every centroid that is within a ratio of the nearest one's distance or
among the nearest ones so far. Every vector goes to the list of its nearest
centroid, and a boundary vector also to the lists whose centroids are about as
near. A query reads all lists that the walk finds within its ratio, and no
others; that ratio is learned: it is the one under which sample vectors find
``RECALL`` of their nearest in the sample, who are farther than those in the
table. Scores are computed in double precision on the original vectors.

A query reads its nearest lists first. Of the others it takes only what is no
worse than its k-th best so far, so few rows leave a list, and none that could
be among the nearest is lost.

Equal vectors are one entry in the index, with the ids that can appear in a
result, so a vector that a third of all rows share costs one row a task. Each list
and the queries on it are cut into blocks of bounded size.

Rows with a null id, and vectors that are null, empty, zero, of another length
than most, or hold null or non-finite components take no part. Repeated rows of
an id and vector count once. Ties go to the smaller id. Other columns of the
table are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import columns, hashed_sample, map_rows, shared
from codeloom.session import materialize

#: Vectors of the sample, vectors for each list, and the most lists.
SAMPLE, LIST, LISTS = 20_000, 256, 2_500
#: Lists that a vector may be in, and how much farther than the nearest they may be.
REPLICAS, REPLICA_RATIO = 4, 1.05
#: Share of their nearest that sample vectors must find under a query's ratio, and how many of them are tried.
RECALL, TRIED = 0.95, 400
#: Lists that a query reads first.
FIRST = 4
#: Near and far links of a centroid, starts of a walk, and the nearest ones from which it always goes on.
NEAR, FAR, STARTS, BEAM = 24, 8, 4, 16
#: Vectors of a list, and queries on it, that are compared in one group.
BLOCK, QUERIES = 8192, 32_768
SEED = 5


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles), once for each id and vector."""
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = columns(rows, vec_id=vec_id, v=vector).withColumn("v", v.cast("array<double>"))
    some = given.where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists(v, lambda x: x != 0)
    )
    lengths = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return some.where(F.size("v") == (lengths["n"] if lengths else 0)).dropDuplicates(["vec_id", "v"])


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    ratio: float = 1.0

    def lists(self, x: np.ndarray, ratio: float) -> list[np.ndarray]:
        """The centroids that a walk finds within ``ratio`` of the nearest one's distance, nearest first."""
        return [one for i in range(0, len(x), 256) for one in self._walk(x[i : i + 256], ratio)]

    def _walk(self, x: np.ndarray, ratio: float) -> list[np.ndarray]:
        count = len(self.centroids)
        far = np.full((len(x), count), np.inf)
        gone = np.zeros(far.shape, bool)
        beam = min(BEAM, count) - 1
        new = np.zeros(far.shape, bool)
        new[:, np.linspace(0, count - 1, STARTS).astype(int)] = True
        while new.any():
            at, c = np.nonzero(new)
            for i in range(0, len(at), 8192):
                a, b = at[i : i + 8192], c[i : i + 8192]
                far[a, b] = np.sqrt(((self.centroids[b] - x[a]) ** 2).sum(axis=1))
            edge = np.partition(far, beam, axis=1)[:, beam]
            bound = np.maximum(np.where(np.isfinite(edge), edge, far.max(axis=1, where=np.isfinite(far), initial=0)), ratio * far.min(axis=1))
            at, c = np.nonzero((far <= bound[:, None]) & ~gone)
            gone[at, c] = True
            new[:] = False
            new[at[:, None], self.graph[c]] = True
            new &= np.isinf(far)
        out = []
        for row, limit in zip(far, ratio * far.min(axis=1) + 1e-12):
            found = np.flatnonzero(row <= limit)
            out.append(found[np.argsort(row[found], kind="stable")])
        return out

    def postings(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of vectors."""
        return [one[:REPLICAS] for one in self.lists(lifted(x, self.norm), REPLICA_RATIO)]

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that queries read."""
        return self.lists(self.stretched(x), self.ratio)

    def stretched(self, x: np.ndarray) -> np.ndarray:
        x = x * (self.norm / np.sqrt((x**2).sum(axis=1, keepdims=True)))
        return np.hstack([x, np.zeros((len(x), 1))])

    def learned_ratio(self, x: np.ndarray, k: int) -> float:
        """The ratio under which the first ``TRIED`` of the vectors find ``RECALL`` of their ``k`` nearest."""
        tried, n = x[:TRIED], min(k, len(x) - 1)
        if not n:
            return 1.0
        score = tried @ x.T
        np.fill_diagonal(score, -np.inf)
        nearest = np.argpartition(-score, n - 1, axis=1)[:, :n]
        width = min(REPLICAS, len(self.centroids))
        lists = np.array([np.resize(one, width) for one in self.postings(x)])
        q = self.stretched(tried)
        square = (self.centroids**2).sum(axis=1) - 2 * q @ self.centroids.T + (q**2).sum(axis=1, keepdims=True)
        far = np.sqrt(np.maximum(square, 0))
        far /= np.maximum(far.min(axis=1, keepdims=True), 1e-12)
        needed = far[np.arange(len(q))[:, None, None], lists[nearest]].min(axis=2)
        return float(np.quantile(needed, RECALL, method="higher"))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """With the component that makes all norms equal."""
    return np.hstack([x, np.sqrt(np.maximum(0, norm**2 - (x**2).sum(axis=1, keepdims=True)))])


def centroids_of(x: np.ndarray, size: int) -> np.ndarray:
    """Halves, each time at the median between two centres, until parts have at most ``size`` points."""
    rng, todo, out = np.random.default_rng(SEED), [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(x[part].mean(axis=0))
            continue
        p = x[part]
        a, b = p[rng.choice(len(p), 2, replace=False)]
        for _ in range(6):
            side = ((p - a) ** 2).sum(axis=1) - ((p - b) ** 2).sum(axis=1)
            order = np.argsort(side, kind="stable")
            half = len(p) // 2
            a, b = p[order[:half]].mean(axis=0), p[order[half:]].mean(axis=0)
        todo += [part[order[:half]], part[order[half:]]]
    return np.array(out)


def graph_of(c: np.ndarray) -> np.ndarray:
    """Links of each centroid: the nearest ones, and some at random so that the graph hangs together."""
    rng, n = np.random.default_rng(SEED), len(c)
    near = []
    for i in range(0, n, 256):
        d = ((c[i : i + 256, None] - c[None]) ** 2).sum(axis=2)
        near.append(np.argsort(d, axis=1, kind="stable")[:, 1 : NEAR + 1])
    near = np.concatenate(near)
    following = ((np.arange(n) + 1) % n)[:, None]
    return np.hstack([near, following, rng.integers(0, n, (n, FAR))])


def build(distinct: DataFrame, k: int = 20) -> Index | None:
    """From at most ``SAMPLE`` distinct vectors, those with the smallest hashes; None without any."""
    n, norm = distinct.agg(F.count(F.lit(1)), F.max(_norm())).first()
    if not n:
        return None
    rows = hashed_sample(distinct.select("v", "key"), SAMPLE, "v", "key").collect()
    x = np.array([r["v"] for r in rows])
    c = centroids_of(lifted(x, norm), max(1, -(-len(x) // min(LISTS, max(1, n // LIST)))))
    index = Index(c, graph_of(c), norm)
    index.ratio = index.learned_ratio(x, k)
    return index


def _norm() -> Column:
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def _lists(df: DataFrame, index: Index, query: bool) -> DataFrame:
    """Rows ``key, v, lists`` with the lists that vectors are in, or that queries read, nearest first."""
    held = shared(df, index)

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        while rows := list(islice(it, 2048)):
            x = np.array([r[1] for r in rows])
            lists = held.value.probes(x) if query else held.value.postings(x)
            yield from ((key, v, one.tolist()) for (key, v), one in zip(rows, lists))

    return map_rows(df.select("key", "v"), run, "key long, v array<double>, lists array<int>")


def _blocked(df: DataFrame, own: str, other: str, sizes: DataFrame) -> DataFrame:
    """Each row in its block of each list, once for each block of the other side there.

    ``sizes`` has a row for each list, of which there are at most ``LISTS``.
    """
    rows = df.withColumn("list", F.explode("lists")).drop("lists").join(F.broadcast(sizes), "list")
    rows = rows.withColumn(own, F.pmod(F.xxhash64("key"), F.col(own + "s")).cast("int"))
    rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(other + "s") - 1).cast("int"))))
    return rows.drop("blocks", "query_blocks")


def _sizes(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """``list, blocks, query_blocks``: how many blocks each list's vectors and queries make; none without both."""

    def blocks(df: DataFrame, most: int, name: str) -> DataFrame:
        counts = df.select(F.explode("lists").alias("list")).groupBy("list").count()
        return counts.select("list", F.ceil(F.col("count") / most).alias(name))

    return blocks(postings, BLOCK, "blocks").join(blocks(probes, QUERIES, "query_blocks"), "list")


def _compared(probes: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``q, key, score``: the ``k`` best of each list that a query reads, those no worse than its ``least``."""
    sizes, at = _sizes(postings, probes), ["list", "block", "query_block"]
    asked = _blocked(probes, "query_block", "block", sizes).groupBy(*at)
    held = _blocked(postings, "block", "query_block", sizes).groupBy(*at)
    found = asked.cogroup(held).applyInArrow(_pair_blocks(k), "q long, key long, score double")
    return found.groupBy("q", "key").agg(F.max("score").alias("score"))


def _pair_blocks(k: int):
    def run(key: tuple, q: pa.Table, p: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not (q.num_rows and p.num_rows):
            return empty
        qs, ps = (np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (q, p))
        qk, pk, parts = q.column("key").to_numpy(), p.column("key").to_numpy(), []
        least = q.column("least").to_numpy()
        n = min(len(pk), k + 16)
        for i in range(0, len(qs), 256):
            block = qs[i : i + 256]
            rough = block @ ps.T
            best = np.argpartition(-rough, n - 1, axis=1)[:, :n] if n < len(pk) else np.tile(np.arange(n), (len(block), 1))
            exact = (block[:, None] * ps[best]).sum(axis=2)
            top = np.lexsort((pk[best], -exact), axis=1)[:, :k]
            score = np.take_along_axis(exact, top, 1)
            good = score >= least[i : i + 256, None]
            own = np.broadcast_to(qk[i : i + 256, None], top.shape)
            parts.append((own[good], np.take_along_axis(pk[best], top, 1)[good], score[good]))
        cells = [np.concatenate(c) for c in zip(*parts)]
        return pa.table(dict(zip(["q", "key", "score"], cells)))

    return run


def search(rows: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best found for the rows where ``queries`` (on vec_id) holds."""
    given = materialize(usable(rows, vec_id, vector), "vectors")
    few = Window.partitionBy("v").orderBy("vec_id")
    first = given.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    distinct = first.groupBy("v").agg(F.min("vec_id").alias("key"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = materialize(distinct, "distinct-vectors")
    asked = given.where(queries).join(distinct.select("v", "key"), "v")
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), "key", "v"), "queries")
    index = build(distinct, k)
    if index is None:
        return given.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        ).where(F.lit(False))
    per_key = asked.dropDuplicates(["key"])
    postings = materialize(_lists(distinct, index, False), "postings")
    probes = materialize(_lists(per_key, index, True), "probes")
    none = F.lit(float("-inf"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    near = _compared(probes.withColumn("lists", F.slice("lists", 1, FIRST)).withColumn("least", none), postings, k + 1)
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    near = materialize(near, "near")
    least = near.where(F.col("n") == k + 1).select(F.col("q").alias("key"), F.col("score").alias("least"))
    others = F.expr(f"slice(lists, {FIRST + 1}, greatest(size(lists) - {FIRST}, 0))")
    rest = probes.withColumn("lists", others).where(F.size("lists") > 0).join(least, "key", "left")
    rest = _compared(rest.withColumn("least", F.coalesce("least", none)), postings, k + 1)
    found = near.drop("n").unionByName(rest).groupBy("q", "key").agg(F.max("score").alias("score"))
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    named = found.join(distinct.select("key", "ids"), "key")
    entries = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))))
    tops = named.groupBy(F.col("q").alias("key")).agg(F.slice(F.array_sort(entries), 1, k + 1).alias("top"))
    own = F.filter("top", lambda t: t["i"] != F.col("query_id"))
    return (
        asked.select("query_id", "key")
        .join(tops, "key")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "t"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.i").alias("vec_id"), (-F.col("t.s")).alias("score"))
    )
