"""Nearest neighbours by inner product with vantage-point trees, one for each shard of vectors.

Inner products become distances by one more coordinate: a vector of norm r gets sqrt(R*R - r*r), R the largest
norm, and a query gets 0; the nearest vector then has the largest inner product. A tree splits its vectors by
their distance to a vantage point. A query leaves out a subtree if the triangle inequality says that it holds
nothing nearer than what is found; the bound may be stretched by a factor, and factor one is exact search.

Vectors are dealt to shards by hash, queries to blocks by hash; every block meets every shard in a task of its
own. Shards and blocks have bounded sizes, so a task's memory does not grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelmint.llm.common import durable, table


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, vector) with one row for each id that is not null, the least of its vectors; without null, zero, or not finite ones."""
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


#: How far pruning is stretched and how many points a leaf has: the README gives recall and the share of pairs compared.
FACTOR, LEAF = 6.0, 64


class VpTree:
    """Points (rows, the last coordinate the added one). A node: (vantage point, inner part's greatest and outer part's least distance, inner, outer); a leaf: its number."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        self.points, self.leaf, self.rng, self.leaves = points, leaf, rng, []
        self.square = (points * points).sum(1)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> tuple | int:
        if len(rows) <= self.leaf:
            self.leaves.append(rows)
            return len(self.leaves) - 1
        vantage = self.points[rows[self.rng.integers(len(rows))]]
        d = np.sqrt(((self.points[rows] - vantage) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        return vantage, d[order[half - 1]], d[order[half]], self._build(rows[order[:half]]), self._build(rows[order[half:]])

    def search(self, queries: np.ndarray, k: int, factor: float, slack: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Pairs (query's row, point's row) that hold each query's k nearest found, and the share of all pairs that were compared.

        Each query first goes down to its own leaf, which bounds its k-th distance; then all queries walk the tree
        together, each leaving out the parts that the bound rules out, so that a leaf meets all its queries at once.
        A pair is kept while its distance is within the k-th found so far, plus the slack of its rounding, so points
        that tie at the end are all there.
        """
        self.best = np.full((len(queries), k), np.inf)
        self.reach, self.home = np.full(len(queries), np.inf), np.full(len(queries), -1)
        self.kept, self.slack, self.factor, self.compared = [], slack, factor, 0
        self.of_query = (queries * queries).sum(1)
        everyone = np.arange(len(queries))
        self._go_home(self.root, queries, everyone)
        self._visit(self.root, queries, everyone)
        q, p, d = (np.concatenate(x) for x in zip(*self.kept))
        last = d <= self.reach[q] + slack
        return q[last], p[last], self.compared / max(1, len(queries) * len(self.points))

    def _compare(self, leaf: int, queries: np.ndarray, some: np.ndarray) -> None:
        rows, k = self.leaves[leaf], self.best.shape[1]
        square = self.of_query[some][:, None] + self.square[rows][None] - 2 * queries[some] @ self.points[rows].T
        d = np.sqrt(np.maximum(square, 0))
        self.compared += d.size
        near = np.nonzero(d <= (self.reach[some] + self.slack)[:, None])
        self.kept.append((some[near[0]], rows[near[1]], d[near]))
        held = np.unique(near[0])
        better = np.partition(np.concatenate([self.best[some[held]], d[held]], 1), k - 1, 1)[:, :k]
        self.best[some[held]], self.reach[some[held]] = better, better[:, k - 1]

    def _go_home(self, node: tuple | int, queries: np.ndarray, some: np.ndarray) -> None:
        if isinstance(node, int):
            self.home[some] = node
            self._compare(node, queries, some)
            return
        vantage, inner_most, outer_least, inner, outer = node
        near = ((queries[some] - vantage) ** 2).sum(1) <= ((inner_most + outer_least) / 2) ** 2
        for part, group in ((inner, some[near]), (outer, some[~near])):
            if len(group):
                self._go_home(part, queries, group)

    def _visit(self, node: tuple | int, queries: np.ndarray, some: np.ndarray) -> None:
        if isinstance(node, int):
            some = some[self.home[some] != node]
            if len(some):
                self._compare(node, queries, some)
            return
        vantage, inner_most, outer_least, inner, outer = node
        d = np.sqrt(((queries[some] - vantage) ** 2).sum(1))
        for part, gap in ((inner, d - inner_most), (outer, outer_least - d)):
            group = some[gap * self.factor <= self.reach[some] + self.slack]
            if len(group):
                self._visit(part, queries, group)


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query_id, vec_id, score) of each query's k nearest found in a shard, ties to the smaller id, and the share of pairs compared."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    # equal vectors are one point with its smallest ids; one more than k, as a query may be among them
    _, one, same = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    by_point = np.argsort(same.ravel(), kind="stable")
    starts = np.searchsorted(same.ravel()[by_point], np.arange(len(one) + 1))
    distinct = vectors[one]
    # powers of two round nothing: squares of the shard's largest component, and of a query's far from it, neither overflow nor vanish
    size = lambda x: np.frexp(np.abs(x).max(-1, keepdims=True))[1]
    of_shard, of_query = int(size(distinct).max()), size(queries)
    scaled, aim = np.ldexp(distinct, -of_shard), np.ldexp(queries, -np.where(np.abs(of_query - of_shard) <= 64, of_shard, of_query))
    square = (scaled * scaled).sum(1)
    top = square.max()
    points = np.column_stack([scaled, np.sqrt(np.maximum(top - square, 0))])
    asked = np.column_stack([aim, np.zeros(len(queries))])
    # a distance is the root of a difference of squares: what rounding adds to it near 0 is the root of that of the squares
    slack = 1e-7 * float(np.sqrt(top + (aim * aim).sum(1).max()))
    q, p, compared = VpTree(points, leaf, np.random.default_rng(1)).search(asked, k + 1, factor, slack)
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.concatenate([np.zeros(0), *((distinct[p[a : a + 65_536]] * queries[q[a : a + 65_536]]).sum(1) for a in range(0, len(p), 65_536))])
    copies = np.minimum(starts[p + 1] - starts[p], k + 1)
    at = np.repeat(starts[p], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    q, score, vec = np.repeat(q, copies), np.repeat(score, copies), ids[by_point[at]]
    others = vec != query_ids[q]
    q, score, vec = q[others], score[others], vec[others]
    order = np.lexsort((vec, -score, q))
    q, score, vec = q[order], score[order], vec[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return query_ids[q[first]], vec[first], score[first], compared


def _searcher(k: int, factor: float, leaf: int) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """left: the shard's vectors; right: the block's queries."""
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(left) and len(right):
            take = lambda t: (t.column("id").to_numpy(), np.array(t.column("vector").combine_chunks().flatten()).reshape(len(t), -1))
            *out, _ = search_shard(*take(left), *take(right), k, factor, leaf)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out)))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, shard_rows: int = 16_384, query_rows: int = 4096, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest found, of vectors (id, vector, as of usable()).

    is_query: a condition on id. factor: how far pruning is stretched; 1 is exact. shard_rows, query_rows: vectors
    of a shard and queries of a block, about. leaf: vectors of a tree's leaf.

    score is the inner product in double precision, the nearest has the largest, ties go to the smaller id; the
    query itself is no candidate, its copies are. Vectors of other lengths than the query's are no candidates.
    Products beyond a double are infinite, or NaN where both signs are; NaN comes last.
    """
    vectors = durable(vectors.select("id", "vector", F.size("vector").alias("dims"), is_query.alias("asked")))
    n, queries = vectors.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    # columns of their own on each side, or the two sides of a cogroup could be taken for one another
    asked, vectors = (df.select(*[F.col(c).alias(c) for c in ("id", "vector", "dims")]) for df in (vectors.where("asked"), vectors))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-queries // query_rows))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("shard", F.pmod(F.xxhash64(F.lit(41), "id"), F.lit(shards)).cast("int")).withColumn("block", each(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
    key = ["dims", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searcher(k, factor, leaf), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("id") % 20 == 0)
