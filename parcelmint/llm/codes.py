"""Compression of vectors to codes: a vector is cut into parts, each told by its nearest entry in the part's codebook.

Codebooks are learned in rounds. In each, the codebooks go to all tasks as kd-trees (parts x entries, a fixed size);
a task finds its parts' nearest entries and sums the parts of every entry; the sums, whole numbers, are added in a
shuffle by part and entry, and the driver divides as many sums as there are entries.

A tree is searched by branch and bound for a batch at once. A node is left out only if its bound is above the
best distance found: a node at an equal bound may hold an entry of lower index that ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.llm.common import commonest_length, durable, finite, lean, matrix, small, table, whole

#: A component becomes floor(SCALE * c).
SCALE = 256
#: Beyond this a squared distance may not fit in 64 bits: such batches are worked out in whole numbers of any size.
NARROW = 1 << 27
_LEAF = 8


class KdTree:
    """Entries (rows of whole numbers) split at the median of their widest dimension; each node keeps its box."""

    def __init__(self, entries: np.ndarray, leaf: int = _LEAF) -> None:
        self.entries, self.leaf = entries, leaf
        self.root = self._build(np.arange(len(entries)))

    def _build(self, rows: np.ndarray) -> tuple:
        """(lowest corner, highest corner, leaf's rows or None, dimension, cut, lower, upper)."""
        points = self.entries[rows]
        low, high = points.min(0), points.max(0)
        axis = int(np.argmax(high - low))
        if len(rows) <= self.leaf or high[axis] == low[axis]:
            return low, high, rows, None, None, None, None
        order = rows[np.argsort(points[:, axis], kind="stable")]
        half = len(order) // 2
        cut = self.entries[order[half], axis]
        # rows of a leaf stay in the order of their indexes
        return low, high, None, axis, cut, self._build(np.sort(order[:half])), self._build(np.sort(order[half:]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest entry, ties to the lower index, and the squared distance."""
        self.points = points
        self.index = np.full(len(points), len(self.entries), np.int64)
        self.best = np.zeros(len(points), points.dtype)
        self.home = np.zeros(len(points), bool)
        everyone = np.arange(len(points))
        self._descend(self.root, everyone)
        self._visit(self.root, everyone)
        return self.index, self.best

    def _compare(self, rows: np.ndarray, some: np.ndarray) -> None:
        d = ((self.points[some][:, None] - self.entries[rows][None]) ** 2).sum(2)
        at = d.argmin(1)
        d, index = d[np.arange(len(some)), at], rows[at]
        first = self.index[some] == len(self.entries)
        better = first | (d < self.best[some]) | ((d == self.best[some]) & (index < self.index[some]))
        better = better.astype(bool)
        self.best[some[better]], self.index[some[better]] = d[better], index[better]

    def _descend(self, node: tuple, some: np.ndarray) -> None:
        """Every point goes down to the leaf on its side of the cuts, which gives a first bound."""
        _, _, rows, axis, cut, lower, upper = node
        if rows is not None:
            self._compare(rows, some)
            return
        below = (self.points[some, axis] < cut).astype(bool)
        for child, part in ((lower, some[below]), (upper, some[~below])):
            if len(part):
                self._descend(child, part)

    def _visit(self, node: tuple, some: np.ndarray) -> None:
        """All points walk down together; a point leaves where the box is farther than its best."""
        low, high, rows, _, _, lower, upper = node
        p = self.points[some]
        gap = np.maximum(np.maximum(low - p, p - high), 0)
        some = some[((gap * gap).sum(1) <= self.best[some]).astype(bool)]
        if not len(some):
            return
        if rows is not None:
            self._compare(rows, some)
            return
        self._visit(lower, some)
        self._visit(upper, some)


def assign(trees: list[KdTree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts): the nearest entries' indexes and the squared distances of vectors."""
    parts = np.split(x, len(trees), axis=1)
    found = [tree.nearest(part) for tree, part in zip(trees, parts)]
    return np.column_stack([i for i, _ in found]), np.column_stack([d for _, d in found])


def _trees(books: np.ndarray, x: np.ndarray) -> tuple[list[KdTree], np.ndarray]:
    """Trees of the codebooks (parts, entries, width), and x, in numbers wide enough for both."""
    wide = max(int(np.abs(books).max(initial=0)), int(np.abs(x).max(initial=0))) > NARROW
    kind = object if wide else np.int64
    return [KdTree(book.astype(kind)) for book in books], x.astype(kind)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over rows (x array of long)."""
    parts, entries, width = books.shape
    dims = parts * width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), object)
        for batch in batches:
            trees, x = _trees(books, matrix(batch.column("x"), dims))
            index, _ = assign(trees, x)
            at = (index + np.arange(parts) * entries).ravel()
            some = np.zeros(total.shape, object if int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62 else x.dtype)
            np.add.at(some, at, x.reshape(-1, width))
            count += np.bincount(at, minlength=len(count))
            total = total + some.astype(object)
        used = np.flatnonzero(count)
        columns = {f"t{i}": pa.array([int(v) for v in total[used, i]], pa.decimal128(38)) for i in range(width)}
        yield pa.record_batch({"entry": pa.array(used.astype(np.int32)), "n": pa.array(count[used]), **columns})

    kind = "entry int, n long, " + ", ".join(f"t{i} decimal(38,0)" for i in range(width))
    found = rows.select("x").mapInArrow(lean(sums), kind).groupBy("entry").agg(F.sum("n"), *[F.sum(f"t{i}") for i in range(width)])
    flat = books.reshape(-1, width).copy()
    for entry, n, *total in found.collect():  # one row for each entry at most
        flat[entry] = [int(t) // n for t in total]
    return flat.reshape(books.shape)


def learned(rows: DataFrame, id_: str, dims: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width): begun with the vectors of the smallest ids, then improved."""
    first = rows.orderBy(F.col(id_).asc_nulls_last(), "x").limit(entries).collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = improved(rows, books)
    return books


def compress(vectors: DataFrame, id_: str, vector: str, label: str, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) for each row of vectors, and the codebooks (parts, entries, width).

    Rows whose vector is null, empty or holds null or not finite components go, as do vectors of another length than
    the commonest (of equally common ones the shorter); that length must be a multiple of parts. Repeated rows are
    all coded; a null id comes last among those that begin the codebooks, of equal ids the least vector is first.
    Fewer rows than entries give as many entries. Components beyond 2**53 in whole numbers stay at it; error is
    null beyond a long. An empty table gives no rows and no entries. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(finite(F.col("v")) & (F.size("v") > 0)).select("id", "label", whole(F.col("v"), SCALE).alias("x"))
    kind = f"id {vectors.schema[id_].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}, code string, error long"
    dims = commonest_length(rows, "x")
    if dims is None:
        return vectors.sparkSession.createDataFrame([], kind), np.zeros((parts, 0, 0), np.int64)
    if dims % parts:
        raise ValueError(f"vectors of length {dims} cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("x") == dims)
    books = learned(rows, "id", dims, parts, entries, rounds)
    digits = np.array([f"{k:02x}" for k in range(max(256, books.shape[1]))])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, x = _trees(books, matrix(batch.column("x"), dims))
            index, d = assign(trees, x)
            error = [int(e) if e < 1 << 63 else None for e in d.sum(1)]
            columns = {"code": pa.array(["".join(c) for c in digits[index]], pa.string()), "error": pa.array(error, pa.int64())}
            yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label"), **columns})

    return rows.mapInArrow(lean(coded), kind), books


def books_sha256(books: np.ndarray) -> str:
    """The digest of all entries' components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    found = durable(found)
    summed = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = found.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), summed).try_cast("long").alias("label_error"))
    sums = small(durable(sums.withColumnRenamed("label", "of")))
    out = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
