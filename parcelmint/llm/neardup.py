"""Near-duplicate embeddings by collision-counting projections.

Only equal labels are compared. Unit vectors are projected on many random directions. Two vectors collide on a
direction if one projection lies in the window around the other; how often a pair at the threshold's distance
collides is known exactly, so the count that a pair must reach is set by the share of such pairs that may be missed.
Pairs that reach it are verified by their cosine.

A label is sorted by its first projection, over all tasks, and cut into blocks of equal size; blocks whose
projections are too far from each other never meet. Each pair of blocks that meets is a task: it sorts the other
projections of its vectors, takes the window around each, and counts. Equal vectors are one vector with a
multiplicity, and a task returns a spanning forest and numbers of links instead of pairs, so groups of copies cost
no quadratic output.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelmint.llm.common import components, durable as written, scratch, small, table

_KEY = ["label", "dims", "one", "other"]


@dataclass(frozen=True)
class Counting:
    """Projections, half the window's width, the count that a pair must reach, and how far first projections of a pair may lie apart."""

    projections: int
    window: float
    least: int
    reach: float


def calibrated(cosine: float, miss: float = 1e-4, projections: int = 32, collide: float = 0.9) -> Counting:
    """The counting that misses at most a share `miss` of the pairs whose cosine is the threshold, and fewer of nearer ones.

    On a direction of independent normal numbers, unit vectors at this cosine differ by a normal number of variance
    2 - 2 * cosine. The window is as wide as a share `collide` of such pairs needs.
    """
    spread = math.sqrt(2 - 2 * cosine)
    window = spread * NormalDist().inv_cdf((1 + collide) / 2)
    below, least = 0.0, 0
    while least < projections:
        below += math.comb(projections, least) * collide**least * (1 - collide) ** (projections - least)
        if below > miss / 2:
            break
        least += 1
    return Counting(projections, window, least, spread * NormalDist().inv_cdf(1 - miss / 4))


def directions(dims: int, projections: int) -> np.ndarray:
    return np.random.default_rng(29).normal(size=(dims, projections))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors (the last axis) by powers of two, which round nothing, so that their squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def _vectors(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [_scaled(np.asarray(v, float)) for v in column.to_pylist()]


def _first_projection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's projection on the first direction, after it is scaled to length one."""
    for batch in batches:
        found = [float(v @ directions(len(v), 1)[:, 0]) / math.sqrt(v @ v) for v in _vectors(batch.column("vector"))]
        yield batch.append_column("place", pa.array(found, pa.float64()))


def counted(left: np.ndarray, right: np.ndarray, counting: Counting) -> np.ndarray:
    """For all pairs of projections (rows of left, rows of right): on how many directions they collide.

    On each direction the right side is sorted and a left row's window is a range of it.
    """
    count = np.zeros((len(left), len(right)), np.uint8)
    ends = np.arange(len(right))
    for x, y in zip(left.T, right.T):
        order = np.argsort(y, kind="stable")
        place = np.empty(len(y), np.int64)
        place[order] = ends
        low = np.searchsorted(y[order], x - counting.window, "left").astype(np.int32)
        high = np.searchsorted(y[order], x + counting.window, "right").astype(np.int32)
        place = place.astype(np.int32)
        count += (place[None] >= low[:, None]) & (place[None] < high[:, None])
    return count


def _pairs_of_blocks(cosine: float, counting: Counting) -> Callable:
    def run(part: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if len(part) < 2:
            return empty
        ids, copies, block = (part.column(c).to_numpy() for c in ("id", "copies", "block"))
        order = np.lexsort((ids, block))
        ids, copies, block = ids[order], copies[order], block[order]
        x = np.array(part.column("vector").combine_chunks().flatten()).reshape(len(part), -1)[order]
        x = _scaled(x)
        norm = np.sqrt((x * x).sum(1))
        inner = part.column("one")[0].as_py() == part.column("other")[0].as_py()
        cut = 0 if inner else int(np.searchsorted(block, block[-1]))
        if not inner and cut == 0:
            return empty
        projected = x / norm[:, None] @ directions(x.shape[1], counting.projections)
        near = counted(projected[: len(ids) if inner else cut], projected[cut:], counting) >= counting.least
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(len(near)):
            found = np.flatnonzero(near[i]) + cut
            found = found[found > i] if inner else found
            if not len(found):
                continue
            found = found[(x[found] * x[i]).sum(1) / (norm[found] * norm[i]) >= cosine]
            if not len(found):
                continue
            labels = np.unique(np.append(label[found], label[i]))
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
            links[i] += copies[found].sum()
            links[found] += copies[i]
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, label, ids)
        root = root[label]
        keep = (links > 0) | (root != ids)
        return pa.table({"id": ids[keep], "links": links[keep], "root": root[keep]})

    return run


def _blocks(rows: DataFrame, block_rows: int, reach: float, durable: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (id, label, dims, vector, copies) with block, first and last: where they are in the order of their first projections, and which blocks theirs may meet.

    Ranges of (label, dims, projection) are numbered each in a task of its own; with the sizes of the ranges before
    them, the numbers are ranks in the whole label.
    """
    projected = rows.mapInArrow(_first_projection, "id long, label int, copies long, dims int, vector array<double>, place double")
    kind = ["label", "dims"]
    ranged = durable(projected.repartitionByRange(*kind, "place", "id").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy(*kind, "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*kind).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = durable(sizes.withColumn("before", F.coalesce(before, F.lit(0))))
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*kind, "range").orderBy("place", "id")) - 1
    placed = ranged.join(small(sizes.drop("n")), [*kind, "range"]).withColumn("block", F.floor(rank / block_rows).cast("int"))
    placed = durable(placed.drop("range", "before"))
    spans = placed.groupBy(*kind, "block").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    # blocks are in order, so those in reach of one are a run
    other = spans.select(*kind, F.col("block").alias("at"), F.col("low").alias("low_"), F.col("high").alias("high_"))
    met = spans.join(other, kind).where((F.col("low_") <= F.col("high") + reach) & (F.col("high_") >= F.col("low") - reach))
    runs = durable(met.groupBy(*kind, "block").agg(F.min("at").alias("first"), F.max("at").alias("last")))
    return placed.drop("place").join(small(runs), [*kind, "block"])


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block_rows: int = 1024, miss: float = 1e-4) -> DataFrame:
    """One row for each row of vectors (id long, label int, vector array of double): id, n_links, component_id.

    Vectors with equal labels link if their cosine, in double precision, reaches the threshold; every link counted is
    one, and of the pairs right at the threshold a share of at most `miss` is not found. Null labels and
    vectors that are null, zero or hold null or not finite components link with nothing, as do vectors of unlike
    lengths. Rows that share an id are one vector, the least of them by label and components; a null id links with
    nothing and has no component. No rows give no rows; other columns are ignored. Every label is treated alike,
    whatever its size; the work grows with the square of a label's distinct vectors.
    """
    counting = calibrated(cosine, miss)
    vectors = vectors.select("id", F.col("label").cast("int").alias("label"), "vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    nodes = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    nodes = nodes.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector")
    same = ["label", "h", "h2"]
    with scratch(vectors.sparkSession) as durable:
        nodes = durable(nodes.select("id", "label", "vector", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("h2")))
        classes = nodes.groupBy("label", "vector", "h", "h2").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"))
        classes = durable(classes.withColumn("dims", F.size("vector")))
        rows = classes.select(F.col("class").alias("id"), "label", "copies", "dims", "vector")
        placed = _blocks(rows, block_rows, counting.reach, durable).withColumn("with", F.explode(F.expr("sequence(first, last)")))
        tasks = placed.select(F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "label", "dims", "id", "copies", "block", "vector")
        found = durable(tasks.groupBy(*_KEY).applyInArrow(_pairs_of_blocks(cosine, counting), "id long, links long, root long"))

        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), durable=durable)
        classes = classes.join(links, F.col("class") == links.id, "left").drop("id").join(labels, F.col("class") == labels.id, "left")
        classes = classes.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
        nodes = nodes.select("id", *same).join(classes, same).select("id", "n_links", "component_id")
        out = vectors.select("id").join(nodes, "id", "left")
        return written(out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    return near_duplicates(rows).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
