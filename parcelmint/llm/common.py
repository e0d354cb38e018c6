"""Helpers that the operators share: reading tables, durable intermediate tables, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most so many rows may be broadcast; beyond it the plain join runs.
BROADCAST_ROWS = 200_000


#: Rows of text that go to a Python worker at a time, where the session has Spark's own number for short rows.
TEXT_BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches: rows that hold whole texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


@functools.lru_cache(1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, which gives what it no longer needs back to the machine at the end of each task.

    Python workers live on from stage to stage; without this, each would keep the most that any of its tasks took.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if _libc() is not None:
                _libc().malloc_trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here and outlives lost executors.

    The table stays when the query is over: whoever owns spark.checkpoint.dir empties it. See scratch().
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark) + '/parcelmint'}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A durable() whose tables go when the block ends; what outlives the block must not be planned on them."""
    folder = f"{shared_dir(spark)}/parcelmint/{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        return durable(df, folder)

    try:
        yield keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows (counted unless given), else df as it is."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def veiled(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with all columns but `used` renamed to names that no operator has, and what gives the names and their order back.

    The second takes a DataFrame that still has these columns, new values for columns that docs has, by name, and
    further columns.
    """
    hidden = {c: c if c in used else f"veiled_{k}__" for k, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")

    def restored(df: DataFrame, new: dict[str, Column] | None = None, **more: Column) -> DataFrame:
        back = [(new or {}).get(c, F.col(h)).alias(c) for c, h in hidden.items()]
        return df.select(*back, *[x.alias(c) for c, x in more.items()])

    return docs.select(*[quoted(c).alias(h) for c, h in hidden.items()]), restored


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


#: A scaled component beyond this stays at it: doubles hold every whole number up to here.
WIDEST = 1 << 53


def finite(vector: Column) -> Column:
    """Whether a vector (array of double) is not null and holds neither null nor not finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * component) of each component, as long."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(WIDEST))), F.lit(-float(WIDEST)))))


def commonest_length(rows: DataFrame, vector: str) -> int | None:
    """The length that most rows' vectors have, of equally common ones the shorter; None without rows."""
    found = rows.groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return found and found.dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A batch's vectors of equal length, one a row."""
    return np.asarray(column.flatten()).reshape(-1, dims)


def components(edges: DataFrame, rounds: int = 100, durable: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """The connected components of undirected edges (a, b): one row (id, component) for each node, component its smallest id.

    Every round takes the least label among neighbours, then jumps to that label's own label, so the rounds
    grow with the logarithm of a chain's length. The labels of a round are a written table; sums per node are
    combined before the shuffle, so a hub node is no hot group.
    """
    there = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    both = durable(there.union(back).where("u <> v").distinct())
    label = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("component"))
    label = durable(label)
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = label.select(F.col("id").alias("c"), F.col("component").alias("far"))
        new = durable(step.join(jump, "c", "left").select("id", "old", F.least("c", "far").alias("component")))
        changed = new.where("component <> old").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")
