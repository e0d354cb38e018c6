"""Scan files as a stream: listings without repeats, written once for each batch and generation. An extension; batch tables hold the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCAN = "task long, generation int, source string, title string, price double, seen timestamp"


def scans(spark: SparkSession, path: str, lateness: str = "1 hour") -> DataFrame:
    """Listings from JSON files, each (source, title) once within the watermark."""
    rows = spark.readStream.schema(SCAN).json(path)
    return rows.withWatermark("seen", lateness).dropDuplicatesWithinWatermark(["source", "title"])


def hourly(rows: DataFrame) -> DataFrame:
    """Listings and mean price by hour and source."""
    return rows.groupBy(F.window("seen", "1 hour"), "source").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"))


def write_once(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes each batch to a folder of its own, so a batch that runs again replaces itself; every: how often, None for what there is and no more.

    State that goes by the clock needs an interval: there is always another batch to come.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest(rows: DataFrame) -> DataFrame:
    """rows of each task's latest generation: what a run wrote that another has taken the place of does not count."""
    last = rows.groupBy("task").agg(F.max("generation").alias("generation"))
    return rows.join(last, ["task", "generation"], "left_semi")


def current(spark: SparkSession, path: str) -> DataFrame:
    """What has been written, of each task's latest generation only."""
    return latest(spark.read.parquet(path))
