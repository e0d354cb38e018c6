"""Keyed upserts, deletions, de-duplication and lookups over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str], most: int = 1) -> DataFrame:
    """The first `most` rows of each key in an order; ties need an order that tells rows apart."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("place_", place).where(F.col("place_") <= most).drop("place_")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with new's rows put in by key, and the action taken: kept, updated or created. Of new rows with one key the last in `order` counts.

    Both sides meet in one shuffle by key.
    """
    values = [c for c in old.columns if c != key]
    last = first_by(new, [key], [F.desc(order)]).select(key, F.struct(*values).alias("new_"))
    both = old.select(key, F.struct(*values).alias("old_")).join(last, key, "full")
    action = F.when(F.col("new_").isNull(), "kept").when(F.col("old_").isNull(), "created").otherwise("updated")
    return both.select(key, F.coalesce("new_", "old_").alias("v"), action.alias("action")).select(key, "v.*", "action")


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def overlay(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """live rows, and the stored ones that have no live row."""
    return live.unionByName(without(stored, live, key))


def changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, old, new): values that differ where both tables have the key."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("double").alias("old"), F.col(f"n.{f}").cast("double").alias("new")) for f in fields])
    return old.alias("o").join(new.alias("n"), key).select(key, F.explode(pairs).alias("c")).select(key, "c.*").where(~F.col("old").eqNullSafe(F.col("new")))
