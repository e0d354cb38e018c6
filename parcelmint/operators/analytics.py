"""Reports over evaluated listings and offers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmint.functions.compat import js_round
from parcelmint.operators.folders import work_folder

CONDITION_ORDER = ["new", "open_box", "excellent", "very_good", "good", "fair", "unknown"]


def floor_price(category: Column) -> Column:
    """The least plausible price of a category, in the source's currency."""
    return F.when(category == "macbook", 2000).when(category == "ipad", 800).when(category == "ps5", 1000).otherwise(500)


def stored(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read again: what several reports are made from is worked out once, and outlives lost executors."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_medians(rows: DataFrame, by: list[str], value: str, rounding: str = "none", weight: str | None = None, width: float | None = None) -> DataFrame:
    """(by, median): the exact median of a group's values, nulls left out, with no group in one task.

    Equal values are counted first, then counts are summed over ranges, some thousands for the whole spread of values;
    the middle of a group lies in one or two of them, and only those are sorted. Groups without a value are left out.
    rounding: as of compat.median(). weight: how often a row counts; rows are then taken as counted by value already. width: of a range, where the
    values' spread is known; None for one that follows it.
    """
    rows = rows.where(F.col(value).isNotNull())
    counts = rows.select(*by, F.col(value).cast("double").alias("value_"), F.col(weight).alias("n_")) if weight else rows.groupBy(*by, F.col(value).cast("double").alias("value_")).agg(F.count(F.lit(1)).alias("n_"))
    # ranges of one unit, wider where values spread far, narrower where all lie within a few units
    spread = counts.agg(F.max("value_") - F.min("value_")).first()[0] if weight and width is None else None
    width = width or 1.0 if spread is None or 16 <= spread <= 65_536 else 2.0 ** math.ceil(math.log2(max(spread, 1e-9) / 4096))
    counts = counts.withColumn("range_", F.floor(F.col("value_") / width))
    ranges = counts.groupBy(*by, "range_").agg(F.sum("n_").alias("n_"))
    ordered = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before_", F.coalesce(F.sum("n_").over(ordered), F.lit(0))).withColumn("all_", F.sum("n_").over(Window.partitionBy(*by)))
    # ranks from 0 of the lower and the upper middle value
    low, high = F.floor((F.col("all_") - 1) / 2), F.floor(F.col("all_") / 2)
    holds = lambda n: (F.col("before_") <= n) & (n < F.col("before_") + F.col("n_"))
    middle = ranges.where(holds(low) | holds(high)).drop("n_")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "range_"]]
    inside = counts.alias("c").join(middle.alias("m"), same).select("c.*", "m.before_", "m.all_")
    within = Window.partitionBy(*by, "range_").orderBy("value_").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before_", F.col("before_") + F.coalesce(F.sum("n_").over(within), F.lit(0)))
    found = inside.groupBy(*by).agg(*[F.max(F.when(holds(n), F.col("value_"))).alias(c) for n, c in ((low, "low_"), (high, "high_"))], F.max("all_").alias("all_"))
    median = F.when(F.col("low_") == F.col("high_"), F.col("low_")).otherwise((F.col("low_") + F.col("high_")) / 2)
    if rounding == "all":
        median = js_round(median).cast("double")
    elif rounding == "even":
        median = F.when(F.col("all_") % 2 == 0, js_round(median).cast("double")).otherwise(median)
    return found.select(*by, median.alias("median"))


def heatmap(rows: DataFrame) -> DataFrame:
    """(family, condition, median_profit, n, mean_margin, least, most): all conditions for every family; least and most of all medians.

    Rows are counted once by family, condition and profit; cells and exact medians are made from the counts, and the
    grid from the cells, a row for each family, not from a join of the input.
    """
    by = ["family", "condition"]
    counted = stored(rows.groupBy(*by, "profit").agg(F.count(F.lit(1)).alias("n"), F.sum("margin").alias("margins"), F.count("margin").alias("known")))
    cells = counted.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("margins") / F.nullif(F.sum("known"), F.lit(0))).alias("mean_margin"))
    medians = exact_medians(counted, by, "profit", weight="n").select(*[F.col(c).alias(f"{c}_") for c in by], F.col("median").alias("median_profit"))
    cells = cells.join(medians, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by], "left")
    by_family = cells.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("condition", F.struct("median_profit", "n", "mean_margin")))).alias("cells"))
    grid = by_family.select("family", "cells", F.explode(F.array(*map(F.lit, CONDITION_ORDER))).alias("condition")).withColumn("cell", F.try_element_at("cells", F.col("condition")))
    whole = Window.partitionBy()
    out = grid.select("family", "condition", "cell.median_profit", F.coalesce("cell.n", F.lit(0)).alias("n"), "cell.mean_margin")
    return out.withColumn("least", F.min("median_profit").over(whole)).withColumn("most", F.max("median_profit").over(whole))


def profit_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "none").when(x < 0, "<0").when(x < 30, "<30").when(x < 60, "<60").when(x < 100, "<100").otherwise(">=100")


def market_preview(offers: DataFrame) -> DataFrame:
    """(source, n, mean, median, least, most) for each platform and for new and used, over distinct (platform, title, euros).

    Offers are counted once by platform and price; both kinds of sources are sums of these counts.
    """
    counted = stored(offers.select("platform", "title", "euros").distinct().groupBy("platform", "euros").agg(F.count(F.lit(1)).alias("n")))
    side = F.when(F.col("platform").isin("kuantokusta", "amazon"), "new").otherwise("used")
    sides = counted.select("euros", "n", F.explode(F.array(F.col("platform"), side)).alias("source")).groupBy("source", "euros").agg(F.sum("n").alias("n"))
    mean = F.sum(F.col("euros") * F.col("n")) / F.nullif(F.sum(F.when(F.col("euros").isNotNull(), F.col("n"))), F.lit(0))
    facts = sides.groupBy("source").agg(F.sum("n").alias("n"), js_round(mean).alias("mean"), F.min("euros").alias("least"), F.max("euros").alias("most"))
    medians = exact_medians(sides, ["source"], "euros", "even", weight="n", width=1.0).withColumnRenamed("source", "source_")
    return facts.join(medians, F.col("source").eqNullSafe(F.col("source_")), "left").select("source", "n", "mean", "median", "least", "most")


def page(ordered: DataFrame, number: int, size: int = 15) -> DataFrame:
    return ordered.offset((max(number, 1) - 1) * size).limit(size)


def or_default(rows: DataFrame, default: dict) -> DataFrame:
    """rows, or one row of defaults if there are none, without counting rows first."""
    made = rows.sparkSession.range(1).select(*[F.lit(default[f.name]).cast(f.dataType).alias(f.name) for f in rows.schema])
    return rows.unionByName(made.join(rows.limit(1).select(F.lit(1).alias("any_")), F.lit(True), "left").where("any_ is null").drop("any_"))


def price_bounds(price: Column, least: float, most: float) -> Column:
    """Positive prices within bounds; a bound of 0 is none."""
    test = price > 0
    test = test & (price >= least) if least else test
    return test & (price <= most) if most else test
