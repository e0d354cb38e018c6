"""The table of reference prices: seeding, reading, checks of edits, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmint.functions import labels
from parcelmint.functions.compat import js_round

PRICES = ["new", "excellent", "very_good", "good", "fair"]
#: Bounds of a price in euros, and how long a key and a category may be.
PRICE_BOUNDS, KEY_LENGTH, CATEGORY_LENGTH = (0, 1_000_000), 120, 40


def seeded(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """stored, or if it has no rows, the seed (standard_key, new, excellent, very_good, good, fair) with its categories and fair prices filled in."""
    fair = F.coalesce("fair", js_round(F.col("good") * 0.75).cast("double"))
    rows = seed.select("standard_key", labels.key_category(F.col("standard_key")).alias("category"), *PRICES[:-1], fair.alias("fair"))
    any_ = stored.limit(1).select(F.lit(True).alias("any_"))
    return stored.select(*rows.columns).unionByName(rows.join(any_, F.lit(True), "left").where("any_ is null").drop("any_"))


def of_category(rows: DataFrame, category: str = "all") -> DataFrame:
    """The rows of a category, or all, by category and key."""
    kept = rows if category == "all" else rows.where(F.col("category") == category)
    return kept.orderBy("category", "standard_key")


def checked(rows: DataFrame) -> DataFrame:
    """rows (standard_key, category, prices) with rejected: why an edit must not be stored, else null."""
    low, high = PRICE_BOUNDS
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad = [F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(low, high) for c in PRICES]
    wrong = bad[0]
    for x in bad[1:]:
        wrong = wrong | x
    long_ = (F.length("standard_key") > KEY_LENGTH) | (F.length("category") > CATEGORY_LENGTH)
    return rows.withColumn("rejected", F.when(missing("standard_key") | missing("category"), "incomplete").when(long_, "key or category too long").when(wrong, "price out of bounds"))


def number(text: Column) -> Column:
    """The number that a text begins with once all but digits, dots and minus signs are gone, else 0."""
    found = F.regexp_extract(F.regexp_replace(text, r"[^0-9.\-]", ""), r"^(-?\d*\.?\d+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("double"), F.lit(0.0))


def parsed(raw: DataFrame) -> DataFrame:
    """raw with columns standardkey, category, new, excellent, verygood, good, fair as texts, read as reference prices.

    Blank keys go; unknown categories are iphone; what is no number is 0.
    """
    kind = F.lower(F.trim("category"))
    kind = F.when(kind.isin(*labels.CATEGORIES), kind).otherwise("iphone")
    prices = [number(F.col(p.replace("_", ""))).alias(p) for p in PRICES]
    return raw.where(F.trim("standardkey") != "").select(F.trim("standardkey").alias("standard_key"), kind.alias("category"), *prices)


def from_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with a column that holds one line of CSV each (standardKey, category and the five prices, in this order), read as of parsed()."""
    fields = ["standardkey", "category", *(p.replace("_", "") for p in PRICES)]
    read = F.from_csv(line, ", ".join(f"{f} string" for f in fields), {"quote": '"', "escape": '"'})
    others = [c for c in lines.columns if c != line]
    rows = lines.select(*others, read.alias("r"))
    made = [F.trim("r.standardkey").alias("standard_key"), F.lower(F.trim("r.category")).alias("category")]
    rows = rows.where(F.trim("r.standardkey") != "").select(*others, *made, *[number(F.col(f"r.{p.replace('_', '')}")).alias(p) for p in PRICES])
    return rows.withColumn("category", F.when(F.col("category").isin(*labels.CATEGORIES), F.col("category")).otherwise("iphone"))


def to_line(prefix: str = "") -> Column:
    """A reference row as one line of CSV."""
    prices = [F.regexp_replace(F.col(p).cast("string"), r"\.0$", "") for p in PRICES]
    return F.concat_ws(",", labels.csv_field(F.col("standard_key")), F.col("category"), *prices)
