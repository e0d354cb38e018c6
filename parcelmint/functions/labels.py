"""Short texts for facts: labels of tables and charts, names of files, fields of CSV."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmint.functions.compat import ascii_pattern, cases, first

# Labels by value.
REGIONS = {"china": "CN", "international": "INT", "us": "US", "japan": "JP", "korea": "KR"}
LOCKS = {"unlocked": "Unlocked", "carrier_locked": "Locked", "icloud_locked": "iCloud", "mdm_locked": "MDM"}
CONDITIONS = {"new": "New", "open_box": "Open Box", "excellent": "Excellent", "very_good": "Very Good", "good": "Good", "fair": "Fair", "unknown": "Used"}
CATEGORIES = {
    "iphone": "iPhone", "macbook": "MacBook", "ipad": "iPad", "ps5": "PlayStation 5", "samsung": "Samsung", "applewatch": "Apple Watch", "dji": "DJI", "xiaomi": "Xiaomi", "gaming": "Gaming",
}
# What a reference price's key begins with, and its category.
KEY_CATEGORIES = [
    (r"^iPhone", "iphone"), (r"^MacBook", "macbook"), (r"^iPad", "ipad"), (r"^PlayStation", "ps5"), (r"^Galaxy", "samsung"), (r"^Apple Watch", "applewatch"), (r"^DJI", "dji"),
    (r"^Xiaomi|^Redmi|^POCO", "xiaomi"), (r"^Steam Deck|^Legion Go|^ROG Ally", "gaming"),
]
# Price bands offered for a category, as (label, least, most); "" stands for all others.
PRICE_BANDS = {
    "iphone": [("Sweet Spot", 2500, 5500), ("Pro / Max", 3500, 7500), ("Budget Entry", 1200, 3000)],
    "macbook": [("Air / Entry", 3000, 6500), ("Pro / Max", 5500, 14000)],
    "ipad": [("Air / Mini", 1500, 3800), ("iPad Pro", 3000, 7500)],
    "ps5": [("Standard", 1500, 3200), ("Bundle / Pro", 2500, 5000)],
    "gaming": [("Standard", 1500, 3200), ("Bundle / Pro", 2500, 5000)],
    "applewatch": [("Series / SE", 800, 2200), ("Ultra", 2500, 5500)],
    "dji": [("Mini / Air", 1800, 4500), ("Mavic / Pro", 4500, 12000)],
    "samsung": [("Mainstream", 1500, 4000), ("Ultra / Flagship", 3500, 7000)],
    "xiaomi": [("Mainstream", 1500, 4000), ("Ultra / Flagship", 3500, 7000)],
    "": [("Target Range", 1500, 5000), ("Premium", 4000, 10000)],
}


def label(value: Column, labels: dict[str, str]) -> Column:
    """A value's label; values without one as they are."""
    return cases([(value == k, F.lit(v)) for k, v in labels.items()], value)


def badge(value: Column, labels: dict[str, str]) -> Column:
    """A label for a table's cell: null for null and unknown."""
    return F.when(value != "unknown", label(value, labels))


def key_category(key: Column) -> Column:
    return cases([(F.rlike(key, F.lit(ascii_pattern(rule))), F.lit(v)) for rule, v in KEY_CATEGORIES], F.lit("iphone"))


def chart_label(key: Column, storage_gb: Column, place: Column) -> Column:
    """A product's name for a chart's axis: a few letters and the storage, or its place (from 0) in the list."""
    gb = F.coalesce(storage_gb.cast("string"), F.lit(""))
    rule = ascii_pattern(r"iPhone\s*(\d+)\s*(Pro)?")
    number = first(key, rule)
    phone = F.concat(F.lit("i"), number, F.when(F.regexp_extract(key, rule, 2) != "", "P").otherwise(""), F.lit(" "), gb)
    has = lambda words: F.rlike(key, F.lit(f"(?i){words}"))
    nth = (place + 1).cast("string")
    return (
        F.when(number.isNotNull(), F.trim(phone))
        .when(has("MacBook"), F.trim(F.concat(F.lit("MB "), gb)))
        .when(has("iPad"), F.trim(F.concat(F.lit("iPad "), gb)))
        .when(has("PlayStation|PS5"), F.concat(F.lit("PS5 "), nth))
        .otherwise(F.concat(F.lit("#"), nth))
    )


def csv_field(text: Column) -> Column:
    """A text as a field of CSV: quoted where it holds a comma, a quote or a line's end; empty for null."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))
    return F.coalesce(F.when(F.rlike(text, F.lit('[",\n]')), quoted).otherwise(text), F.lit(""))


def slug(text: Column, most: int = 40) -> Column:
    return F.left(F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]+", "-")), F.lit(most))


def price_bands(category: Column) -> Column:
    """The bands offered for a category: array of (label, least, most)."""
    made = lambda bands: F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).alias("least"), F.lit(b).alias("most")) for n, a, b in bands])
    return cases([(category == k, made(bands)) for k, bands in PRICE_BANDS.items() if k], made(PRICE_BANDS[""]))


def unexplained(tokens: Column, flags: Column) -> Column:
    """The tokens that hold no flag as a part of them."""
    return F.filter(tokens, lambda t: ~F.exists(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.contains(t, f)))
