"""What is done with results: order, export's choice, chart scales, ages, profiles, repairs, enrichment, catalog lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmint.functions import titles
from parcelmint.functions.compat import SPACES
from parcelmint.operators.relational import first_by

#: The keys that results are sorted by; names as people order them, all else by number.
SORT_KEYS = {
    "product": lambda: F.collate(F.coalesce("product.standard_key", "title"), "UNICODE"),
    "cost": lambda: F.col("landed.acquisition"),
    "resale": lambda: F.col("profit.resale"),
    "profit": lambda: F.col("profit.profit"),
    "margin": lambda: F.col("profit.margin"),
    "risk": lambda: F.col("risk.score"),
}


def ranked(evaluated: DataFrame, key: str = "profit", descending: bool = True) -> DataFrame:
    """evaluated in the order of one of SORT_KEYS, ties by id."""
    by = SORT_KEYS[key]()
    return evaluated.orderBy(by.desc() if descending else by.asc(), "id")


def card(evaluated_risk_threshold: int = 60) -> Column:
    """The summary card that an evaluated listing counts for: viable, scam or profit."""
    scam = F.col("risk.dropped") | (F.col("risk.score") >= evaluated_risk_threshold)
    return F.when(~F.col("hidden"), "viable").when(scam, "scam").otherwise("profit")


def exported(evaluated: DataFrame, kind: str | None = None, family: str | None = None, condition: str | None = None) -> DataFrame:
    """The listings of an export: those of a card and of a heatmap's cell, where given; whether a listing is hidden does not matter."""
    out = evaluated if kind is None else evaluated.where(card() == kind)
    if family is not None:
        out = out.where(titles.family_of_key(F.col("product.standard_key")) == family)
    return out if condition is None else out.where(F.coalesce("product.condition", F.lit("unknown")) == condition)


def chart_heights(points: DataFrame, value: str) -> DataFrame:
    """points with height, from 0 to 1: where a value stands between the least (0 at most) and the greatest of all values but 0."""
    facts = points.where(F.col(value) != 0).agg(F.coalesce(F.max(value), F.lit(0.0)).alias("high_"), F.least(F.coalesce(F.min(value), F.lit(0.0)), F.lit(0.0)).alias("low_"))
    span = F.coalesce(F.nullif(F.col("high_") - F.col("low_"), F.lit(0.0)), F.lit(1.0))
    return points.join(F.broadcast(facts)).withColumn("height", (F.col(value) - F.col("low_")) / span).drop("high_", "low_")


def age_seconds(began: Column, now: Column, ended: Column | None = None) -> Column:
    """Whole seconds from a start to its end, or to now."""
    until = now if ended is None else F.coalesce(ended, now)
    return F.floor(until.cast("double") - began.cast("double"))


def or_empty(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def profile(rows: DataFrame, by: str, fields: dict[str, Column], sample: str, most: int = 5) -> DataFrame:
    """For each value of `by`: n, how many rows have each field (with_<name>), and the first `most` samples in their order."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(test).alias(f"with_{name}") for name, test in fields.items()])
    some = first_by(rows.select(by, sample), [by], [sample], most).groupBy(by).agg(F.sort_array(F.collect_list(sample)).alias("samples"))
    return counts.join(some, by, "left")


_STORED = (
    "struct<summary:struct<total:int,shown:int>,warnings:array<string>,"
    "listings:array<struct<id:bigint,euComps:array<string>,listing:struct<imageUrls:array<string>,conditionFlags:array<string>>,scam:struct<reasons:array<string>,matchedYellowTokens:array<string>>>>>"
)


def repaired(text: Column) -> Column:
    """A stored result's JSON with what is broken or missing in it made empty: lists, the summary, lists within listings."""
    r = F.from_json(text, _STORED)
    none = F.array().cast("array<string>")

    def whole(x: Column) -> Column:
        inner = x["listing"].withField("imageUrls", F.coalesce(x["listing"]["imageUrls"], none)).withField("conditionFlags", F.coalesce(x["listing"]["conditionFlags"], none))
        scam = x["scam"].withField("reasons", F.coalesce(x["scam"]["reasons"], none)).withField("matchedYellowTokens", F.coalesce(x["scam"]["matchedYellowTokens"], none))
        return x.withField("euComps", F.coalesce(x["euComps"], none)).withField("listing", inner).withField("scam", scam)

    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("shown"))
    listings = F.coalesce(F.transform(r["listings"], whole), F.from_json(F.lit("[]"), _STORED[_STORED.index("listings:") + 9 : -1]))
    return F.struct(F.coalesce(r["summary"], zero).alias("summary"), F.coalesce(r["warnings"], none).alias("warnings"), listings.alias("listings"))


def merged(defaults: Column, changes: Column) -> Column:
    """A map of sections with the values of another put in, section by section; sections that only one has stay whole."""
    return F.map_zip_with(defaults, changes, lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))))


def enriched(listings: DataFrame, details: DataFrame) -> DataFrame:
    """listings with what their own pages tell, by href: details (href, rating, images, pictures, description, labels), one row each.

    A rating, a number of pictures above 0 and its pictures replace those of the listing. The longer description
    counts, and the block of labels is added to it. Listings without a page stay as they are.
    """
    d = details.select("href", *[F.col(c).alias(f"{c}_") for c in ("rating", "images", "pictures", "description", "labels")])
    out = listings.join(d, "href", "left")
    more = F.col("images_") > 0
    longer = F.length("description_") > F.length(F.coalesce("description", F.lit("")))
    text = F.when(F.coalesce(longer, F.lit(False)), F.col("description_")).otherwise(F.col("description"))
    said = F.trim(F.concat_ws(" ", F.nullif(text, F.lit("")), F.nullif("labels_", F.lit(""))))
    changed = {
        "rating": F.coalesce("rating_", "rating"),
        "images": F.when(more, F.col("images_")).otherwise(F.col("images")),
        "pictures": F.when(more & (F.size("pictures_") > 0), F.col("pictures_")).otherwise(F.col("pictures")),
        "description": F.when(said != "", said).otherwise(F.col("description")),
    }
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in listings.columns])


def catalog_lookup(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """queries (id, query, category) with the catalog's entry for them: brand, type, generation, model, and the storage asked for.

    catalog: ordinal, brand, type, category, generation, model, query. A query's storage at its end does not count;
    of several entries the first by ordinal does. storage: gigabytes, or all. Without an entry all is null.
    """
    low = F.lower(F.regexp_replace("query", f"^[{SPACES}]+|[{SPACES}]+$", ""))
    rows = queries.withColumn("base_", F.regexp_replace(low, rf"[{SPACES}]*\d+[{SPACES}]*(?:gb|tb)$", "")).withColumn("low_", low)
    size, unit = (F.regexp_extract("low_", rf"(\d+)[{SPACES}]*(gb|tb)$", k) for k in (1, 2))
    storage = F.when(unit == "tb", "1024").when(unit == "gb", size).otherwise("all")
    entry = F.struct("ordinal", "brand", "type", "generation", "model")
    entries = catalog.groupBy(F.lower("query").alias("base_"), F.col("category").alias("category_")).agg(F.min(entry).alias("entry"))
    found = rows.join(entries.withColumnRenamed("base_", "key_"), (F.col("base_") == F.col("key_")) & (F.col("category") == F.col("category_")), "left")
    return found.select("id", *[F.col(f"entry.{c}").alias(c) for c in ("brand", "type", "generation", "model")], F.when(F.col("entry").isNotNull(), storage).alias("storage"))


def release_dates(models: DataFrame, generations: DataFrame, overrides: DataFrame) -> DataFrame:
    """models (query, generation, year) with released: the model's own date, else its generation's, else its year."""
    out = models.join(overrides.select("query", F.col("released").alias("own_")), "query", "left")
    out = out.join(generations.select("generation", F.col("released").alias("of_generation_")), "generation", "left")
    return out.withColumn("released", F.coalesce("own_", "of_generation_", "year")).drop("own_", "of_generation_")


def first_rows(rows: DataFrame, order: Sequence[Column | str], most: int) -> DataFrame:
    return rows.orderBy(*order).limit(most)
