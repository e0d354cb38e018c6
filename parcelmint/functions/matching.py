"""Matching of products with comparable offers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmint.functions.compat import SPACES, js_round, pattern


def offer_query(category: Column, family: Column, storage_gb: Column, inch: Column, form: Column, drive: Column) -> Column:
    """What to search for: the family with its storage, and what else tells the category's products apart."""
    storage = F.concat(storage_gb.cast("string"), F.lit("GB"))
    console = F.trim(F.regexp_replace(F.concat_ws(" ", F.lit("PlayStation 5"), form, drive), f"[{SPACES}]+", " "))
    return F.when(category == "ps5", console).when(category == "macbook", F.concat_ws(" ", family, F.concat(inch.cast("string"), F.lit('"')), storage)).otherwise(F.concat_ws(" ", family, storage))


def tier(text: Column) -> Column:
    has = lambda w: F.rlike(text, F.lit(pattern(f"‹{w}›")))
    return F.when(has("ultra"), "ultra").when(has("pro") & has("max"), "pro_max").when(has("max"), "max").when(has("plus"), "plus").when(has("pro"), "pro").otherwise("base")


def query_words(query: Column) -> Column:
    """The words of a query that an offer's title may share."""
    return F.filter(F.split(F.lower(query), f"[{SPACES}]+"), lambda t: F.length(t) > 1)


def score(words: Column, family: Column, storage_gb: Column, low_title: Column, title_storage_gb: Column) -> Column:
    """0 to 100 for an offer of the product's own tier: words of the query, the family as a whole (lower case), the storage."""
    overlap = F.coalesce(F.try_divide(F.size(F.filter(words, lambda t: F.contains(low_title, t))), F.size(words)), F.lit(0.0)) * 60
    whole = F.when(F.contains(low_title, family), 25).otherwise(0)
    both = title_storage_gb.isNotNull() & storage_gb.isNotNull()
    far = (title_storage_gb >= storage_gb * 4) | (storage_gb >= title_storage_gb * 4)
    storage = F.when(title_storage_gb == storage_gb, 25).when(both & far, -30).when(both, -20).otherwise(0)
    return js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), overlap + whole + storage))).cast("int")
