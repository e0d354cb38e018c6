"""The evaluation of listings against offers: match, resale value, landed cost, profit, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmint.functions import matching, pricing, risk, titles
from parcelmint.functions.compat import js_round
from parcelmint.functions.config import Config

#: Below so many euros an offer is an accessory, not a device.
LEAST_OFFER = 100.0
TIERS = ["new", "excellent", "very_good", "good", "fair"]


def with_product(listings: DataFrame) -> DataFrame:
    """listings with product, unless the caller has made it already."""
    return listings if "product" in listings.columns else titles.with_product(listings)


def title_facts(offers: DataFrame) -> DataFrame:
    """(task, title, tier, offer_gb, low_title): what matching reads from the titles of a scan's offers, each title of it once."""
    facts = [matching.tier(F.col("title")).alias("tier"), titles.storage_gb(F.col("title")).alias("offer_gb"), F.lower("title").alias("low_title")]
    return offers.select("task", "title").distinct().select("task", "title", *facts)


def with_want(rows: DataFrame) -> DataFrame:
    """rows with want: one text for all that a product's match depends on; null without a product."""
    product = F.col("product")
    query = matching.offer_query(product["category"], product["family"], product["storage_gb"], product["display_inch"], product["form_factor"], product["drive_config"])
    named = F.concat_ws("\n", query, F.lower(product["family"]), F.coalesce(product["storage_gb"].cast("string"), F.lit("")))
    return rows.withColumn("want", F.when(product.isNotNull(), named))


def _sliced(wanted: DataFrame, facts: DataFrame, slice_titles: int) -> tuple[DataFrame, DataFrame]:
    """Both with slice: titles of a scan and tier are cut into slices of about slice_titles by hash, and products go to each slice.

    Only scans with more titles than that are listed, so the list is short beside the titles; all others are slice 0.
    """
    many = facts.groupBy("task", "tier").agg(F.ceil(F.count(F.lit(1)) / slice_titles).cast("int").alias("slices")).where("slices > 1")
    of_title = F.pmod(F.xxhash64(F.lit(53), "title"), F.coalesce("slices", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
    split = lambda df, slice_: df.join(many, ["task", "tier"], "left").withColumn("slice", slice_).drop("slices")
    return split(wanted, every), split(facts, of_title)


def scored_titles(rows: DataFrame, facts: DataFrame, least_score: int = 40, slice_titles: int = 10_000) -> DataFrame:
    """(task, want, gb, title, offer_gb, score): the titles of a scan's offers that match a product wanted there.

    Scores depend on product and title alone, so each product of a scan meets each title of its tier there once,
    however many listings and offers have them. Offers of another tier never match. Words may be any part of a title,
    so they are no key; a scan with many titles is split into slices of about slice_titles instead.
    """
    product = F.col("product")
    query = F.split("want", "\n")[0]
    wanted = rows.where("want is not null").select("task", "want", product["family"].alias("family"), product["storage_gb"].alias("gb")).distinct()
    wanted = wanted.select("task", "want", "gb", matching.query_words(query).alias("words"), F.lower("family").alias("low_family"), matching.tier(F.col("family")).alias("tier"))
    score = matching.score(F.col("words"), F.col("low_family"), F.col("gb"), F.col("low_title"), F.col("offer_gb"))
    wanted, facts = _sliced(wanted, facts, slice_titles)
    return wanted.join(facts, ["task", "tier", "slice"]).select("task", "want", "gb", "title", "offer_gb", score.alias("score")).where(F.col("score") >= least_score)


def matches(listings: DataFrame, offers: DataFrame, least_score: int = 40, unknown: bool = False) -> DataFrame:
    """(id, task, product, offer, platform, euros, offer_gb, score): offers of a listing's own scan that match its product.

    unknown: whether listings that are no known product are paired with all offers of their scan, too, with a null
    score. There are as many pairs as such listings times offers; with_value() gives these listings their value
    without them.
    """
    rows, facts = with_want(listings), title_facts(offers)
    narrow = rows.select("id", "task", "product", "want")
    priced = offers.select("task", "title", "offer", "platform", "euros")
    found = narrow.join(scored_titles(rows, facts, least_score), ["task", "want"]).join(priced, ["task", "title"])
    columns = ["id", "task", "product", "offer", "platform", "euros", "offer_gb", "score"]
    if not unknown:
        return found.select(*columns)
    with_gb = priced.join(facts.select("task", "title", "offer_gb"), ["task", "title"])
    others = narrow.where("want is null").join(with_gb, "task").withColumn("score", F.lit(None).cast("int"))
    return found.select(*columns).unionByName(others.select(*columns))


def _values(matched: DataFrame, keys: list[str], gb: Column, blended: Column, config: Config) -> DataFrame:
    """(keys, offers, exact, resale, fee_rate): exact medians by the storage rule, and the blended fee, an aggregate."""
    real = F.col("euros") >= LEAST_OFFER
    exact = real & (F.col("offer_gb") == gb)
    adjusted = pricing.storage_adjusted(F.col("euros"), F.col("offer_gb"), gb)
    found = matched.groupBy(*keys).agg(
        F.count_if(real).alias("offers"),
        F.count_if(exact).alias("exact"),
        F.median(F.when(exact, F.col("euros"))).alias("exact_median"),
        F.median(F.when(real, adjusted)).alias("adjusted_median"),
        blended.alias("blended"),
    )
    resale = F.when(F.col("exact") >= 2, F.col("exact_median")).otherwise(F.col("adjusted_median"))
    fee = F.when(F.col("offers") > 0, F.col("blended")).otherwise(config.fee_default)
    return found.select(*keys, "offers", "exact", resale.alias("resale"), fee.alias("fee_rate"))


def resale_values(matched: DataFrame, config: Config) -> DataFrame:
    """(id, offers, exact, resale, fee_rate) of matches().

    Two offers with the listing's own storage are enough to use those alone; otherwise all are adjusted to it. Offers
    under 100 euros count for the fee only, unless there are no others. The fee is a mean over rows, whose last digits
    depend on their order; with_value() has one that does not.
    """
    mean = F.avg(pricing.platform_fee(F.col("platform"), config))
    return _values(matched, ["id"], F.col("product.storage_gb"), mean, config)


def with_value(rows: DataFrame, offers: DataFrame, config: Config) -> DataFrame:
    """rows (id, task, product, ...) with offers, exact, resale and fee_rate, as of resale_values(); nulls without a match.

    A product's value in a scan is worked out once, for all listings of it; offers are matched by title, so the
    pairs of listings and offers are never made. Listings that are no known product share the value of all offers
    of their scan. Scans with the same offers have the same values to the last digit, so profits can be ranked.
    """
    rows = with_want(rows)
    priced = offers.select("task", "title", "platform", "euros")
    known = scored_titles(rows, title_facts(offers)).select("task", "want", "gb", "title", "offer_gb").join(priced, ["task", "title"])
    some = rows.where("want is null").select("task").distinct()
    none = F.lit(None).cast("int")
    unknown = priced.join(some, "task", "left_semi").withColumns({"want": F.lit(""), "gb": none, "offer_gb": none})
    value = _values(known.unionByName(unknown.select(*known.columns)), ["task", "want", "gb"], F.col("gb"), pricing.blended_fee(F.col("platform"), config), config).drop("gb")
    value = value.withColumnsRenamed({"task": "task_", "want": "want_"})
    same = (F.col("task") == F.col("task_")) & (F.coalesce("want", F.lit("")) == F.col("want_"))
    return rows.join(value, same, "left").drop("task_", "want_", "want")


def _spellings(key: Column) -> Column:
    """A key with its terabytes spelled the other way."""
    other = key
    for old, new in (("1024GB", "#1"), ("2048GB", "#2"), ("1TB", "1024GB"), ("2TB", "2048GB"), ("#1", "1TB"), ("#2", "2TB")):
        other = F.regexp_replace(other, old, new)
    return other


def with_reference(rows: DataFrame, references: DataFrame) -> DataFrame:
    """rows (product, ...) with reference: the reference price of the product.

    The product's key, then its key with the other spelling of terabytes, then the nearest storage in its family, the
    first in the table's order on ties, adjusted by storage. A reference belongs to the families that its key begins
    with, word by word, so all three are equi-joins; the table has at most one row for each key, and a family's rows
    come as one array, which is as long as the family has storage sizes.
    """
    key, tiers = F.col("product.standard_key"), F.struct(*TIERS)
    exact = references.select(F.col("standard_key").alias("key_"), tiers.alias("exact_"))
    spelled = references.select(F.col("standard_key").alias("other_key_"), tiers.alias("spelled_"))
    near = references.select(titles.storage_gb(F.col("standard_key")).alias("have"), "ordinal", tiers.alias("near"), F.split("standard_key", " ").alias("words"))
    heads = F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: F.array_join(F.slice("words", F.lit(1), n), " "))
    near = near.where("have is not null").select("have", "ordinal", "near", F.explode(F.array_distinct(heads)).alias("family_"))
    near = near.groupBy("family_").agg(F.collect_list(F.struct("have", "ordinal", "near")).alias("sizes_"))
    out = rows.withColumns({"key_": key, "other_key_": _spellings(key), "family_": F.col("product.family"), "gb_": F.col("product.storage_gb")})
    out = out.join(exact, "key_", "left").join(spelled, "other_key_", "left").join(near, "family_", "left")
    by_distance = F.transform("sizes_", lambda x: F.struct(F.abs(x["have"] - F.col("gb_")).alias("off"), x["ordinal"].alias("ordinal"), x["have"].alias("have"), x["near"].alias("near")))
    out = out.withColumn("nearest_", F.when(F.col("gb_").isNotNull(), F.array_min(by_distance)))
    adjusted = [pricing.reference_adjusted(F.col(f"nearest_.near.{t}"), F.col("nearest_.have"), F.col("gb_")).alias(t) for t in TIERS]
    out = out.withColumn("r_", F.coalesce("exact_", "spelled_", F.when(F.col("nearest_").isNotNull(), F.struct(*adjusted))))
    price = pricing.tier_price(F.col("product.condition"), {t: F.col(f"r_.{t}") for t in TIERS})
    out = out.withColumn("reference", F.when(F.col("r_").isNotNull(), price))
    return out.drop("key_", "other_key_", "family_", "gb_", "exact_", "spelled_", "sizes_", "nearest_", "r_")


def reference_prices(products: DataFrame, references: DataFrame) -> DataFrame:
    """(id, reference) of each product (id, product) that is known, as of with_reference()."""
    return with_reference(products.where("product is not null").select("id", "product"), references).select("id", "reference")


def evaluate(listings: DataFrame, offers: DataFrame, references: DataFrame, config: Config, rate: float | None = None) -> DataFrame:
    """listings with product, risk, landed, profit and whether and why they are hidden: a function of the tables and the parameters alone."""
    rows = with_reference(with_value(with_product(listings), offers, config), references)
    resale = F.coalesce(F.nullif("resale", F.lit(0.0)), F.col("reference"), F.lit(0.0))
    rows = rows.withColumn("landed", pricing.landed_cost(F.col("price"), config, None if rate is None else F.lit(rate)))
    rows = rows.withColumn("profit", pricing.profit(resale, F.coalesce("fee_rate", F.lit(config.fee_default)), F.col("landed.total"), config))
    rows = risk.with_risk(rows)
    by_risk = risk.hidden_by_risk(F.col("risk"), config.hide_above)
    little, few = ~F.col("profit.enough_margin"), ~F.col("profit.enough_profit")
    why = F.when(F.col("risk.dropped"), "blacklist").when(by_risk, "risk").when(little & few, "margin, profit").when(little, "margin").when(few, "profit")
    return rows.withColumn("hidden", by_risk | F.col("profit.hidden")).withColumn("hidden_reason", why)


def summary(evaluated: DataFrame, config: Config) -> DataFrame:
    """One row: total, shown, hidden_scam, hidden_profit, avg_margin (shown, one decimal), avg_risk (all), best_profit, best_margin; zeros when empty."""
    shown, scam = ~F.col("hidden"), F.col("hidden") & risk.hidden_by_risk(F.col("risk"), config.hide_above)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return evaluated.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(shown).alias("shown"), F.count_if(scam).alias("hidden_scam"), F.count_if(F.col("hidden") & ~scam).alias("hidden_profit"),
        zero(js_round(F.avg(F.when(shown, F.col("profit.margin"))) * 10) / 10).alias("avg_margin"), F.coalesce(js_round(F.avg("risk.score")), F.lit(0)).cast("int").alias("avg_risk"),
        zero(F.max(F.when(shown, F.col("profit.profit")))).alias("best_profit"), zero(F.max(F.when(shown, F.col("profit.margin")))).alias("best_margin"),
    )
