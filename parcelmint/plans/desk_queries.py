"""Queries on what is done around an evaluation: labels, reference table, enrichment, catalog, exports, stored results, pasted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelmint.functions import labels, prices, pricing, risk, titles
from parcelmint.functions.config import BOUNDS, Config
from parcelmint.operators import analytics, evaluate, references, relational, results
from parcelmint.plans.bindings import LISTINGS_SQL, NOTES, OFFERS_SQL, TOKENS, listings, offers, out, pick, sql_list, table
from parcelmint.plans.catalog import query
from parcelmint.plans.margin_queries import C, _r, evaluated, evaluated_sql
from parcelmint.sources import exports, pages

def _key() -> Column:
    return F.col("p_partkey")


def _part(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    return table(spark, sf_dir, "part").select(_key().alias("id"), *columns)


@query("X26", f"""WITH {LISTINGS_SQL} SELECT id, trim(CASE kind
  WHEN 'iphone' THEN 'i15' || CASE WHEN family LIKE '%Pro%' THEN 'P' ELSE '' END || ' ' || coalesce(CAST(gb AS VARCHAR), '')
  WHEN 'macbook' THEN 'MB ' || coalesce(CAST(gb AS VARCHAR), '') WHEN 'ipad' THEN 'iPad ' || coalesce(CAST(gb AS VARCHAR), '') ELSE '#' || (id + 1) END) AS label FROM listings""")
def x26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.with_product(listings(spark, sf_dir))
    return rows.select("id", labels.chart_label(F.col("product.standard_key"), F.col("product.storage_gb"), F.col("id")).alias("label"))


_KEYS = [
    ("iPhone 15 128GB", "iphone"), ("macbook Air M3", "macbook"), ("iPad Air 5", "ipad"), ("PlayStation 5 Slim", "ps5"), ("Galaxy S24", "samsung"), ("Apple Watch SE 3", "applewatch"),
    ("DJI Mini 3", "dji"), ("POCO F6", "xiaomi"), ("Redmi 13", "xiaomi"), ("ROG Ally", "gaming"), ("Steam Deck", "gaming"), ("my iPad", "iphone"), ("Nokia", "iphone"),
]


@query("X28", f"SELECT p_partkey AS id, {sql_list([v for _, v in _KEYS])}[p_partkey % {len(_KEYS)} + 1] AS category FROM part")
def x28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, labels.key_category(pick([k for k, _ in _KEYS], _key() % len(_KEYS))).alias("category"))


@query("X29", """SELECT doc_id, CASE WHEN regexp_matches(text, '[",\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field,
  substr(lower(regexp_replace(text, '[^a-zA-Z0-9]+', '-', 'g')), 1, 40) AS slug FROM documents""")
def x29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as fields of CSV, and as parts of a file's name."""
    return table(spark, sf_dir, "documents").select("doc_id", labels.csv_field(F.col("text")).alias("field"), labels.slug(F.col("text")).alias("slug"))


_REGION, _LOCK = ["china", "international", "us", "japan", "korea", "unknown", None], ["unlocked", "carrier_locked", "icloud_locked", "mdm_locked", "unknown"]
_CONDITION, _CATEGORY = [*labels.CONDITIONS], [*labels.CATEGORIES, "other"]


@query("X35", f"""SELECT p_partkey AS id, {sql_list(['CN', 'INT', 'US', 'JP', 'KR', None, None])}[p_partkey % 7 + 1] AS region,
  {sql_list(['Unlocked', 'Locked', 'iCloud', 'MDM', None])}[p_partkey % 5 + 1] AS lock,
  {sql_list(['New', 'Open Box', 'Excellent', 'Very Good', 'Good', 'Fair', 'Used'])}[p_size % 7 + 1] AS condition,
  {sql_list(['iPhone', 'MacBook', 'iPad', 'PlayStation 5', 'Samsung', 'Apple Watch', 'DJI', 'Xiaomi', 'Gaming', 'other'])}[p_size % 10 + 1] AS category FROM part""")
def x35(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    shown = {
        "region": labels.badge(pick(_REGION, _key() % 7), labels.REGIONS), "lock": labels.badge(pick(_LOCK, _key() % 5), labels.LOCKS),
        "condition": labels.label(pick(_CONDITION, size % 7), labels.CONDITIONS), "category": labels.label(pick(_CATEGORY, size % 10), labels.CATEGORIES),
    }
    return _part(spark, sf_dir, *[v.alias(k) for k, v in shown.items()])


_BANDED = ["iphone", "macbook", "gaming", "dji", "other"]


@query("P20", f"""SELECT p_partkey AS id, b.k AS place, b.least, b.most FROM part, (VALUES
  (0, 0, 2500, 5500), (0, 1, 3500, 7500), (0, 2, 1200, 3000), (1, 0, 3000, 6500), (1, 1, 5500, 14000), (2, 0, 1500, 3200), (2, 1, 2500, 5000), (3, 0, 1800, 4500), (3, 1, 4500, 12000), (4, 0, 1500, 5000), (4, 1, 4000, 10000)) b(c, k, least, most)
  WHERE p_partkey % 5 = b.c AND p_retailprice * 2.5 BETWEEN b.least AND b.most""")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of a category that a price lies in."""
    rows = _part(spark, sf_dir, (F.col("p_retailprice") * 2.5).alias("price"), F.posexplode(labels.price_bands(pick(_BANDED, _key() % 5))).alias("place", "b"))
    return rows.where(F.col("price").between(F.col("b.least"), F.col("b.most"))).select("id", "place", "b.least", "b.most")


@query("U04", "SELECT p_partkey AS id, ['换屏 (replaced screen)|无盒 (no box)', '无盒 (no box)', '', '换屏 (replaced screen)|无盒 (no box)'][p_partkey % 4 + 1] AS shown FROM part")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without those that hold a flag."""
    tokens = F.array(F.lit("换屏 (replaced screen)"), F.lit("无盒 (no box)"))
    flags = F.split(pick(["Screen Replaced", "replaced screen", "screen|box", "Locked"], _key() % 4), "[|]")
    return _part(spark, sf_dir, F.array_join(labels.unexplained(tokens, flags), "|").alias("shown"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference row for each part; some without a fair price."""
    new = F.col("p_retailprice")
    tiers = {"new": new, "excellent": new - 80, "very_good": new - 150, "good": new - 230, "fair": F.when(_key() % 3 == 0, new - 330)}
    key = F.concat_ws(" ", pick([k for k, _ in _KEYS], _key() % len(_KEYS)), _key().cast("string"))
    return table(spark, sf_dir, "part").select(key.alias("standard_key"), *[v.alias(k) for k, v in tiers.items()])


_SEED_SQL = f"""seed AS (SELECT {sql_list([k for k, _ in _KEYS])}[p_partkey % {len(_KEYS)} + 1] || ' ' || p_partkey AS standard_key, {sql_list([v for _, v in _KEYS])}[p_partkey % {len(_KEYS)} + 1] AS category,
  p_retailprice - 230 AS good, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice - 330 ELSE floor((p_retailprice - 230) * 0.75 + 0.5) END AS fair FROM part)"""


@query("S17", f"WITH {_SEED_SQL} SELECT standard_key, category, {_r('fair')} AS fair FROM seed")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty table is seeded; one with rows stays as it is."""
    seed = _references(spark, sf_dir)
    full = references.seeded(seed.limit(0).withColumn("category", F.lit("")), seed)
    again = references.seeded(full, seed.where("good < 0"))
    return again.select("standard_key", "category", out(F.col("fair")).alias("fair"))


@query("S15", f"WITH {_SEED_SQL} SELECT category, count(*) AS n, {_r('sum(fair) / count(*)')} AS mean_fair FROM seed GROUP BY category")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = references.seeded(_references(spark, sf_dir).limit(0).withColumn("category", F.lit("")), _references(spark, sf_dir))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), out(F.sum("fair") / F.count(F.lit(1))).alias("mean_fair"))


@query("S16", f"WITH {_SEED_SQL} SELECT standard_key, category, CAST(row_number() OVER (PARTITION BY category ORDER BY standard_key) AS INT) AS place FROM seed QUALIFY place <= 20")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty rows of each category by key."""
    rows = references.seeded(_references(spark, sf_dir).limit(0).withColumn("category", F.lit("")), _references(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("category").orderBy("standard_key"))
    return rows.select("standard_key", "category", place.alias("place")).where("place <= 20")


@query("P15", f"WITH {_SEED_SQL} SELECT standard_key FROM seed WHERE category = 'xiaomi'")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = references.seeded(_references(spark, sf_dir).limit(0).withColumn("category", F.lit("")), _references(spark, sf_dir))
    return references.of_category(rows, "xiaomi").select("standard_key")


@query("N11", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'key or category too long' WHEN 2 THEN 'price out of bounds' WHEN 3 THEN 'price out of bounds' END AS rejected FROM part""")
def n11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that must not be stored, and why."""
    k = _key() % 6
    key = F.when(k == 0, "").when(k == 1, F.repeat(F.lit("x"), 121)).otherwise("iPhone 15 128GB")
    new = F.when(k == 2, -1.0).when(k == 3, float("nan")).when(k == 4, 1_000_000.0).otherwise(F.col("p_retailprice"))
    others = [F.lit(1.0).alias(c) for c in references.PRICES[1:]]
    return references.checked(_part(spark, sf_dir, key.alias("standard_key"), F.lit("iphone").alias("category"), new.alias("new"), *others)).select("id", "rejected")


@query("S22", f"""SELECT p_partkey AS id, 'Key "' || p_partkey || '", red' AS standard_key, CASE WHEN p_partkey % 2 = 0 THEN 'ipad' ELSE 'iphone' END AS category, 1000.0 + p_size AS new,
  CAST(0 AS DOUBLE) AS excellent, CAST(-3.5 AS DOUBLE) AS very_good, CAST(p_size AS DOUBLE) AS good, CAST(0 AS DOUBLE) AS fair FROM part WHERE p_partkey % 5 > 0""")
def s22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a CSV: quoted keys, unknown categories, prices with signs and words, blank keys."""
    key = F.when(_key() % 5 == 0, " ").otherwise(F.concat(F.lit('"Key ""'), _key().cast("string"), F.lit('"", red"')))
    kind = F.when(_key() % 2 == 0, " iPad ").otherwise("phones")
    size = F.col("p_size").cast("string")
    line = F.concat_ws(",", key, kind, F.concat(F.lit("€"), (F.col("p_size") + 1000).cast("string"), F.lit(".0")), F.lit("none"), F.lit("-3.5x"), F.concat(size, F.lit(" EUR")), F.lit(""))
    return references.from_lines(_part(spark, sf_dir, line.alias("line")))


@query("S21", """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '"a, ""' || p_partkey || '""' || '"' ELSE 'k' || p_partkey END || ',ipad,' || (p_size + 100) || ',' || (p_size + 90) || '.5,80,70,60' AS line FROM part""")
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows as lines of CSV."""
    key = F.when(_key() % 2 == 0, F.concat(F.lit('a, "'), _key().cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("k"), _key().cast("string")))
    values = [(F.col("p_size") + 100.0).alias("new"), (F.col("p_size") + 90.5).alias("excellent"), F.lit(80.0).alias("very_good"), F.lit(70.0).alias("good"), F.lit(60.0).alias("fair")]
    return _part(spark, sf_dir, key.alias("standard_key"), F.lit("ipad").alias("category"), *values).select("id", references.to_line().alias("line"))


_LONG = "机器正常使用痕迹，功能全部正常，配件齐全，支持当面验机，非诚勿扰，价格可以小刀"


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every third listing: longer or shorter texts, labels, pictures, a rating for some."""
    key = F.col("id")
    return listings(spark, sf_dir).where(key % 3 == 0).select(
        key.alias("href"), F.when(key % 2 == 0, 88.0).alias("rating"), (key % 4).cast("int").alias("images"), F.array_repeat(F.lit("p"), (key % 4).cast("int")).alias("pictures"),
        F.when(key % 2 == 0, _LONG).otherwise("短").alias("description"), F.when(key % 9 == 0, "版本 海外有锁").otherwise("").alias("labels"),
    )


_ENRICHED_SQL = f"""enriched AS (SELECT id, CASE WHEN id % 6 = 0 THEN 88 ELSE rating END AS rating, CASE WHEN id % 3 = 0 AND id % 4 > 0 THEN id % 4 ELSE images END AS images,
  CASE WHEN id % 6 = 0 THEN {len(_LONG)} WHEN id % 3 = 0 AND note_length = 0 THEN 1 ELSE note_length END + CASE WHEN id % 9 = 0 THEN 8 ELSE 0 END AS n FROM listings)"""


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumn("href", F.col("id")).withColumn("pictures", F.array().cast("array<string>"))
    return results.enriched(rows, _details(spark, sf_dir))


@query("J9", f"WITH {LISTINGS_SQL}, {_ENRICHED_SQL} SELECT id, CAST(rating AS DOUBLE) AS rating, CAST(images AS INT) AS images, CAST(n AS INT) AS n FROM enriched")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with what their own pages tell (S14, C25)."""
    return _enriched(spark, sf_dir).select("id", "rating", F.col("images").cast("int").alias("images"), F.length("description").alias("n"))


@query("C25", f"""WITH {LISTINGS_SQL}, said AS (SELECT id, {sql_list(NOTES)}[note + 1] AS own, CASE WHEN id % 2 = 0 THEN '{_LONG}' ELSE '短' END AS found FROM listings WHERE id % 3 = 0)
  SELECT id, trim(CASE WHEN length(found) > length(own) THEN found ELSE own END || CASE WHEN id % 9 = 0 THEN ' 版本 海外有锁' ELSE '' END) AS description FROM said""")
def c25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer description with the block of labels."""
    return _enriched(spark, sf_dir).where("id % 3 = 0").select("id", "description")


_MODELS = [(0, "apple", "phone", "iphone", "15", "Pro", "iPhone 15 Pro"), (1, "apple", "phone", "iphone", "15", "Base", "iPhone 15"), (2, "apple", "phone", "iphone", "old", "Base", "iphone 15"), (3, "apple", "tablet", "ipad", "air", "Air 5", "iPad Air 5"), (4, "samsung", "phone", "samsung", "s24", "Ultra", "Galaxy S24 Ultra"), (5, "apple", "phone", "ipad", "x", "wrong category", "MacBook Air M3")]


@query("J10", f"""WITH {OFFERS_SQL} SELECT offer AS id, CASE family WHEN 'Galaxy S24 Ultra' THEN 'samsung' ELSE 'apple' END AS brand, CASE family WHEN 'iPad Air 5' THEN 'Air 5' WHEN 'iPhone 15 Pro' THEN 'Pro' WHEN 'iPhone 15' THEN 'Base' ELSE 'Ultra' END AS model,
  CASE family WHEN 'iPad Air 5' THEN 'air' WHEN 'Galaxy S24 Ultra' THEN 's24' ELSE '15' END AS generation, CASE WHEN gb IS NULL THEN 'all' ELSE CAST(gb AS VARCHAR) END AS storage FROM offers WHERE family IN ('iPhone 15 Pro', 'iPhone 15', 'iPad Air 5', 'Galaxy S24 Ultra')""")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's entry for a query, its storage left out; of two entries the first."""
    catalog = spark.createDataFrame(_MODELS, "ordinal int, brand string, type string, category string, generation string, model string, query string")
    o = offers(spark, sf_dir)
    asked = o.select(F.col("offer").alias("id"), F.concat(F.lit(" "), F.upper("title")).alias("query"), titles.category(F.col("title")).alias("category"))
    return results.catalog_lookup(asked, catalog).where("brand is not null").select("id", "brand", "model", "generation", "storage")


@query("J11", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '2024-09' WHEN p_partkey % 3 = 0 THEN '2023-03' ELSE CAST(2000 + p_size AS VARCHAR) END AS released FROM part")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's own release date, else its generation's, else its year."""
    models = table(spark, sf_dir, "part").select(_key().alias("query"), (_key() % 3).alias("generation"), (F.col("p_size") + 2000).cast("string").alias("year"))
    own = models.where("query % 4 = 0").select("query", F.lit("2024-09").alias("released"))
    generations = spark.createDataFrame([(0, "2023-03")], "generation long, released string")
    return results.release_dates(models, generations, own).select(F.col("query").alias("id"), "released")


@query("W07", """WITH f AS (SELECT max(c_acctbal) FILTER (c_acctbal <> 0) AS high, least(min(c_acctbal) FILTER (c_acctbal <> 0), 0) AS low FROM customer)
  SELECT c_custkey AS id, floor((c_acctbal - low) / (high - low) * 1e6 + 0.5) / 1e6 AS height FROM customer, f""")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results.chart_heights(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("v")), "v")
    return rows.select("id", (F.floor(F.col("height") * 1e6 + 0.5) / 1e6).alias("height"))


_RANKS = {"product": "lower(standard_key)", "cost": "price", "resale": "resale", "profit": "profit", "margin": "margin", "risk": "score"}


@query("L01k", evaluated_sql(C) + " " + " UNION ALL ".join(f"(SELECT '{k}' AS key, id FROM evaluated ORDER BY {v} {'ASC' if k in ('product', 'risk') else 'DESC'}, id LIMIT 20)" for k, v in _RANKS.items()))
def l01k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty by each of the six keys."""
    e, all_ = evaluated(spark, sf_dir), None
    for k in _RANKS:
        first = results.ranked(e, k, k not in ("product", "risk")).limit(20).select(F.lit(k).alias("key"), "id")
        all_ = first if all_ is None else all_.unionByName(first)
    return all_


@query("P22", evaluated_sql(C) + """ SELECT 'card' AS export, id FROM evaluated WHERE (by_risk OR by_profit) AND (dropped OR score >= 60)
  UNION ALL SELECT 'cell', id FROM evaluated WHERE family = 'iPhone 15 Pro' AND cond = 'good' UNION ALL SELECT 'both', id FROM evaluated WHERE (by_risk OR by_profit) AND (dropped OR score >= 60) AND family = 'Galaxy S24 Ultra' AND cond = 'new'""")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of a card's listings, of a heatmap's cell and of both, hidden ones too."""
    e, found = evaluated(spark, sf_dir), None
    for name, chosen in (("card", ("scam",)), ("cell", (None, "iPhone 15 Pro", "good")), ("both", ("scam", "Galaxy S24", "new"))):
        rows = results.exported(e, *chosen).select(F.lit(name).alias("export"), "id")
        found = rows if found is None else found.unionByName(rows)
    return found


_ACQ = f"(price * {C.rate} * {1 + C.exchange_fee})"
_BASE = f"({_ACQ} + {_ACQ} * {C.agent_fee} + {C.inspection} + {C.source_shipping} + {_ACQ} * {C.insurance} + {C.freight})"
_YES = "CASE WHEN {} THEN 'YES' ELSE 'NO' END"
#: All columns of an export from the numbers that the texts were made of.
_EXPORTED = {
    "Product": "standard_key", "Condition": "CASE cond WHEN 'new' THEN 'New' WHEN 'open_box' THEN 'Open Box' WHEN 'excellent' THEN 'Excellent' WHEN 'very_good' THEN 'Very Good' ELSE 'Good' END", "Price_CNY": "price",
    **{k: f"floor(({v}) * 100 + 0.5) / 100" for k, v in {
        "Acquisition_EUR": _ACQ, "Agent_Fee_EUR": f"{_ACQ} * {C.agent_fee}", "Inspection_EUR": C.inspection, "CN_Domestic_EUR": C.source_shipping, "Insurance_EUR": f"{_ACQ} * {C.insurance}", "Intl_Shipping_EUR": C.freight,
        "Customs_Clearance_EUR": C.customs, "Import_Duty_EUR": f"{_BASE} * {C.duty}", "Import_VAT_EUR": f"({_BASE} + {C.customs} + {_BASE} * {C.duty}) * {C.vat}", "PT_Domestic_EUR": C.home_shipping, "Total_Landed_EUR": "landed",
        "EU_Baseline_EUR": "resale", "Resale_Fee_EUR": "resale * fee_rate", "Net_Resale_EUR": "resale - resale * fee_rate", "Net_Profit_EUR": "profit"}.items()},
    "Margin_Pct": "floor(margin * 10 + 0.5) / 10", "Risk_Score": "CAST(score AS INT)", "Dropped": _YES.format("dropped"), "Hidden": _YES.format("by_risk OR by_profit"),
    "Hidden_Reason": f"CASE WHEN dropped THEN 'blacklist' WHEN by_risk THEN 'risk' WHEN margin < {C.min_margin * 100} AND profit < {C.min_profit} THEN 'margin, profit' WHEN margin < {C.min_margin * 100} THEN 'margin' WHEN profit < {C.min_profit} THEN 'profit' ELSE '' END",
    "Seller_Location": "NULL", "Seller_Verified": _YES.format("verified"), "Seller_Transactions": "transactions", "Seller_Rating": "CAST(rating AS DOUBLE)", "Wants_Count": "NULL", "Image_Count": "images", "Condition_Flags": "NULL",
    "Region_Version": "CASE WHEN note = 6 THEN 'china' ELSE 'unknown' END", "Lock_Status": "lock", "Storage_GB": "gb", "Color": "CASE WHEN note = 3 THEN '白色' END", "Chip": "CASE WHEN kind = 'macbook' THEN 'M3' END", "RAM_GB": "NULL",
    "Display_Inch": "CASE WHEN kind = 'macbook' THEN 13 END", "Battery_Health": "CASE WHEN note = 3 AND kind IN ('iphone', 'samsung') THEN 93 END", "Release_Year": "NULL", "Form_Factor": "NULL", "Drive_Config": "NULL", "Goofish_Href": "NULL",
    "EU_Comps_Count": "coalesce((SELECT v.offers FROM valued v WHERE v.id = evaluated.id), 0)", "Goofish_Title": "family || CASE WHEN gb IS NULL THEN '' ELSE ' ' || gb || 'G' END || ' ' || " + sql_list(TOKENS) + "[(id // 6) % 5 + 1]", "Description": sql_list(NOTES) + "[note + 1]",
}


@query("S19", evaluated_sql(C) + " SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in _EXPORTED.items()) + " FROM evaluated")
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 45 columns of an export (P16)."""
    return exports.flat(evaluated(spark, sf_dir))


@query("P16", evaluated_sql(C) + " SELECT standard_key AS Product, CAST(count(*) AS INT) AS n, max(gb) AS Storage_GB FROM evaluated GROUP BY standard_key")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two visible columns of an export."""
    shown = exports.flat(evaluated(spark, sf_dir)).select("Product", "Storage_GB")
    return shown.groupBy("Product").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("Storage_GB").alias("Storage_GB"))


@query("S20", evaluated_sql(C) + " SELECT 'iphone' AS query, count(*) AS total_listings, count(*) FILTER (NOT (by_risk OR by_profit)) AS viable_listings FROM evaluated")
def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a JSON export says of itself."""
    return exports.meta(evaluated(spark, sf_dir), "iphone")


_NOW = "2024-01-15 00:00:00"


@query("N03", f"SELECT event_id, CAST(floor(epoch(TIMESTAMP '{_NOW}') - epoch(ts)) AS BIGINT) AS age FROM events")
def n03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", results.age_seconds(F.col("ts").cast("timestamp"), F.expr(f"TIMESTAMP '{_NOW}'")).alias("age"))


@query("N05", "SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 3 END AS INT) AS n FROM part")
def n05(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(_key() % 3 > 0, F.array_repeat(F.lit("x"), (_key() % 3).cast("int")))
    return _part(spark, sf_dir, F.size(results.or_empty(some)).alias("n"))


_STORED = [
    '{"summary":{"total":3,"shown":1},"warnings":["w"],"listings":[{"id":1,"euComps":["a"],"listing":{"imageUrls":["u"],"conditionFlags":null},"scam":{"reasons":["r"]}}]}',
    '{"listings":{"0":1},"warnings":null}', "not json", '{"summary":{"total":2,"shown":2},"listings":[{"id":1},{"id":2,"euComps":["a","b"],"listing":{},"scam":{}}]}',
]


@query("N08", "SELECT p_partkey AS id, CAST([3, 0, 0, 2][p_partkey % 4 + 1] AS INT) AS total, CAST([1, 0, 0, 0][p_partkey % 4 + 1] AS INT) AS warnings, CAST([1, 0, 0, 2][p_partkey % 4 + 1] AS INT) AS listings, CAST([1, 0, 0, 2][p_partkey % 4 + 1] AS INT) AS offers FROM part")
def n08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results with broken or missing parts made empty."""
    r = _part(spark, sf_dir, results.repaired(pick(_STORED, _key() % 4)).alias("r")).select("id", "r.*")
    offers_ = F.aggregate("listings", F.lit(0), lambda s, x: s + F.size(x["euComps"]))
    return r.select("id", "summary.total", F.size("warnings").alias("warnings"), F.size("listings").alias("listings"), offers_.alias("offers"))


@query("N09", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 5.0::DOUBLE END AS vat, 7.0::DOUBLE AS duty, CASE WHEN p_partkey % 3 = 0 THEN 9.0::DOUBLE END AS added FROM part")
def n09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters section by section: those that are changed, and the others as they were."""
    inner = "map<string,double>"
    defaults = F.create_map(F.lit("tax"), F.create_map(F.lit("vat"), F.lit(5.0), F.lit("duty"), F.lit(7.0)))
    vat = F.when(_key() % 2 == 0, F.create_map(F.lit("tax"), F.create_map(F.lit("vat"), F.col("p_size").cast("double")))).otherwise(F.create_map().cast(f"map<string,{inner}>"))
    more = F.when(_key() % 3 == 0, F.create_map(F.lit("more"), F.create_map(F.lit("added"), F.lit(9.0)))).otherwise(F.create_map().cast(f"map<string,{inner}>"))
    m = results.merged(results.merged(defaults, vat), more)
    at = lambda a, b: F.try_element_at(F.try_element_at(m, F.lit(a)), F.lit(b))
    return _part(spark, sf_dir, at("tax", "vat").alias("vat"), at("tax", "duty").alias("duty"), at("more", "added").alias("added"))


@query("N10", f"SELECT p_partkey AS id, greatest({BOUNDS['freight'][0]}, least({BOUNDS['freight'][1]}, p_retailprice - 500)) AS freight, greatest({BOUNDS['vat'][0]}, least({BOUNDS['vat'][1]}, p_size / 20)) AS vat FROM part")
def n10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides within their bounds, for many what-ifs at once."""
    return _part(spark, sf_dir, pricing.bounded("freight", F.col("p_retailprice") - 500).alias("freight"), pricing.bounded("vat", F.col("p_size") / 20).alias("vat"))


@query("S18", "SELECT o_orderkey AS task, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'queued' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'updated' ELSE 'kept' END AS action FROM orders")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks created, then those that ended updated, by key; of two writes the last counts."""
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.lit("queued").alias("status"))
    writes = tasks.where("task % 3 = 0").select("task", F.explode(F.array(F.struct(F.lit("running").alias("status"), F.lit(1).alias("at")), F.struct(F.lit("done").alias("status"), F.lit(2).alias("at")))).alias("w"))
    return relational.upsert(tasks, writes.select("task", "w.*"), "task", "at")


@query("S24", f"""WITH {OFFERS_SQL} SELECT platform, count(*) AS n, count(gb) AS with_storage, count(*) FILTER (euros >= 100) AS with_price,
  (SELECT string_agg(CAST(o.offer AS VARCHAR), ',' ORDER BY o.offer) FROM (SELECT offer FROM offers i WHERE i.platform = offers.platform ORDER BY offer LIMIT 5) o) AS samples FROM offers GROUP BY platform""")
def s24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source gave, and five samples."""
    rows = offers(spark, sf_dir).select("platform", "offer", "euros", titles.storage_gb(F.col("title")).alias("gb"))
    found = results.profile(rows, "platform", {"storage": F.col("gb").isNotNull(), "price": F.col("euros") >= 100}, "offer")
    return found.withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query("L03", f"WITH {LISTINGS_SQL} SELECT id FROM listings ORDER BY price, id LIMIT 100")
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.first_rows(listings(spark, sf_dir), ["price", "id"], 100).select("id")


@query("L08", f"WITH {OFFERS_SQL} SELECT offer FROM offers WHERE platform = 'olx' ORDER BY offer LIMIT 10")
def l08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.first_rows(offers(spark, sf_dir).where("platform = 'olx'"), ["offer"], 10).select("offer")


@query("L12", "SELECT o_orderkey AS task, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS place FROM orders WHERE o_orderstatus = 'F' QUALIFY place <= 100")
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred points of a trend, the newest first."""
    last = results.first_rows(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 100)
    return last.select(F.col("o_orderkey").alias("task"), F.row_number().over(Window.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("place"))


@query("L09", f"WITH {LISTINGS_SQL}, cells AS (SELECT DISTINCT family, cond FROM listings) SELECT family, cond AS condition, CAST(dense_rank() OVER (ORDER BY family) AS INT) AS row_, list_position({sql_list(analytics.CONDITION_ORDER)}, cond) AS column_ FROM cells")
def l09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of the heatmap: families by code point, conditions in their fixed order."""
    cells = evaluate.with_product(listings(spark, sf_dir)).select(F.col("product.family").alias("family"), F.col("product.condition").alias("condition")).distinct()
    column = F.array_position(F.array(*map(F.lit, analytics.CONDITION_ORDER)), F.col("condition")).cast("int")
    return cells.select("family", "condition", F.dense_rank().over(Window.orderBy("family")).alias("row_"), column.alias("column_"))


@query("J2", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 700.0::DOUBLE WHEN 1 THEN 700.0::DOUBLE WHEN 2 THEN 900.0::DOUBLE END AS reference FROM part")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by key, in either spelling of terabytes."""
    refs = spark.createDataFrame([(0, "PlayStation 5 1TB", 700.0), (1, "PlayStation 5 2048GB", 900.0)], "ordinal int, standard_key string, new double")
    refs = refs.select("*", *[F.col("new").alias(c) for c in evaluate.TIERS[1:]])
    key = pick(["PlayStation 5 1024GB", "PlayStation 5 1TB", "PlayStation 5 2TB", "PlayStation 4 1TB"], _key() % 4)
    fields = {"standard_key": key, "family": F.lit("Console"), "storage_gb": F.lit(1024), "condition": F.lit("new")}
    return evaluate.reference_prices(_part(spark, sf_dir, F.struct(*[v.alias(k) for k, v in fields.items()]).alias("product")), refs)


@query("J4", f"SELECT p_partkey AS id, {_r('p_retailprice * (0.1 + (SELECT count(*) FROM region) / 1000.0) * 1.025')} AS cost FROM part")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings at one exchange rate that a table of one row holds."""
    rate = table(spark, sf_dir, "region").agg((F.count(F.lit(1)) / 1000.0 + 0.1).alias("rate"))
    rows = _part(spark, sf_dir, F.col("p_retailprice").alias("price")).join(F.broadcast(rate))
    return rows.select("id", out(pricing.landed_cost(F.col("price"), Config(), F.col("rate"))["acquisition"]).alias("cost"))


@query("X15", f"WITH {LISTINGS_SQL} SELECT id, standard_key FROM listings")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_product(listings(spark, sf_dir)).select("id", F.col("product.standard_key").alias("standard_key"))


@query("X20", "SELECT p_partkey AS id, ['Lisboa', 'Portugal', 'Porto - Maia', 'Portugal'][p_partkey % 4 + 1] AS location FROM part")
def x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, prices.location(pick(["Usado Lisboa 12 de maio", "450 €", "Como novo Porto - Maia 3 dias", "Usado 5"], _key() % 4)).alias("location"))


@query("C04", "SELECT p_partkey AS id, ['无进水 (no water damaged)', '', '非翻新 (no refurbished)', ''][p_partkey % 4 + 1] AS denied FROM part")
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir, F.array_join(risk.declarations(pick(["无进水", "进水", "非翻新", "无进水，但曾进水"], _key() % 4)), ",").alias("denied"))


@query("C05", "SELECT p_partkey AS id, CAST([100, 100, 58, 8, 8][p_partkey % 5 + 1] AS INT) AS score, p_partkey % 5 < 2 AS dropped FROM part")
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lock alone does to a listing's risk."""
    lock = pick(["icloud_locked", "mdm_locked", "carrier_locked", "unlocked", None], _key() % 5)
    long_ = F.lit("一段足够长的描述文字一段足够长的描述文字")
    r = risk.report(F.lit("t"), long_, lock, F.lit(99.0), F.lit(99), F.lit(False), F.lit(4))
    return _part(spark, sf_dir, r.alias("r")).select("id", "r.score", "r.dropped")


@query("J7", "SELECT p_partkey AS id, CAST(CASE WHEN p_size % 3 = p_partkey % 3 THEN p_size % 3 ELSE 0 END AS INT) AS pairs FROM part")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with the prices at their places, if there are as many."""
    some = lambda n: F.array_repeat(F.lit("x"), (n % 3).cast("int"))
    return _part(spark, sf_dir, F.size(pages.zipped(some(F.col("p_size")), some(_key()))).alias("pairs"))


def _captured(spark: SparkSession, sf_dir: str, *parts: Column) -> DataFrame:
    """Each page's own html with further blocks made from its id after it."""
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws("", F.coalesce("html", F.lit("")), *parts).alias("html"))


@query("S04", "SELECT page_id, CAST(place AS INT) AS place, 'Listing ' || page_id || '-' || n AS title, page_id % 900 + 1000.0 * n + 0.5 AS price FROM (SELECT page_id, n, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS place FROM pages, (VALUES (1), (2), (4)) v(n)) WHERE page_id % 900 + 1000.0 * n + 0.5 >= 1500")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with a title and a price of pasted pages; the third has no price."""
    pid = F.col("page_id")

    def block(n: int) -> Column:
        amount = (pid % 900 + 1000 * n).cast("string")
        price = F.when(F.length(amount) > 3, F.concat(F.substr(amount, F.lit(1), F.length(amount) - 3), F.lit(","), F.right(amount, F.lit(3)))).otherwise(amount)
        return F.concat(F.lit('<div class="feeds-item-wrap"><h3 class="title">Listing '), pid.cast("string"), F.lit(f"-{n}</h3><span>"), F.lit("none") if n == 3 else F.concat(F.lit("¥ "), price, F.lit(".5")), F.lit("</span></div>"))

    found = pages.pasted(_captured(spark, sf_dir, *map(block, (1, 2, 3, 4))), least=1500)
    return found.select("page_id", "place", "title", "price")
