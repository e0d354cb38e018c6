"""Queries on titles, page text and price texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.functions import compat, flags, matching, prices, relevance, risk, titles
from parcelmint.operators import evaluate
from parcelmint.plans.bindings import LISTINGS_SQL, OFFERS_SQL, RISK_SQL, listings, offers, pick, sql_list, table
from parcelmint.plans.catalog import query
from parcelmint.sources import pages


@query("X16", f"WITH {LISTINGS_SQL}, {RISK_SQL} SELECT id, standard_key, kind AS category, family, gb AS storage_gb, cond AS condition, lock AS lock_status, CASE WHEN note = 6 THEN 'china' ELSE 'unknown' END AS region, CASE WHEN note = 3 AND kind IN ('iphone', 'samsung') THEN 93 END AS battery FROM risk")
def x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole product read from title and description (X04 to X15)."""
    p = evaluate.with_product(listings(spark, sf_dir))
    return p.select("id", *[F.col(f"product.{c}").alias(c) for c in ("standard_key", "category", "family", "storage_gb", "condition", "lock_status")], F.col("product.region_version").alias("region"), F.col("product.battery_health").alias("battery"))


@query("X04", f"WITH {OFFERS_SQL} SELECT offer, gb FROM offers")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("offer", titles.storage_gb(F.col("title")).alias("gb"))


@query("X09", f"WITH {LISTINGS_SQL} SELECT cond AS condition, count(*) AS n FROM listings GROUP BY cond")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).groupBy(titles.condition(F.col("title")).alias("condition")).agg(F.count(F.lit(1)).alias("n"))


@query("X10", f"WITH {LISTINGS_SQL} SELECT CASE cond WHEN 'new' THEN 'Brand New' WHEN 'open_box' THEN 'Open Box' WHEN 'excellent' THEN 'Like New (99%)' WHEN 'very_good' THEN 'Excellent (95%)' ELSE 'Good (90%)' END AS label, count(*) AS n FROM listings GROUP BY 1")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).groupBy(titles.condition_label(titles.condition_raw(F.col("title"))).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("X11", f"WITH {LISTINGS_SQL} SELECT kind AS category, count(*) AS n FROM listings GROUP BY kind")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).groupBy(titles.category(F.col("title")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("X01", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS clean FROM documents")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", titles.clean_title(F.col("text")).alias("clean"))


@query("X02", f"WITH {LISTINGS_SQL} SELECT id, family || CASE WHEN gb IS NULL THEN '' ELSE ' ' || gb || 'GB' END AS head FROM listings")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles for display, up to the condition."""
    shown = titles.display_title(F.col("title"))
    return listings(spark, sf_dir).select("id", F.regexp_replace(shown, " [^ ]+$", "").alias("head"))


@query("X03", "SELECT p_partkey AS id, CASE WHEN gb >= 1024 AND gb % 1024 = 0 THEN CAST(gb // 1024 AS VARCHAR) || 'TB' ELSE CAST(gb AS VARCHAR) || 'GB' END AS label FROM (SELECT p_partkey, p_size * 128 AS gb FROM part)")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), titles.storage_label(F.col("p_size") * 128).alias("label"))


@query("X17", "SELECT l_orderkey AS k, l_linenumber AS n, floor(l_extendedprice * 100 + 0.5) / 100 AS euros FROM lineitem")
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as they stand in offers, with a comma and spaced thousands, read back."""
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    whole, rest = F.floor(cents / 100), cents % 100
    text = F.concat(F.lit("Preço: "), F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string")), F.lit(","), F.lpad(rest.cast("string"), 2, "0"), F.lit(" €"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), prices.euros(text).alias("euros"))


@query("X18", "SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 THEN p_size * 1000 ELSE CASE WHEN 10 * p_size BETWEEN 50 AND 100000 THEN 10 * p_size END END AS BIGINT) AS price FROM part")
def x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source prices with their unit: plain, in thousands, or a year that is no price."""
    size, kind = F.col("p_size"), F.col("p_partkey") % 4
    text = F.when(kind == 3, F.concat(F.lit("¥20"), F.lpad(size.cast("string"), 2, "0"), F.lit("年"))).when(kind == 2, F.concat(F.lit("¥"), size.cast("string"), F.lit("千"))).otherwise(F.concat(F.lit("¥"), (size * 10).cast("string"), F.lit("人想要")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), prices.source_price(text).alias("price"))


@query("X19", "SELECT p_partkey AS id, ['new', 'excellent', 'good', 'very_good', 'very_good'][p_partkey % 5 + 1] AS condition FROM part")
def x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = F.concat(F.lit("Telemóvel "), pick(["Novo", "Como novo", "Usado", "Bom estado", "sem estado"], F.col("p_partkey") % 5))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), prices.card_condition(card).alias("condition"))


@query("X21", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages")
def x21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", prices.page_text(F.col("html")).alias("text"))


@query("X22", "SELECT p_partkey AS id, ['Apple', 'Samsung', 'Xiaomi', 'Sony', 'Unknown'][p_partkey % 5 + 1] AS brand FROM part")
def x22(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = pick(["Apple iPhone 15", "SAMSUNG Galaxy", "xiaomi 14", "Sony PS5", "telemóvel"], F.col("p_partkey") % 5)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), prices.brand(title).alias("brand"))


@query("X25", f"WITH {LISTINGS_SQL} SELECT CASE family WHEN 'Galaxy S24 Ultra' THEN 'Galaxy S24' ELSE family END AS family, count(*) AS n FROM listings GROUP BY 1")
def x25(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate.with_product(listings(spark, sf_dir))
    return p.groupBy(titles.family_of_key(F.col("product.standard_key")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("X27", f"WITH {OFFERS_SQL} SELECT family AS query, count(*) AS n FROM offers GROUP BY family")
def x27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).groupBy(titles.without_storage(F.col("title")).alias("query")).agg(F.count(F.lit(1)).alias("n"))


@query("X31", r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda t: t <> '')) AS words FROM documents")
def x31(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", f"[{compat.SPACES}]+"), lambda t: t != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("words"))


@query("S13", "SELECT p_partkey AS id, 'https://shop.example/s?q=' || replace(p_name, ' ', '%20') || CASE WHEN p_size % 5 > 1 THEN '&page=' || (p_size % 5) ELSE '' END AS url FROM part")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), prices.search_url(F.lit("https://shop.example/s"), F.col("p_name"), F.col("p_size") % 5).alias("url"))


@query("S06", "SELECT page_id, page_id % 4 IN (0, 1) OR (page_id % 4 > 1 AND regexp_matches(html, '猜你喜欢')) AS none FROM pages")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that say that nothing was found, recommend other things, or do so beside pagination."""
    told = pick(["<p>没有找到你想要的宝贝</p>", "<div>为你推荐</div>", "<p>猜你喜欢</p><button class='x search-pagination-arrow-y'>", "<script>猜你喜欢</script>"], F.col("page_id") % 4)
    return table(spark, sf_dir, "pages").select("page_id", pages.says_nothing_found(F.concat(F.coalesce("html", F.lit("")), told)).alias("none"))


@query("P06", "SELECT p_partkey % 4 AS k, p_partkey % 4 IN (0, 1) AS accessory, count(*) AS n FROM part GROUP BY 1")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = pick(["Capa iPhone 15", "iPhone 15 case", "iPhone 15 128GB", "Surface casement"], F.col("p_partkey") % 4)
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 4).alias("k"), relevance.is_accessory(title).alias("accessory")).agg(F.count(F.lit(1)).alias("n"))


@query("P03", "SELECT p_partkey % 6 AS k, p_partkey % 6 < 4 AS junk, count(*) AS n FROM part GROUP BY 1")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = pick(["iPhone 15 包邮", "iPhone 15 空盒", "苹果15 租赁", "iPhone 14 解锁服务", "iPhone 15 Pro 256G 国行", "iPhone 13 128GB 换过屏幕"], F.col("p_partkey") % 6)
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 6).alias("k"), relevance.is_junk(title).alias("junk")).agg(F.count(F.lit(1)).alias("n"))


@query("P04", "SELECT doc_id, contains(lower(text), 'tion') OR contains(lower(text), 'sch') AS hit FROM documents")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", relevance.has_any_token(F.col("text"), "tion, sch").alias("hit"))


@query("P07", f"WITH {OFFERS_SQL} SELECT family, family LIKE 'iPhone 15%' AS relevant, count(*) AS n FROM offers GROUP BY 1, 2")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    return o.groupBy(titles.without_storage(F.col("title")).alias("family"), relevance.is_relevant(F.col("title"), "iPhone 15 256GB").alias("relevant")).agg(F.count(F.lit(1)).alias("n"))


@query("X05", f"WITH {LISTINGS_SQL} SELECT id, CASE WHEN note = 3 THEN 93 END AS battery FROM listings")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", titles.battery_health(F.col("description")).alias("battery"))


@query("X06", f"WITH {LISTINGS_SQL} SELECT id, CASE WHEN note = 3 THEN '白色' END AS color FROM listings")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", titles.color(F.col("description")).alias("color"))


@query("X07", "SELECT p_partkey AS id, CASE WHEN 2000 + p_size BETWEEN 2015 AND 2027 THEN CAST(2000 + p_size AS INT) END AS year FROM part")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("iPad "), (F.col("p_size") + 2000).cast("string"), F.lit("款"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), titles.release_year(text, 2026).alias("year"))


@query("X08", "SELECT p_partkey AS id, CAST(p_size AS INT) AS ram FROM part")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("MacBook Air "), F.col("p_size").cast("string"), F.lit(" GB 内存 512G"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), titles.ram_gb(text).alias("ram"))


@query("X12", "SELECT p_partkey AS id, ['international', 'us', 'japan', 'korea', 'international', 'china', 'international', 'unknown'][p_partkey % 8 + 1] AS region FROM part")
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(["【版本】国际版，比国行便宜", "美版有锁", "日版", "韩版", "港版双卡", "国行双卡", "全球版 国行对比", "【版本】双卡双待"], F.col("p_partkey") % 8)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), titles.region(text).alias("region"))


@query("X13", "SELECT p_partkey AS id, ['icloud_locked', 'mdm_locked', 'unlocked', 'carrier_locked', 'icloud_locked', 'unknown'][p_partkey % 6 + 1] AS lock FROM part")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(["无ID锁", "监管锁", "全网通 无锁", "有锁屏密码", "iCloud  Locked", "成色好"], F.col("p_partkey") % 6)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), titles.lock_status(text).alias("lock"))


@query("X23", f"WITH {LISTINGS_SQL} SELECT id, family || CASE WHEN kind = 'macbook' THEN ' 13\"' ELSE '' END || CASE WHEN gb IS NULL THEN '' ELSE ' ' || gb || 'GB' END AS query FROM listings")
def x23(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("product")
    rows = evaluate.with_product(listings(spark, sf_dir))
    return rows.select("id", matching.offer_query(p["category"], p["family"], p["storage_gb"], p["display_inch"], p["form_factor"], p["drive_config"]).alias("query"))


@query(
    "X24",
    """WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS said, generate_subscripts(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1), 1) - 1 AS place FROM pages), varied AS (
      SELECT page_id, place, CASE (page_id + place) % 3 WHEN 0 THEN '/' || said WHEN 1 THEN 'http://y' || said ELSE said END AS said FROM found)
    SELECT page_id, CAST(place AS INT) AS place, CASE WHEN starts_with(said, '//') THEN 'https:' || said WHEN starts_with(said, '/') THEN 'https://shop' || said ELSE said END AS url FROM varied""",
)
def x24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses in pages, some with another host or another scheme put before them, as absolute ones."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))).alias("place", "said"))
    kind = (F.col("page_id") + F.col("place")) % 3
    said = F.when(kind == 0, F.concat(F.lit("/"), "said")).when(kind == 1, F.concat(F.lit("http://y"), "said")).otherwise(F.col("said"))
    return found.select("page_id", "place", prices.absolute(said, "https://shop").alias("url"))


@query("C01", "SELECT p_partkey AS id, p_partkey % 3 <> 0 AS says FROM part")
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(["整机无进水", "进水修好", "无进水，但曾进水"], F.col("p_partkey") % 3)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), risk.says(text, "进水").alias("says"))


@query("C02", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '无进水' WHEN 1 THEN '' ELSE '没有进水,未进水' END AS denied FROM part")
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(["整机无进水 无进水", "进水修好", "没有进水，未进水"], F.col("p_partkey") % 3)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(risk.negated(text, "进水"), ",").alias("denied"))


@query("C03", "SELECT p_partkey AS id, [1, 0, 1, 1, 0][p_partkey % 5 + 1] = 1 AS dropped FROM part")
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(["翻新机", "非翻新 无进水", "有锁", "有网络锁", "有锁屏密码"], F.col("p_partkey") % 5)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.size(risk.blacklist(text)) > 0).alias("dropped"))


@query("C07", "SELECT p_partkey AS id, CAST([10, 20, 20, 0][p_partkey % 4 + 1] AS INT) AS risk FROM part")
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yellow tokens, capped (A07)."""
    text = pick(["换过电池", "换过屏幕 无盒", "换屏 换电池 维修过", "无拆修"], F.col("p_partkey") % 4)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), risk.yellow_risk(risk.yellow(text)).alias("risk"))


@query("A07", "SELECT p_partkey AS id, CAST(least(20, 10 * (CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 = 1 THEN 1 ELSE 0 END)) AS INT) AS risk FROM part")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten points for each token that asks for care, twenty at most."""
    key = F.col("p_partkey")
    text = F.concat_ws("，", *[F.when(key % n == 1, t) for n, t in ((2, "换过电池"), (3, "换过屏幕"), (5, "无盒"))], F.lit("成色好"))
    return table(spark, sf_dir, "part").select(key.alias("id"), risk.yellow_risk(risk.yellow(text)).cast("int").alias("risk"))


# A title for each rule of a family's generation, some that name several, and one that names none.
MARKED = [
    ("iPhone 15 Pro国行", "iphone 15"),
    ("iPhone 16e", "iphone 16e"),
    ("iPad Pro 11-inch M4", "ipad 4"),
    ("iPad 10", "ipad 10"),
    ("iPad Mini 6", "ipad 6,dji-mini 6"),
    ("MacBook Air M3", "macbook 3"),
    ("Apple Watch Series 9", "watch 9"),
    ("Apple Watch Ultra 2", "watch 2"),
    ("Apple Watch SE 3", "watch 3"),
    ("AirPods Pro 2", "airpods 2"),
    ("Galaxy S24 Ultra", "galaxy s24"),
    ("Galaxy Z Fold 6", "galaxy 6"),
    ("Galaxy Tab S9", "galaxy 9"),
    ("Pixel 8 Pro", "pixel 8"),
    ("PlayStation 5", "playstation 5"),
    ("Sony WH-1000XM5", "sony-headphones 5"),
    ("Nintendo Switch 2", "switch "),
    ("Nintendo Switch OLED", "switch 1"),
    ("Redmi Note 13", "xiaomi 13"),
    ("OnePlus 12", "oneplus 12"),
    ("OPPO Find X 7", "oppo 7"),
    ("HONOR Magic 6", "honor 6"),
    ("realme GT 5", "realme 5"),
    ("vivo X 100", "vivo 100"),
    ("Motorola Edge 50", "motorola 50"),
    ("DJI Mavic 3", "dji-mavic 3"),
    ("DJI Mini 4 Pro", "dji-mini 4"),
    ("DJI Air 3S", "dji-air 3"),
    ("Osmo Pocket 3", "dji-osmo 3"),
    ("DJI RS 4", "dji-rs 4"),
    ("DJI Avata 2", "dji-avata "),
    ("Canon EOS R6", "canon-r 6"),
    ("Nikon Z 8", "nikon-z 8"),
    ("Fujifilm X-T5", "fuji-xt 5"),
    ("x-h2", "fuji-xh 2"),
    ("Fujifilm X100", "fuji-x100 100"),
    ("GoPro HERO 12", "gopro 12"),
    ("Dyson V15", "dyson 15"),
    ("JBL Charge 5", "jbl 5"),
    ("QuietComfort Ultra", "bose-qc ultra"),
    ("QuietComfort 45", "bose-qc 45"),
    ("Roborock S 8", "roborock 8"),
    ("Deebot X 2", "ecovacs 2"),
    ("iPad Pro 11-inch M4 / MacBook Air M3", "ipad 4,macbook 3"),
    ("telemóvel sem marca", ""),
]


@query("C12", f"SELECT p_partkey AS id, {sql_list([m for _, m in MARKED])}[p_partkey % {len(MARKED)} + 1] AS markers FROM part")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 41 rules of families and generations."""
    text = pick([t for t, _ in MARKED], F.col("p_partkey") % len(MARKED))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(relevance.markers(text), ",").alias("markers"))


# Titles of every family with what is read from them: (title, family).
MODELLED = [
    (name, name)
    for rules in (titles.IPHONES, titles.MACBOOKS, titles.IPADS, titles.GALAXIES, titles.WATCHES, titles.DRONES)
    for name in dict.fromkeys(r[1] for r in rules)
    if not name.endswith("+")
]
# A + after a name in capitals is not read; the word is.
MODELLED += [("Galaxy S26 plus", "Galaxy S26+"), ("Galaxy S25+", "Galaxy S25"), ("galaxy s24+", "Galaxy S24+")]
MODELLED += [("Galaxy Tab S10 Plus", "Galaxy Tab S10+"), ("Galaxy Tab S9 FE Plus", "Galaxy Tab S9 FE+"), ("Galaxy Tab S9 plus", "Galaxy Tab S9+")]
MODELLED += [("苹果 14 pro max 紫色", "iPhone 14 Pro Max"), ("PS5 slim 数字版", "PlayStation 5 Slim"), ("PlayStation 5", "PlayStation 5 Standard"), ("华为 Mate 60", None)]


@query("X14", f"SELECT p_partkey AS id, {sql_list([m for _, m in MODELLED])}[p_partkey % {len(MODELLED)} + 1] AS family FROM part")
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of every model that the rules know."""
    text = pick([t for t, _ in MODELLED], F.col("p_partkey") % len(MODELLED))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("title"), F.lit("").alias("description"))
    return evaluate.with_product(rows).select("id", F.col("product.family").alias("family"))


@query("C15", "SELECT p_partkey AS id, [93, 88, 91, NULL, NULL][p_partkey % 5 + 1] AS health, [NULL, 120, 45, 88, NULL][p_partkey % 5 + 1] AS cycles FROM part")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(["电池健康93%", "电池 88% 充电 120 次", "battery health: 91%, 45 cycles", "充电88次", "电池健康12%"], F.col("p_partkey") % 5)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), flags.battery_state(text).alias("b")).select("id", "b.health", "b.cycles")


@query("C16", "SELECT p_partkey AS id, [1, 0, 1, 0, 0][p_partkey % 5 + 1] = 1 AS sealed FROM part")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(["全新未拆 国行", "全新未拆封", "Factory Sealed", "原封 二手", "99新"], F.col("p_partkey") % 5)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), flags.is_sealed(text).alias("sealed"))
