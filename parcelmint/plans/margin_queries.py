"""Queries on prices, matches, risk and profit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelmint.functions import matching, pricing, risk, titles
from parcelmint.functions.compat import js_round
from parcelmint.functions.config import FORWARDERS, PRESETS, Config
from parcelmint.operators import analytics, evaluate
from parcelmint.plans.bindings import LISTINGS_SQL, OFFERS_SQL, REFERENCES_SQL, RISK_SQL, listings, offers, out, references, table
from parcelmint.plans.catalog import query
from parcelmint.sources import goods

C = Config()


def _r(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


def landed_sql(price: str, c: Config) -> str:
    acq = f"({price} * {c.rate} * {1 + c.exchange_fee})"
    base = f"({acq} + {acq} * {c.agent_fee} + {c.inspection} + {c.source_shipping} + {acq} * {c.insurance} + {c.freight})"
    duty = f"({base} * {c.duty})"
    vat = f"(({base} + {c.customs} + {duty}) * {c.vat})"
    return f"({base} + {c.customs} + {duty} + {vat} + {c.home_shipping})"


MATCHED_SQL = """pairs AS (
  SELECT l.id, l.gb AS want, l.family AS family, o.offer, o.platform, o.euros, o.gb AS have, lower(o.title) AS low,
    list_filter(string_split(lower(l.family || CASE WHEN l.kind = 'macbook' THEN ' 13"' ELSE '' END || CASE WHEN l.gb IS NULL THEN '' ELSE ' ' || l.gb || 'GB' END), ' '), lambda t: length(t) > 1) AS words
  FROM listings l JOIN offers o ON l.task = o.task AND l.tier = o.tier), raw_scores AS (
  SELECT *, len(list_filter(words, lambda t: contains(low, t))) / len(words) * 60.0 + CASE WHEN contains(low, lower(family)) THEN 25 ELSE 0 END
    + CASE WHEN want = have THEN 25 WHEN greatest(want, have) / least(want, have) >= 4 THEN -30 WHEN want IS NOT NULL AND have IS NOT NULL THEN -20 ELSE 0 END AS s FROM pairs), matched AS (
  SELECT * EXCLUDE (s), CAST(floor(greatest(0.0, least(100.0, s)) + 0.5) AS INT) AS score FROM raw_scores WHERE floor(greatest(0.0, least(100.0, s)) + 0.5) >= 40)"""
VALUE_SQL = """value AS (
  SELECT id, count(*) FILTER (euros >= 100) AS offers, count(*) FILTER (euros >= 100 AND have = want) AS exact, median(euros) FILTER (euros >= 100 AND have = want) AS exact_median,
    median(CASE WHEN have IS NOT NULL AND want IS NOT NULL AND have <> want THEN greatest(euros * 0.5, euros + (want - have) * 0.25) ELSE euros END) FILTER (euros >= 100) AS adjusted_median,
    avg(CASE platform WHEN 'vinted' THEN 0.05::DOUBLE WHEN 'amazon' THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) AS blended FROM matched GROUP BY id), valued AS (
  SELECT id, offers, exact, CASE WHEN exact >= 2 THEN exact_median ELSE adjusted_median END AS resale, CASE WHEN offers > 0 THEN blended ELSE 0.05 END AS fee_rate FROM value)"""
REFERENCE_SQL = """nearest AS (
  SELECT l.id, arg_min(struct_pack(r := r, d := l.gb - r.gb), struct_pack(a := abs(l.gb - r.gb), o := r.ordinal)) AS n FROM listings l JOIN refs r ON r.standard_key = l.family OR starts_with(r.standard_key, l.family || ' ')
  WHERE l.gb IS NOT NULL AND l.standard_key NOT IN (SELECT standard_key FROM refs) GROUP BY l.id), referenced AS (
  SELECT l.id, l.cond, r.*, n.n AS n FROM listings l LEFT JOIN refs r ON r.standard_key = l.standard_key LEFT JOIN nearest n ON n.id = l.id), reference AS (
  SELECT id, CASE cond WHEN 'new' THEN coalesce("new", floor(greatest(n.r."new" * 0.5, n.r."new" + n.d * 0.25) + 0.5)) WHEN 'open_box' THEN coalesce("new", floor(greatest(n.r."new" * 0.5, n.r."new" + n.d * 0.25) + 0.5))
    WHEN 'excellent' THEN coalesce(excellent, floor(greatest(n.r.excellent * 0.5, n.r.excellent + n.d * 0.25) + 0.5)) WHEN 'good' THEN coalesce(good, floor(greatest(n.r.good * 0.5, n.r.good + n.d * 0.25) + 0.5))
    ELSE coalesce(very_good, floor(greatest(n.r.very_good * 0.5, n.r.very_good + n.d * 0.25) + 0.5)) END AS reference FROM referenced)"""


def evaluated_sql(c: Config) -> str:
    return f"""WITH {LISTINGS_SQL}, {OFFERS_SQL}, {REFERENCES_SQL}, {RISK_SQL}, {MATCHED_SQL}, {VALUE_SQL}, {REFERENCE_SQL}, priced AS (
  SELECT s.*, coalesce(nullif(v.resale, 0), f.reference, 0.0) AS resale, coalesce(v.fee_rate, {c.fee_default}) AS fee_rate, {landed_sql('s.price', c)} AS landed
  FROM scored s LEFT JOIN valued v ON v.id = s.id LEFT JOIN reference f ON f.id = s.id), gained AS (
  SELECT *, resale - resale * fee_rate - landed AS profit, (resale - resale * fee_rate - landed) / landed * 100 AS margin FROM priced), evaluated AS (
  SELECT *, dropped OR score > {c.hide_above} AS by_risk, margin < {c.min_margin * 100} OR profit < {c.min_profit} AS by_profit FROM gained)"""


def evaluated(spark: SparkSession, sf_dir: str, c: Config = C) -> DataFrame:
    return evaluate.evaluate(listings(spark, sf_dir), offers(spark, sf_dir), references(spark, sf_dir), c)


@query("C20", evaluated_sql(C) + f" SELECT id, standard_key, {_r('resale')} AS resale, {_r('landed')} AS landed, {_r('profit')} AS profit, {_r('margin')} AS margin, CAST(score AS INT) AS risk, by_risk OR by_profit AS hidden FROM evaluated")
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit of every listing after all import costs."""
    e = evaluated(spark, sf_dir)
    return e.select("id", F.col("product.standard_key").alias("standard_key"), out(F.col("profit.resale")).alias("resale"), out(F.col("landed.total")).alias("landed"), out(F.col("profit.profit")).alias("profit"), out(F.col("profit.margin")).alias("margin"), F.col("risk.score").alias("risk"), "hidden")


@query("A01", evaluated_sql(C) + f""" SELECT count(*) AS total, count(*) FILTER (NOT (by_risk OR by_profit)) AS shown, count(*) FILTER (by_risk) AS hidden_scam, count(*) FILTER (by_profit AND NOT by_risk) AS hidden_profit,
  coalesce(floor(avg(margin) FILTER (NOT (by_risk OR by_profit)) * 10 + 0.5) / 10, 0.0) AS avg_margin, CAST(floor(avg(score) + 0.5) AS INT) AS avg_risk,
  {_r('coalesce(max(profit) FILTER (NOT (by_risk OR by_profit)), 0.0)')} AS best_profit, {_r('coalesce(max(margin) FILTER (NOT (by_risk OR by_profit)), 0.0)')} AS best_margin FROM evaluated""")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summary(evaluated(spark, sf_dir), C)
    return s.withColumn("best_profit", out(F.col("best_profit"))).withColumn("best_margin", out(F.col("best_margin")))


@query("P11", evaluated_sql(C) + """ SELECT id, by_risk OR by_profit AS hidden, CASE WHEN dropped THEN 'blacklist' WHEN by_risk THEN 'risk' WHEN margin < 15.0 AND profit < 30 THEN 'margin, profit' WHEN margin < 15.0 THEN 'margin' WHEN profit < 30 THEN 'profit' END AS reason FROM evaluated""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("id", "hidden", F.col("hidden_reason").alias("reason"))


@query("P12", evaluated_sql(C) + " SELECT CASE WHEN NOT (by_risk OR by_profit) THEN 'viable' WHEN dropped OR score >= 60 THEN 'scam' ELSE 'profit' END AS card, count(*) AS n FROM evaluated GROUP BY 1")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluated(spark, sf_dir)
    return e.groupBy(F.when(~F.col("hidden"), "viable").when(F.col("risk.dropped") | (F.col("risk.score") >= 60), "scam").otherwise("profit").alias("card")).agg(F.count(F.lit(1)).alias("n"))


@query("ST8", evaluated_sql(PRESETS["conservative"]) + f" SELECT count(*) FILTER (NOT (by_risk OR by_profit)) AS shown, {_r('sum(profit) / count(*)')} AS mean_profit FROM evaluated")
def st8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same listings evaluated again with other parameters."""
    e = evaluated(spark, sf_dir, PRESETS["conservative"])
    return e.agg(F.count_if(~F.col("hidden")).alias("shown"), out(F.sum("profit.profit") / F.count(F.lit(1))).alias("mean_profit"))


@query("C17", f"SELECT p_partkey AS id, {_r(landed_sql('p_retailprice', C))} AS total FROM part")
def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), out(pricing.landed_cost(F.col("p_retailprice"), C)["total"]).alias("total"))


_MODES = PRESETS | {f"forwarder_{k}": v for k, v in FORWARDERS.items()}


@query("C21", " UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) AS n, {_r(f'avg({landed_sql('p_retailprice', c)})')} AS mean_landed FROM part" for m, c in _MODES.items()))
def c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What-if over all cost modes in one pass."""
    part = table(spark, sf_dir, "part")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), pricing.landed_cost(F.col("p_retailprice"), c)["total"].alias("total")) for m, c in _MODES.items()])
    return part.select(F.explode(modes).alias("x")).groupBy("x.mode").agg(F.count(F.lit(1)).alias("n"), out(F.avg("x.total")).alias("mean_landed"))


@query("J1", f"WITH {LISTINGS_SQL}, {OFFERS_SQL}, {MATCHED_SQL} SELECT id, count(*) AS n, CAST(max(score) AS INT) AS best, CAST(sum(score) AS BIGINT) AS total FROM matched GROUP BY id")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.matches(evaluate.with_product(listings(spark, sf_dir)), offers(spark, sf_dir))
    return m.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.sum("score").alias("total"))


@query("W02", f"WITH {LISTINGS_SQL}, {OFFERS_SQL}, {MATCHED_SQL} SELECT id, CAST(place AS INT) AS place, offer, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, offer) AS place FROM matched) WHERE place <= 3")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best offers of each listing."""
    m = evaluate.matches(evaluate.with_product(listings(spark, sf_dir)), offers(spark, sf_dir))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "offer"))).where("place <= 3").select("id", "place", "offer", "score")


@query("A02", f"WITH {LISTINGS_SQL}, {OFFERS_SQL}, {MATCHED_SQL}, {VALUE_SQL} SELECT id, offers, exact, {_r('resale')} AS resale FROM valued")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = evaluate.resale_values(evaluate.matches(evaluate.with_product(listings(spark, sf_dir)), offers(spark, sf_dir)), C)
    return v.select("id", "offers", "exact", out(F.col("resale")).alias("resale"))


@query("A03", f"WITH {LISTINGS_SQL}, {OFFERS_SQL}, {MATCHED_SQL}, {VALUE_SQL} SELECT id, floor(fee_rate * 1e7 + 0.5) / 1e7 AS fee_rate FROM valued")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = evaluate.resale_values(evaluate.matches(evaluate.with_product(listings(spark, sf_dir)), offers(spark, sf_dir)), C)
    return v.select("id", (F.floor(F.col("fee_rate") * 1e7 + 0.5) / 1e7).alias("fee_rate"))


@query("J3", f"WITH {LISTINGS_SQL}, {REFERENCES_SQL}, {REFERENCE_SQL} SELECT id, CAST(reference AS DOUBLE) AS reference FROM reference")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference prices, exact (J2), by nearest storage (J3), for the condition's tier (C19)."""
    return evaluate.reference_prices(evaluate.with_product(listings(spark, sf_dir)).select("id", "product"), references(spark, sf_dir))


@query("C09", f"WITH {LISTINGS_SQL}, {RISK_SQL} SELECT id, CAST(score AS INT) AS score, dropped, CASE WHEN dropped THEN '进水 (water damaged)' ELSE '' END AS blacklist, CASE WHEN note = 4 THEN '换过电池 (replaced battery)' ELSE '' END AS yellow FROM scored")
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = risk.with_risk(evaluate.with_product(listings(spark, sf_dir))).select("id", F.col("risk").alias("r"))
    return r.select("id", "r.score", "r.dropped", F.array_join("r.blacklist", ", ").alias("blacklist"), F.array_join("r.yellow", ", ").alias("yellow"))


@query("C06", f"WITH {LISTINGS_SQL}, {RISK_SQL} SELECT id, CAST(seller AS INT) AS risk FROM risk")
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", risk.seller_risk(F.col("rating"), F.col("transactions"), F.col("verified")).alias("risk"))


@query("C08", f"WITH {LISTINGS_SQL} SELECT id, CAST(CASE WHEN images < 2 THEN 8 ELSE 0 END + CASE WHEN note_length < 20 THEN 5 ELSE 0 END AS INT) AS risk FROM listings")
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", risk.asset_risk(F.col("images"), F.col("description")).alias("risk"))


@query("P09", f"WITH {LISTINGS_SQL}, {RISK_SQL} SELECT id, dropped OR score > 60 AS hidden FROM scored")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = risk.with_risk(evaluate.with_product(listings(spark, sf_dir))).select("id", F.col("risk").alias("r"))
    return r.select("id", risk.hidden_by_risk(F.col("r"), C.hide_above).alias("hidden"))


@query("C18", f"WITH {OFFERS_SQL} SELECT offer, {_r('CASE WHEN gb IS NOT NULL AND gb <> 256 THEN greatest(euros * 0.5, euros + (256 - gb) * 0.25) ELSE euros END')} AS adjusted FROM offers")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("offer", out(pricing.storage_adjusted(F.col("euros"), titles.storage_gb(F.col("title")), F.lit(256))).alias("adjusted"))


@query("C22", f"WITH {OFFERS_SQL} SELECT platform, count(*) AS n, CAST(CASE platform WHEN 'vinted' THEN 0.05 WHEN 'amazon' THEN 0.08 ELSE 0.0 END AS DOUBLE) AS fee FROM offers GROUP BY platform")
def c22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).groupBy("platform").agg(F.count(F.lit(1)).alias("n")).withColumn("fee", pricing.platform_fee(F.col("platform"), C))


@query("C10", f"WITH {OFFERS_SQL} SELECT tier, count(*) AS n FROM offers GROUP BY tier")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).groupBy(matching.tier(F.col("title")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("P05", f"WITH {OFFERS_SQL} SELECT platform, count(*) AS n FROM offers WHERE euros BETWEEN 100 AND 3000 GROUP BY platform")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).where(analytics.price_bounds(F.col("euros"), goods.LEAST, goods.MOST)).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


_ASKED = [("all", "true"), ("two", "platform NOT IN ('olx', 'amazon')"), ("no used", "platform NOT IN ('olx', 'vinted')"), ("one", "platform = 'vinted'")]


@query("P18", f"WITH {OFFERS_SQL} " + " UNION ALL ".join(f"SELECT '{name}' AS asked, platform, count(*) AS n FROM offers WHERE {test} GROUP BY platform" for name, test in _ASKED))
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of the sources that are asked: all, without two, without those for used goods, and without retail and one more."""
    o, found = offers(spark, sf_dir), None
    for (name, _), how in zip(_ASKED, ({}, {"skipped": ("olx", "amazon")}, {"used": False}, {"skipped": ("olx",), "retail": False})):
        rows = goods.asked(o, **how).groupBy("platform").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("asked"), "platform", "n")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("P08", f"WITH {OFFERS_SQL} SELECT task, platform, title, min(offer) AS offer FROM offers GROUP BY ALL")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title of a scan and source once, where it is first seen."""
    return goods.first_titles(offers(spark, sf_dir), ["task", "platform"], ["offer"]).select("task", "platform", "title", "offer")


@query("A08", f"SELECT p_partkey AS id, {_r(landed_sql('p_retailprice', C))} AS total FROM part")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grand total of an import as the sum of its parts."""
    landed = pricing.landed_cost(F.col("p_retailprice"), C)
    parts = [landed[f] for f in ("acquisition", "agent", "inspection", "source_shipping", "insurance", "freight", "customs", "duty", "vat", "home_shipping")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), out(sum(parts[1:], parts[0])).alias("total"))


@query("P02", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 1 THEN 2000 WHEN 2 THEN 800 WHEN 3 THEN 1000 ELSE 500 END AS floor_price FROM part")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least price by category, where the buyer sets none."""
    kind = F.element_at(F.array(*map(F.lit, ["iphone", "macbook", "ipad", "ps5", "dji"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), analytics.floor_price(kind).alias("floor_price"))


@query("A05", evaluated_sql(C) + f""", cells AS (SELECT family, cond, median(profit) AS m, count(*) AS n, avg(margin) AS a FROM evaluated GROUP BY 1, 2), grid AS (
  SELECT f.family, c.cond, c.ord FROM (SELECT DISTINCT family FROM evaluated) f, (VALUES (1, 'new'), (2, 'open_box'), (3, 'excellent'), (4, 'very_good'), (5, 'good'), (6, 'fair'), (7, 'unknown')) c(ord, cond))
  SELECT g.family, g.cond AS condition, {_r('m')} AS median_profit, coalesce(n, 0) AS n, {_r('a')} AS mean_margin, {_r('min(m) OVER ()')} AS least, {_r('max(m) OVER ()')} AS most FROM grid g LEFT JOIN cells c ON c.family = g.family AND c.cond = g.cond""")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = analytics.heatmap(evaluated(spark, sf_dir).select(F.col("product.family").alias("family"), F.col("product.condition").alias("condition"), F.col("profit.profit").alias("profit"), F.col("profit.margin").alias("margin")))
    return h.select("family", "condition", *[out(F.col(c)).alias(c) for c in ("median_profit", "mean_margin", "least", "most")], "n")


@query("A17", evaluated_sql(C) + " SELECT CASE WHEN profit < 0 THEN '<0' WHEN profit < 30 THEN '<30' WHEN profit < 60 THEN '<60' WHEN profit < 100 THEN '<100' ELSE '>=100' END AS bucket, count(*) AS n FROM evaluated GROUP BY 1")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).groupBy(analytics.profit_bucket(F.col("profit.profit")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("A10", evaluated_sql(C) + " SELECT id, CAST(floor(profit + 0.5) AS BIGINT) AS profit, CAST(floor(margin + 0.5) AS BIGINT) AS margin, CASE WHEN profit < 0 THEN 'loss' WHEN by_profit THEN 'low' ELSE 'good' END AS bucket FROM evaluated")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("profit.profit")
    return evaluated(spark, sf_dir).select("id", js_round(p).alias("profit"), js_round(F.col("profit.margin")).alias("margin"), F.when(p < 0, "loss").when(F.col("profit.hidden"), "low").otherwise("good").alias("bucket"))


@query("A11", evaluated_sql(C) + f" SELECT {_r('100.0 * count(*) FILTER (NOT (by_risk OR by_profit)) / count(*)')} AS viable_percent FROM evaluated")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).agg(out(F.lit(100.0) * F.count_if(~F.col("hidden")) / F.count(F.lit(1))).alias("viable_percent"))


_PREVIEW = "count(*) AS n, CAST(floor(avg(euros) + 0.5) AS BIGINT) AS mean, CASE WHEN count(*) % 2 = 0 THEN floor(median(euros) + 0.5) ELSE floor(median(euros) * 1e4 + 0.5) / 1e4 END AS median, floor(min(euros) * 1e4 + 0.5) / 1e4 AS least, floor(max(euros) * 1e4 + 0.5) / 1e4 AS most"


@query("A06", f"WITH {OFFERS_SQL}, u AS (SELECT DISTINCT platform, title, euros, retail FROM offers) SELECT platform AS source, {_PREVIEW} FROM u GROUP BY platform UNION ALL SELECT CASE WHEN retail THEN 'new' ELSE 'used' END, {_PREVIEW} FROM u GROUP BY retail")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market preview by platform and by new and used, over distinct offers."""
    p = analytics.market_preview(offers(spark, sf_dir))
    return p.select("source", "n", "mean", *[out(F.col(c)).alias(c) for c in ("median", "least", "most")])


@query("L01", evaluated_sql(C) + f" SELECT id, {_r('profit')} AS profit, CAST(row_number() OVER (ORDER BY profit DESC, id) AS INT) AS place FROM evaluated QUALIFY place <= 100")
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best by profit: a top-k report."""
    e = evaluated(spark, sf_dir).select("id", F.col("profit.profit").alias("p")).orderBy(F.desc("p"), "id").limit(100)
    return e.select("id", out(F.col("p")).alias("profit"), F.row_number().over(Window.orderBy(F.desc("p"), "id")).alias("place"))


@query("L02", "SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 30")
def l02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifteen."""
    return analytics.page(table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").select(F.col("p_partkey").alias("id")), 3)


@query("L05", f"WITH {OFFERS_SQL} SELECT offer, {_r('euros')} AS euros FROM offers ORDER BY offers.euros, offer LIMIT 50")
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).orderBy("euros", "offer").limit(50).select("offer", out(F.col("euros")).alias("euros"))


@query("U03", f"WITH {OFFERS_SQL} SELECT platform, count(*) AS n FROM (SELECT DISTINCT platform, title, euros FROM offers) GROUP BY platform")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).dropDuplicates(["platform", "title", "euros"]).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@query("U01", f"WITH {OFFERS_SQL} SELECT platform, list_position(['olx', 'vinted', 'kuantokusta', 'amazon'], platform) AS place, count(*) AS n FROM offers GROUP BY platform")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources in their fixed order, as one scan: the order is a column, not a union of four."""
    place = F.array_position(F.array(*map(F.lit, ("olx", "vinted", "kuantokusta", "amazon"))), F.col("platform")).cast("int")
    return offers(spark, sf_dir).groupBy("platform").agg(F.count(F.lit(1)).alias("n")).select("platform", place.alias("place"), "n")


@query("U02", f"WITH {OFFERS_SQL} SELECT CASE WHEN retail THEN 'new' ELSE 'used' END AS side, count(*) AS n, {_r('median(euros)')} AS median FROM offers GROUP BY 1")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("platform").isin("kuantokusta", "amazon"), "new").otherwise("used").alias("side")
    rows = offers(spark, sf_dir).select(side, "euros")
    counts = rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    medians = analytics.exact_medians(rows, ["side"], "euros")
    return counts.join(medians, "side").select("side", "n", out(F.col("median")).alias("median"))


@query("U05", """SELECT g.source, coalesce(p.p_name, 'synthetic') AS id, CAST(coalesce(p.p_retailprice, 0) AS DOUBLE) AS price FROM (VALUES ('none', 0), ('small', 3), ('all', 99)) g(source, most) LEFT JOIN part p ON p.p_size < g.most""")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source without rows gives one row that stands for it, others their own."""
    part, found = table(spark, sf_dir, "part"), None
    for name, most in (("none", 0), ("small", 3), ("all", 99)):
        rows = part.where(F.col("p_size") < most).select(F.col("p_name").alias("id"), F.col("p_retailprice").cast("double").alias("price"))
        rows = analytics.or_default(rows, {"id": "synthetic", "price": 0.0}).withColumn("source", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found


#: Listings of which every fifth is no known product.
_SOME_UNKNOWN = f"""WITH {LISTINGS_SQL}, {OFFERS_SQL}, facts AS (SELECT task, count(*) FILTER (euros >= 100) AS offers, median(euros) FILTER (euros >= 100) AS resale,
    avg(CASE platform WHEN 'vinted' THEN 0.05::DOUBLE WHEN 'amazon' THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) AS fee FROM offers GROUP BY task)
  SELECT id, offers, {_r('resale')} AS resale, {_r('fee')} AS fee_rate FROM listings JOIN facts ON facts.task = listings.task WHERE id % 5 = 0"""


@query("P21", _SOME_UNKNOWN)
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that are no known product are kept and share the value of all offers of their scan."""
    rows = listings(spark, sf_dir).withColumn("title", F.when(F.col("id") % 5 == 0, "老式收音机 九成新").otherwise(F.col("title")))
    found = evaluate.with_value(evaluate.with_product(rows), offers(spark, sf_dir), C).where("product is null")
    return found.select("id", "offers", out(F.col("resale")).alias("resale"), out(F.col("fee_rate")).alias("fee_rate"))


@query("P01", f"WITH {LISTINGS_SQL} SELECT id FROM listings WHERE price > 0 AND price >= 1000")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).where(analytics.price_bounds(F.col("price"), 1000, 0)).select("id")


@query("P10", evaluated_sql(C) + " SELECT id, margin >= 15.0 AS enough_margin, profit >= 30 AS enough_profit FROM evaluated")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("id", "profit.enough_margin", "profit.enough_profit")


@query("P13", evaluated_sql(C) + " SELECT id FROM evaluated WHERE family = 'iPhone 15 Pro' AND cond = 'excellent'")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings behind a cell of the heatmap."""
    return evaluated(spark, sf_dir).where((titles.family_of_key(F.col("product.standard_key")) == "iPhone 15 Pro") & (F.col("product.condition") == "excellent")).select("id")


@query("P14", evaluated_sql(C) + " SELECT id FROM evaluated WHERE NOT (by_risk OR by_profit)")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).where(~F.col("hidden")).select("id")


@query("P17", f"WITH {LISTINGS_SQL}, {OFFERS_SQL}, {MATCHED_SQL} SELECT id, count(*) FILTER (euros >= 100) AS kept FROM matched GROUP BY id")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.matches(evaluate.with_product(listings(spark, sf_dir)), offers(spark, sf_dir))
    return m.groupBy("id").agg(F.count_if(F.col("euros") >= evaluate.LEAST_OFFER).alias("kept"))


@query("C11", f"WITH {LISTINGS_SQL}, {OFFERS_SQL}, {MATCHED_SQL} SELECT score, count(*) AS n FROM matched GROUP BY score")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.matches(evaluate.with_product(listings(spark, sf_dir)), offers(spark, sf_dir))
    return m.groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query("C19", "SELECT p_partkey AS id, CAST(CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice - 80 WHEN 2 THEN floor((p_retailprice - 230) * 0.75 + 0.5) ELSE p_retailprice - 150 END AS DOUBLE) AS price FROM part")
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.col("p_retailprice")
    kind = F.element_at(F.array(*map(F.lit, ["open_box", "excellent", "fair", "unknown"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    tiers = {"new": new, "excellent": new - 80, "very_good": new - 150, "good": new - 230, "fair": F.lit(None).cast("double")}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pricing.tier_price(kind, tiers).alias("price"))


@query("L07", evaluated_sql(C) + f" SELECT family, {_r('max(profit)')} AS best, arg_max(id, struct_pack(p := profit, k := -id)) AS id FROM evaluated GROUP BY family")
def l07(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluated(spark, sf_dir)
    return e.groupBy(F.col("product.family").alias("family")).agg(out(F.max("profit.profit")).alias("best"), F.max_by("id", F.struct(F.col("profit.profit"), -F.col("id"))).alias("id"))


@query("C24", "SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 4 = 0 THEN greatest(6, p_partkey % 5 * 2 + 4) ELSE greatest(12, floor((p_size % 10 + 1) * 4.5 + CASE WHEN p_partkey % 3 = 0 THEN 6 ELSE 2 END + 6 + 0.5)) END AS INT) AS seconds FROM part")
def c24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long scans take: live ones by pages and enrichment, every fourth from a pasted page."""
    key = F.col("p_partkey")
    seconds = pricing.scan_seconds(F.col("p_size") % 10 + 1, key % 3 == 0, key % 4 == 0, key % 5)
    return table(spark, sf_dir, "part").select(key.alias("id"), seconds.alias("seconds"))


@query("C26", "SELECT p_partkey AS id, CAST(CASE WHEN p_size % 4 > 0 THEN p_size % 4 ELSE 3 END AS INT) AS pages FROM part")
def c26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pricing.pages_asked(F.col("p_size") % 4).alias("pages"))
