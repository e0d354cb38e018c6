"""Queries on scans over time, stored tables and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelmint.functions import pricing
from parcelmint.functions.compat import js_round, median
from parcelmint.operators import logs, relational
from parcelmint.plans.bindings import out, table
from parcelmint.plans.catalog import query
from parcelmint.sources import goods

_R = "floor({x} * 1e4 + 0.5) / 1e4"


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as scans; their lines as what they found, viable where the discount is small."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    done = orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return done.join(line.where("l_discount <= 0.05"), F.col("o_orderkey") == F.col("l_orderkey"))


_SCANS = "scans AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_discount <= 0.05)"


@query("A04", f"WITH {_SCANS} SELECT o_orderkey AS task, count(*) AS viable, floor(median(l_extendedprice) FILTER (l_extendedprice > 0) + 0.5) AS median_price, floor(max(l_extendedprice) + 0.5) AS best FROM scans GROUP BY o_orderkey")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of the trend for each finished scan with anything viable."""
    price = F.col("l_extendedprice")
    return _scans(spark, sf_dir).groupBy(F.col("o_orderkey").alias("task")).agg(F.count(F.lit(1)).alias("viable"), median(F.when(price > 0, price), "all").alias("median_price"), js_round(F.max(price)).cast("double").alias("best"))


@query("A16", f"WITH {_SCANS}, points AS (SELECT o_orderkey, any_value(o_orderdate) AS d, floor(median(l_extendedprice) + 0.5) AS m, floor(max(l_extendedprice) + 0.5) AS b FROM scans GROUP BY o_orderkey) SELECT count(*) AS scans, arg_max(m, struct_pack(d := d, k := o_orderkey)) AS latest, max(b) AS best, floor(avg(m) + 0.5) AS mean FROM points")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    points = _scans(spark, sf_dir).groupBy("o_orderkey").agg(F.max("o_orderdate").alias("d"), median(price, "all").alias("m"), js_round(F.max(price)).cast("double").alias("b"))
    return points.agg(F.count(F.lit(1)).alias("scans"), F.max_by("m", F.struct("d", "o_orderkey")).alias("latest"), F.max("b").alias("best"), js_round(F.avg("m")).cast("double").alias("mean"))


@query("W03", f"WITH {_SCANS}, p AS (SELECT o_orderkey AS task, o_custkey AS c, any_value(o_orderdate) AS d, floor(max(l_extendedprice) / 50 + 0.5) AS best FROM scans GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC, task DESC) AS place FROM p), l AS (SELECT *, best - lag(best) OVER (PARTITION BY c ORDER BY d, task) AS delta FROM r WHERE place <= 20) SELECT task, c AS customer, best, delta, CASE WHEN delta > 5 THEN 'up' WHEN delta < -5 THEN 'down' WHEN delta IS NOT NULL THEN 'flat' END AS tone FROM l")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty scans of each customer with the change from scan to scan."""
    scans = _scans(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("customer")), F.col("o_orderkey") == F.col("task"))
    p = scans.groupBy("task", "customer").agg(F.max("o_orderdate").alias("d"), js_round(F.max("l_extendedprice") / 50).cast("double").alias("best"))
    last = relational.first_by(p, ["customer"], [F.desc("d"), F.desc("task")], 20)
    delta = F.col("best") - F.lag("best").over(Window.partitionBy("customer").orderBy("d", "task"))
    last = last.withColumn("delta", delta)
    return last.select("task", "customer", "best", "delta", F.when(F.col("delta") > 5, "up").when(F.col("delta") < -5, "down").when(F.col("delta").isNotNull(), "flat").alias("tone"))


@query("A12", "SELECT o_orderpriority AS query, max(o_orderdate) AS last FROM orders GROUP BY o_orderpriority ORDER BY last DESC LIMIT 50")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("query")).agg(F.max("o_orderdate").alias("last")).orderBy(F.desc("last")).limit(50)


@query("L06", "SELECT o_orderkey AS task FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def l06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select(F.col("o_orderkey").alias("task"))


@query("P19", "SELECT o_orderkey AS task FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'high')")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & F.contains(F.lower("o_orderpriority"), F.lit("high"))).select(F.col("o_orderkey").alias("task"))


@query("J5", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'live' ELSE 'stored' END AS side FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    live, stored = (o.where(f"o_orderkey % {k} = 0").select(F.col("o_orderkey").alias("id"), F.lit(s).alias("side")) for k, s in ((3, "live"), (2, "stored")))
    return relational.overlay(live, stored, "id")


@query("J12", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS rank FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row from memory if there is one, else from the store."""
    o = table(spark, sf_dir, "orders")
    both = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("rank")).unionByName(o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit(2).alias("rank")))
    return both.groupBy("id").agg(F.min("rank").alias("rank"))


_OLD, _NEW = "p_partkey % 2 = 0", "p_partkey % 3 = 0"


@query("J14", f"SELECT p_partkey AS k, CASE WHEN {_NEW} THEN p_size + 100 ELSE p_size END AS size, CASE WHEN {_NEW} AND {_OLD} THEN 'updated' WHEN {_NEW} THEN 'created' ELSE 'kept' END AS action FROM part WHERE {_OLD} OR {_NEW}")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.where(_OLD).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    new = part.where(_NEW).select(F.col("p_partkey").alias("k"), F.explode(F.array(F.struct(F.lit(1).alias("at"), (F.col("p_size") + 50).alias("size")), F.struct(F.lit(2).alias("at"), (F.col("p_size") + 100).alias("size")))).alias("x")).select("k", "x.size", "x.at")
    return relational.upsert(old, new, "k", "at")


@query("A13", f"SELECT CASE WHEN {_NEW} AND {_OLD} THEN 'updated' WHEN {_NEW} THEN 'created' ELSE 'kept' END AS action, count(*) AS n FROM part WHERE {_OLD} OR {_NEW} GROUP BY 1")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j14(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("J15", f"SELECT p_partkey AS k FROM part WHERE NOT ({_NEW})")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return relational.without(part, part.where("k % 3 = 0"), "k")


@query("J6", "SELECT p_partkey AS k, f AS field, CASE f WHEN 'size' THEN p_size ELSE p_retailprice END AS old, CASE f WHEN 'size' THEN p_size + 1 ELSE p_retailprice + 2 END AS new FROM part, (VALUES ('size'), ('price')) t(f) WHERE p_partkey % 3 = 0 AND ((f = 'size' AND p_partkey % 2 = 0) OR (f = 'price' AND p_partkey % 5 = 0))")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    new = part.where("k % 3 = 0").select("k", F.when(F.col("k") % 2 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("k") % 5 == 0, F.col("price") + 2).otherwise(F.col("price")).alias("price"))
    return relational.changes(part, new, "k", ["size", "price"])


@query("A15", "SELECT count(*) AS conflicts, count(DISTINCT p_partkey) AS keys FROM part, (VALUES ('size'), ('price')) t(f) WHERE p_partkey % 3 = 0 AND ((f = 'size' AND p_partkey % 2 = 0) OR (f = 'price' AND p_partkey % 5 = 0))")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j6(spark, sf_dir).agg(F.count(F.lit(1)).alias("conflicts"), F.countDistinct("k").alias("keys"))


@query("J13", "SELECT c_custkey AS id FROM customer WHERE lower(c_mktsegment) IN (SELECT lower(c_mktsegment) FROM customer WHERE c_custkey = 1)")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    saved = c.where("c_custkey = 1").select(F.lower("c_mktsegment").alias("q"))
    return c.join(F.broadcast(saved.limit(20)), F.lower("c_mktsegment") == F.col("q"), "left_semi").select(F.col("c_custkey").alias("id"))


@query("W01", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind and user."""
    return relational.first_by(table(spark, sf_dir, "events"), ["event_type", "user_id"], ["event_id"]).select("event_type", "user_id", "event_id")


@query("W04", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 400")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 400 entries of each log."""
    return relational.first_by(table(spark, sf_dir, "events"), ["user_id"], [F.desc("event_id")], 400).select("user_id", "event_id")


@query("W05", "SELECT doc_id, source || '-live-' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS place_id FROM documents")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers within runs of ids, and the sizes of the runs before, so that no task holds a whole source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(F.col("doc_id") / 4096).alias("run"))
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = docs.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("source_"), F.col("run").alias("run_"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    docs = docs.withColumn("at", F.row_number().over(Window.partitionBy("source", "run").orderBy("doc_id")) - 1)
    docs = docs.join(runs, F.col("source").eqNullSafe(F.col("source_")) & F.col("run").eqNullSafe(F.col("run_")))
    place = F.col("before") + F.col("at")
    return docs.select("doc_id", F.concat_ws("-live-", "source", place.cast("string")).alias("place_id"))


@query("S02", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a scan without repeated titles: the first of each text."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


_ROUNDS = """WITH rounds AS (SELECT DISTINCT source, CAST(doc_id // 20 AS INT) + 1 AS round FROM documents), first AS (SELECT source, round, doc_id FROM (SELECT source, CAST(doc_id // 20 AS INT) + 1 AS round, doc_id, text, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS r FROM documents WHERE length(text) % 3 = 0) WHERE r = 1),
  told AS (SELECT rounds.*, coalesce(max(CASE WHEN n > 0 THEN rounds.round END) OVER (PARTITION BY rounds.source ORDER BY rounds.round), 0) AS last FROM rounds LEFT JOIN (SELECT source, round, count(*) AS n FROM first GROUP BY 1, 2) c ON c.source IS NOT DISTINCT FROM rounds.source AND c.round = rounds.round),
  ended AS (SELECT source, min(round) AS at_ FROM told WHERE round - last >= 5 GROUP BY source)
  SELECT first.doc_id FROM first LEFT JOIN ended ON ended.source = first.source WHERE first.source IS NOT NULL AND (at_ IS NULL OR round < at_)"""


@query("S02r", _ROUNDS)
def s02r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a scan in rounds of ids: first texts only, until five rounds in a row bring none."""
    docs = table(spark, sf_dir, "documents").where("source is not null").select("source", "doc_id", "text", (F.floor(F.col("doc_id") / 20) + 1).cast("int").alias("round"))
    some = docs.where(F.length("text") % 3 == 0).withColumn("h", F.sha2("text", 256))
    first = some.groupBy("source", "h").agg(F.min(F.struct("doc_id", "round")).alias("f")).select("source", "f.round", "f.doc_id")
    return goods.until_empty(docs.select("source", "round"), first, ["source"], 5).select("doc_id")


@query("A09", "SELECT event_type AS level, count(*) AS n FROM events GROUP BY event_type")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.counted(table(spark, sf_dir, "events"), "event_type", "level")


@query("N01", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def n01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


_NOW = "2024-01-15 00:00:00"


@query("N02", f"SELECT event_id, ts + INTERVAL 3600 SECOND > TIMESTAMP '{_NOW}' AS valid FROM events")
def n02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(f"ts + INTERVAL 3600 SECOND > TIMESTAMP '{_NOW}'").alias("valid"))


@query("ST5", f"SELECT user_id, count(*) AS kept FROM events WHERE NOT (event_type = 'purchase' AND ts < TIMESTAMP '{_NOW}' - INTERVAL 10 MINUTE) GROUP BY user_id")
def st5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished entries go ten minutes after their end; the others stay."""
    e = logs.held(table(spark, sf_dir, "events"), F.col("event_type") == "purchase", "ts", F.lit(_NOW))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("ST6", f"SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 AND ts > TIMESTAMP '{_NOW}' THEN 0.13 WHEN event_id % 3 = 0 THEN 0.128 WHEN event_id % 5 = 0 THEN 0.12 ELSE 0.127 END AS DOUBLE) AS rate, CASE WHEN event_id % 2 = 0 AND ts > TIMESTAMP '{_NOW}' THEN 'cache' WHEN event_id % 3 = 0 THEN 'api' WHEN event_id % 5 = 0 THEN 'user' ELSE 'default' END AS source FROM events")
def st6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exchange rate: a valid cached one, else a fetched one, else the user's, else the default."""
    number = F.col("event_id")
    cached, fetched, own = F.when(number % 2 == 0, 0.13), F.when(number % 3 == 0, 0.128), F.when(number % 5 == 0, 0.12)
    rate = pricing.exchange_rate(cached, F.expr(f"ts > TIMESTAMP '{_NOW}'"), fetched, own, 0.127)
    return table(spark, sf_dir, "events").select("event_id", F.inline(F.array(rate)))


@query("N07", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def n07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("C23", "SELECT l_orderkey AS k, l_linenumber AS n, CAST(floor(l_extendedprice - 20000.5 + 0.5) AS BIGINT) AS r FROM lineitem")
def c23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding of halves up, also below zero."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), js_round(F.col("l_extendedprice") - 20000.5).alias("r"))


@query("J16", f"SELECT o_orderpriority AS p, count(*) AS n, {_R.format(x='sum(l_quantity)')} AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested offers of stored results, flattened."""
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    flat = table(spark, sf_dir, "orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("p"), F.explode("q").alias("x"))
    return flat.groupBy("p").agg(F.count(F.lit(1)).alias("n"), out(F.sum("x")).alias("quantity"))


@query("L10", "SELECT lower(event_type) AS q, max(event_id) AS last FROM events GROUP BY 1 ORDER BY last DESC LIMIT 20")
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.recent(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("L11", "SELECT DISTINCT p_brand AS brand FROM part WHERE contains(lower(p_brand), '1')")
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.suggested(table(spark, sf_dir, "part"), "p_brand", "1", "brand")


@query("A14", "SELECT DISTINCT p_type AS kind FROM part")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.kinds(table(spark, sf_dir, "part"), "p_type")
