"""Queries on how things are shown and asked for: amounts, ages, logs and steps, addresses of searches, a listing's sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.functions import prices, shown
from parcelmint.plans.bindings import pick, sql_list, table
from parcelmint.plans.catalog import query
from parcelmint.plans.margin_queries import C, evaluated, evaluated_sql
from parcelmint.sources import exports

def _money(x: str, cents: bool) -> str:
    """SQL for an amount in euros: digits are cut by hand, groups apart from five digits on."""
    unit = 100 if cents else 1
    whole = f"CAST(floor(abs({x}) * {unit} + 0.5) AS BIGINT)"
    digits = f"CAST({whole} // {unit} AS VARCHAR)"
    grouped = f"CASE WHEN length({digits}) < 5 THEN {digits} WHEN length({digits}) < 7 THEN left({digits}, length({digits}) - 3) || chr(160) || right({digits}, 3) ELSE left({digits}, length({digits}) - 6) || chr(160) || substr({digits}, length({digits}) - 5, 3) || chr(160) || right({digits}, 3) END"
    tail = f" || ',' || lpad(CAST({whole} % 100 AS VARCHAR), 2, '0')" if cents else ""
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || {grouped}{tail} || chr(160) || '€'"


_NOW = "2024-01-31 00:00:00"
_MONTHS = sql_list(shown.MONTHS)


@query(
    "X30",
    f"SELECT c_custkey AS id, {_money('c_acctbal', False)} AS whole, {_money('(c_acctbal * 1000)', True)} AS cents, '¥' || CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || CASE WHEN abs(c_acctbal) < 1000 THEN '' ELSE CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) // 1000 AS VARCHAR) || ',' END"
    " || CASE WHEN abs(c_acctbal) < 1000 THEN CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) ELSE lpad(CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 1000 AS VARCHAR), 3, '0') END || rtrim(rtrim('.' || lpad(CAST(CAST(round(abs(c_acctbal) * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'), '0'), '.') AS yuan FROM customer",
)
def x30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of money in three formats."""
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), shown.euros(x).alias("whole"), shown.euros(x * 1000, 2).alias("cents"), shown.yuan(x).alias("yuan"))


@query(
    "X30t",
    f"""WITH e AS (SELECT event_id, ts, CAST(floor(date_diff('microsecond', ts, TIMESTAMP '{_NOW}') / 60000000) AS BIGINT) AS m FROM events)
    SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN m // 60 || 'h ago' ELSE m // 1440 || 'd ago' END AS age, day(ts) || ' ' || {_MONTHS}[month(ts)] || ' ' || strftime(ts, '%H:%M') AS label, strftime(ts, '%H:%M') AS short FROM e""",
)
def x30t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago events were, and their times as a chart labels them."""
    e = table(spark, sf_dir, "events").withColumn("t", shown.time_labels(F.col("ts")))
    return e.select("event_id", shown.ago(F.col("ts").cast("timestamp"), F.lit(_NOW).cast("timestamp")).alias("age"), "t.label", "t.short")


_STATES = ["⏳ running", "✅ {} listings", "❌ failed", "⏭️ skipped", "✅ done"]


@query(
    "X34",
    """WITH told AS (SELECT event_id, s.k, s.source, (event_id + s.k) % 5 AS state, event_id % 90 AS items, event_id % 7 = 0 AS plain, s.k = 3 AND event_id % 3 = 0 AS gone FROM events, (VALUES (0, 'Goofish'), (1, 'OLX'), (2, 'Vinted'), (3, 'KuantoKusta'), (4, 'Amazon')) s(k, source))
    SELECT event_id, source, CASE WHEN plain OR gone THEN 'running' ELSE ['running', 'done', 'error', 'skipped', 'done'][state + 1] END AS state, CASE WHEN NOT (plain OR gone) AND state = 1 THEN CAST(items AS INT) END AS items,
      CASE WHEN plain OR gone THEN 'Preparing…' WHEN state = 1 THEN items || ' items' ELSE ['Scraping…', '', 'Failed', 'Skipped', 'Done'][state + 1] END AS said FROM told""",
)
def x34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the text of a scan's step tells of each source: its state, how much it found, and how that is said."""
    number = F.col("event_id")

    def part(k: int, name: str) -> Column:
        state = F.replace(pick(_STATES, (number + k) % 5), F.lit("{}"), (number % 90).cast("string"))
        return F.concat(F.lit(f"{name}: "), state)

    parts = [part(k, name if k % 2 else name.upper()) for k, name in enumerate(shown.SOURCES)]
    parts[3] = F.when(number % 3 == 0, F.lit("other")).otherwise(parts[3])
    step = F.when(number % 7 == 0, "Resuming").otherwise(F.concat_ws(" | ", *parts))
    return table(spark, sf_dir, "events").select("event_id", F.inline(shown.step_parts(step)))


@query(
    "X34l",
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN ['[Amazon]', '[x Forex]', '[other]'][event_id % 4 + 1] END AS tag, CASE WHEN event_id % 4 < 3 THEN props ELSE ' [late] ' || props END AS rest, CASE WHEN event_id % 4 < 3 THEN ['orange', 'emerald', 'slate'][event_id % 4 + 1] END AS colour FROM events""",
)
def x34l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log's messages by tag and text."""
    said = F.concat(pick(["[Amazon] ", "[x Forex]", "[other]   ", " [late] "], F.col("event_id") % 4), "props")
    return table(spark, sf_dir, "events").select("event_id", F.inline(F.array(shown.log_parts(said))))


@query(
    "S13s",
    """WITH q AS (SELECT p_partkey AS id, p_name AS q, p_size % 4 AS page, p_size % 3 * 100 AS least, p_partkey % 2 * 900 AS most FROM part)
    SELECT id, 'https://o/q-' || replace(lower(q), ' ', '-') || CASE WHEN page > 1 THEN '/?page=' || page ELSE '/' END AS olx, 'https://v/catalog?search_text=' || replace(q, ' ', '%20') || CASE WHEN page > 1 THEN '&page=' || page ELSE '' END AS vinted,
      'https://k/search?q=' || replace(q, ' ', '%20') || CASE WHEN page > 1 THEN '&page=' || page ELSE '' END AS kuantokusta, 'https://a/s?k=' || replace(q, ' ', '%20') || CASE WHEN page > 1 THEN '&page=' || page ELSE '' END AS amazon,
      'https://s/search?q=' || replace(q, ' ', '%20') || '&spm=a21ybx.search.searchInput.0' || CASE WHEN least > 0 THEN '&minPrice=' || least || '&startPrice=' || least ELSE '' END || CASE WHEN most > 0 THEN '&maxPrice=' || most || '&endPrice=' || most ELSE '' END AS source FROM q""",
)
def s13s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of all five searches."""
    q, page = F.col("p_name"), F.col("p_size") % 4
    starts = {"olx": "https://o/q-", "vinted": "https://v/catalog?search_text=", "kuantokusta": "https://k/search?q=", "amazon": "https://a/s?k="}
    bounds = ((F.col("p_size") % 3 * 100).cast("long"), F.col("p_partkey") % 2 * 900)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[prices.site_search_url(site, start, q, page).alias(site) for site, start in starts.items()], prices.source_search_url("https://s/search?q=", q, *bounds).alias("source"))


@query(
    "S23",
    evaluated_sql(C)
    + f""" SELECT id, '## ' || standard_key || chr(10) || chr(10) || '| Field | Value |' || chr(10) || '|-------|-------|' || chr(10) || '| **Total landed cost** | **' || {_money('landed', True)} || '** |' || chr(10) || '| **Expected resale (EU)** | ' || {_money('resale', False)} || ' |' || chr(10)
      || '| **Net profit** | **' || {_money('profit', True)} || '** |' || chr(10) || '| **Risk score** | ' || CAST(score AS INT) || '/100' || CASE WHEN dropped THEN ' · ⚠️ auto-dropped' ELSE '' END || ' |' || chr(10) || '| **Seller** | ' || CASE WHEN verified THEN '✅ verified' ELSE '⚠️ unverified' END || ' · ' || transactions || ' txns |' AS markdown,
      'Product: ' || standard_key || chr(10) || 'TOTAL LANDED: ' || {_money('landed', True)} || chr(10) || 'NET PROFIT: ' || {_money('profit', True)} || chr(10) || 'RISK SCORE: ' || CAST(score AS INT) || '/100' AS text FROM evaluated""",
)
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lines of each listing's sheet, as text and as Markdown."""
    e = evaluated(spark, sf_dir)
    lines = lambda sheet, *starts: F.array_join(F.filter(F.split(sheet, "\n"), lambda t: F.exists(F.array(*map(F.lit, starts)), lambda s: F.startswith(t, s))), "\n")
    markdown = exports.markdown()
    head = F.array_join(F.slice(F.split(markdown, "\n"), F.lit(1), F.lit(2)), "\n")
    rest = lines(markdown, "| Field", "|---", "| **Total", "| **Expected", "| **Net profit", "| **Risk", "| **Seller")
    return e.select("id", F.concat_ws("\n", head, rest).alias("markdown"), lines(exports.blueprint(), "Product:", "TOTAL LANDED", "NET PROFIT", "RISK SCORE").alias("text"))
