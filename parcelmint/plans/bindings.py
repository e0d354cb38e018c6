"""Listings, offers, reference prices and scans made from the star-schema tables, so that queries run at any scale.

Titles and descriptions are written from a row's numbers; the queries read them back, and the SQL beside a query
derives the same facts from the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ["iPhone 15 Pro", "iPhone 15", "iPhone 15 Pro Max", "MacBook Air M3", "iPad Air 5", "Galaxy S24 Ultra"]
KINDS = ["iphone", "iphone", "iphone", "macbook", "ipad", "samsung"]
TIERS = ["pro", "base", "pro_max", "base", "base", "ultra"]
STORAGE = [128, 256, 512, None]
TOKENS = ["未拆封", "仅拆封", "99新", "95新", "9成新"]
CONDITIONS = ["new", "open_box", "excellent", "very_good", "good"]
NOTES = ["有锁屏密码已告知 屏幕正常 电池耐用 外观完好无损", "无锁 功能正常 配件齐全 支持当面验机 欢迎咨询", "进水", "无进水 成色好 使用正常 电池健康93% 白色 原装", "换过电池", "", "国行 全网通 功能正常 原装配件齐全 支持验货宝"]
PLATFORMS = ["olx", "vinted", "kuantokusta", "amazon"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def out(x: Column) -> Column:
    """A double for output: four decimals, halves up."""
    return F.floor(x * 1e4 + 0.5) / 1e4


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier").count()
    key, size = F.col("p_partkey"), F.col("p_size")
    title = F.concat_ws(" ", pick(FAMILIES, key % 6), F.concat(pick(STORAGE, size % 4).cast("string"), F.lit("G")), pick(TOKENS, F.floor(key / 6) % 5))
    return part.select(
        key.alias("id"), (key % n + 1).alias("task"), title.alias("title"), pick(NOTES, key % 7).alias("description"), (F.col("p_retailprice") * 2.5).alias("price"),
        (size % 31 + 70).cast("double").alias("rating"), (key % 250).cast("int").alias("transactions"), (key % 2 == 0).alias("verified"), (size % 5).alias("images"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    label = F.concat(pick(STORAGE, F.col("l_linenumber") % 4).cast("string"), F.lit("GB"))
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer"), F.col("l_suppkey").alias("task"), F.concat_ws(" ", pick(FAMILIES, F.col("l_partkey") % 6), label).alias("title"),
        pick(PLATFORMS, F.col("l_orderkey") % 4).alias("platform"), (F.col("l_extendedprice") / 50).alias("euros"), (F.col("l_orderkey") % 4 >= 2).alias("retail"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference prices by standard key: every third family and the sizes 64 and 256."""
    rows = [(i, f"{f}{' 13' if k == 'macbook' else ''} {gb}GB", f, gb, 900.0 + 50 * i + gb / 8) for i, (f, k, gb) in enumerate((f, k, gb) for f, k in zip(FAMILIES, KINDS) for gb in (64, 256))]
    rows = [(i, key, f, gb, new, new - 80, new - 150, new - 230, None if i % 2 else new - 330) for i, key, f, gb, new in rows]
    return spark.createDataFrame(rows, "ordinal int, standard_key string, family string, gb int, new double, excellent double, very_good double, good double, fair double")


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


LISTINGS_SQL = f"""listings AS (
  SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM supplier) + 1 AS task, {sql_list(FAMILIES)}[p_partkey % 6 + 1] AS family, {sql_list(KINDS)}[p_partkey % 6 + 1] AS kind,
    {sql_list(TIERS)}[p_partkey % 6 + 1] AS tier, {sql_list(STORAGE)}[p_size % 4 + 1] AS gb, {sql_list(CONDITIONS)}[(p_partkey // 6) % 5 + 1] AS cond, p_partkey % 7 AS note,
    length({sql_list(NOTES)}[p_partkey % 7 + 1]) AS note_length, p_retailprice * 2.5 AS price, p_size % 31 + 70 AS rating, p_partkey % 250 AS transactions,
    p_partkey % 2 = 0 AS verified, p_size % 5 AS images,
    {sql_list(FAMILIES)}[p_partkey % 6 + 1] || CASE WHEN p_partkey % 6 = 3 THEN ' 13' ELSE '' END || CASE WHEN p_size % 4 = 3 THEN '' ELSE ' ' || {sql_list(STORAGE)}[p_size % 4 + 1] || 'GB' END AS standard_key
  FROM part)"""
OFFERS_SQL = f"""offers AS (
  SELECT l_orderkey * 10 + l_linenumber AS offer, l_suppkey AS task, {sql_list(FAMILIES)}[l_partkey % 6 + 1] AS family, {sql_list(TIERS)}[l_partkey % 6 + 1] AS tier,
    {sql_list(STORAGE)}[l_linenumber % 4 + 1] AS gb, {sql_list(PLATFORMS)}[l_orderkey % 4 + 1] AS platform, l_extendedprice / 50 AS euros, l_orderkey % 4 >= 2 AS retail,
    {sql_list(FAMILIES)}[l_partkey % 6 + 1] || CASE WHEN l_linenumber % 4 = 3 THEN '' ELSE ' ' || {sql_list(STORAGE)}[l_linenumber % 4 + 1] || 'GB' END AS title
  FROM lineitem)"""
_REFS = ", ".join(
    f"({i}, '{f}{' 13' if k == 'macbook' else ''} {gb}GB', '{f}', {gb}, {900.0 + 50 * i + gb / 8}, {820.0 + 50 * i + gb / 8}, {750.0 + 50 * i + gb / 8}, {670.0 + 50 * i + gb / 8}, {'NULL' if i % 2 else 570.0 + 50 * i + gb / 8})"
    for i, (f, k, gb) in enumerate((f, k, gb) for f, k in zip(FAMILIES, KINDS) for gb in (64, 256))
)
REFERENCES_SQL = f"refs AS (SELECT * FROM (VALUES {_REFS}) AS t(ordinal, standard_key, family, gb, new, excellent, very_good, good, fair))"
RISK_SQL = """risk AS (
  SELECT *, note = 2 AS dropped, CASE WHEN kind = 'macbook' THEN NULL WHEN note = 0 THEN 'carrier_locked' WHEN note IN (1, 6) THEN 'unlocked' ELSE 'unknown' END AS lock,
    least(60, CASE WHEN rating >= 98 THEN 0 WHEN rating >= 95 THEN 5 WHEN rating >= 90 THEN 12 WHEN rating >= 85 THEN 20 WHEN rating >= 70 THEN 30 ELSE 40 END
      + CASE WHEN transactions >= 50 THEN 0 WHEN transactions >= 10 THEN 4 WHEN transactions > 0 THEN 10 ELSE 8 END + CASE WHEN verified THEN 0 ELSE 8 END) AS seller
  FROM listings), scored AS (
  SELECT *, CASE WHEN dropped THEN 100 ELSE least(100, seller + CASE WHEN lock = 'carrier_locked' THEN 50 ELSE 0 END + CASE WHEN note = 4 THEN 10 ELSE 0 END
    + CASE WHEN images < 2 THEN 8 ELSE 0 END + CASE WHEN note_length < 20 THEN 5 ELSE 0 END) END AS score FROM risk)"""
