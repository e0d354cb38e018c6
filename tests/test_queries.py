"""Queries against their SQL on the smallest tables."""

import math
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from parcelmint.plans import catalog, margin_queries

SF = "/root/testdata/sf0.001"


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(float(r[i]), 6)) if isinstance(r[i], float) and not math.isnan(r[i]) else str(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    answer = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(answer.fetchall(), columns)


def test_numbering_is_spread(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") * 3).alias("doc_id"), F.when(F.col("id") % 100 == 0, None).otherwise(F.lit("a")).alias("source"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = catalog.QUERIES["W05"](spark, str(tmp_path))
        got = df.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    expected, next_ = {}, {True: 0, False: 0}
    for i in range(40_000):
        key = i % 100 == 0
        expected[3 * i] = f"{next_[key]}" if key else f"a-live-{next_[key]}"
        next_[key] += 1
    assert {r.doc_id: r.place_id for r in got} == expected and len(got) == 40_000
    assert max(Counter(r.task for r in got if r.place_id.startswith("a")).values()) < 30_000


def test_best_of_equal_profits_is_the_first_id(spark, tmp_path):
    """L07 and L01: 40 scans have the same listing and the same offers in other orders, so all profits are equal."""
    deal, scans, lines = random.Random(4), 41, []
    for scan in range(1, scans):
        offers = [(4 * k + k * k % 11 % 4, 6 * k, scan, k % 4, 90_005.0 + 37 * k) for k in range(200)]
        lines += deal.sample(offers, len(offers))
    tables = {
        "part": ([(6 * k, 4, 900.0) for k in range(1, 2 * scans) if 6 * k % scans + 1 < scans], "p_partkey long, p_size int, p_retailprice double"),
        "supplier": ([(k,) for k in range(scans)], "s_suppkey long"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double"),
    }
    for name, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert margin_queries.evaluated(spark, str(tmp_path)).select("fee_rate", "profit").distinct().count() == 1
    [best] = catalog.QUERIES["L07"](spark, str(tmp_path)).collect()
    assert (best.family, best.id) == ("iPhone 15 Pro", 6)
    assert [r.id for r in catalog.QUERIES["L01"](spark, str(tmp_path)).orderBy("place").collect()] == [r[0] for r in tables["part"][0]]
