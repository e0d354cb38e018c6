"""Golden cases for what is read from texts, and for prices and risk."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from parcelmint.functions import conditions, config, folds, matching, prices, pricing, relevance, risk, titles
from parcelmint.operators import analytics, logs, results
from parcelmint.plans import condition_queries


def value(spark, column, **texts):
    return spark.createDataFrame([Row(**texts)]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,gb",
    [("256G国行", 256), ("12+256G", 256), ("1TB", 1024), ("容量: 1T", 1024), ("iPhone 15 Pro 256", 256), ("Xiaomi 15T Pro", 15360), ("iPhone 15 Pro", None), ("8G+128G", 128), ("iPhone 15 Pro Max 512", 512), ("12GB 内存", None)],
)
def test_storage(spark, text, gb):
    assert value(spark, titles.storage_gb(F.col("t")), t=text) == gb


def test_rounds_halves_up_and_labels_storage(spark):
    assert value(spark, titles.storage_label(F.lit(2048)), t="") == "2TB"
    assert value(spark, titles.display_title(F.col("t")), t="iPhone 15 256G  1T 😀") == "iPhone 15 256GB 1TB"


@pytest.mark.parametrize("text,token,found", [("整机无进水", "进水", False), ("进水修好", "进水", True), ("无进水，但曾进水", "进水", True)])
def test_negation(spark, text, token, found):
    assert value(spark, risk.says(F.col("t"), token), t=text) is found


def test_lock_screen_password_is_no_lock(spark):
    assert value(spark, risk.blacklist(F.col("t")), t="有锁屏密码") == []
    assert value(spark, risk.blacklist(F.col("t")), t="有锁") == ["有锁 (carrier locked)"]
    assert value(spark, risk.negated(F.col("t"), "进水"), t="没有进水，无进水") == ["没有进水", "无进水"]


@pytest.mark.parametrize("mode,cny,total", [("realistic", 1000.0, 242.71274125), ("realistic", 0.0, 72.19), ("conversion", 1000.0, 127.0), ("conservative", 1000.0, 309.105020925)])
def test_landed_cost(spark, mode, cny, total):
    got = value(spark, pricing.landed_cost(F.col("p"), config.PRESETS[mode])["total"], p=cny)
    assert got == pytest.approx(total, abs=1e-9)


def test_overrides_are_bounded():
    assert config.overridden(config.Config(), rate=5).rate == 1
    for bad in ({"fee_olx": 1}, {"unknown": 1}, {"vat": float("nan")}):
        with pytest.raises(ValueError):
            config.overridden(config.Config(), **bad)


@pytest.mark.parametrize("title,gb,score", [("iPhone 15 Pro 256GB", 256, 100), ("iPhone 15 Pro", None, 70), ("iPhone 15 Pro 128GB", 128, 50), ("iPhone 15 Pro 1TB", 1024, 40)])
def test_score(spark, title, gb, score):
    words = matching.query_words(F.lit("iPhone 15 Pro 256GB"))
    assert value(spark, matching.score(words, F.lit("iphone 15 pro"), F.lit(256), F.lower("t"), F.lit(gb).cast("int")), t=title) == score
    assert value(spark, matching.tier(F.col("t")), t="iPhone 15 Pro Max 256GB国行") == "pro_max"


@pytest.mark.parametrize("title,query,fits", [("iPhone 15 128GB", "iPhone 17", False), ("iPhone 17 Pro", "iPhone 17", True), ("iPhone case", "iPhone 17", True), ("Galaxy S25", "iPhone 17", False), ("Switch OLED", "Switch 2", False)])
def test_relevance(spark, title, query, fits):
    assert value(spark, relevance.is_relevant(F.col("t"), query), t=title) is fits


def test_junk_and_accessories(spark):
    assert value(spark, relevance.is_junk(F.col("t")), t="iPhone 15 包邮")
    assert not value(spark, relevance.is_junk(F.col("t")), t="iPhone 15 Pro 256G 国行")
    assert value(spark, relevance.is_accessory(F.col("t")), t="PELÍCULA iPhone")
    assert not value(spark, relevance.is_accessory(F.col("t")), t="iPhone 15")


@pytest.mark.parametrize("text,price", [("¥2019年", None), ("¥3.5万", None), ("¥379917人想要", None), ("¥3,299", 3299), ("¥2千", 2000)])
def test_source_price(spark, text, price):
    assert value(spark, prices.source_price(F.col("t")), t=text) == price


def test_euros(spark):
    assert value(spark, prices.euros(F.col("t")), t="1 250,00 €") == 1250.0
    assert value(spark, prices.euros(F.col("t")), t="iPhone 15 450 €") == 15450.0
    assert value(spark, prices.euros(F.col("t")), t="nada") is None


def test_products(spark):
    rows = [("iPhone 15 Pro 256G国行 95新 无锁", "电池健康93%"), ("PS5 Slim 数字版 全新未拆封", ""), ("iPhone 15 128GB 无ID锁", ""), ("华为手机", ""), ("苹果16 128GB 99新", "有锁屏密码"), (None, None)]
    got = [r.product for r in titles.with_product(spark.createDataFrame(rows, "title string, description string")).collect()]
    assert (got[0].standard_key, got[0].condition, got[0].region_version, got[0].battery_health, got[0].lock_status) == ("iPhone 15 Pro 256GB", "very_good", "china", 93, "unlocked")
    assert (got[1].standard_key, got[1].condition) == ("PlayStation 5 Slim Digital", "new")
    assert got[2].lock_status == "icloud_locked" and got[3] is None and got[5] is None
    assert (got[4].family, got[4].lock_status, got[4].condition) == ("iPhone 16", "carrier_locked", "excellent")


def test_unenriched_listing_risk(spark):
    r = risk.report(F.lit("iPhone 15"), F.lit("一段足够长的描述文字一段足够长的描述文字"), F.lit("unknown"), F.lit(None).cast("double"), F.lit(0), F.lit(False), F.lit(1))
    assert value(spark, r, t="")["score"] == 49


@pytest.mark.parametrize("text,verdicts,flags", condition_queries.CASES)
def test_conditions(spark, text, verdicts, flags):
    rows = spark.createDataFrame([(None, text, None)], f"title string, description string, product {titles.PRODUCT}")
    got = conditions.with_conditions(rows).first()
    assert {k: v for k, v in got.verdicts.asDict().items() if v} == verdicts and got.condition_flags == flags


def test_storage_of_a_text_is_put_into_its_product(spark):
    rows = titles.with_product(spark.createDataFrame([("MacBook Air M3", ""), ("iPhone 15", "1TB"), ("华为", "1TB")], "title string, description string"))
    later = rows.withColumn("description", F.lit("容量: 1TB 有锁"))
    got = [r.product for r in conditions.with_conditions(later).collect()]
    assert got[0].standard_key == "MacBook Air M3 13 1TB" and got[0].storage_gb == 1024
    assert got[1].standard_key == "iPhone 15 1024GB" and got[2] is None


def test_exact_medians(spark):
    rows = [("a", x) for x in (5.0, 1.25, 1.5, 900.0)] + [("b", 7.5)] * 9 + [("c", None), (None, 2.0), (None, 4.0), ("d", -3.5), ("d", -1.0), ("d", None)]
    got = {r.k: r.median for r in analytics.exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"a": 3.25, "b": 7.5, None: 3.0, "d": -2.25}


def test_running(spark):
    rng = random.Random(3)
    for n in (0, 1, 63, 64, 65, 4096, 5000):
        values = [rng.randrange(-50, 50) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<bigint>")
        zero, low = F.lit(0).cast("long"), F.lit(-1000).cast("long")
        row = df.select(folds.running(F.col("v"), zero, lambda a, x: a + x).alias("sums"), folds.running(F.col("v"), low, lambda a, x: F.greatest(a, x), levels=1).alias("most")).first()
        assert row.sums == [sum(values[:k]) for k in range(n)]
        assert row.most == [max([-1000, *values[:k]]) for k in range(n)]


@pytest.mark.parametrize("values", [[0.1, 0.11, 0.2, 0.4], [1.0, 1e9, 3.0, 2e9, 5.0], [5.0, 5.0, 5.0], [-3.5, 2.0, None, 7.25, 7.25], list(map(float, range(200)))])
def test_weighted_medians(spark, values):
    rows = spark.createDataFrame([("a", v, 1 + k % 3) for k, v in enumerate(values)] + [(None, 1.5, 2)], "g string, v double, n long")
    want = sorted(v for k, v in enumerate(values) if v is not None for _ in range(1 + k % 3))
    middle = (want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2
    assert {r.g: r.median for r in analytics.exact_medians(rows, ["g"], "v", weight="n").collect()} == {"a": middle, None: 1.5}


def test_heatmap_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", "new", 10.0, 1.0), ("a", "new", 20.0, None), ("a", "good", None, 3.0), (None, "new", -5.0, -1.0)], "family string, condition string, profit double, margin double")
    found = {(r.family, r.condition): (r.median_profit, r.n, r.mean_margin, r.least, r.most) for r in analytics.heatmap(rows).collect()}
    assert len(found) == 14 and found["a", "new"] == (15.0, 2, 1.0, -5.0, 15.0) and found["a", "good"] == (None, 1, 3.0, -5.0, 15.0) and found[None, "new"][:3] == (-5.0, 1, -1.0) and found["a", "fair"][1] == 0
    assert analytics.heatmap(rows.limit(0)).collect() == []


def test_logs_and_rates(spark):
    rows = spark.createDataFrame([("iPhone", 1, 5), ("IPHONE", 9, 5), ("iPad", 3, None), (None, 4, 5)], "q string, at int, x int")
    assert [tuple(r) for r in logs.recent(rows.where("q is not null"), "q", "at", 1).collect()] == [("iphone", 9)]
    assert sorted(r.text for r in logs.suggested(rows, "q", "PH").collect()) == ["IPHONE", "iPhone"]
    assert {r.kind: r.n for r in logs.counted(rows, "x").collect()} == {5: 3, None: 1}
    rates = spark.createDataFrame([(0.1, True, 0.2, 0.3), (0.1, False, 0.2, 0.3), (None, True, 0.0, 0.3), (None, None, None, None)], "c double, ok boolean, f double, o double")
    found = rates.select(pricing.exchange_rate(F.col("c"), F.col("ok"), F.col("f"), F.col("o"), 0.127).alias("r")).collect()
    assert [tuple(x.r) for x in found] == [(0.1, "cache"), (0.2, "api"), (0.3, "user"), (0.127, "default")]
    assert value(spark, pricing.scan_seconds(F.lit(3), F.lit(False)), t="") == 22 and value(spark, pricing.scan_seconds(F.lit(1), F.lit(True), F.lit(True), F.lit(0)), t="") == 6


def test_enrichment_takes_the_longer_text(spark):
    say = "href long, rating double, images int, pictures array<string>, description string, labels string"
    own = spark.createDataFrame([(1, 90.0, 1, ["a"], "own words", None), (2, 90.0, 1, ["a"], None, None), (3, 90.0, 1, ["a"], "x", None)], say).drop("labels")
    found = spark.createDataFrame([(1, None, 0, None, "short", "版本 国行"), (2, 97.0, 2, None, "", None)], say)
    got = {r.href: (r.rating, r.images, r.pictures, r.description) for r in results.enriched(own, found).collect()}
    assert got == {1: (90.0, 1, ["a"], "own words 版本 国行"), 2: (97.0, 2, ["a"], None), 3: (90.0, 1, ["a"], "x")}
