"""How things are shown, what searches are asked, what cards of used goods and steps say, and when a scan ends."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parcelmint.functions import prices, shown
from parcelmint.sources import goods

N = " "


def values(spark, rows, kind, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, kind).select(*columns).collect()]


def test_money(spark):
    rows = [(0.0,), (0.5,), (-0.4,), (999.5,), (1234.0,), (9999.5,), (12345.678,), (-1234567.005,), (None,)]
    got = values(spark, rows, "x double", shown.euros(F.col("x")), shown.euros(F.col("x"), 2), shown.yuan(F.col("x")))
    assert got[0] == (f"0{N}€", f"0,00{N}€", "¥0") and got[1] == (f"1{N}€", f"0,50{N}€", "¥0.5")
    assert got[3] == (f"1000{N}€", f"999,50{N}€", "¥999.5") and got[4] == (f"1234{N}€", f"1234,00{N}€", "¥1,234")
    assert got[5][0] == f"10{N}000{N}€" and got[6] == (f"12{N}346{N}€", f"12{N}345,68{N}€", "¥12,345.678")
    assert got[7] == (f"-1{N}234{N}567{N}€", f"-1{N}234{N}567,01{N}€", "¥-1,234,567.005") and got[8] == (None, None, None)


def test_ages_and_times(spark):
    now = datetime(2024, 9, 5, 12, 0)
    rows = [(datetime(2024, 9, 5, 11, 59, 30),), (datetime(2024, 9, 5, 11, 1),), (datetime(2024, 9, 4, 12, 30),), (datetime(2024, 9, 1, 11, 0),)]
    got = values(spark, rows, "t timestamp", shown.ago(F.col("t"), F.lit(now)), shown.time_labels(F.col("t"))["label"])
    assert got == [("just now", "5 Sept 11:59"), ("59m ago", "5 Sept 11:01"), ("23h ago", "4 Sept 12:30"), ("4d ago", "1 Sept 11:00")]


def test_logs_and_steps(spark):
    got = values(spark, [("[OLX] found 3",), ("[Data]none",), ("plain [x]",), ("[a] b\nc",), (None,)], "m string", shown.log_parts(F.col("m")).alias("p"))
    assert [tuple(r[0]) for r in got] == [("[OLX]", "found 3", "teal"), ("[Data]", "none", "slate"), (None, "plain [x]", None), (None, "[a] b\nc", None), (None, None, None)]
    got = values(spark, [("goofish: ✅ 12 Listings | OLX: ❌ failed|Vinted: ⏭️ skipped | Amazon ⏳ 4 comps",), ("KuantoKusta: ✅ done",)], "s string", shown.step_parts(F.col("s")).alias("p"))
    assert [tuple(x) for x in got[0][0]] == [("Goofish", "done", 12, "12 items"), ("OLX", "error", None, "Failed"), ("Vinted", "skipped", None, "Skipped"), ("KuantoKusta", "running", None, "Preparing…"), ("Amazon", "running", 4, "4 items")]
    assert {tuple(x)[1:] for x in got[1][0]} == {("running", None, "Preparing…")}


def test_search_addresses(spark):
    row = [("iPhone 15  Pro+", 1, 2)]
    got = values(spark, row, "q string, a int, b int", prices.site_search_url("olx", "https://o/q-", F.col("q"), F.col("a")), prices.site_search_url("olx", "https://o/q-", F.col("q"), F.col("b")), prices.site_search_url("amazon", "https://a/s?k=", F.col("q"), F.col("b")), prices.source_search_url("https://s?q=", F.col("q"), F.lit(5), F.lit(0)))
    assert got == [("https://o/q-iphone-15-pro+/", "https://o/q-iphone-15-pro+/?page=2", "https://a/s?k=iPhone%2015%20%20Pro%2B&page=2", "https://s?q=iPhone%2015%20%20Pro%2B&spm=a21ybx.search.searchInput.0&minPrice=5&startPrice=5")]


def test_used_goods(spark):
    page = lambda html: spark.createDataFrame([(1, html)], "page_id long, html string")
    html = '<div data-cy="l-card"><h4>iPhone 13 azul</h4><p>1 050,00 €</p>Como novo Lisboa, Alvalade 12 de maio<a href="/d/x">y</a></div><div data-cy="l-card"><p>no title</p> 5 €</div>'
    assert [tuple(r)[1:] for r in goods.used_goods(page(html), goods.OLX, "https://o").collect()] == [(0, "iPhone 13 azul", 1050.0, "excellent", "Lisboa, Alvalade", "Apple", "https://o/d/x")]
    html = '<div class="item-box">Galaxy preto 20 € Bom estado</div>'
    assert [tuple(r)[1:] for r in goods.used_goods(page(html), goods.VINTED, "").collect()] == [(0, "Galaxy preto 20 € Bom estado", 20.0, "good", "Portugal", "Samsung", None)]
    assert goods.used_goods(page(None), goods.OLX, "").collect() == [] and goods.used_goods(page("<p>x</p>"), goods.VINTED, "").collect() == []


@pytest.mark.parametrize("empty, want", [(1, [1, 2]), (2, [1, 2, 4]), (5, [1, 2, 4, 7])])
def test_scans_end_after_empty_rounds(spark, empty, want):
    rounds = spark.createDataFrame([(1, k) for k in range(1, 9)] + [(2, 1)], "scan long, round int")
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (1, 7), (3, 1)], "scan long, round int")
    assert sorted(r.round for r in goods.until_empty(rounds, rows, ["scan"], empty).collect()) == want


def test_blocked_pages(spark):
    got = values(spark, [("<p>Lo SENTIMOS</p>",), ("<script>captcha</script>ok",), ("results",)], "h string", goods.looks_blocked(F.col("h")))
    assert got == [(True,), (False,), (False,)]
