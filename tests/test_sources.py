"""Parsers of captured pages, exports, keyed tables and the stream."""

import json

from pyspark.sql import functions as F

from parcelmint.operators import evaluate, relational
from parcelmint.functions.config import Config
from parcelmint.sources import elements, exports, market, pages
from parcelmint.streaming import ingest


def page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


def test_search_results(spark):
    html = '[{"title":"iPhone 15","price":"3299","desc":"ok","pic":"//img/a.jpg"},{"title":"","price":"5","desc":"","pic":""},{"title":"iPad","price":"0","desc":"","pic":"/b"},{"title":"PS5","price":"2600","desc":"x","pic":"http://c"}]'
    got = [(r.place, r.title, r.price, r.picture) for r in pages.search_results(page(spark, html)).orderBy("place").collect()]
    assert got == [(0, "iPhone 15", 3299.0, "https://img/a.jpg"), (1, "PS5", 2600.0, "http://c")]


def test_products_at_any_place(spark):
    for shape in ({"products": []}, {"searchResults": {"products": []}}, {"results": []}):
        item = [{"name": "iPhone 15", "price": 799.0, "store": "s", "url": "/p/1"}, {"name": "x", "price": 0}]
        inner = {k: item if v == [] else {"products": item} for k, v in shape.items()}
        html = f'<script id="__NEXT_DATA__" type="x">{json.dumps({"props": {"pageProps": inner}})}</script>'
        assert [(r.title, r.price, r.url) for r in pages.products(page(spark, html), "https://k").collect()] == [("iPhone 15", 799.0, "https://k/p/1")]
    assert pages.products(page(spark, "<html>"), "https://k").count() == 0


BLOCK = '<div data-component-type="s-search-result">'


def test_cards(spark):
    html = (
        f'x{BLOCK}<h2 class=a><span>iPhone 15</span></h2> 1 250,00 € prime{BLOCK}<h2 aria-label="Galaxy S24"></h2> <b>799 €</b><a href="/x/dp/B0">{BLOCK}<h2>no price</h2>'
        f'{BLOCK}<i aria-label="not the heading">5 €</i>{BLOCK}<h2><a href="/gp/1"><b>x</b><span class=c>With a link</span></a></h2> 0 € €1.099,90{BLOCK}<h2><span>four</span></h2> 8 €'
    )
    got = [(r.title, r.euros, r.prime, r.url) for r in pages.cards(page(spark, html), "https://a").orderBy("place").collect()]
    assert got == [("iPhone 15", 1250.0, True, None), ("Galaxy S24", 799.0, False, "https://a/x/dp/B0"), ("With a link", 1099.9, False, "https://a/gp/1")]


def test_cards_fall_back_to_headings(spark):
    spans = "".join(f'<h2 class="h">{a}<span class="x a-text-normal y"> Title {k} </span></h2> {k + 2},50 €' for k, a in enumerate(('<a href="/dp/0">', '<a href="http://b">', "")))
    html = f"<h2>plain</h2>{BLOCK}<h2><span>no price</span></h2>{spans}"
    got = [(r.title, r.euros, r.url) for r in pages.cards(page(spark, html), "https://a").orderBy("place").collect()]
    # the block has a price further down, so it is a card; without a block, headings count
    assert got == [("no price", 2.5, None)]
    got = [(r.title, r.euros, r.url) for r in pages.cards(page(spark, spans), "https://a").orderBy("place").collect()]
    assert got == [("Title 0", 2.5, "https://a/dp/0"), ("Title 1", 3.5, "http://b"), ("Title 2", 4.5, None)]
    assert pages.cards(page(spark, None), "https://a").collect() == []


def test_products_are_not_cut(spark):
    items = [{"name": "none", "price": 0}] * 10 + [{"name": f"p{i}", "price": 1.0 + i, "store": "s", "url": "/p"} for i in range(60)]
    html = f'<script id="__NEXT_DATA__">{json.dumps({"props": {"pageProps": {"products": items}}})}</script>'
    got = [(r.place, r.title, r.price) for r in pages.products(page(spark, html), "https://k").orderBy("place").collect()]
    assert got == [(i, f"p{i}", 1.0 + i) for i in range(60)]


def test_cards_are_counted_after_the_filter(spark):
    block = f"{BLOCK}<h2><span>"
    for valid in (50, 55):
        html = "x" + (block + "no price</span></h2>") * 5 + (block + "</span></h2> 7 €") * 5 + "".join(f"{block}card {i}</span></h2> {i + 1} €" for i in range(valid))
        got = [(r.place, r.title, r.euros) for r in pages.cards(page(spark, html)).orderBy("place").collect()]
        assert got == [(i, f"card {i}", 1.0 + i) for i in range(50)]
        assert pages.cards(page(spark, html), most=None).count() == valid


def test_proximity_pairs_take_each_price_once(spark):
    html = "<h2>A</h2><h2>B</h2> 100 € <h2>C</h2>" + "x" * 1600 + "200 € <h2>D</h2> 300 €"
    got = [(r.title, r.euros) for r in pages.proximity_pairs(page(spark, html)).orderBy("place").collect()]
    assert got == [("A", 100.0), ("D", 300.0)]


def test_pairs_count_what_is_kept(spark):
    bad = "<p>0 €</p>" * 250 + "<p>12.000 €</p>" * 250
    html = bad + "<h2>A phone</h2> 300 €"
    assert [(r.title, r.euros) for r in pages.proximity_pairs(page(spark, html)).collect()] == [("A phone", 300.0)]
    many = "".join(f"<h2>t{k}</h2> {k + 2} €" for k in range(120))
    assert pages.proximity_pairs(page(spark, many)).count() == 50
    assert pages.proximity_pairs(page(spark, many), most=None).count() == 100
    assert pages.proximity_pairs(page(spark, many), most=None, most_titles=None).count() == 120


def test_pairs_reach_from_the_title_on(spark):
    # reach counts from where the title begins, plus its length: 1,500 is within
    for gap, found in ((1500, 1), (1501, 0)):
        html = "<h2>Title</h2>" + "x" * (gap - len("<h2></h2>")) + "200 €"
        assert pages.proximity_pairs(page(spark, html)).count() == found
    # a price inside the title's element counts
    inside = '<h2 class="9 €">Title</h2>'
    assert [r.euros for r in pages.proximity_pairs(page(spark, inside)).collect()] == [9.0]


def test_many_titles_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        html = "".join(f"<h2>t{k}</h2> {k % 900 + 2} €" for k in range(n))
        began = time.process_time()
        assert len(list(pages.merged(pages.headings(html), pages.amounts_in(html, None), 1500, None))) == n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_third_way_of_products(spark):
    html = '<h3>Short</h3><a href="/x">Pesquisa avançada</a><h2>A product title</h2> 1 € 20,50 €<a class=b href="/y">Another title</a> 30 €<a href="javascript:0">Third title</a> 40 €'
    got = [(r.title, r.price, r.url, r.store, r.way) for r in pages.listed_products(page(spark, html), "https://k").orderBy("place").collect()]
    assert got == [("A product title", 20.5, None, "Loja", 3), ("Another title", 30.0, "https://k/y", "Loja", 3), ("Third title", 40.0, None, "Loja", 3)]
    assert pages.listed_products(page(spark, None), "https://k").collect() == []


def test_trees(spark):
    html = '<ul class="a"><li>one<li>two <b>bold</b> &amp; more<br></ul></i><script>if (a < b) {}</script><p>un<em>closed'
    row = elements.trees(page(spark, html)).first()
    assert row.text == "onetwo bold & moreif (a < b) {}unclosed"
    got = [(n.tag, n.parent, n.last, row.text[n.begin : n.end], list(n.path)) for n in row.nodes]
    assert got == [
        ("ul", -1, 4, "onetwo bold & more", []), ("li", 0, 1, "one", [0]), ("li", 0, 4, "two bold & more", [0]), ("b", 2, 3, "bold", [2, 0]), ("br", 2, 4, "", [2, 0]),
        ("script", -1, 5, "if (a < b) {}", []), ("p", -1, 7, "unclosed", []), ("em", 6, 7, "closed", [6]),
    ]
    assert [list(n.own) for n in row.nodes][2] == [3, 7, 11, 18]
    assert elements.trees(page(spark, None)).first().nodes == []


def listing(n, price, title=None):
    return f'<div class="c"><a href="/item/{n}"><b><i class="main-title">{title or f"Title {n}"}</i></b>{price}<img data-src="/p{n}"></a></div>'


def price(text):
    return f'<u class="row3-wrap-price">{text}</u>'


def test_cards_by_tree(spark):
    whole = listing(1, price("<s>¥3,799</s><s>17人想要</s>")) + listing(2, price("¥26.50<q>54人想要</q>")) + listing(3, price("¥2千")) + listing(4, price("只要 <s>面议</s> ¥880"))
    got = [(r.place, r.title, r.price, r.picture, r.href) for r in market.cards(page(spark, f"<main>{whole}</main>"), "https://m").orderBy("place").collect()]
    assert got == [(0, "Title 1", 3799, "/p1", "https://m/item/1"), (1, "Title 3", 2000, "/p3", "https://m/item/3"), (2, "Title 4", 880, "/p4", "https://m/item/4")]
    # numbers differ: every title takes the price of its own card, and one without a price takes none
    fewer = listing(1, price("¥100")) + listing(2, "") + listing(3, price("¥300"))
    assert [(r.title, r.price) for r in market.cards(page(spark, f"<main>{fewer}</main>"), "").orderBy("place").collect()] == [("Title 1", 100), ("Title 3", 300)]
    # equal numbers, a price without sense: it is not looked for in another card
    odd = listing(1, price("¥2019年")) + listing(2, price("¥70"))
    assert [(r.title, r.price) for r in market.cards(page(spark, f"<main>{odd}</main>"), "").collect()] == [("Title 2", 70)]
    # more than six elements up is too far
    far = f'<div>{"<p><span>" * 4}<i class="main-title">Far</i>{"</span></p>" * 4}{price("¥99")}{price("x")}</div>'
    assert market.cards(page(spark, far), "").collect() == []
    assert [r.price for r in market.cards(page(spark, f"<main>{fewer}</main>"), "", least=150, most=400).collect()] == [300]
    assert market.cards(page(spark, "<p>猜你喜欢</p>" + whole), "").collect() == [] and market.cards(page(spark, None), "").collect() == []


def test_details(spark):
    html = (
        '<span class="item-user-info-label">x</span><span class="item-user-info-label">好评率 97%</span><ul><li class="item-main-window-list-item"><img src="//a/1"></li><li class="item-main-window-list-item"><i></i></li></ul>'
        '<div class="desc">short</div><div class="main-desc">the  longest\n text</div><div class="params">品牌 x</div><div class="spec">版本 国行</div>'
    )
    r = market.details(page(spark, html)).first()
    assert (r.rating, r.images, r.pictures, r.description, r.labels) == (97, 2, ["https://a/1"], "the longest text", "版本 国行")
    r = market.details(page(spark, "<p>nothing</p>")).first()
    assert (r.rating, r.images, r.pictures, r.description, r.labels) == (None, 0, None, None, None)
    assert market.details(page(spark, None)).first().images == 0


def test_zip_needs_equal_numbers(spark):
    row = spark.range(1).select(pages.zipped(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2"))).alias("x"), pages.zipped(F.array(F.lit("a")), F.array(F.lit("1"), F.lit("2"))).alias("y")).first()
    assert [tuple(p) for p in row.x] == [("a", "1"), ("b", "2")] and row.y == []


def test_evaluate_export_and_summary(spark, tmp_path):
    listings = spark.createDataFrame([(1, 1, "iPhone 15 Pro 256G国行 95新 无锁", "整机无进水，屏幕没换过，电池健康93%，功能正常，配件齐全", 3000.0, 99.0, 320, True, 4), (2, 1, "iPhone 12 64GB 进水", "", 900.0, 99.0, 500, True, 3), (3, 1, "华为手机", "x", 1200.0, None, 0, False, 1)], "id long, task long, title string, description string, price double, rating double, transactions int, verified boolean, images int")
    offers = spark.createDataFrame([(1, 1, "iPhone 15 Pro 256GB", "olx", 720.0), (2, 1, "Apple iPhone 15 Pro 256 GB azul", "vinted", 690.0), (3, 1, "iPhone 15 Pro 128GB", "olx", 640.0), (4, 1, "iPhone 15 Pro Max 256GB", "amazon", 1150.0), (5, 1, "iPhone 15 Pro 1TB", "kuantokusta", 1300.0)], "offer long, task long, title string, platform string, euros double")
    refs = spark.createDataFrame([(0, "iPhone 12 64GB", 380.0, 320.0, 285.0, 240.0, 180.0)], "ordinal int, standard_key string, new double, excellent double, very_good double, good double, fair double")
    done = evaluate.evaluate(listings, offers, refs, Config())
    rows = {r.id: r for r in done.collect()}
    assert rows[1].profit.resale == 705.0 and not rows[1].hidden and rows[1].product.standard_key == "iPhone 15 Pro 256GB"
    assert rows[2].risk.dropped and rows[2].hidden_reason == "blacklist"
    assert rows[3].product is None and rows[3].profit.resale == 720.0
    s = evaluate.summary(done, Config()).first()
    assert (s.total, s.hidden_scam) == (3, 1)
    assert evaluate.summary(done.limit(0), Config()).first().best_profit == 0.0
    exports.write_csv(done, str(tmp_path / "csv"))
    exports.write_json(done, str(tmp_path / "json"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 3 and {r.Hidden for r in back.collect()} == {"YES", "NO"} and spark.read.json(str(tmp_path / "json")).count() == 3
    header = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8").split("\n")[0]
    assert header.startswith("\ufeffProduct,Condition,Price_CNY,Acquisition_EUR") and header.rstrip().endswith("EU_Comps_Count,Goofish_Title,Description") and header.count(",") == 44
    assert exports.meta(done, "iphone").first().asDict() == {"query": "iphone", "total_listings": 3, "viable_listings": sum(not r.hidden for r in rows.values())}


def test_read_references(spark, tmp_path):
    (tmp_path / "r.csv").write_text('StandardKey,Category,New,Excellent,veryGood,good,fair\r\n"iPhone 12, red",nothing,"€1,200.50",x,300,200,\r\n ,ipad,1,1,1,1,1\r\n', encoding="utf-8")
    got = exports.read_references(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.standard_key, r.category, r.new, r.excellent, r.very_good, r.fair) for r in got] == [("iPhone 12, red", "iphone", 1200.5, 0.0, 300.0, 0.0)]


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, at int")
    assert sorted(tuple(r) for r in relational.upsert(old, new, "k", "at").collect()) == [("a", 1, "kept"), ("b", 4, "updated"), ("c", 5, "created")]


def test_stream_writes_each_title_once(spark, tmp_path):
    rows = [{"task": 1, "generation": g, "source": "s", "title": t, "price": 1.0, "seen": f"2024-01-01T0{h}:00:00Z"} for g, t, h in ((1, "a", 1), (1, "a", 1), (2, "b", 2), (2, "c", 2))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    ingest.write_once(ingest.scans(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    assert sorted(r.title for r in ingest.current(spark, str(tmp_path / "out")).collect()) == ["b", "c"]
