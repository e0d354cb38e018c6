"""Queries on captured pages: each page's own html with further blocks after it, made from the page's id, so that the SQL can tell what must be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.plans.bindings import pick, table
from parcelmint.plans.catalog import query
from parcelmint.sources import goods, market, pages


def _id() -> Column:
    return F.col("page_id")


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def captured(spark: SparkSession, sf_dir: str, *parts: Column) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws("", F.coalesce("html", F.lit("")), *parts).alias("html"))


@query(
    "S03",
    """WITH rows AS (SELECT page_id, n, CASE n WHEN 2 THEN '' ELSE 'Item ' || page_id || ' no ' || n END AS title, CASE WHEN n = page_id % 3 + 3 THEN 0 ELSE page_id % 700 + n * 0.5 END AS price, n % 2 = 0 AS slash
      FROM pages, range(1, 8) t(n))
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS place, title, CAST(price AS DOUBLE) AS price, 'says \\"' || n || '\\"' AS description, CASE WHEN slash THEN 'https://i.example/' ELSE 'http://j.example/' END || n || '.jpg' AS picture
    FROM rows WHERE title <> '' AND price > 0""",
)
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a search result's JSON: seven on each page, one without a title, one without a price."""

    def row(n: int) -> Column:
        title = F.lit("") if n == 2 else _say("Item ", _id(), f" no {n}")
        price = F.when(F.lit(n) == _id() % 3 + 3, F.lit("0")).otherwise((_id() % 700 + n * 0.5).cast("string"))
        return _say('{"title":"', title, '" , "price": "', price, f'","desc":"says \\"{n}\\"","pic":"{"//i" if n % 2 == 0 else "http://j"}.example/{n}.jpg"}}')

    return pages.search_results(captured(spark, sf_dir, *map(row, range(1, 8))))


_BLOCKS = 9


@query(
    "J8",
    f"""WITH RECURSIVE blocks AS (SELECT page_id, b, 'Title ' || page_id || '-' || b AS title, (page_id * 7 + b * 613) % 2400 AS gap, CASE WHEN (page_id + b) % 4 = 0 THEN '0' WHEN (page_id + b) % 7 = 0 THEN '12.500,00' ELSE CAST((page_id * 31 + b * 97) % 900 + 2 AS VARCHAR) || ',50' END AS said
      FROM pages, range(1, {_BLOCKS + 1}) t(b)),
    laid AS (SELECT *, sum(9 + length(title) + gap + 1 + length(said) + 2) OVER (PARTITION BY page_id ORDER BY b) - (9 + length(title) + gap + 1 + length(said) + 2) AS start FROM blocks),
    prices AS (SELECT page_id, b, start + 9 + length(title) + gap + 1 AS place, said FROM laid WHERE said NOT IN ('0', '12.500,00')),
    step(page_id, b, used, took) AS (SELECT page_id, 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM pages UNION ALL
      SELECT s.page_id, s.b + 1, coalesce(x.b, s.used), x.b FROM step s JOIN laid t ON t.page_id = s.page_id AND t.b = s.b + 1
        LEFT JOIN LATERAL (SELECT b FROM (SELECT b, place FROM prices p WHERE p.page_id = s.page_id AND p.b > s.used AND p.place >= t.start ORDER BY p.b LIMIT 1) WHERE place - (t.start + length(t.title)) <= 1500) x ON true)
    SELECT step.page_id, CAST(row_number() OVER (PARTITION BY step.page_id ORDER BY step.b) - 1 AS INT) AS place, laid.title, CAST(replace(p.said, ',', '.') AS DOUBLE) AS euros
    FROM step JOIN laid USING (page_id, b) JOIN prices p ON p.page_id = step.page_id AND p.b = step.took""",
)
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles paired with prices after them: nine of each on a page, some too far apart, some prices no price of a product."""

    def block(b: int) -> Column:
        gap = ((_id() * 7 + b * 613) % 2400).cast("int")
        said = F.when((_id() + b) % 4 == 0, "0").when((_id() + b) % 7 == 0, "12.500,00").otherwise(_say((_id() * 31 + b * 97) % 900 + 2, ",50"))
        return _say("<h2>Title ", _id(), f"-{b}</h2>", F.repeat(F.lit("x"), gap), " ", said, " €")

    return pages.proximity_pairs(captured(spark, sf_dir, *map(block, range(1, _BLOCKS + 1))))


@query(
    "S09",
    """WITH rows AS (SELECT page_id, page_id % 3 + 1 AS way, n FROM pages, range(3) t(n))
    SELECT page_id, CAST(n AS INT) AS place, CAST(way AS INT) AS way, CASE way WHEN 1 THEN 'Embedded ' || n WHEN 2 THEN 'Linked product ' || n ELSE 'Near a price ' || n END AS title, page_id % 500 + 10.5 + n AS price,
      CASE way WHEN 1 THEN 's' ELSE 'Loja' END AS store, CASE way WHEN 1 THEN 'https://k/p' || n WHEN 2 THEN 'https://k/produto/' || n ELSE CASE n WHEN 0 THEN NULL WHEN 1 THEN 'https://k/q1' ELSE 'https://other/q2' END END AS url FROM rows""",
)
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of pages by the first of three ways that finds any; the third from headings and links, but not those of navigation."""
    way = _id() % 3 + 1
    price = lambda n: _id() % 500 + 10 + n
    item = lambda n: _say(f'{{"name":"Embedded {n}","price":', price(n), f'.5,"store":"s","url":"/p{n}"}}')
    embedded = F.concat(F.lit('<script id="__NEXT_DATA__">{"props":{"pageProps":{"products":['), F.concat_ws(",", *map(item, range(3))), F.lit(',{"name":"none","price":0}]}}}</script>'))
    linked = F.concat(*[_say(f'<a href="/produto/{n}">Linked product {n}</a> <b>', price(n), ",50 €</b>") for n in range(3)])
    near = [f'<h3 class="t">Near a price {n}</h3>' if n == 0 else f'<a class="t" href="{"/q1" if n == 1 else "https://other/q2"}">Near a price {n}</a>' for n in range(3)]
    third = F.concat(F.repeat(F.lit("x"), F.lit(1600)), F.lit(' 0 € <h3>Short</h3><a href="/">Início da loja</a>'), *[_say(near[n], " ", price(n), ",50 €") for n in range(3)])
    return pages.listed_products(captured(spark, sf_dir, F.when(way == 1, embedded).when(way == 2, linked).otherwise(third)), "https://k")


@query(
    "S11",
    """WITH rows AS (SELECT page_id, n FROM pages, range(3) t(n) WHERE page_id % 5 < 4 OR n < 2)
    SELECT page_id, CAST(n AS INT) AS place, CASE WHEN page_id % 5 = 4 THEN 'Further down ' || n WHEN n = 0 THEN 'Phone ' || page_id WHEN n = 1 THEN 'Labelled ' || page_id ELSE 'Plain heading' END AS title,
      CASE WHEN page_id % 5 = 4 THEN 99.9 + n WHEN n = 0 THEN 1000.5 + page_id % 900 WHEN n = 1 THEN page_id % 700 + 20.0 ELSE 7.0 END::DOUBLE AS euros, page_id % 5 < 4 AND n = 0 AS prime,
      CASE WHEN page_id % 5 = 4 THEN CASE n WHEN 0 THEN 'https://a/dp/F0' END WHEN n = 0 THEN 'https://a/dp/A' || page_id WHEN n = 1 THEN 'https://a/x/dp/B' || page_id || '/ref=1' END AS url FROM rows""",
)
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a retail result page in the layouts there are, blocks without title or price between them; every fifth page has no blocks but headings."""
    block = lambda *parts: _say('<div data-component-type="s-search-result">', *parts, "</div>")
    # three digits after the dot, filled up
    thousands = F.lpad((_id() % 900).cast("string"), 3, "0")
    blocks = F.concat(
        block('<h2 class="h"><a class="l" href="/dp/A', _id(), '"><span class="s"> Phone ', _id(), " </span></a></h2><b>1.", thousands, ",50 €</b> PRIME"),
        block("<h2><span>No price here</span></h2>"),
        block('<a href="/x/dp/B', _id(), '/ref=1"></a><h2 aria-label="Labelled ', _id(), '"></h2> € ', _id() % 700 + 20),
        block('<p aria-label="no heading of the block">5 €</p>'),
        block("<h2><span>Plain heading</span></h2> 0 € or €7"),
    )
    further = _say('<h2><a href="/dp/F0"><span class="a-x a-text-normal">Further down 0</span></a></h2> 99,90 €<h2><span class="a-text-normal">Further down 1</span></h2> 100,90 €')
    return pages.cards(captured(spark, sf_dir, F.when(_id() % 5 == 4, further).otherwise(blocks)), "https://a")


@query(
    "S05",
    """WITH cards AS (SELECT page_id, n, page_id % 4 AS kind, 1000 + (page_id * 37 + n * 211) % 5000 AS price, page_id % 90 + n AS wants FROM pages, range(1, 5) t(n)),
    told AS (SELECT *, CASE WHEN kind = 0 AND n = 4 THEN '¥2019年' WHEN kind = 3 AND n = 1 THEN '¥1.50万' ELSE '¥' || price END AS said FROM cards),
    priced AS (SELECT *, CASE WHEN kind = 0 AND n = 4 OR kind = 1 AND n = 2 OR kind = 2 AND n = 3 THEN NULL WHEN kind = 3 AND n = 1 THEN 15000 ELSE price END AS amount FROM told)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS place, 'Title ' || page_id || '-' || n AS title, CAST(amount AS DOUBLE) AS price,
      'Title ' || page_id || '-' || n || ' ' || said || wants || '人想要 & more' AS description, '//img.example/' || n || '.jpg' AS picture, 'https://m.example/item?id=' || page_id || '-' || n AS href
    FROM priced WHERE amount >= 1500""",
)
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards by the page's tree, four on a page: as many titles as prices, one card without a price, one with two, or a price outside of all cards."""
    kind = _id() % 4

    def card(n: int) -> Column:
        price = _say("¥", 1000 + (_id() * 37 + n * 211) % 5000)
        price = F.when(kind == 0, "¥2019年").otherwise(price) if n == 4 else F.when(kind == 3, "¥1.50万").otherwise(price) if n == 1 else price
        shown = _say('<div class="row3-wrap-price--x"><span>', price, "</span><span>", _id() % 90 + n, "人想要</span></div>")
        shown = F.when(kind == 1, "").otherwise(shown) if n == 2 else F.when(kind == 2, F.concat(shown, shown)).otherwise(shown) if n == 3 else shown
        return _say('<div class="card"><a class="feeds" href="/item?id=', _id(), f'-{n}"><p class="row1"><span class="main-title--y"> Title ', _id(), f'-{n}</span> </p>', shown, f' &amp; more<img src="//img.example/{n}.jpg"><br></a></div>')

    ad = F.when(kind == 3, '<div class="row3-wrap-price--ad">¥9</div>').otherwise("")
    found = market.cards(captured(spark, sf_dir, ad, F.lit('<div class="grid">'), *map(card, range(1, 5)), F.lit("</div>")), "https://m.example", least=1500)
    return found.withColumn("price", F.col("price").cast("double"))


_LONG = "机器正常使用痕迹，功能全部正常，配件齐全，支持当面验机，非诚勿扰"


@query(
    "S14",
    f"""SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE CAST(80 + page_id % 20 AS INT) END AS rating, CAST(CASE page_id % 3 WHEN 0 THEN page_id % 5 ELSE 2 END AS INT) AS images,
      '[' || array_to_string(CASE WHEN page_id % 3 = 0 AND page_id % 5 = 0 THEN NULL WHEN page_id % 3 = 0 THEN list_transform(range(1, page_id % 5 + 1), lambda k: 'https://p.example/' || k) WHEN page_id % 3 = 1 THEN ['https://g.example/1', 'http://g.example/2'] ELSE ['https://x.alicdn.com/only'] END, ', ') || ']' AS pictures,
      CASE WHEN page_id % 2 = 0 THEN '{_LONG} ' || page_id ELSE 'short ' || page_id END AS description, CASE page_id % 3 WHEN 0 THEN '品牌 Apple 版本 海外有锁 ' || page_id WHEN 1 THEN '品牌 A 版本 国行' END AS labels FROM pages""",
)
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing's own page: its rating told in one of three places, pictures in one of three frames, texts of two lengths, labels in a block, in any element or not at all."""
    rated = _say("好评率", 80 + _id() % 20, "%")
    rating = pick(["a", "b", "c", "d"], _id() % 4)
    rating = F.when(rating == "a", _say('<i class="item-user-info-label--1">来自上海</i><i class="item-user-info-label--1">', rated, "</i>")).when(rating == "b", _say("<u>卖家 <s>", rated, "</s></u>")).when(rating == "c", _say("<div>", F.repeat(F.lit("长"), F.lit(60)), rated, "</div>")).otherwise("")
    listed = F.concat_ws("", F.transform(F.sequence(F.lit(0), (_id() % 5).cast("int")), lambda k: F.when(k > 0, _say('<li class="item-main-window-list-item"><img src="//p.example/', k, '"></li>'))))
    framed = F.lit('<div class="gallery-x"><span><img src="//g.example/1"><img data-src="http://g.example/2"></span></div><img src="//other">')
    hosted = F.lit('<div class="swiper"><img><img src=""></div><img data-src="https://x.alicdn.com/only">')
    described = F.concat(_say('<div class="desc-a">short ', _id(), "</div>"), F.when(_id() % 2 == 0, _say('<p class="item-desc"> ', _LONG, "\n ", _id(), "</p>")).otherwise(""))
    labels = F.when(_id() % 3 == 0, _say('<ul class="labels-1"><li>品牌 Apple </li><li>版本 海外有锁 ', _id(), "</li></ul>")).when(_id() % 3 == 1, "<section><div>版本</div><div>品牌 A <b>版本 国行</b></div></section>").otherwise("")
    html = captured(spark, sf_dir, rating, F.when(_id() % 3 == 0, listed).when(_id() % 3 == 1, framed).otherwise(hosted), described, labels)
    found = market.details(html)
    return found.withColumn("pictures", F.concat(F.lit("["), F.concat_ws(", ", "pictures"), F.lit("]"))).withColumn("pictures", F.when(F.col("pictures") != "[]", F.col("pictures")))


def _unlike(name: Column | str) -> Column:
    """An element of text without marks around it, as cards hold it."""
    return _say("<div><span>", name, "</span></div>")


@query(
    "S07",
    """WITH rows AS (SELECT page_id, n FROM pages, range(4) t(n) WHERE n <> 1)
    SELECT page_id, CAST(n - CASE WHEN n > 1 THEN 1 ELSE 0 END AS INT) AS place, ['iPhone ' || page_id || ' Pro', NULL, 'Galaxy S24 Ultra', 'Outro'][n + 1] AS title, [1000.5 + page_id % 900, NULL, page_id % 90 + 10, 7][n + 1]::DOUBLE AS euros,
      CASE n WHEN 0 THEN 'good' WHEN 2 THEN ['new', 'excellent'][page_id % 2 + 1] ELSE 'very_good' END AS condition, CASE n WHEN 0 THEN 'Vila ' || chr(65 + (page_id % 26)::INT) || ' -' WHEN 2 THEN 'Porto' ELSE 'Portugal' END AS location,
      CASE n WHEN 0 THEN 'https://o/d/anuncio/' || page_id WHEN 2 THEN 'https://o/any' END AS url FROM rows""",
)
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a used-goods site: price, condition and place from their text, one card without a price between them."""
    card = lambda *parts: _say('<div data-cy="l-card">', *parts, "</div>")
    thousands = F.lpad((_id() % 900).cast("string"), 3, "0")
    letter = F.char(F.lit(65) + _id() % 26)
    blocks = [
        card('<a href="/x"></a><a href="/d/anuncio/', _id(), '"><h4>iPhone ', _id(), " Pro</h4></a>", _unlike(_say("1.", thousands, ",50 €")), " Usado Vila ", letter, " - 12 de maio"),
        card("<h6>No price</h6> Novo"),
        card('<a href="/any">x</a><h6> Galaxy S24 Ultra </h6>', _unlike(_say(_id() % 90 + 10, " €")), F.when(_id() % 2 == 0, "Novo").otherwise("Como novo"), " Porto 3 de maio"),
        card("<h4>Outro</h4>7 €"),
    ]
    return goods.used_goods(captured(spark, sf_dir, *blocks), goods.OLX, "https://o").drop("brand")


@query(
    "S08",
    """SELECT page_id, CAST(n AS INT) AS place, CASE n WHEN 0 THEN 'Samsung ' || page_id || ' x' ELSE 'sem título ' || page_id || ' por 20 €' END AS title, CASE n WHEN 0 THEN page_id % 500 + 1.0 ELSE 20.0 END AS euros, CASE n WHEN 0 THEN 'good' ELSE 'very_good' END AS condition,
      CASE n WHEN 0 THEN 'Samsung' ELSE 'Unknown' END AS brand, CASE n WHEN 0 THEN 'https://v/items/' || page_id END AS url FROM pages, range(2) t(n)""",
)
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the other used-goods site, told by the first of five rules that any element fits; one without a title is named by its text."""
    rule = pick(['class="x feed-grid__item y"', 'class="a-ItemBox"', 'class="item-box__z"', 'data-testid="catalog-item"', 'class="u-word-break"'], _id() % 5)
    later = F.when(_id() % 5 < 4, '<div class="u-word-break"><h3>later rule</h3>9 €</div>').otherwise("")
    one = _say("<div ", rule, '><p class="t-title"> Samsung ', _id(), " x</p><b>", _id() % 500 + 1, ' €</b> Bom estado<a href="/items/', _id(), '"></a></div>')
    two = _say("<div ", rule, "><i>sem título ", _id(), "</i> por 20 €</div>")
    return goods.used_goods(captured(spark, sf_dir, later, one, two), goods.VINTED, "https://v").drop("location")


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages a scan."""
    return table(spark, sf_dir, "pages").select("page_id", F.floor(_id() / 4).alias("scan"), (_id() % 4 + 1).alias("round"))


#: Three products on each page; titles come again on later pages, and pages 3 of every third scan bring nothing new.
_FOUND = """WITH items AS (SELECT page_id // 4 AS scan, page_id % 4 + 1 AS round, n, CASE WHEN n = 2 THEN 'Capa iPhone 15 Pro ' || page_id ELSE 'iPhone 15 Pro loja ' || CASE WHEN page_id // 4 % 3 = 0 AND page_id % 4 = 2 THEN 0 ELSE (page_id % 4 * 2 + n) // 2 * 2 + n END END AS title,
    CASE WHEN n = 1 AND page_id % 5 = 0 THEN 50 ELSE 500 + page_id % 100 END + 0.5 AS euros, page_id FROM pages, range(3) t(n) WHERE {where}),
  first AS (SELECT * FROM items WHERE n < 2 AND euros >= 100 QUALIFY row_number() OVER (PARTITION BY scan, title ORDER BY round, n) = 1),
  ended AS (SELECT page_id // 4 AS scan, min(page_id % 4 + 1) AS round FROM pages WHERE NOT EXISTS (SELECT 1 FROM first WHERE first.page_id = pages.page_id) GROUP BY 1)
  SELECT first.scan, '{name}-live-' || (row_number() OVER (PARTITION BY first.scan ORDER BY first.round, n) - 1) AS offer, title, euros, {more} 'new' AS condition, true AS retail FROM first LEFT JOIN ended ON ended.scan = first.scan WHERE ended.round IS NULL OR first.round < ended.round"""


def _product(n: int) -> tuple[Column, Column]:
    shown = _id() % 4 * 2 + n
    number = F.when((F.floor(_id() / 4) % 3 == 0) & (_id() % 4 == 2), 0).otherwise(F.floor(shown / 2) * 2 + n)
    title = _say("Capa iPhone 15 Pro ", _id()) if n == 2 else _say("iPhone 15 Pro loja ", number)
    return title, (F.when(_id() % 5 == 0, 50).otherwise(500 + _id() % 100) if n == 1 else 500 + _id() % 100)


@query("S10", _FOUND.format(where="true", name="kuantokusta", more="'s' || n AS vendor,"))
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New devices of a price comparison, from each scan's pages: first titles, no accessories, until a page brings nothing new."""
    item = lambda n: _say('{"name":"', _product(n)[0], '","price":', _product(n)[1], f'.5,"store":"s{n}","url":"/p"}}')
    embedded = F.concat(F.lit('<script id="__NEXT_DATA__">{"props":{"pageProps":{"products":['), F.concat_ws(",", *map(item, range(3))), F.lit("]}}}</script>"))
    rows = pages.listed_products(captured(spark, sf_dir, embedded), "https://k").withColumnRenamed("price", "euros").drop("way", "url")
    found = goods.retail_offers(_scans(spark, sf_dir), rows, "iPhone 15 Pro", "kuantokusta", F.col("store"))
    return found.drop("store")


@query("S12", _FOUND.format(where="page_id % 8 <> 5", name="amazon", more="CASE WHEN n = 0 THEN 'Amazon Prime' ELSE 'Amazon' END AS vendor,"))
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New devices of a shop, from pages of which some hold a check for robots instead of results."""
    block = lambda n: _say('<div data-component-type="s-search-result"><h2><span>', _product(n)[0], "</span></h2>", _product(n)[1], ",50 €", " prime" if n == 0 else "", "</div>")
    html = captured(spark, sf_dir, F.when(_id() % 8 == 5, "<p>Robot Check: enter the characters</p>").otherwise(""), *map(block, range(3)))
    rows = pages.cards(html.where(~goods.looks_blocked(F.col("html"))), "https://a")
    found = goods.retail_offers(_scans(spark, sf_dir), rows, "iPhone 15 Pro", "amazon", F.when(F.col("prime"), "Amazon Prime").otherwise("Amazon"))
    return found.drop("prime", "url")


@query("L04", "SELECT page_id, kind, CAST(CASE kind WHEN 'products' THEN page_id % 80 + 30 WHEN 'pasted' THEN least(60, page_id % 80 + 30) WHEN 'all' THEN page_id % 80 + 30 ELSE least(50, page_id % 80 + 30) END AS BIGINT) AS n FROM pages, (VALUES ('results'), ('cards'), ('pairs'), ('pasted'), ('products'), ('all')) k(kind)")
def l04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each parser gives of pages that hold 30 to 109, with its limit and without."""
    each = lambda made: captured(spark, sf_dir, F.concat_ws("", F.transform(F.sequence(F.lit(1), (_id() % 80 + 30).cast("int")), made)))
    say = lambda *parts: lambda k: F.concat(*[F.lit(p) if isinstance(p, str) else k.cast("string") for p in parts])
    products = captured(spark, sf_dir, F.lit('<script id="__NEXT_DATA__">{"props":{"pageProps":{"products":['), F.concat_ws(",", F.transform(F.sequence(F.lit(1), (_id() % 80 + 30).cast("int")), say('{"name":"n', 0, '","price":', 0, "}"))), F.lit("]}}}</script>"))
    results = each(say('{"title":"t', 0, '","price":"', 0, '","desc":"d","pic":"p"}'))
    found = {
        "results": pages.search_results(results), "all": pages.search_results(results, most=None), "products": pages.products(products, "https://k"), "pairs": pages.proximity_pairs(each(say("<h2>t", 0, "</h2> 1", 0, " €"))),
        "cards": pages.cards(each(say('<i data-component-type="s-search-result"><h2><span>title ', 0, "</span></h2> 1", 0, " €"))), "pasted": pages.pasted(each(say('<p class="item-card"><b>title ', 0, "</b>¥ 1", 0, "</p>"))),
    }
    all_ = None
    for kind, rows in found.items():
        n = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).select("page_id", F.lit(kind).alias("kind"), "n")
        all_ = n if all_ is None else all_.unionByName(n)
    return all_
