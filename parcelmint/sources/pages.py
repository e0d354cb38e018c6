"""Rows from captured pages: search results, product pages, cards, and titles paired with prices by their place."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmint.functions import prices
from parcelmint.functions.compat import SPACES

#: Rows that a page gives at most (a product list gives all of its), and how far after a title its price may stand.
MOST_ROWS, MOST_TITLES, MOST_PRICES, REACH = 50, 100, 200, 1500


SPACE = r"\s*"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def _at_most(rows: Column, most: int | None) -> Column:
    return rows if most is None else F.slice(rows, F.lit(1), F.lit(most))


def search_results(pages: DataFrame, text: str = "html", most: int | None = MOST_ROWS) -> DataFrame:
    """(page_id, place, title, price, description, picture) of a result page's JSON: fields in the order of the page, rows without title or price left out before they are numbered; most: rows of a page, None for all."""
    field = lambda name: F.regexp_extract_all(text, F.lit(f'"{name}"{SPACE}:{SPACE}"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1))
    rows = F.arrays_zip(field("title").alias("title"), field("price").alias("price"), field("desc").alias("description"), field("pic").alias("picture"))
    kept = _at_most(F.filter(rows, lambda r: (r["title"] != "") & (F.coalesce(r["price"].try_cast("double"), F.lit(0.0)) > 0)), most)
    out = pages.select("page_id", F.posexplode(kept).alias("place", "r"))
    return out.select("page_id", "place", "r.title", F.col("r.price").cast("double").alias("price"), "r.description", prices.absolute(F.col("r.picture"), "https://").alias("picture"))


_PRODUCT = "array<struct<title:string,price:double,store:string,url:string>>"


def _embedded(html: Column, base: str) -> Column:
    """The rows of a page's embedded product list, found at one of three places, as _PRODUCT."""
    item = "array<struct<name:string,price:double,store:string,url:string>>"
    blob = F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    shape = f"props struct<pageProps:struct<products:{item},searchResults:struct<products:{item}>,results:{item}>>"
    found = F.from_json(blob, shape)["props"]["pageProps"]
    rows = F.coalesce(found["products"], found["searchResults"]["products"], found["results"])
    kept = F.filter(rows, lambda r: r["name"].isNotNull() & (r["price"] > 0))
    return F.transform(kept, lambda r: F.struct(r["name"].alias("title"), r["price"].alias("price"), r["store"].alias("store"), prices.absolute(r["url"], base).alias("url"))).cast(_PRODUCT)


def _unfolded(pages: DataFrame, rows: Column, *more: Column) -> DataFrame:
    """(page_id, place, the fields of rows, more) with a row for each of a page's rows."""
    return pages.select("page_id", *more, F.posexplode(rows).alias("place", "r")).select("page_id", "place", "r.*", *more)


def products(pages: DataFrame, base: str, text: str = "html") -> DataFrame:
    """(page_id, place, title, price, store, url) of a page's embedded product list, found at one of three places."""
    return _unfolded(pages, _embedded(F.col(text), base))


def _numeric(said: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(said, rf"[.{SPACES}]", ""), ",", ".").try_cast("double")


def cards(pages: DataFrame, base: str = "", text: str = "html", most: int | None = MOST_ROWS) -> DataFrame:
    """(page_id, place, title, euros, prime, url) of a retail result page, one for each result block with a title and a price; blocks without are left out before they are numbered. most: rows of a page, None for all.

    The title is the first span of 5 to 200 characters after the block's heading, else what the heading is labelled
    with; the address that of the link before this span, else of the first link to a product. A page without any
    such block gives its headings' spans paired with prices by their place.
    """

    def read(card: Column) -> Column:
        rest = F.regexp_extract(card, r"(?s)<h2[^>]*>(.*)", 1)
        span = r"<span[^>]*>([^<]{5,200})</span>"
        before = F.regexp_extract(rest, rf"(?s)^(.*?){span}", 1)
        named = lambda t: F.nullif(trimmed(t), F.lit(""))
        title = F.coalesce(named(F.regexp_extract(rest, span, 1)), named(F.regexp_extract(card, r'<h2[^>]*aria-label="([^"]{5,200})"', 1)))
        href = F.coalesce(named(F.regexp_extract(before, r'<a[^>]+href="([^"]+)"[^>]*>', 1)), named(F.regexp_extract(card, r'href="(/[^"]*/dp/[^"]+)"', 1)))
        number = rf"(\d[\d.{SPACES}]*(?:,\d{{1,2}})?)"
        ahead, behind = (_numeric(F.regexp_extract(card, rule, 1)) for rule in (rf"{number}[{SPACES}]*€", rf"€[{SPACES}]*{number}"))
        amount = F.coalesce(F.nullif(ahead, F.lit(0.0)), behind)
        return F.struct(F.left(title, F.lit(120)).alias("title"), amount.alias("euros"), F.contains(F.lower(card), F.lit("prime")).alias("prime"), prices.absolute(href, base).alias("url"))

    blocks = F.split(text, 'data-component-type="s-search-result"')
    rows = F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), read)
    kept = pages.select("page_id", F.col(text).alias("html"), F.coalesce(_at_most(F.filter(rows, lambda r: r["title"].isNotNull() & (r["euros"] > 0)), most), F.array()).alias("kept"))
    near = paired(F.when(F.size("kept") == 0, F.col("html")), spans_in_headings, base=base, most=most)
    near = F.transform(near, lambda r: F.struct(r["title"].alias("title"), r["euros"].alias("euros"), F.lit(False).alias("prime"), r["url"].alias("url")))
    return _unfolded(kept.withColumn("near", near), F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("near")))


#: Fixed value: a link to a product, its title and the price after it.
PRODUCT_LINK = r'href="(/produto/[^"]+)"[^>]*>([^<]{5,120})</a>[\s\S]{0,500}?(\d[\d\s.\u00A0]*(?:,\d{1,2})?)\s*€'


def _linked(html: Column, base: str, most: int | None) -> Column:
    """The rows of links to products that a price follows, as _PRODUCT."""
    part = lambda k: F.regexp_extract_all(html, F.lit(PRODUCT_LINK), F.lit(k))
    found = F.arrays_zip(part(1).alias("url"), part(2).alias("title"), part(3).alias("price"))
    rows = F.transform(found, lambda r: F.struct(F.trim(r["title"]).alias("title"), prices.amount(r["price"]).alias("price"), F.lit("Loja").alias("store"), F.concat(F.lit(base), r["url"]).alias("url")))
    return _at_most(F.filter(rows, lambda r: (r["title"] != "") & (r["price"] > 0) & (r["price"] <= 10_000)), most).cast(_PRODUCT)


def anchors(pages: DataFrame, base: str, text: str = "html", most: int | None = MOST_ROWS) -> DataFrame:
    """(page_id, place, title, price, store, url) of links to products that a price follows; most: rows of a page, None for all."""
    return _unfolded(pages, _linked(F.col(text), base, most))


def listed_products(pages: DataFrame, base: str, text: str = "html", most: int | None = MOST_ROWS) -> DataFrame:
    """(page_id, place, title, price, store, url, way) of a page by the first of three ways that finds anything: its embedded list, links with prices, headings and links near prices (J8). most: rows of a page by the latter two, None for all.

    Each page is read once; only a page that the first two ways find nothing in goes to the third.
    """
    some = lambda c: F.coalesce(c, F.array().cast(_PRODUCT))
    read = pages.select("page_id", F.col(text).alias("html"), some(_embedded(F.col(text), base)).alias("one"), some(_linked(F.col(text), base, most)).alias("two"))
    way = F.when(F.size("one") > 0, 1).when(F.size("two") > 0, 2).otherwise(3)
    near = paired(F.when(way == 3, F.col("html")), headings_and_links, base=base, most=most)
    near = F.transform(near, lambda r: F.struct(r["title"].alias("title"), r["euros"].alias("price"), F.lit("Loja").alias("store"), r["url"].alias("url"))).cast(_PRODUCT)
    read = read.select("page_id", "one", "two", near.alias("three"), way.alias("way"))
    rows = F.when(F.col("way") == 1, F.col("one")).when(F.col("way") == 2, F.col("two")).otherwise(F.col("three"))
    return _unfolded(read, rows, F.col("way"))


#: How a page says that nothing was found, and what only pages of results have.
NOTHING_FOUND = ["没有找到你想要的宝贝", "猜你喜欢", "为你推荐"]
PAGINATION = r"<button[^>]*class=['\"][^'\"]*search-pagination-arrow"


def says_nothing_found(html: Column) -> Column:
    """Whether a page's text says that nothing was found, or recommends other things, and the page has no pagination."""
    return F.rlike(prices.page_text(html), F.lit("|".join(NOTHING_FOUND))) & ~F.rlike(html, F.lit(PAGINATION))


#: Fixed value: rows that a pasted page gives at most.
MOST_PASTED = 60


def pasted(pages: DataFrame, least: float = 0, most: float = 0, text: str = "html", rows: int | None = MOST_PASTED) -> DataFrame:
    """(page_id, place, title, price, description) of a page that someone pasted: of its JSON, else of its blocks with a price.

    A block begins at an element whose class names an item, a card or a search result. Its title is that of an
    element for titles, else its first text, else all of its text. least and most bound prices where they are
    above 0; rows: how many blocks of a page are read, None for all.
    """

    def read(block: Column) -> Column:
        price = F.regexp_replace(F.regexp_extract(block, r"¥\s*(\d[\d,]*(?:\.\d{1,2})?)", 1), ",", "").try_cast("double")
        clean = prices.page_text(block)
        named = F.regexp_extract(block, r'(?i)<[^>]+class="[^"]*(?:title|name|header)[^"]*"[^>]*>([^<]{4,120})</[^>]+>', 1)
        some = F.regexp_extract(block, r"<[^>]*>([^<]{4,120})</[^>]*>", 1)
        title = F.trim(F.coalesce(F.nullif(named, F.lit("")), F.nullif(some, F.lit("")), clean))
        return F.struct(title.alias("title"), price.alias("price"), F.left(clean, F.lit(500)).alias("description"))

    blocks = F.split(text, r'(?i)(?=<[^>]+class="[^"]*(?:item|card|search-result)[^"]*")')
    kept = F.filter(F.transform(blocks, read), lambda r: (r["price"] > 0) & (F.length(r["title"]) >= 3))
    kept = kept if rows is None else F.slice(kept, F.lit(1), F.lit(rows))
    loose = pages.select("page_id", F.posexplode(kept).alias("place", "r")).select("page_id", "place", "r.title", "r.price", "r.description")
    strict = search_results(pages, text).select("page_id", "place", "title", "price", "description")
    found = strict.unionByName(loose.join(strict.select("page_id").distinct(), "page_id", "left_anti"))
    found = found.where(F.col("price") >= least) if least > 0 else found
    return found.where(F.col("price") <= most) if most > 0 else found


def zipped(titles: Column, amounts: Column) -> Column:
    """Titles with the amounts at the same places, if there are as many of both; else nothing."""
    empty = F.array().cast("array<struct<title:string,amount:string>>")
    return F.when(F.size(titles) == F.size(amounts), F.arrays_zip(titles.alias("title"), amounts.alias("amount"))).otherwise(empty)


#: Prices as they stand in text, headings that hold a title, and what titles of the wider rule do not say.
_PRICE = re.compile(r"([0-9][0-9.\s]*(?:,[0-9]{1,2})?)\s*€")
_HEADING = re.compile(r"<h2[^>]*>([^<]+)</h2>")
_HEADING_OR_LINK = re.compile(r"<(?:h2|h3|a)([^>]*)>([^<]{5,120})</(?:h2|h3|a)>")
_NAVIGATION = ("Pesquisa", "Início")


def headings(html: str) -> Iterator[tuple[int, str, str]]:
    """(place, title, address) of second headings that hold nothing but text."""
    return ((m.start(), m[1], "") for m in _HEADING.finditer(html))


def headings_and_links(html: str) -> Iterator[tuple[int, str, str]]:
    """Of second and third headings and links with 5 to 120 characters, more than 5 without space around, none of navigation."""
    for m in _HEADING_OR_LINK.finditer(html):
        if len(m[2].strip()) > 5 and not any(w in m[2] for w in _NAVIGATION):
            href = re.search(r'href="([^"]+)"', m[1])
            yield m.start(), m[2].strip(), href[1] if href and href[1].startswith(("/", "http")) else ""


_SPAN = re.compile(r'<span[^>]*class="[^"]*a-text-normal[^"]*"[^>]*>([^<]{5,200})</span>')
_ANY_HEADING, _LINK = re.compile(r"<h2[^>]*>"), re.compile(r'<a[^>]+href="([^"]+)"[^>]*>')


def spans_in_headings(html: str) -> Iterator[tuple[int, str, str]]:
    """Of second headings: the next span for titles after each, and the first link between the two."""
    at = 0
    while (heading := _ANY_HEADING.search(html, at)) and (span := _SPAN.search(html, heading.end())):
        link = _LINK.search(html, heading.end(), span.start())
        yield heading.start(), span[1].strip(), link[1] if link else ""
        at = span.end()


def merged(titles: Iterator[tuple[int, str, str]], amounts: list[tuple[int, float]], reach: int, most: int | None) -> Iterator[tuple[str, str, float]]:
    """Each title with the next price at or after it that is not taken, if it stands within reach of the title's end; both in order, one pass.

    A title whose next price is out of reach is left out and leaves the price to a later one.
    """
    k = found = 0
    for place, title, href in titles:
        while k < len(amounts) and amounts[k][0] < place:
            k += 1
        if k == len(amounts) or (most is not None and found >= most):
            return
        if amounts[k][0] - (place + len(title)) <= reach:
            yield title, href, amounts[k][1]
            k, found = k + 1, found + 1


def amounts_in(html: str, most: int | None) -> list[tuple[int, float]]:
    """(place, euros) of the first `most` prices above 1 and up to 10,000; others do not count."""
    said = ((m.start(), float(re.sub(r"[.\s]", "", m[1]).replace(",", "."))) for m in _PRICE.finditer(html))
    return list(islice(((k, x) for k, x in said if 1 < x <= 10_000), most))


def paired(html: Column, titles: Callable[[str], Iterator[tuple[int, str, str]]] = headings, base: str = "", most_titles: int | None = MOST_TITLES, most_prices: int | None = MOST_PRICES, most: int | None = MOST_ROWS, reach: int = REACH) -> Column:
    """Titles of a page paired with the prices after them, in order: (title, url, euros). None for no limit; a null page has none."""

    @F.arrow_udf("array<struct<title:string,url:string,euros:double>>")
    def pair(pages: pa.Array) -> pa.Array:
        out = []
        for html in pages.to_pylist():
            found = merged(islice(titles(html), most_titles), amounts_in(html, most_prices), reach, most) if html else []
            out.append([{"title": t[:120], "url": base + u if u.startswith("/") else u or None, "euros": x} for t, u, x in found])
        return pa.array(out, pa.list_(pa.struct([("title", pa.string()), ("url", pa.string()), ("euros", pa.float64())])))

    return pair(html)


def proximity_pairs(pages: DataFrame, text: str = "html", titles: Callable[[str], Iterator[tuple[int, str, str]]] = headings, **limits: int | None) -> DataFrame:
    """(page_id, place, title, euros) of a page's titles and the prices after them; limits: as of paired()."""
    return _unfolded(pages, paired(F.col(text), titles, **limits)).select("page_id", "place", F.trim("title").alias("title"), "euros")
