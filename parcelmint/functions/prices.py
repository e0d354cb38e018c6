"""Prices, conditions and addresses as they stand in offers and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmint.functions.compat import SPACES, cases, first, js_round


def euros(text: Column) -> Column:
    """The amount before the first euro sign: spaces and dots part thousands, a comma the cents."""
    found = first(text, rf"(\d[\d.{SPACES}]*(?:,\d{{1,2}})?)[{SPACES}]*€")
    return F.regexp_replace(F.regexp_replace(found, rf"[.{SPACES}]", ""), ",", ".").cast("double")


def amount(text: Column) -> Column:
    """A number with dots between thousands and a comma before cents."""
    return F.regexp_replace(F.regexp_replace(text, rf"[.{SPACES}]", ""), ",", ".").try_cast("double")


def source_price(text: Column, least: int = 50, most: int = 100_000) -> Column:
    """The amount after the first ¥, with its unit of thousands or ten thousands; null for a year or an implausible one."""
    rule = rf"¥[{SPACES}]*(\d[\d,]*(?:\.\d{{2}})?)(.?)"
    number = F.regexp_replace(first(text, rule), ",", "").cast("double")
    unit = F.regexp_extract(text, rule, 2)
    whole = js_round(number * F.when(unit == "万", 10_000).when(unit == "千", 1000).otherwise(1))
    return F.when((unit != "年") & whole.between(least, most), whole)


def card_condition(text: Column) -> Column:
    return cases([(F.contains(text, F.lit(t)), F.lit(v)) for t, v in (("Novo", "new"), ("Como novo", "excellent"), ("Usado", "good"))], F.lit("very_good"))


def location(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, rf"(?:Usado|Novo|Como novo)[{SPACES}]*(.+?)\d", 1)), F.lit("")), F.lit("Portugal"))


def brand(title: Column) -> Column:
    low = F.lower(title)
    has = lambda *words: F.rlike(low, F.lit("|".join(words)))
    rules = [(has("samsung", "galaxy"), "Samsung"), (has("xiaomi", "redmi", "poco"), "Xiaomi"), (has("dji"), "DJI"), (has("nintendo", "switch"), "Nintendo"), (has("xbox"), "Microsoft"), (has("sony", "playstation", "ps5"), "Sony"), (has("iphone", "ipad", "macbook", "apple watch", "airpods"), "Apple")]
    return cases([(t, F.lit(v)) for t, v in rules], F.lit("Unknown"))


def page_text(html: Column) -> Column:
    """A page's text: without scripts, styles and tags, white space collapsed."""
    s = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), f"[{SPACES}]+", " "))


def absolute(url: Column, base: str) -> Column:
    return F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).when(F.startswith(url, F.lit("/")), F.concat(F.lit(base), url)).otherwise(url)


def search_url(base: Column, query: Column, page: Column) -> Column:
    """A search address; spaces are %20, the page is named from the second on."""
    return F.concat(base, F.lit("?q="), F.regexp_replace(F.url_encode(query), r"\+", "%20"), F.when(page > 1, F.concat(F.lit("&page="), page.cast("string"))).otherwise(F.lit("")))


def _encoded(query: Column) -> Column:
    return F.regexp_replace(F.url_encode(query), r"\+", "%20")


#: How each site's search is asked: what comes before the query, whether the query is a slug, and what names a later page.
SEARCHES = {"olx": (True, "/?page="), "vinted": (False, "&page="), "kuantokusta": (False, "&page="), "amazon": (False, "&page=")}


def site_search_url(site: str, start: str, query: Column, page: Column) -> Column:
    """The address of a page of a site's search; start: the address up to the query. A slug is in lower case with hyphens for spaces, else the query is percent-encoded."""
    slug, more = SEARCHES[site]
    said = F.regexp_replace(F.lower(query), f"[{SPACES}]+", "-") if slug else _encoded(query)
    later = F.concat(F.lit(more), page.cast("string"))
    return F.concat(F.lit(start), said, F.when(page > 1, later).otherwise(F.lit("/" if slug else "")))


def source_search_url(start: str, query: Column, least: Column, most: Column) -> Column:
    """The address of the source's search for a query in its own words, with bounds of prices where they are above 0."""
    bound = lambda x, a, b: F.when(x > 0, F.concat(F.lit(f"&{a}="), x.cast("string"), F.lit(f"&{b}="), x.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit(start), _encoded(query), F.lit("&spm=a21ybx.search.searchInput.0"), bound(least, "minPrice", "startPrice"), bound(most, "maxPrice", "endPrice"))
