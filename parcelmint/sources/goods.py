"""Offers of the four shops where goods are sold again: what cards of the used-goods sites say, and the chain from pages to offers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmint.functions import prices, relevance
from parcelmint.functions.compat import SPACES, cases
from parcelmint.sources.elements import has_class, inside, said, trees
from parcelmint.sources.pages import trimmed


@dataclass(frozen=True)
class Site:
    """How a used-goods site's cards are told (the first rule that any element fits), titled and linked, and what names a good condition."""

    cards: tuple[Callable[[Column], Column], ...]
    titled: Callable[[Column], Column]
    links: tuple[str, ...]
    good: str
    whole_text: bool


_data = lambda name: lambda n: F.coalesce(n["data"] == name, F.lit(False))
_class = lambda word: lambda n: has_class(n, word)
#: The cards of the two sites.
OLX = Site((_data("l-card"),), lambda n: n["tag"].isin("h4", "h6"), ("/d/anuncio/", "/d/"), "Usado", False)
VINTED = Site((_class("feed-grid__item"), _class("ItemBox"), _class("item-box"), _data("catalog-item"), _class("u-word-break")), lambda n: n["tag"].isin("a", "h3", "h4") | has_class(n, "title"), ("/items/",), "Bom estado", True)


def used_goods(pages: DataFrame, site: Site, base: str, text: str = "html") -> DataFrame:
    """(page_id, place, title, euros, condition, location, brand, url) of the cards of a used-goods site that have a title and a price.

    All else is read from a card's unmarked text by the order in which it appears: the first amount before a euro
    sign, the place after the word for a condition. Where the site's cards may lack a title, their first 80
    characters are one. A null page gives no rows.
    """
    first = lambda a: F.try_element_at(a, F.lit(1))
    tree = trees(pages, text)
    found = F.array().cast(tree.schema["nodes"].dataType)
    for rule in reversed(site.cards):
        some = F.filter("nodes", rule)
        found = F.when(F.size(some) > 0, some).otherwise(found)

    def read(card: Column) -> Column:
        whole = F.trim(F.regexp_replace(said(card), f"[{SPACES}]+", " "))
        inner = inside(card)
        named = F.nullif(trimmed(said(first(F.filter(inner, site.titled)))), F.lit(""))
        title = F.coalesce(named, F.nullif(F.left(whole, F.lit(80)), F.lit(""))) if site.whole_text else named
        linked = F.filter(inner, lambda n: (n["tag"] == "a") & n["href"].isNotNull())
        direct = F.filter(linked, lambda n: F.rlike(n["href"], F.lit("|".join(site.links))))
        condition = cases([(F.contains(whole, F.lit(t)), F.lit(v)) for t, v in (("Novo", "new"), ("Como novo", "excellent"), (site.good, "good"))], F.lit("very_good"))
        return F.struct(
            F.left(title, F.lit(120)).alias("title"), prices.euros(whole).alias("euros"), condition.alias("condition"), (F.lit("Portugal") if site.whole_text else prices.location(whole)).alias("location"),
            prices.brand(title).alias("brand"), prices.absolute(F.coalesce(first(direct), first(linked))["href"], base).alias("url"),
        )

    rows = F.filter(F.transform(found, read), lambda r: r["title"].isNotNull() & (r["euros"] > 0))
    return tree.select("page_id", F.posexplode(rows).alias("place", "r")).select("page_id", "place", "r.*")


#: Fixed value: what a page says that holds a check for robots in place of results.
BLOCKED = r"(?i)sentimos|lo sentimos|captcha|robot check|enter the characters|escribe los caracteres"
#: Which sources sell used goods and which new ones.
USED, RETAIL = ("olx", "vinted"), ("kuantokusta", "amazon")
#: The least and the greatest price of a device in euros.
LEAST, MOST = 100, 3000


def looks_blocked(html: Column) -> Column:
    return F.rlike(prices.page_text(html), F.lit(BLOCKED))


def until_empty(rounds: DataFrame, rows: DataFrame, by: list[str], empty: int = 1) -> DataFrame:
    """rows (by, round, ...) of the rounds before so many in a row that bring none; rounds (by, round): all that were made, from 1 on.

    Rows of a round that was not made do not count.
    """
    n = rows.groupBy(*by, "round").agg(F.count(F.lit(1)).alias("n_"))
    told = rounds.select(*by, "round").distinct().join(n, [*by, "round"], "left")
    before = Window.partitionBy(*by).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.max(F.when(F.col("n_") > 0, F.col("round"))).over(before), F.lit(0))
    ended = F.max((F.col("round") - last >= empty).cast("int")).over(before)
    return rows.join(told.withColumn("ended_", ended).where("ended_ = 0").select(*by, "round"), [*by, "round"], "left_semi")


def offers_found(pages: DataFrame, rows: DataFrame, query: str, platform: str, by: str = "scan") -> DataFrame:
    """(scan, offer, title, euros, and what else rows have) of a scan's pages for a query, as offers of a platform.

    pages: (scan, round, page_id), the pages of each scan in order; rows: what their parser found. A title counts once,
    where it is first seen; accessories, titles that do not fit the query and implausible prices go; a page that
    brings nothing new ends its scan. Offers are numbered in the order in which they were found.
    """
    fits = F.col("euros").between(LEAST, MOST) & ~relevance.is_accessory(F.col("title")) & relevance.is_relevant(F.col("title"), query)
    kept = rows.where(F.coalesce(fits, F.lit(False))).join(pages.select(by, "round", "page_id"), "page_id")
    first = first_titles(kept, [by], ["round", "place"])
    found = until_empty(pages, first, [by])
    number = F.row_number().over(Window.partitionBy(by).orderBy("round", "place")) - 1
    extra = [c for c in rows.columns if c not in ("page_id", "place", "title", "euros")]
    return found.select(by, F.concat(F.lit(f"{platform}-live-"), number.cast("string")).alias("offer"), "title", "euros", *extra)


def retail_offers(pages: DataFrame, rows: DataFrame, query: str, platform: str, vendor: Column) -> DataFrame:
    """offers_found() of a shop that sells new devices: condition new, retail, and the vendor's kind."""
    found = offers_found(pages, rows, query, platform)
    return found.withColumns({"condition": F.lit("new"), "retail": F.lit(True), "vendor": vendor})


def asked(offers: DataFrame, skipped: tuple[str, ...] = (), used: bool = True, retail: bool = True) -> DataFrame:
    """The offers of the sources that a scan asks: without those that are skipped, and without all of a kind that is switched off, whatever a source's own switch says."""
    out = [*skipped, *(() if used else USED), *(() if retail else RETAIL)]
    return offers.where(~F.col("platform").isin(out)) if out else offers


def first_titles(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with each title of a group once, where it is first seen."""
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy(*by, "title").orderBy(*order))).where("r_ = 1").drop("r_")
