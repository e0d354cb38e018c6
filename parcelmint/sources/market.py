"""What pages of the source marketplace say: cards of a result page, and a listing's own page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmint.functions import prices
from parcelmint.functions.compat import SPACES
from parcelmint.sources.elements import has_class, inside, own_pieces, said, trees
from parcelmint.sources.pages import says_nothing_found, trimmed

#: What the classes of a card's title and price hold, how far up a card is looked for, and plausible prices.
TITLE, PRICE, CARD_LEVELS, TEXT_LEVEL, LEAST, MOST = "main-title", "row3-wrap-price", 6, 3, 50, 100_000

_first = lambda a: F.try_element_at(a, F.lit(1))
_flat = lambda t: F.trim(F.regexp_replace(t, f"[{SPACES}]+", " "))


def _amount(text: Column) -> Column:
    return prices.source_price(text, 0, 10**15)


def _price_of(node: Column) -> Column:
    """The amount that a price element says: in a child of its own, else in its own text, else in all of its text."""
    marked = lambda texts: _first(F.filter(F.transform(F.filter(texts, lambda t: F.contains(t, F.lit("¥"))), _amount), lambda a: a.isNotNull()))
    children = F.transform(F.filter(inside(node), lambda c: c["parent"] == node["element"]), lambda c: said(c))
    return F.coalesce(marked(children), marked(own_pieces(node)), _amount(said(node)))


def _is_listing(href: Column) -> Column:
    return F.coalesce(F.rlike(href, F.lit("/item|/detail")), F.lit(False))


def cards(pages: DataFrame, base: str, least: float = 0, most: float = 0, text: str = "html") -> DataFrame:
    """(page_id, place, title, price, description, picture, href) of the cards of a result page.

    If a page has as many titles as prices, they belong together in their order (J7). A title without a plausible
    price there, or on a page where the numbers differ, takes that of the nearest of six elements around it that holds
    exactly one title and one price; one that holds several titles and a price ends the search. least, most: bounds of
    prices where they are above 0. Description, picture and link come from the third element around the title.
    A page that says that nothing was found gives no rows, nor does a null one.

    What lies below an element is summed by (page, element) from the paths of titles, prices, pictures and links, so
    the work grows with their number times their depth, not with its square.
    """
    tree = trees(pages, text).where(~F.coalesce(says_nothing_found(F.col("html")), F.lit(False)))
    is_title, is_price = lambda n: has_class(n, TITLE), lambda n: has_class(n, PRICE)
    marked = F.filter("nodes", lambda n: is_price(n) | (n["tag"] == "img") | ((n["tag"] == "a") & n["href"].isNotNull()) | is_title(n))
    facts = F.transform(marked, lambda n: F.struct(n["element"].alias("element"), n["path"].alias("path"), is_title(n).alias("is_title"), is_price(n).alias("is_price"), F.when(is_price(n), _price_of(n)).alias("amount"), (n["tag"] == "img").alias("is_img"), n["src"].alias("src"), F.when(n["tag"] == "a", n["href"]).alias("href")))
    below = tree.select("page_id", F.explode(facts).alias("n")).select("page_id", "n.*").withColumn("ancestor", F.explode("path"))
    at = lambda when, what: F.min(F.when(when, F.struct("element", F.col(what).alias("v"))))["v"]
    below = below.groupBy("page_id", "ancestor").agg(
        F.count_if("is_title").alias("titles"), F.count_if("is_price").alias("prices"), at(F.col("is_price"), "amount").alias("amount"), at(F.col("is_img"), "src").alias("src"),
        F.coalesce(at(_is_listing(F.col("href")), "href"), at(F.col("href").isNotNull(), "href")).alias("href"),
    )

    all_titles = F.filter("nodes", is_title)
    amounts = F.transform(F.filter("nodes", is_price), _price_of)

    def told(n: Column, k: Column) -> Column:
        card = F.get("nodes", F.get(n["path"], F.lit(TEXT_LEVEL - 1)))
        around = F.filter(F.concat(F.array(n["element"]), n["path"]), lambda i: (F.get("nodes", i)["tag"] == "a") & _is_listing(F.get("nodes", i)["href"]))
        return F.struct(
            n["element"].alias("element"), n["path"].alias("path"), F.left(trimmed(said(n)), F.lit(120)).alias("title"), F.left(_flat(said(card)), F.lit(500)).alias("description"),
            card["element"].alias("card"), F.get("nodes", _first(around))["href"].alias("closest"), F.when(F.size("amounts") == F.size("all_titles"), F.get("amounts", k)).alias("paired"),
        )

    arrays = tree.select("page_id", "text", "nodes", all_titles.alias("all_titles"), amounts.alias("amounts"))
    titles = arrays.select("page_id", F.explode(F.transform("all_titles", told)).alias("t")).select("page_id", "t.*")
    one = (F.col("titles") == 1) & (F.col("prices") == 1)
    ends = one | ((F.col("titles") > 1) & (F.col("prices") > 0))
    ups = titles.select("page_id", "element", F.posexplode(F.slice("path", 1, CARD_LEVELS)).alias("up", "ancestor")).join(below, ["page_id", "ancestor"])
    near = ups.groupBy("page_id", "element").agg(F.min(F.when(ends, F.struct("up", F.when(one, F.col("amount")).alias("v"))))["v"].alias("near"))
    plausible = lambda c: F.when(F.col(c).between(LEAST, MOST), F.col(c))
    found = titles.join(near, ["page_id", "element"], "left").withColumn("price", F.coalesce(plausible("paired"), plausible("near")))
    found = found.where(F.col("price").isNotNull() & (F.lit(least <= 0) | (F.col("price") >= least)) & (F.lit(most <= 0) | (F.col("price") <= most)))
    found = found.join(below.select("page_id", F.col("ancestor").alias("card"), "src", "href"), ["page_id", "card"], "left")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("element")) - 1
    return found.select("page_id", place.alias("place"), "title", "price", F.coalesce("description", F.lit("")).alias("description"), F.col("src").alias("picture"), prices.absolute(F.coalesce("closest", "href"), base).alias("href"))


_RATED = r"好评率\s*(\d+)"
_PICTURES = [["item-main-window", "main-image", "detail-image"], ["pic", "gallery", "slider", "carousel", "swiper"]]
_LABELS = ["labels", "spec", "params"]


def details(pages: DataFrame, text: str = "html") -> DataFrame:
    """(page_id, rating, images, pictures, description, labels) of listings' own pages, as results.enriched takes them.

    rating: the share of good reviews in the first label of the seller that tells it, else in the first element of
    under 50 characters, else anywhere. Pictures: the items of the picture list, else pictures in one of two kinds of
    frames. description: the longest text of an element for descriptions, of equal ones the first. labels: the first
    block of labels, else the first short element with both brand and version, that tells the version. What a page
    does not have is null, images 0.
    """
    rated = lambda t: F.nullif(F.regexp_extract(t, _RATED, 1), F.lit("")).try_cast("int")
    rating = lambda nodes: _first(F.filter(F.transform(nodes, lambda n: rated(said(n))), lambda r: r.isNotNull()))
    short = F.filter("nodes", lambda n: n["end"] - n["begin"] < 50)
    tells = F.rlike("text", F.lit(_RATED))
    items = F.filter("nodes", lambda n: has_class(n, "item-main-window-list-item"))
    within = lambda words: F.filter("nodes", lambda n: (n["tag"] == "img") & F.exists(n["path"], lambda i: has_class(F.get("nodes", i), *words)))
    shown = F.when(F.size(items) > 0, items)
    for other in map(within, _PICTURES):
        shown = F.coalesce(shown, F.when(F.size(other) > 0, other))
    source = lambda n: F.when(n["tag"] == "img", n["src"]).otherwise(_first(F.filter(inside(n), lambda c: c["tag"] == "img"))["src"])
    full = lambda s: F.when(F.startswith(s, F.lit("http")), s).otherwise(F.concat(F.lit("https:"), s))
    some = lambda found: F.transform(F.filter(found, lambda s: s.isNotNull() & (s != "")), full)
    hosted = F.transform(F.filter("nodes", lambda n: (n["tag"] == "img") & F.contains(n["src"], F.lit("alicdn.com"))), lambda n: n["src"])
    pictures = F.when(F.size(some(F.col("sources"))) > 0, some(F.col("sources"))).when(F.size("sources") > 0, some(hosted))
    described = F.transform(F.filter("nodes", lambda n: has_class(n, "desc")), lambda n: _flat(said(n)))
    longest = F.reduce(described, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    telling = lambda found, *words: _first(F.filter(F.transform(found, lambda n: _flat(said(n))), lambda t: (F.length(t) < 600) & F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))))
    blocks = telling(F.filter("nodes", lambda n: has_class(n, *_LABELS)), "版本")
    loose = telling(F.filter("nodes", lambda n: n["tag"].isin("div", "li", "span") & (n["end"] - n["begin"] < 6000)), "版本", "品牌")
    loose = F.when(F.contains("text", F.lit("版本")) & F.contains("text", F.lit("品牌")), loose)
    tree = trees(pages, text).withColumn("sources", F.coalesce(F.transform(shown, source), F.array().cast("array<string>")))
    return tree.select(
        "page_id", F.coalesce(rating(F.filter("nodes", lambda n: has_class(n, "item-user-info-label"))), F.when(tells, rating(short)), rated(prices.page_text(F.col("html")))).alias("rating"), F.size("sources").alias("images"),
        pictures.alias("pictures"), F.nullif(longest, F.lit("")).alias("description"), F.coalesce(blocks, loose).alias("labels"),
    )
