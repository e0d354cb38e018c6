"""URL filters: rules for hosts and paths, and link-graph propagation for the hosts that no rule fits.

Trust is a personalised PageRank over host links from the hosts that rules allow; distrust is one over the same
links reversed, from the hosts that rules block: who links to bad hosts is suspect. A host whose distrust exceeds
its trust by a factor is blocked. All of it is DataFrame and SQL work on a table of hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.llm.common import durable, small, table

#: Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<(?:a|area|link)\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, A-Z lower-cased; empty for null or without ://."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def best_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits the columns host and path, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts: links with a host in the html of pages (host, html), with or without a scheme, counted."""
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("url"))
    url = F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), F.col("url"))).otherwise(F.col("url"))
    found = found.select("src", host_of(url).alias("dst")).where("dst <> '' and dst <> src")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(links: DataFrame, seeds: DataFrame, settled: float = 1e-6, damping: float = 0.85, every: int = 4) -> DataFrame:
    """(side, host, score): PageRank on both sides at once. links (src, dst, links); seeds (side, host, weight), sides trust and distrust.

    Trust runs along the links, distrust against them; a side's seeds' weights are scaled to 1. A host's score is
    shared out by its numbers of links; what a host without links holds is not passed on. Rounds go on until `every` of
    them reach no new host and change the scores by at most `settled` in sum; the scores are written so often.
    """
    edges = links.select(F.lit("trust").alias("side"), "src", "dst", "links").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "links"))
    edges = durable(edges.join(edges.groupBy("side", "src").agg(F.sum("links").alias("all_links")), ["side", "src"]).select("side", "src", "dst", (F.col("links") / F.col("all_links")).alias("share")))
    whole = seeds.groupBy("side").agg(F.sum("weight").alias("whole"))
    start = durable(seeds.join(whole, "side").select("side", "host", (F.col("weight") / F.col("whole")).alias("score")))
    if edges.limit(1).count() == 0:
        return start
    score = start
    while True:
        old = score.withColumnRenamed("score", "was")
        for _ in range(every):
            passed = score.withColumnRenamed("host", "src").join(edges, ["side", "src"]).select("side", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            score = passed.union(start.select("side", "host", F.col("score") * (1 - damping))).groupBy("side", "host").agg(F.sum("score").alias("score"))
        score = durable(score)
        change = F.sum(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0)))).alias("change")
        step = score.join(old, ["side", "host"], "left").agg(change, F.count_if(F.col("was").isNull()).alias("reached")).first()
        if not step["reached"] and (step["change"] or 0.0) <= settled:
            return score


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, factor: float = 1.0, settled: float = 1e-6) -> DataFrame:
    """One row for each page (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    Seeds: hosts of pages that a rule decides, weighted by those pages. A page that no rule decides is blocked if
    its host's distrust exceeds factor times its trust, else allowed; hosts that no seed reaches are allowed.

    Null urls and urls without :// have an empty host and path, no rule and verdict allow; null html has no links;
    rows that repeat are judged each and count each; no rows give no rows; other columns are ignored.
    """
    rule, verdict = best_rule(rules)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule).withColumn("verdict", verdict)
    links = durable(host_links(pages.select(host_of(F.col("url")).alias("host"), "html")))
    side = F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("side")
    seeds = rows.where("verdict is not null").groupBy(side, "host").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    score = propagate(links, seeds, settled)
    hosts = durable(score.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("score"))), F.lit(0.0)).alias(s) for s in ("trust", "distrust")]))
    out = rows.join(small(hosts), "host", "left")
    trust, distrust = (F.coalesce(s, F.lit(0.0)) for s in ("trust", "distrust"))
    judged = F.coalesce("verdict", F.when(distrust > trust * factor, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", judged.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
