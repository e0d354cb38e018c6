"""Secret scans through a trigram inverted index.

A Boolean trigram query is derived from each rule's regular expression: every match must hold these trigrams. The
index has a posting (trigram, doc_id) for every document that holds a trigram of some rule's query. A rule's
candidates are what is left of its postings after intersecting and uniting them; only candidates are searched with
the rule. Rules without mandatory trigrams search every document. All of it is DataFrame and SQL work.

Case is folded in the index (A-Z and a-z are one there), which can only add candidates.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.functions.folds import let, running
from parcelmint.llm.common import durable, small, table, veiled


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its matches, leftmost and not overlapping; those whose group is shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base scan.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: A trigram query is None (no mandatory trigram) or alternatives, each a set of trigrams that must all be there.
Query = frozenset[frozenset[str]] | None
_MOST = 32


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    both = frozenset(x | y for x in a for y in b)
    return both if len(both) <= _MOST else min(a, b, key=len)


def _grams(strings: frozenset[str]) -> Query:
    if min(map(len, strings)) < 3:
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _concat(parts: list[tuple[frozenset[str] | None, Query]]) -> tuple[frozenset[str] | None, Query]:
    """Exact strings are multiplied out while they are few; where they end, their trigrams become mandatory."""
    exact, whole, query = frozenset({""}), True, None
    for strings, q in parts:
        if strings is not None and len(exact) * len(strings) <= _MOST:
            exact = frozenset(a + b for a in exact for b in strings)
            continue
        query, whole = _and(_and(query, _grams(exact)), q if strings is None else _grams(strings)), False
        exact = frozenset({""}) if strings is None else strings
    return (exact, None) if whole else (None, _and(query, _grams(exact)))


def _walk(node: tuple) -> tuple[frozenset[str] | None, Query]:
    """What a piece of a regular expression matches: exactly these strings, or else a query that holds for its matches."""
    op, arg = node
    if op is sre.LITERAL:
        return frozenset({chr(arg).lower()}), None
    if op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
        return frozenset(chr(c).lower() for _, c in arg), None
    if op is sre.SUBPATTERN:
        return _concat([_walk(x) for x in arg[3]])
    if op is sre.BRANCH:
        found = [_concat([_walk(x) for x in branch]) for branch in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= _MOST:
            return frozenset().union(*(s for s, _ in found)), None
        queries = [_grams(s) if s is not None else q for s, q in found]
        return None, None if None in queries else frozenset().union(*queries)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _concat([_walk(x) for x in inner])
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, None
        if least == most == 1:
            return strings, query
        return None, None if least == 0 else (_grams(strings) if strings is not None else query)
    return None, None


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams, case folded, of which every match of the pattern holds one whole; None if there is none."""
    strings, query = _concat([_walk(x) for x in _parser.parse(pattern)])
    query = _grams(strings) if strings is not None else query
    return query and frozenset(x for x in query if not any(y < x for y in query))


def build_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings (trigram, doc_id), distinct, of the given trigrams over the whole texts of docs."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram")).distinct()


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, rules): documents in the intersection of postings of some rule's query, and the kinds of those rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    per_doc = postings.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    fits = []
    for kind, query in queries.items():
        if query is not None:
            wanted = [F.size(F.array_except(F.array(*map(F.lit, sorted(alternative))), "held")) == 0 for alternative in sorted(query, key=sorted)]
            test = wanted[0]
            for x in wanted[1:]:
                test = test | x
            fits.append(F.when(test, F.lit(kind)))
    return per_doc.select("doc_id", F.array_compact(F.array(*fits)).alias("rules")).where("size(rules) > 0")


_SPAN = "array<struct<start:bigint,end:bigint,order:int,kind:string>>"


def _spans(rule: Rule, order: int) -> Column:
    """The rule's spans in the column text: array of (start, end, order, kind), in code points."""
    whole, piece = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    gaps = F.split("text", rule.pattern, -1)
    found = F.arrays_zip(lengths(whole).alias("n"), lengths(piece).alias("m"), lengths(F.slice(gaps, F.lit(1), F.size(whole))).alias("gap"))

    def spans(found: Column) -> Column:
        before = running(F.transform(found, lambda x: x["gap"] + x["n"]), F.lit(0).cast("long"), lambda a, x: a + x)
        placed = F.zip_with(found, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), x["m"].alias("m")))
        return F.transform(F.filter(placed, lambda x: x["m"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["order"].alias("order"), x["kind"].alias("kind")))

    return F.when(F.rlike("text", F.lit(rule.pattern)), let(found, spans)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs (doc_id, text and any more) with spans: array of (start, end, order, kind), by start, then the rules' order.

    Null text is empty; rows with a null doc_id, which have no posting, are searched with every rule; rows that
    repeat are each searched; no rows give no rows; columns other than doc_id and text pass unread, whatever their
    names, but for one named spans, which is replaced.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() if q for alternative in q for t in alternative})
    docs, restored = veiled(docs.drop("spans"), "doc_id", "text")
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    out = docs
    if trigrams:
        hits = small(durable(candidates(build_index(docs, trigrams), rules))).withColumnsRenamed({"doc_id": "hit_id__", "rules": "hit_rules__"})
        out = docs.join(hits, F.col("doc_id") == F.col("hit_id__"), "left")
    found = []
    for order, rule in enumerate(rules):
        spans = _spans(rule, order)
        if queries[rule.kind] is not None:
            spans = F.when(F.col("doc_id").isNull() | F.coalesce(F.array_contains("hit_rules__", rule.kind), F.lit(False)), spans).otherwise(F.array().cast(_SPAN))
        found.append(spans)
    return restored(out, spans=F.array_sort(F.concat(*found)))


#: Characters of a piece of text that is cut at once.
_PIECE = 1024


def redact(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The rows of scan() with every span's characters replaced by the mask (overlapping spans by one), without spans.

    A character far into a text is reached by counting all before it, so the text is cut into pieces first.
    """

    def between(pieces: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _PIECE)
        some = F.array_join(F.slice(pieces, (first + 1).cast("int"), (F.floor(end / _PIECE) - first + 1).cast("int")), "")
        return F.substring(some, (start - first * _PIECE + 1).cast("int"), (end - start).cast("int"))

    def masked(pieces: Column) -> Column:
        def cut(reached: Column) -> Column:
            gap = lambda x, at: F.when(x["start"] >= at, F.concat(between(pieces, at, x["start"]), F.lit(mask))).otherwise(F.lit(""))
            return F.array_join(F.zip_with("spans", reached, gap), "")

        reached = running(F.transform("spans", lambda x: x["end"]), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
        return F.concat(let(reached, cut), between(pieces, F.array_max(F.transform("spans", lambda x: x["end"])), F.length("text").cast("long")))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return scanned.withColumn("text", F.when(F.size("spans") > 0, let(pieces, masked)).otherwise(F.col("text"))).drop("spans")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["order"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
