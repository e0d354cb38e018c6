"""How amounts, ages, times and a scan's progress are shown, independent of the locale that a machine has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmint.functions.compat import SPACES, cases
from parcelmint.functions.folds import let

_NBSP = "\u00a0"
#: Fixed value: months as British English shortens them.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sept Oct Nov Dec".split()


def _grouped(amount: Column, decimals: int) -> Column:
    """Digits with a comma between thousands and a point, halves away from zero; zero has no sign."""
    return F.format_number(F.round(F.abs(amount).cast("decimal(30,10)"), decimals), decimals)


def euros(amount: Column, decimals: int = 0) -> Column:
    """An amount as Portuguese writes it: thousands apart from five digits on, a comma, the sign after a space that does not break."""
    text = _grouped(amount, decimals)
    text = F.when(F.abs(F.round(amount.cast("decimal(30,10)"), decimals)) < 10_000, F.regexp_replace(text, ",", "")).otherwise(F.regexp_replace(text, ",", _NBSP))
    sign = F.when(amount < 0, "-").otherwise("")
    return F.concat(sign, F.regexp_replace(text, r"\.", ","), F.lit(f"{_NBSP}€"))


def yuan(amount: Column) -> Column:
    """An amount as Chinese writes it: commas between thousands, up to three decimals, none that are zero."""
    text = F.regexp_replace(_grouped(amount, 3), r"\.?0+$", "")
    return F.concat(F.lit("¥"), F.when(amount < 0, "-").otherwise(""), text)


def ago(then: Column, now: Column) -> Column:
    """How long ago: just now, then minutes, hours, days, each rounded down."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 60_000_000)
    hours = F.floor(minutes / 60)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, say(minutes, "m")).when(hours < 24, say(hours, "h")).otherwise(say(F.floor(hours / 24), "d"))


def time_labels(at: Column) -> Column:
    """(label, short): day, month and time of day, and the latter alone."""
    short = F.date_format(at, "HH:mm")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(at))
    return F.struct(F.concat_ws(" ", F.dayofmonth(at).cast("string"), month, short).alias("label"), short.alias("short"))


#: What colours a log's tag, by what it holds, and the sources whose progress a step tells.
TAGS = {"Goofish": "amber", "OLX": "teal", "Vinted": "cyan", "KuantoKusta": "blue", "Amazon": "orange", "Config": "purple", "Pipeline": "purple", "Forex": "emerald"}
SOURCES = ["Goofish", "OLX", "Vinted", "KuantoKusta", "Amazon"]


def log_parts(message: Column) -> Column:
    """(tag, rest, colour) of a log's message; one without a tag is all rest. A message of several lines has no tag."""
    whole = r"\A(\[[^\]]+\])[" + SPACES + r"]*([^\n\r]*)\z"
    tagged = F.rlike(message, F.lit(whole))
    tag = F.when(tagged, F.regexp_extract(message, whole, 1))
    colour = cases([(F.contains(tag, F.lit(t)), F.lit(c)) for t, c in TAGS.items()], F.lit("slate"))
    return F.struct(tag.alias("tag"), F.when(tagged, F.regexp_extract(message, whole, 2)).otherwise(message).alias("rest"), F.when(tagged, colour).alias("colour"))


def step_parts(step: Column) -> Column:
    """An array of (source, state, items, said) for each source: what a step's text, parts between bars, tells of it.

    A source belongs to the first part that holds its name, in either case; without one it is running and preparing.
    """
    parts = F.when(F.contains(step, F.lit("|")), F.transform(F.split(step, r"\|"), lambda p: F.regexp_replace(p, f"^[{SPACES}]+|[{SPACES}]+$", ""))).otherwise(F.array().cast("array<string>"))

    def told(source: str, part: Column) -> Column:
        count = r"(?i)(\d+)[" + SPACES + r"]+(?:listings|comps)"
        items = F.nullif(F.regexp_extract(part, count, 1), F.lit("")).try_cast("int")
        state = F.when(part.isNull(), "running").when(F.contains(part, F.lit("✅")), "done").when(F.contains(part, F.lit("⏭️")), "skipped").when(F.contains(part, F.lit("❌")), "error").when(F.contains(part, F.lit("⏳")), "running")
        words = F.when(state == "done", "Done").when(state == "skipped", "Skipped").when(state == "error", "Failed").when(state == "running", "Scraping…").otherwise("Preparing…")
        said = F.when(part.isNull(), "Preparing…").when(items.isNotNull(), F.concat(items.cast("string"), F.lit(" items"))).otherwise(words)
        return F.struct(F.lit(source).alias("source"), state.alias("state"), items.alias("items"), said.alias("said"))

    def found(ps: Column, source: str) -> Column:
        return let(F.try_element_at(F.filter(ps, lambda p: F.contains(F.lower(p), F.lit(source.lower()))), F.lit(1)), lambda part: told(source, part))

    return let(parts, lambda ps: F.array(*[found(ps, s) for s in SOURCES]))
