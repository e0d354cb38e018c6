"""Building blocks for text rules and rounding that every other module shares.

Listings come from a source whose rules count only ASCII letters, digits and _ as word characters, treat the
no-break and ideographic spaces as white space, and round halves up. Java's defaults differ, so rules are built
from these pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the rules mean it, for use inside [...].
SPACES = r"\t\n\x0B\f\r\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: A place between a word character and none, on the left or the right of a word character.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def pattern(text: str, fold: bool = True) -> str:
    """A rule in the notation of this library for Java: ~ is any white space, ‹ and › are word edges; case is folded on demand."""
    out = text.replace("~", f"[{SPACES}]*").replace("‹", LEFT).replace("›", RIGHT)
    return ("(?iu)" if fold else "") + out


#: An edge between a word character and none.
EDGE = f"(?:{LEFT}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){RIGHT})"


def ascii_pattern(text: str, fold: bool = True) -> str:
    r"""A rule with \b, \s and \d as the source means them (ASCII words and digits, wide white space), for Java; case is folded on demand."""
    out = text.replace(r"\b", EDGE).replace(r"\s", f"[{SPACES}]").replace(r"\d", "[0-9]")
    return ("(?iu)" if fold else "") + out


def first(text: Column | str, rule: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, rule, group), F.lit(""))


def js_round(x: Column) -> Column:
    """The nearest whole number, halves up."""
    return F.floor(x + F.lit(0.5))


def nz(x: Column) -> Column:
    """x, but null for 0, as rules treat 0 as absent."""
    return F.nullif(x, F.lit(0))


def median(x: Column, rounding: str = "none") -> Column:
    """The exact median; rounding 'none', 'all', or 'even' (rounded only as the mean of two)."""
    m = F.median(x)
    if rounding == "all":
        return js_round(m).cast("double")
    if rounding == "even":
        return F.when(F.count(x) % 2 == 0, js_round(m).cast("double")).otherwise(m)
    return m


def cases(pairs: list[tuple[Column, object]], other: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.when(pairs[0][0], pairs[0][1])
    for test, value in pairs[1:]:
        out = out.when(test, value)
    return out.otherwise(other)
