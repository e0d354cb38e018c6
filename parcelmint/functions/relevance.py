"""Whether a title belongs to what was searched for."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmint.functions.compat import ascii_pattern, pattern
from parcelmint.functions.risk import says

# Titles that are no device, words that say little, and rules for a product family's generation.
ACCESSORIES = "case|cover|capa|film|protector|protetor|charger|carregador|cable|cabo|adapter|adaptador|screen|ecra|écrã|battery|bateria|holder|suporte|stand|dock|mount|bracket|clip|sticker|skin|decal|tempered|vidro|película|pelicula"
BOX_QUALIFIER = "[带有含].{0,3}?(?:包装|盒子)"
BOXES = "手机盒|包装盒|原装盒子|只是盒子|是盒子|只卖包装|空盒|纸盒|only.*box|空壳"
JUNK = [
    "出租|租赁|租借|以租代购|免押金出租|短租",
    "分期|首付|月供|可分|可租",
    "解锁|绕id|绕开|黑解|官解",
    "截图|灵动岛|代截",
    "模型",
    "垫付|佣金|接单|过单",
    "抽纸|纸巾|零食|水果|花盆|衣服|鞋|包",
    "回馈活动|抽奖|中奖|免费送",
]
STOP_WORDS = {"the", "all", "and", "for", "with", "new", "pro", "max", "plus", "ultra"}
# Fixed values: (family, rule, value, titles only). A rule's number is the generation; one without a number has the value.
FAMILIES = [
    ("iphone", r"\biphone\s*(\d{1,2}[es]?)(?:plus|mini|pro|max|air)?\b", None, False),
    ("ipad", r'\bipad\s*(?:pro|air|mini)?\s*(?:\d{1,2}(?:\.\d)?-?\s*(?:in|inch|")\s*)?m([1-9])\b', None, False),
    ("ipad", r"\bipad\s*(?:pro|air|mini)?\s*(\d{1,2})\b(?!\s*-?\s*(?:in|inch))", None, False),
    ("macbook", r'\bmacbook\s*(?:pro|air)?\s*(?:\d{1,2}(?:\.\d)?-?\s*(?:in|inch|")\s*)?m([1-9])\b', None, False),
    ("watch", r"\bapple\s+watch\s*(?:series\s*)?(\d{1,2})\b", None, False),
    ("watch", r"\bapple\s+watch\s*ultra\s*(\d)\b", None, False),
    ("watch", r"\bapple\s+watch\s*se\s*(\d)\b", None, False),
    ("airpods", r"\bairpods\s*(?:pro|max)?\s*(\d{1,2})\b", None, False),
    ("galaxy", r"\bgalaxy\s*([sa]\d{1,2})\b", None, False),
    ("galaxy", r"\bgalaxy\s*z(?:\s*(?:fold|flip))?\s*(\d{1,2})\b", None, False),
    ("galaxy", r"\bgalaxy\s*(?:tab|book|buds)\s*[sa]?\s*(\d{1,2})\b", None, False),
    ("pixel", r"\bpixel\s*(\d{1,2})(?:a|pro|xl)?\b", None, False),
    ("playstation", r"\b(?:playstation|ps)\s*(\d)\b", None, False),
    ("sony-headphones", r"\b(?:wh|wf)-?1000xm(\d)\b", None, False),
    ("switch", r"\bswitch\s*2\b", "", False),
    ("switch", r"\bswitch(?!\s*2\b)", "1", True),
    ("xiaomi", r"\b(?:xiaomi|redmi|poco)\s*(?:note|k|f|m|x|pad)?\s*(\d{1,2})\b", None, False),
    ("oneplus", r"\boneplus\s*(\d{1,2})\b", None, False),
    ("oppo", r"\boppo\s*(?:find\s*x|reno)?\s*(\d{1,2})\b", None, False),
    ("honor", r"\bhonor\s*(?:magic|m|x)?\s*(\d{1,3})\b", None, False),
    ("realme", r"\brealme\s*(?:gt\s*)?(\d{1,2})\b", None, False),
    ("vivo", r"\bvivo\s*(?:x|y|v|s)?\s*(\d{1,3})\b", None, False),
    ("motorola", r"\b(?:edge|razr)\s*(\d{1,2})\b", None, False),
    ("dji-mavic", r"\bmavic\s*(\d{1,2})\b", None, False),
    ("dji-mini", r"\bmini\s*(\d{1,2})\b", None, False),
    ("dji-air", r"\bair\s*(\d{1,2})\s*s\b", None, False),
    ("dji-osmo", r"\bosmo\s*(?:pocket|action|mobile)?\s*(\d{1,2})\b", None, False),
    ("dji-rs", r"\brs\s*(\d)\b", None, False),
    ("dji-avata", r"\bavata\s*2\b", "", False),
    ("canon-r", r"\beos\s*r(\d{1,2})\b", None, False),
    ("nikon-z", r"\bz\s*(\d{1,2})\b", None, False),
    ("fuji-xt", r"\bx-t(\d{1,2})\b", None, False),
    ("fuji-xh", r"\bx-h2\b", "2", False),
    ("fuji-x100", r"\bx100\b", "100", False),
    ("gopro", r"\bhero\s*(\d{1,2})\b", None, False),
    ("dyson", r"\bdyson\s*v(\d{1,2})\b", None, False),
    ("jbl", r"\bjbl\s*(?:flip|charge|extreme|go|clip|tune)\s*(\d{1,2})\b", None, False),
    ("bose-qc", r"\bquietcomfort\s*ultra\b", "ultra", False),
    ("bose-qc", r"\bquietcomfort\s*(\d{2,3})\b", None, False),
    ("roborock", r"\broborock\s*[sq]?\s*(\d{1,2})\b", None, False),
    ("ecovacs", r"\bdeebot\s*[xtn]?\s*(\d{1,2})\b", None, False),
]


def is_accessory(title: Column) -> Column:
    return F.rlike(title, F.lit(pattern(f"‹(?:{ACCESSORIES})›")))


def is_junk(title: Column) -> Column:
    """Boxes, rentals, instalments, unlocking and the like."""
    box = F.rlike(title, F.lit("(?iu)" + BOXES)) | says(title, "包装") | says(title, "盒子")
    out = ~F.rlike(title, F.lit(BOX_QUALIFIER)) & box
    for rule in JUNK:
        out = out | F.rlike(title, F.lit("(?iu)" + rule))
    return out


def tokens(query: str, extra: str = "") -> list[str]:
    """What is worth looking for of a query: words of two characters or more with a letter or digit, short stop words left out."""
    words = [t for t in re.split(rf"[\s\-—,./{re.escape(extra)}]+", query.lower()) if len(t) >= 2 and re.search("[a-z0-9]", t)]
    return [t for t in words if t not in STOP_WORDS or len(t) >= 4]


def has_any_token(title: Column, query: str) -> Column:
    out, low = None, F.lower(title)
    for t in tokens(query):
        out = F.contains(low, F.lit(t)) if out is None else out | F.contains(low, F.lit(t))
    return F.lit(True) if out is None else out


def _marker(family: str, value: str | None) -> Callable[[Column], Column]:
    return lambda found: F.concat(F.lit(family + " "), found if value is None else F.lit(value))


def markers(text: Column, of_title: bool = True) -> Column:
    """Every (family, generation) that a text names, as 'family value', in the order of the rules."""
    low, found = F.lower(text), []
    for family, rule, value, titles_only in FAMILIES:
        if titles_only and not of_title:
            continue
        values = F.regexp_extract_all(low, F.lit(ascii_pattern(rule)), F.lit(1 if value is None else 0))
        found.append(F.transform(values, _marker(family, value)))
    return F.flatten(F.array(*found))


def is_relevant(title: Column, query: str) -> Column:
    """Whether a title plausibly is what a query asks for.

    A title of the same family and generation is; one that names another generation or family is not; one that names
    none must have the query's most distinctive word, as must any title if the query names none.
    """
    words = tokens(query, "()")
    longest = max(words, key=len) if words else None
    shares = F.contains(F.lower(title), F.lit(longest)) if longest else F.lit(True)
    asked = markers(F.lit(query), of_title=False)
    told = markers(title)
    return F.when(F.size(asked) == 0, shares).otherwise(F.arrays_overlap(asked, told) | ((F.size(told) == 0) & shares))
