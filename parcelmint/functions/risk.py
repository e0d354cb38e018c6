"""Risk of a listing: negation-aware tokens, locks, the seller's record, the listing's own quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmint.functions.compat import js_round, nz

# Words that negate what follows, the longest first; tokens with what they mean.
NEGATIONS = ["没有", "无", "不", "非", "未", "没"]
BLACKLIST = {"组装": "assembled", "山寨": "knock-off", "高仿": "replica", "翻新": "refurbished", "ID锁": "iCloud locked", "坏无拆": "broken uninspected", "进水": "water damaged", "扩容": "storage expanded (fake)", "黑解": "blacklisted unlock", "监管锁": "MDM supervised lock"}
CARRIER = ["有锁(?!屏)", "有网络锁|有运营商锁|有激活锁"]
YELLOW = {"换过屏幕": "replaced screen", "换过电池": "replaced battery", "换屏": "replaced screen", "换电池": "replaced battery", "无盒": "no original retail box", "无原盒": "no original retail box", "维修过": "repaired", "拆修": "opened/repaired"}
_REPORT = "struct<score:int,dropped:boolean,reasons:array<string>,blacklist:array<string>,yellow:array<string>>"


def says(text: Column, token: str) -> Column:
    """Whether the token occurs somewhere without a negation before it."""
    # most texts do not hold the token at all, which is found out faster without a rule
    return F.contains(text, F.lit(token)) & F.rlike(text, F.lit(f"(?<!{'|'.join(NEGATIONS)}){token}"))


def negated(text: Column, token: str) -> Column:
    """The distinct negated occurrences of the token."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?:{'|'.join(NEGATIONS)}){token}"), F.lit(0)))


def blacklist(text: Column) -> Column:
    hits = [F.when(says(text, t), F.lit(f"{t} ({label})")) for t, label in BLACKLIST.items()]
    hits += [F.when(F.rlike(text, F.lit(r)), F.lit("有锁 (carrier locked)")) for r in CARRIER]
    return F.array_compact(F.array(*hits))


def yellow(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(says(text, t), F.lit(f"{t} ({label})")) for t, label in YELLOW.items()]))


def _denial(label: str) -> Callable[[Column], Column]:
    return lambda found: F.concat(found, F.lit(f" (no {label})"))


def declarations(text: Column) -> Column:
    """What a text denies, of the blacklist."""
    none = F.array().cast("array<string>")
    found = []
    for t, label in BLACKLIST.items():
        found.append(F.when(F.contains(text, F.lit(t)) & ~says(text, t), F.transform(negated(text, t), _denial(label))).otherwise(none))
    return F.flatten(F.array(*found))


def seller_risk(rating: Column, transactions: Column, verified: Column) -> Column:
    """0 to 60 for the feedback rate, the number of verified sales and whether the seller is verified."""
    rating, transactions = nz(rating), F.coalesce(transactions, F.lit(0))
    by_rating = F.when(rating.isNull() | (rating < 0), 25).when(rating >= 98, 0).when(rating >= 95, 5).when(rating >= 90, 12).when(rating >= 85, 20).when(rating >= 70, 30).otherwise(40)
    by_sales = F.when(transactions >= 50, 0).when(transactions >= 10, 4).when(transactions > 0, 10).otherwise(8)
    return F.least(F.lit(60), by_rating + by_sales + F.when(verified, 0).otherwise(8))


def yellow_risk(tokens: Column) -> Column:
    return F.least(F.lit(20), F.size(tokens) * 10)


def asset_risk(images: Column, description: Column) -> Column:
    return F.when(images < 2, 8).otherwise(0) + F.when(F.length(description) < 20, 5).otherwise(0)


def _report(black: Column, marks: Column, denied: Column, seller: Column, lock: Column, images: Column, description: Column) -> Column:
    none = F.array().cast("array<string>")
    score = F.when(lock == "carrier_locked", 50).otherwise(0) + seller + yellow_risk(marks) + asset_risk(images, description)
    reasons = [
        F.when(F.size(denied) > 0, F.concat(F.lit("Positive declarations: "), F.array_join(denied, ", "), F.lit(" (+0)"))),
        F.when(lock == "carrier_locked", F.lit("Carrier-locked (+50)")).when(lock == "unlocked", F.lit("Unlocked (+0)")),
        F.concat(F.lit("Seller record (+"), seller.cast("string"), F.lit(")")),
        F.when(F.size(marks) > 0, F.concat(F.lit("Yellow modifier tokens: "), F.array_join(marks, ", "), F.lit(" (+"), yellow_risk(marks).cast("string"), F.lit(")"))),
        F.when(images < 2, F.concat(F.lit("Image count "), images.cast("string"), F.lit(" < 2 (+8)"))),
        F.when(F.length(description) < 20, F.concat(F.lit("Description "), F.length(description).cast("string"), F.lit(" chars < 20 (+5)"))),
    ]

    def made(score: Column, dropped: bool, why: Column, tokens: Column, marks: Column) -> Column:
        return F.struct(score.alias("score"), F.lit(dropped).alias("dropped"), why.alias("reasons"), tokens.alias("blacklist"), marks.alias("yellow")).cast(_REPORT)

    named = F.array(F.concat(F.lit("Critical blacklist tokens detected: "), F.array_join(black, ", ")))
    risk = F.when(F.size(black) > 0, made(F.lit(100), True, named, black, none))
    for kind, label in {"icloud_locked": "iCloud/Activation lock", "mdm_locked": "MDM supervised lock"}.items():
        risk = risk.when(lock == kind, made(F.lit(100), True, F.array(F.lit(label)), F.array(F.lit(label)), none))
    bounded = js_round(F.greatest(F.lit(0), F.least(F.lit(100), score))).cast("int")
    risk = risk.otherwise(made(bounded, False, F.array_compact(F.array(*reasons)), none, marks))
    return risk


def report(title: Column, description: Column, lock: Column, rating: Column, transactions: Column, verified: Column, images: Column) -> Column:
    """score (0 to 100), dropped, reasons, blacklist and yellow tokens."""
    text = F.concat_ws(" ", title, description)
    seller = seller_risk(rating, transactions, verified)
    return _report(blacklist(text), yellow(text), declarations(text), seller, F.coalesce(lock, F.lit("unknown")), images, description)


def with_risk(rows: DataFrame) -> DataFrame:
    """rows (title, description, product, rating, transactions, verified, images) with risk, the report() of each.

    What the score and its reasons share is a projection of its own, so that no rule runs twice on a row.
    """
    text = F.concat_ws(" ", "title", "description")
    parts = {
        "black__": blacklist(text),
        "marks__": yellow(text),
        "denied__": declarations(text),
        "seller__": seller_risk(F.col("rating"), F.col("transactions"), F.col("verified")),
        "lock__": F.coalesce("product.lock_status", F.lit("unknown")),
    }
    out = rows.select("*", *[v.alias(k) for k, v in parts.items()])
    return out.withColumn("risk", _report(*map(F.col, parts), F.col("images"), F.col("description"))).drop(*parts)


def hidden_by_risk(risk: Column, threshold: float) -> Column:
    return risk["dropped"] | (risk["score"] > threshold)
