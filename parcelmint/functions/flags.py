"""The state of a device as its text tells it: battery figures and whether it is sealed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmint.functions.compat import first, nz, pattern

_OWN = pattern(r"电池[】\[\]【]*~(?:健康度|健康|效率)?~[:：]?~(\d{1,3})~%?~(?:充电~(\d{1,4})~次)?", fold=False)
#: Other places of the health and of the charge cycles, in the order in which they are tried.
_HEALTH = [r"‹battery health~[:：]?~(\d{1,3})~%?", r"‹battery~[:：]?~(\d{1,3})~%", r"‹(\d{1,3})~% battery health›"]
_CYCLES = [r"‹(?:charge )?cycles?~[:：]?~(\d{1,4})›", r"‹(\d{1,4}) (?:charge )?cycles?›"]
_SEALED = r"全新未拆|原封|未开封|未拆封|全新正品未拆|未激活|factory~sealed|brand~new~sealed"


def _number(text: Column, rule: str, least: int, most: int, group: int = 1) -> Column:
    n = first(text, rule, group).cast("int")
    return F.when(n.between(least, most), n)


def _other(text: Column, rules: list[str], least: int, most: int) -> Column:
    """The first rule that matches at all decides, within bounds."""
    n = F.coalesce(*[first(text, pattern(r)).cast("int") for r in rules])
    return F.when(n.between(least, most), n)


def battery_state(text: Column) -> Column:
    """(health 50 to 100, cycles 1 to 2000) as a struct; 0 counts as not said."""
    health = F.coalesce(_number(text, _OWN, 50, 100), _other(text, _HEALTH, 50, 100))
    cycles = F.coalesce(nz(_number(text, _OWN, 0, 2000, 2)), nz(_other(text, _CYCLES, 0, 2000)), nz(_number(text, pattern(r"充电~(\d{1,4})~次"), 0, 2000)))
    return F.struct(health.alias("health"), cycles.alias("cycles"))


def is_sealed(text: Column) -> Column:
    """Sealed by the factory, and nothing said of opening; 未拆封 itself contains 拆封, so only other words for sealed count beside it."""
    return F.rlike(text, F.lit(pattern(_SEALED))) & ~F.rlike(text, F.lit("拆封|已拆|后封|二手"))
