"""Queries on what texts say of a device's state, over cases whose answers are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.functions import conditions
from parcelmint.functions.titles import PRODUCT
from parcelmint.plans.bindings import pick, sql_list, table
from parcelmint.plans.catalog import query

#: (text, verdicts that are not 0, flags).
CASES = [
    ("屏幕没换过电池换过", {"screen_replaced": 1, "battery_replaced": 2}, ["Battery Replaced", "Original Screen"]),
    ("换过钢化膜", {}, []),
    ("人为损坏/进水/不在保修范围内", {}, []),
    ("有锁屏密码", {}, []),
    ("有锁 成色好", {"locked": 2}, ["Locked"]),
    ("iPhone 15 256G 换过屏幕 电池健康93%", {"screen_replaced": 2}, ["Screen Replaced", "256GB", "Battery 93%"]),
    ("全新未拆 国行 256G", {"repaired": 1}, ["Factory Sealed", "256GB"]),
    ("无拆无修，全原装 128GB", {"repaired": 1, "all_original": 2}, ["All Original", "128GB"]),
    ("no screen replacement, battery replaced recently", {"screen_replaced": 1, "battery_replaced": 2}, ["Battery Replaced", "Original Screen"]),
    ("进水修好 屏裂", {"screen_replaced": 2, "repaired": 2, "water_damage": 2, "cracked_screen": 2}, ["Screen Replaced", "Opened/Repaired", "Water Damage", "Cracked Screen"]),
    ("无进水，无锁，无盒", {"water_damage": 1, "locked": 1, "no_box": 2}, ["Unlocked", "No Water Damage", "No Box"]),
    ("电池效率100 充电88次 漏液", {"screen_leak": 2}, ["Screen Leak", "Battery 100%", "Cycles 88"]),
    (
        "面容坏 不开机 触摸失灵 亮点 烧屏 鼓包",
        {"face_id_broken": 2, "no_power": 2, "touch_issues": 2, "screen_spots": 2, "screen_burn_in": 2, "battery_swollen": 2},
        ["Screen Burn-in", "Battery Swollen", "Screen Spots", "Touch Issues", "Won't Power On", "Face ID Broken"],
    ),
    ("没有换过屏幕 电池没换过", {"screen_replaced": 1, "battery_replaced": 1}, ["Original Screen", "Original Battery"]),
    ("MacBook Air M3 1TB 原装 unlocked", {"locked": 1, "all_original": 2}, ["Unlocked", "All Original", "1TB"]),
    ("屏幕换过钢化膜", {}, []),
    ("屏幕换电池", {}, []),
    ("后压屏 屏幕总成换过", {"screen_replaced": 2}, ["Screen Replaced"]),
    ("touch works, face id is broken, no cracks", {"touch_issues": 1, "face_id_broken": 2, "cracked_screen": 1}, ["Face ID Broken"]),
    ("成色好 充电口正常", {}, []),
]
#: (characters before a noun, characters after it, verdict on the screen).
WINDOWS = [
    ("换过", "", 2), ("没有换过", "", 1), ("", "换过", 2), ("", "没换过电池换过", 1), ("", "换过钢化膜", 0), ("", "换电池", 0), ("电池换过", "", 0),
    ("换过电池 ", "没换过", 1), ("没有拆修和更换", "", 1), ("换过钢化膜的", "", 0), ("更换过新的原装", "", 2), ("", "原装", 0), ("", "没有动过", 1), ("", "电池换过", 0),
]
_N = len(CASES)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each part with a case's text cut between title and description."""
    text = pick([t for t, _, _ in CASES], F.col("p_partkey") % _N)
    none = F.lit(None).cast(PRODUCT).alias("product")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("").alias("title"), text.alias("description"), none)


@query("W06", f"SELECT p_partkey AS id, CAST({sql_list([v for *_, v in WINDOWS])}[p_partkey % {len(WINDOWS)} + 1] AS INT) AS verdict FROM part")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noun's verdict from the verbs in the window around it."""
    k = F.col("p_partkey") % len(WINDOWS)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick([b for b, _, _ in WINDOWS], k).alias("before"), pick([a for _, a, _ in WINDOWS], k).alias("after"))
    return rows.select("id", conditions.acted_on(F.col("before"), F.col("after"), conditions.SCREEN_REPLACED.others).alias("verdict"))


_NAMES = [c.name for c in conditions.CONDITIONS]
_VERDICTS = ", ".join(f"CAST({sql_list([v.get(n, 0) for _, v, _ in CASES])}[p_partkey % {_N} + 1] AS INT) AS {n}" for n in _NAMES)


@query("C13", f"SELECT p_partkey AS id, {_VERDICTS} FROM part")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all fifteen conditions."""
    return conditions.with_conditions(_cases(spark, sf_dir)).select("id", "verdicts.*")


#: For each condition a text that states it, alone, and one that denies it, if any does.
STATED_AND_DENIED = [
    ("screen_replaced", "screen was replaced", "原装屏"), ("battery_replaced", "换电芯", "original battery"), ("repaired", "拆机", "never been opened"), ("water_damage", "受潮", "no water damage"),
    ("cracked_screen", "摔碎", "crack free"), ("screen_leak", "液晶漏", "无漏液"), ("locked", "卡贴机", "sim-free"), ("screen_burn_in", "oled aging", "无老化"), ("no_box", "裸机", None),
    ("battery_swollen", "swollen battery", "没有鼓包"), ("screen_spots", "dead pixel", "无黄斑"), ("touch_issues", "断触", "touch fine"), ("no_power", "won't boot", "开机正常"),
    ("face_id_broken", "Face ID坏", "面容正常"), ("all_original", "原机", None),
]


@query("C13a", "SELECT p_partkey AS id, p_partkey % 15 AS k, CAST(2 AS INT) AS stated, CAST(CASE WHEN p_partkey % 15 IN (8, 14) THEN 0 ELSE 1 END AS INT) AS denied FROM part")
def c13a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each condition's own phrases."""
    k, stated, denied = F.col("p_partkey") % 15, None, None
    for i, (name, yes, no) in enumerate(STATED_AND_DENIED):
        rule = next(c for c in conditions.CONDITIONS if c.name == name)
        of = lambda text, rule=rule: conditions.verdict(conditions.clauses(F.lit(text or "")), rule)
        stated = F.when(k == i, of(yes)) if stated is None else stated.when(k == i, of(yes))
        denied = F.when(k == i, of(no)) if denied is None else denied.when(k == i, of(no))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), k.alias("k"), stated.alias("stated"), denied.alias("denied"))


@query("C14", f"SELECT p_partkey AS id, {sql_list([', '.join(f) for _, _, f in CASES])}[p_partkey % {_N} + 1] AS flags FROM part")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags shown, with their rules of consistency."""
    return conditions.with_conditions(_cases(spark, sf_dir)).select("id", F.array_join("condition_flags", ", ").alias("flags"))


#: Conditions whose phrases stand in one text without touching one another, by their places above.
_TOGETHER = [i for i, (name, _, no) in enumerate(STATED_AND_DENIED) if no and name not in ("screen_replaced", "battery_replaced", "repaired", "cracked_screen")]
_SEPARATORS, _FILLERS = ["，", "。", "; ", "\n", "！"], ["成色好", "配件齐全", "支持验货", "256G", "iPhone 15 Pro", "国行"]


def _state(j: int) -> str:
    """SQL and Spark alike: whether a part's text says nothing of the j-th of these conditions, states it or denies it."""
    return f"CAST(floor(((p_partkey * 7919 + 13) % 59049) / {3 ** j}) AS BIGINT) % 3"


@query("C13g", "SELECT p_partkey AS id, " + ", ".join(f"CAST([0, 2, 1][{_state(j)} + 1] AS INT) AS {STATED_AND_DENIED[i][0]}" for j, i in enumerate(_TOGETHER)) + " FROM part")
def c13g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on texts put together from phrases, fillers and separators, nearly every part's another one."""
    key, said = F.col("p_partkey"), []
    for j, i in enumerate(_TOGETHER):
        _, yes, no = STATED_AND_DENIED[i]
        phrase = pick(["", yes, no], F.expr(_state(j)))
        filler = F.when((key + j) % 3 == 0, F.concat(pick(_FILLERS, (key + j) % len(_FILLERS)), pick(_SEPARATORS, (key + j) % len(_SEPARATORS)))).otherwise("")
        said.append(F.concat(filler, phrase, F.when(phrase != "", pick(_SEPARATORS, (key * 3 + j) % len(_SEPARATORS))).otherwise("")))
    half = len(said) // 2
    none = F.lit(None).cast(PRODUCT).alias("product")
    texts = table(spark, sf_dir, "part").select(key.alias("id"), F.concat(*said[:half]).alias("title"), F.concat(*said[half:]).alias("description"), none)
    return conditions.with_conditions(texts).select("id", *[f"verdicts.{STATED_AND_DENIED[i][0]}" for i in _TOGETHER])
