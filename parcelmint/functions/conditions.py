"""What a listing's text says of the device's state: a verdict for each of fifteen conditions, and the flags shown for it.

A text is cut into clauses. In a clause, an English denial outweighs an English statement, a noun with its verb comes
next, and set phrases last, denials before statements. A condition is stated if any clause states it, else denied if
any clause denies it. All of it is expressions on arrays of clauses; no Python runs on rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmint.functions import flags, titles
from parcelmint.functions.compat import SPACES, ascii_pattern

STATED, DENIED, UNSAID = 2, 1, 0
#: How far from a noun its verb may stand, in characters.
REACH = 12

# Where clauses end; words that deny; what a verb may act on instead of the device's part; parts and verbs.
CLAUSE_END = r"[，。；、；,!?！？\n|/．]+"
NEGATIONS = ["没有", "没", "无", "未", "不", "不曾", "从未", "未曾", "没有任何", "无任何"]
ACCESSORIES = [
    "钢化膜", "贴膜", "贴了膜", "水凝膜", "镜头膜", "背膜", "保护膜", "膜", "手机壳", "壳", "保护套", "套", "屏保", "后盖", "边框", "边条",
]
GENERIC_PARTS = ["主板", "摄像头", "听筒", "喇叭", "尾插", "充电口", "扬声器", "后盖", "边框", "指纹", "面容", "麦克风", "振动器"]
SCREEN_PARTS = ["屏幕", "内屏", "外屏", "总成", "显示", "排线", "屏"]
BATTERY_PARTS = ["电池", "电芯"]
REPLACE_VERBS = [
    "更换过", "维修过", "组装过", "翻新过", "修复过", "更换", "换过", "换了", "换的", "换新", "新换", "修过", "修好", "已修", "修复", "维修", "动过", "压过", "换",
]
#: Fixed value: after these characters the bare word for a screen is part of another word.
NO_SCREEN = "保风障幕果蔽盘"


@dataclass(frozen=True)
class Condition:
    """Rules of one condition: phrases that state or deny it in either language, and, where it has them, nouns with their verbs."""

    name: str
    zh_stated: tuple[str, ...]
    zh_denied: tuple[str, ...] = ()
    en_stated: tuple[str, ...] = ()
    en_denied: tuple[str, ...] = ()
    nouns: tuple[str, ...] = ()
    others: tuple[str, ...] = ()


# The fifteen conditions.
SCREEN_REPLACED = Condition(
    "screen_replaced",
    (r"后压屏", r"压盖板", r"压排线", r"组装屏", r"国产屏", r"翻新屏"),
    (
        r"(?:原装屏|原屏幕|原屏|屏幕原装|屏幕是原装的|屏是原装)",
        r"(?:非|不是)(?:国产屏|组装屏)",
        r"(?:没|没有|未|无|不曾|从未)(?:有|任何)?(?:换过屏|换屏|换过屏幕|换屏幕)",
    ),
    (
        r"\b(screen|display)\s+(was\s+|has\s+been\s+)?(actually|just|already|recently)?\s*(replaced|changed|swapped)\b",
        r"\b(replaced|changed|swapped)\s+(the\s+)?(screen|display)\b",
        r"\bnew\s+(screen|display)\b",
        r"\b(screen|display)\s+replacement\b",
    ),
    (
        r"\bno\s+(screen|display)\s+(replacement|repair|change|swap|work)\b",
        r"\b(screen|display)\s+(was\s+)?not\s+(replaced|changed|swapped)\b",
        r"\bnever\s+(replaced|changed|swapped)\s+(the\s+)?(screen|display)\b",
        r"\bwithout\s+(any\s+)?(screen|display)\s+(replacement|repair)\b",
        r"\boriginal\s+(screen|display)\b",
    ),
    nouns=tuple(SCREEN_PARTS),
    others=(*GENERIC_PARTS, *BATTERY_PARTS),
)
BATTERY_REPLACED = Condition(
    "battery_replaced",
    (
        r"(?:新电池|新电芯|刚换的电池|新换的电池)",
        r"(?:换电芯|换过电芯|电芯换过)",
        r"(?:电池|电芯)(?:是)?(?:新|全新|新的|全新的)",
    ),
    (
        r"(?:原装电池|原电池|电池原装|电池是原装的|电池是原厂)",
        r"(?:没|没有|未|无|不曾|从未)(?:有|任何)?(?:换过电池|换电池|换过电芯)",
        r"(?:电池|电芯)(?:是)?(?:不|没|没有|不是)(?:新|全新|新的)",
    ),
    (
        r"\bbattery\s+(was\s+|has\s+been\s+)?(actually|just|already|recently)?\s*(replaced|changed|swapped)\b",
        r"\b(replaced|changed|swapped)\s+(the\s+)?battery\b",
        r"\bnew\s+battery\b",
        r"\bbattery\s+replacement\b",
    ),
    (
        r"\bno\s+battery\s+(replacement|repair|change|swap)\b",
        r"\bbattery\s+(was\s+)?not\s+(replaced|changed|swapped)\b",
        r"\bnever\s+(replaced|changed|swapped)\s+(the\s+)?battery\b",
        r"\boriginal\s+battery\b",
    ),
    nouns=tuple(BATTERY_PARTS),
    others=(*GENERIC_PARTS, *SCREEN_PARTS),
)
REPAIRED = Condition(
    "repaired",
    (
        r"(?:拆修|拆机|拆过|拆开过|开过机|拆过机)",
        r"(?:修过|维修过|维修|修好|修复过|已修|修好了|修过机)",
        r"(?:动过|翻新|组装过)",
        r"(?:换过|换了|换)(?:手机|机子)?(?:壳|后盖|边框)",
    ),
    (
        r"(?:没|没有|无|未|不曾|从未|不)(?:有|任何|经过|有过)?(?:拆修|拆机|拆过|修过|维修|维修过|动过|翻新|组装|拆开过|开过机|修过机|换过壳)",
        r"(?:未拆|没拆过|没拆|原封|未动|无修|没修过|无拆无修|无维修|没有维修|没有修过|没修)",
        r"(?:未激活|全新未拆|原封未动)",
    ),
    (r"\brepaired\b", r"\brefurbished\b", r"\bserviced\b", r"\bfixed\b", r"\bopened\b"),
    (
        r"\b(no|never|not|without)\s+(repairs?|repaired|refurbished|serviced|fixed|opened)\b",
        r"\bnever\s+(been\s+)?(repaired|opened|touched|serviced)\b",
        r"\b(unopened|sealed)\b",
    ),
)
WATER_DAMAGE = Condition(
    "water_damage",
    (r"(?:进水|进过水|泡水|泡过水|浸水|浸过水|下水|水损|受潮|液体损坏|进液)",),
    (r"(?:没|没有|无|未|不曾|从未)(?:有|任何)?(?:进过|进)?(?:水|水机|液)",),
    (r"\bwater\s+damage\b", r"\bliquid\s+damage\b", r"\bdamaged\s+by\s+water\b", r"\bwater\s+damaged\b"),
    (
        r"\bno\s+water\s+damage\b",
        r"\bliquid\s+damage\s+free\b",
        r"\bnever\s+(been\s+)?(in|near|exposed\s+to)\s+water\b",
        r"\bnot\s+(water|liquid)\s+damaged\b",
        r"\bwater\s+damage\s+free\b",
    ),
)
CRACKED_SCREEN = Condition(
    "cracked_screen",
    (r"(?:碎屏|屏幕碎|屏碎了|外屏碎|内屏碎|屏裂|屏幕裂|裂纹|裂痕|摔碎|屏幕破|屏破|碎角|屏有裂|屏幕有裂|裂屏)",),
    (r"(?:没|没有|无|未)(?:有|任何)?(?:碎屏|屏幕碎|屏碎|屏裂|裂纹|裂痕|摔碎|屏破)",),
    (r"\b(cracked|broken|shattered)\s+(screen|display)\b", r"\b(screen|display)\s+(is|was)?\s*(cracked|broken|shattered)\b"),
    (r"\bno\s+cracks?\b", r"\b(crack|chip)\s+free\b"),
)
SCREEN_LEAK = Condition(
    "screen_leak",
    (r"(?:漏液|屏漏|液晶漏|漏夜)",),
    (r"(?:没|没有|无|未)(?:有)?(?:漏液|屏漏|液晶漏)",),
    (r"\b(screen|display)\s+leak(?:ing|age)?\b", r"\bleaking\s+(screen|display)\b"),
    (r"\bno\s+(screen|display)\s+leak\b",),
)
LOCKED = Condition(
    "locked",
    (r"(?:有锁(?!屏)|卡贴|卡贴机|网络锁|激活锁|id锁|ID锁|iCloud锁|icloud锁|已锁|锁机|有运营商锁|有网络锁|有激活锁|有id锁|海外有锁|美版有锁|有锁版|监管机|监管锁|美版卡贴|卡贴版)",),
    (r"(?:无锁|没锁|未锁|已解锁|官解|无网络锁|无激活锁|无id锁|无ID锁|已官解|解锁版|无锁版|无卡贴|无运营商锁)",),
    (r"\b(carrier|network|icloud|activation)\s*(-\s*)?locked\b", r"\blocked\b"),
    (
        r"\bunlocked\b",
        r"\bfactory\s+unlocked\b",
        r"\block\s+free\b",
        r"\bsim[- ]free\b",
        r"\bno\s+(carrier|network|activation|icloud)\s+lock\b",
    ),
)
SCREEN_BURN_IN = Condition(
    "screen_burn_in",
    (r"(?:烧屏|屏幕老化|屏老化|有老化|老化明显|老化现象)",),
    (r"(?:没|没有|无|未)(?:有|任何)?(?:烧屏|屏幕老化|老化)",),
    (r"\bburn\s*-?\s*in\b", r"\boled\s+(burn|aging|degradation)\b"),
    (r"\bno\s+burn\s*-?\s*in\b",),
)
BATTERY_SWOLLEN = Condition(
    "battery_swollen",
    (r"(?:电池鼓包|电池胀包|电池鼓|鼓包|胀包)",),
    (r"(?:没|没有|无|未)(?:有|任何)?(?:鼓包|胀包)",),
    (r"\bbattery\s+swollen\b", r"\bswollen\s+battery\b"),
    (r"\bno\s+(battery\s+)?swelling\b",),
)
SCREEN_SPOTS = Condition(
    "screen_spots",
    (r"(?:亮点|暗点|坏点|黄斑|白斑|彩点|烧屏点|屏幕有斑)",),
    (r"(?:没|没有|无|未)(?:有|任何)?(?:亮点|暗点|坏点|黄斑|白斑|彩点)",),
    (r"\b(dead|bright|dark|stuck)\s+pixels?\b", r"\b(pixels?|spots?)\s+(dead|bright|dark)\b"),
    (r"\bno\s+(dead|bright|dark)\s+pixels?\b",),
)
TOUCH_ISSUES = Condition(
    "touch_issues",
    (r"(?:触摸不灵|触屏不灵|触摸失灵|触屏失灵|触摸有问题|触屏有问题|触摸断触|触屏断触|屏幕失灵|触摸不好使|触摸跳屏|触屏跳屏|断触)",),
    (r"(?:触摸|触屏)(?:正常|没问题|无问题|完好)",),
    (
        r"\btouch\s+(?:is\s+)?(not\s+working|broken|unresponsive|faulty|issues?|problems?)\b",
        r"\b(?:screen|display)\s+touch\s+(?:not\s+working|issues?|problems?)\b",
    ),
    (r"\btouch\s+(?:works|working|fine|perfectly|good)\b",),
)
NO_POWER = Condition(
    "no_power",
    (r"(?:不开机|无法开机|开不了机|不能开机|无法开机|开不机|开不了)|(?:无法开机)",),
    (r"(?:能开机|可以开机|开机正常|开机没问题|正常开机)",),
    (r"\b(won'?t|will\s+not|doesn'?t|does\s+not|can'?t|cannot)\s+(power\s+on|boot|turn\s+on|start)\b", r"\bno\s+power\b"),
    (r"\b(powers|boots|turns)\s+on\s+fine\b",),
)
FACE_ID_BROKEN = Condition(
    "face_id_broken",
    (r"(?i:面容坏|面容损坏|面容不可用|面容失灵|面容废了|face\s*id坏|face\s*id不可用|面容有问题)",),
    (r"(?i:面容正常|面容完好|面容可用|face\s*id正常|face\s*id完好|face\s*id可用)",),
    (r"\bface\s*id\s+(is\s+)?(broken|not\s+working|damaged|faulty|unavailable)\b", r"\bfacial\s+recognition\s+(not\s+working|broken)\b"),
    (r"\bface\s*id\s+(works|working|fine|perfectly)\b",),
)
NO_BOX = Condition(
    "no_box",
    (r"(?:无盒|无原盒|不带盒|没有盒|没盒|裸机|单机|无包装|无配件|没有配件|只有手机|无原装盒|无盒说|没有盒子|不带盒子)",),
    (),
    (r"\bno\s+(original\s+)?box\b", r"\bwithout\s+(the\s+)?(original\s+)?box\b", r"\bbox\s+not\s+included\b"),
)
ALL_ORIGINAL = Condition(
    "all_original",
    (r"(?:全原|全原装|原装|原封|原机|原屏|无修无换|无换无修|原装无修|原装无换|全原无修|原装未修|无拆修无换|原封未动)",),
    (),
    (r"\ball\s+original\b", r"\bfully\s+original\b", r"\boriginal\s+condition\b"),
)
CONDITIONS = [
    SCREEN_REPLACED, BATTERY_REPLACED, REPAIRED, WATER_DAMAGE, CRACKED_SCREEN, SCREEN_LEAK, LOCKED, SCREEN_BURN_IN, NO_BOX, BATTERY_SWOLLEN,
    SCREEN_SPOTS, TOUCH_ISSUES, NO_POWER, FACE_ID_BROKEN, ALL_ORIGINAL,
]
# Defects with their flags, in the order shown; warranty clauses; statements of a wholly original device.
REPAIR_FLAGS = {"screen_replaced": "Screen Replaced", "battery_replaced": "Battery Replaced", "repaired": "Opened/Repaired"}
DEFECT_FLAGS = {
    "water_damage": "Water Damage", "cracked_screen": "Cracked Screen", "screen_leak": "Screen Leak", "screen_burn_in": "Screen Burn-in", "battery_swollen": "Battery Swollen",
    "screen_spots": "Screen Spots", "touch_issues": "Touch Issues", "no_power": "Won't Power On", "face_id_broken": "Face ID Broken",
}
WARRANTY = "不在保修范围内|保修范围外|不保修|保修不含|保修不包括"
NOT_COVERED = r"(?:人为损坏|进水|进过水|泡水|泡过水|浸水|碎屏|屏幕碎|屏裂|裂纹|裂痕|漏液|摔碎|屏幕破损|屏破)[^。；\n]{0,25}?(?:不在保修范围内|保修范围外|不保修)"
WHOLLY_ORIGINAL = r"全原|全原装|无修无换|无换无修|原装无修|原装无换|全原无修|原装未修|无拆修无换|all\s+original|fully\s+original"


def any_of(words: list[str] | tuple[str, ...]) -> str:
    return "(?:" + "|".join(words) + ")"


def clauses(text: Column) -> Column:
    """The clauses of a text that are not blank, trimmed."""
    trimmed = F.transform(F.split(text, CLAUSE_END), lambda c: F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", ""))
    return F.filter(trimmed, lambda c: c != "")


def _parted(window: Column) -> tuple[Column, Column, Column]:
    """Whether a verb is in the window, and what is before and after the leftmost one, the longest there."""
    verbs = any_of(REPLACE_VERBS)
    rule = f"(?s)^(.*?){verbs}(.*)$"
    return F.rlike(window, F.lit(verbs)), F.regexp_extract(window, rule, 1), F.regexp_extract(window, rule, 2)


def acted_on(before: Column, after: Column, others: tuple[str, ...]) -> Column:
    """The verdict on a noun with these characters before and after it.

    A verb right before the noun is its own, then one after it, then one farther before it. A verb that acts on an
    accessory or on one of the other parts is not the noun's. A denial counts if it is near the verb.
    """
    has = lambda text, words: F.rlike(text, F.lit(any_of(words)))
    last = lambda text, n: F.right(text, F.lit(n))
    denied = lambda text: F.when(has(text, NEGATIONS), DENIED).otherwise(STATED)
    verb_before, ahead, between = _parted(before)
    claimed = has(last(ahead, 4), others)
    own = verb_before & (F.length(between) <= 2) & ~claimed & ~has(between, ACCESSORIES)
    verb_after, gap, tail = _parted(after)
    part, verbs = "^(?>" + "|".join(others) + ")", any_of(REPLACE_VERBS)
    of_other = F.rlike(tail, F.lit(part)) & ~F.rlike(tail, F.lit(f"(?s){part}.*?{verbs}"))
    behind = verb_after & ~of_other & ~has(gap, others) & ~has(tail, ACCESSORIES)
    astray = has(between, ACCESSORIES) | has(between, others) | claimed
    far = F.when(verb_before & ~astray, denied(last(ahead, 6))).otherwise(UNSAID)
    return F.when(own, denied(last(ahead, 6))).when(behind, denied(gap)).otherwise(far)


def noun_verdict(clause: Column, condition: Condition) -> Column:
    """The verdict of a clause's nouns with the verbs around them: stated if one is, else denied if one is."""
    nouns = any_of([n + (f"(?![{NO_SCREEN}])" if n == "屏" else "") for n in condition.nouns])
    rule = f"(?s)(?<=((?:^.{{0,{REACH - 1}}})|.{{{REACH}}}))(?={nouns}(.{{0,{REACH}}}))"
    before, after = F.regexp_extract_all(clause, F.lit(rule), F.lit(1)), F.regexp_extract_all(clause, F.lit(rule), F.lit(2))
    return F.coalesce(F.array_max(F.zip_with(before, after, lambda b, a: acted_on(b, a, condition.others))), F.lit(UNSAID))


def _says(clause: Column, rules: tuple[str, ...], fold: bool) -> Column:
    return F.rlike(clause, F.lit(ascii_pattern(any_of(rules), fold))) if rules else F.lit(False)


def verdict(parts: Column, condition: Condition) -> Column:
    """2 if a text with these clauses states the condition, 1 if it denies it, 0 if it says nothing of it."""

    def of(clause: Column) -> Column:
        noun = noun_verdict(clause, condition) if condition.nouns else F.lit(UNSAID)
        out = F.when(_says(clause, condition.en_denied, True), DENIED).when(_says(clause, condition.en_stated, True), STATED)
        out = out.when(noun == STATED, STATED) if condition.nouns else out
        out = out.when(_says(clause, condition.zh_denied, False), DENIED).when(_says(clause, condition.zh_stated, False), STATED)
        return out.otherwise(noun)

    return F.coalesce(F.array_max(F.transform(parts, of)), F.lit(UNSAID))


def without_warranty(text: Column) -> Column:
    """The text without what it says the warranty does not cover."""
    return F.when(F.rlike(text, F.lit(WARRANTY)), F.regexp_replace(text, NOT_COVERED, " ")).otherwise(text)


def condition_flags(verdicts: Column, text: Column, storage_gb: Column) -> Column:
    """The flags shown for verdicts (a struct with a field for each condition), in their order.

    A sealed device has no other flags but its storage. Repairs and defects are never beside All Original, which
    replaces single statements of originality.
    """
    stated = lambda name: verdicts[name] == STATED
    denied = lambda name: verdicts[name] == DENIED
    some = lambda names: F.greatest(*[verdicts[n] for n in names]) == STATED
    repaired, defect = some(REPAIR_FLAGS), some(DEFECT_FLAGS)
    original = ~repaired & ~defect & (stated("all_original") | F.rlike(text, F.lit(ascii_pattern(WHOLLY_ORIGINAL))))
    size = F.when(storage_gb != 0, titles.storage_label(storage_gb))
    battery = flags.battery_state(text)
    shown = [F.when(stated(n), F.lit(flag)) for n, flag in (REPAIR_FLAGS | DEFECT_FLAGS).items()]
    shown += [F.when(stated("locked"), "Locked").when(denied("locked"), "Unlocked"), F.when(original, "All Original")]
    shown += [
        F.when(~original & denied("repaired") & ~repaired, "No Repairs"),
        F.when(~original & denied("screen_replaced"), "Original Screen"),
        F.when(~original & denied("battery_replaced"), "Original Battery"),
        F.when(~original & denied("water_damage") & ~defect, "No Water Damage"),
        size,
        F.when(stated("no_box"), "No Box"),
        F.concat(F.lit("Battery "), battery["health"].cast("string"), F.lit("%")),
        F.concat(F.lit("Cycles "), battery["cycles"].cast("string")),
    ]
    sealed = F.array_compact(F.array(F.lit("Factory Sealed"), size))
    return F.when(flags.is_sealed(text), sealed).otherwise(F.array_compact(F.array(*shown)))


def with_conditions(rows: DataFrame) -> DataFrame:
    """rows (title, description, product) with verdicts, a struct of numbers, and condition_flags; product's storage and key follow the text.

    Null titles and descriptions are empty. A product without storage takes that of the text, and its key too,
    unless it names one already.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    out = rows.withColumn("text__", without_warranty(text)).withColumn("clauses__", clauses(F.col("text__")))
    verdicts = F.struct(*[verdict(F.col("clauses__"), c).alias(c.name) for c in CONDITIONS])
    gb = F.coalesce(F.col("product.storage_gb"), titles.storage_gb(F.col("text__")))
    out = out.withColumn("verdicts", verdicts).withColumn("gb__", gb)
    out = out.withColumn("condition_flags", condition_flags(F.col("verdicts"), F.col("text__"), F.col("gb__")))
    key = F.col("product.standard_key")
    bare = F.col("product.family").isNotNull() & ~F.contains(key, F.lit("GB")) & ~F.contains(key, F.lit("TB")) & (F.col("gb__") != 0)
    synced = F.col("product").withField("storage_gb", F.col("gb__"))
    synced = synced.withField("standard_key", F.when(bare, F.concat_ws(" ", key, titles.storage_label(F.col("gb__")))).otherwise(key))
    return out.withColumn("product", F.when(F.col("product").isNotNull(), synced)).drop("text__", "clauses__", "gb__")
