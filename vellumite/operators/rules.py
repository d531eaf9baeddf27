"""Rule symbols and values that a translation must keep, and time markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T

#: Names of attributes, of derived values and of skills.
ATTRIBUTES = "STR CON DEX INT POW CHA SIZ APP EDU".split()
SECONDARY = "SAN HP WP".split()
SKILLS = (
    "Accounting", "Alertness", "Anthropology", "Archaeology", "Art", "Athletics", "Bureaucracy", "Computer Science", "Criminology", "Disguise", "Dodge",
    "Drive", "Firearms", "First Aid", "Forensics", "Heavy Machinery", "History", "HUMINT", "Law", "Medicine", "Melee Weapons", "Navigate", "Occult",
    "Persuade", "Pharmacy", "Psychotherapy", "Ride", "Science", "Search", "SIGINT", "Stealth", "Surgery", "Survival", "Swim", "Unarmed Combat", "Unnatural",
)
#: A border of words of ASCII letters, digits and underscores; \b also counts other letters in some versions of Java.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Kind of symbol and its pattern.
SYMBOLS = {
    "骰子": EDGE + r"\d+[dD]\d+" + EDGE,
    "损失": "(?i)" + EDGE + r"\d+/\d+[dD]\d+[ \t\r\n\f]+SAN" + EDGE,
    "属性": EDGE + "(?:" + "|".join(ATTRIBUTES) + ")" + EDGE,
    "数值": EDGE + "(?:" + "|".join(SECONDARY) + ")" + EDGE,
}
#: Kind of rule value and the pattern whose group is the value.
VALUES = {
    "百分比": r"(?<![\d.])(\d{1,3})\s*%",
    "伤害修正": r"\d+\s*[dD]\s*\d+\s*[+\-]\s*(\d+)",
    "护甲": r"(?i)\bArmou?r\b\s*:?\s*(\d+)",
    "致死率": r"(?i)\bLethality\b\s*:?\s*(\d{1,3})",
    "射程": r"(?i)(?<![\d.])(\d+)\s*(?:m|km|ft|yd|meters?|metres?|kilometers?|kilometres?|feet|yards?)(?![A-Za-z])",
    "技能值": r"\b(?:" + "|".join(SKILLS) + r")\b\s*:?\s*(\d{1,3})",
}
#: Abbreviations and the words they are wrongly put as.
ABBREVIATIONS = {
    "SAN": ("理智", "理智值"), "HP": ("生命值", "生命"), "WP": ("意志力", "意志点"), "STR": ("力量",), "CON": ("体质",), "DEX": ("敏捷",), "INT": ("智力",), "POW": ("意志",), "CHA": ("魅力",),
}
#: Markers of time, the first alternative at a place winning.
TIME_MARKER = (
    r"\bD[-+]\d+\b|\bDay\s+\d+\b|\bNight\s+\d+\b|\b\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?\b|"
    r"\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b|\b(?:midnight|noon|dawn|dusk|sunrise|sunset)\b|"
    r"第\s*(?:\d+|一|二|三|四|五|六|七|八|九|十|十一|十二)\s*天|\d{1,2}\s*[:：]\s*\d{2}|午夜|正午|黎明|黄昏|日出|日落|清晨|傍晚|深夜"
)


def found_symbols(c: Column, kind: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(T.some(c), F.lit(f"({SYMBOLS[kind]})"), F.lit(1)))


def _tagged(found: Column, kind: str, name: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias(name)))


def symbol_profile(df: DataFrame, column: str = "text") -> DataFrame:
    """Add a row per kind and symbol that a text holds."""
    rows = [_tagged(found_symbols(F.col(column), k), k, "symbol") for k in SYMBOLS]
    return df.select("*", F.explode(F.concat(*rows)).alias("s")).select("*", "s.kind", "s.symbol").drop("s")


def present(symbol: Column, text: Column, any_case: bool = True) -> Column:
    """Does the text have the symbol, not inside a longer run of ASCII letters and digits? Dice are found in either case, between words, unless any_case is false."""
    quoted = F.concat(F.lit("\\Q"), symbol, F.lit("\\E"))
    dice = symbol.rlike("^(\\d+[dD]\\d+|(?i)\\d+/\\d+[dD]\\d+\\s+SAN)$")
    pattern = F.concat(F.lit("(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))
    if any_case:
        pattern = F.when(dice, F.concat(F.lit("(?i)" + EDGE), quoted, F.lit(EDGE))).otherwise(pattern)
    return F.regexp_like(text, pattern)


def missing_symbols(pairs: DataFrame, any_case: bool = True) -> DataFrame:
    """Symbols of the source that the translation lost (dice in either case are kept, if any_case): page_num, kind, symbol."""
    df = symbol_profile(pairs.where("source <> '' AND translation <> ''"), "source")
    return df.where(~present(F.col("symbol"), F.col("translation"), any_case)).select((F.col("page_index") + 1).alias("page_num"), "kind", "symbol")


def missing_values(pairs: DataFrame) -> DataFrame:
    """Rule values of the source that the translation lacks, each once a page: page_num, kind, value."""
    src = F.regexp_replace("source", T.SPACES, " ")
    rows = [_tagged(F.array_distinct(F.regexp_extract_all(src, F.lit(p), F.lit(1))), k, "value") for k, p in VALUES.items()]
    df = pairs.where("source <> '' AND translation <> ''").select("*", F.explode(F.concat(*rows)).alias("v")).select("*", "v.kind", "v.value")
    kept = F.regexp_like("translation", F.concat(F.lit("(?<!\\d)"), "value", F.lit("(?!\\d)")))
    return df.where(~kept).select((F.col("page_index") + 1).alias("page_num"), "kind", "value")


def translated_abbreviations(pairs: DataFrame) -> DataFrame:
    """Abbreviations that a word was put for: page_num, symbol, word (the first of its words)."""
    rows = []
    for symbol, words in ABBREVIATIONS.items():
        word = F.lit(None).cast("string")
        for w in reversed(words):
            word = F.when(F.col("translation").contains(w), F.lit(w)).otherwise(word)
        hit = F.upper("source").contains(symbol) & ~present(F.lit(symbol), F.col("translation")) & word.isNotNull()
        rows.append(F.when(hit, F.struct(F.lit(symbol).alias("symbol"), word.alias("word"))))
    df = pairs.where("source <> '' AND translation <> ''").select((F.col("page_index") + 1).alias("page_num"), F.explode(F.array(*rows)).alias("s"))
    return df.where("s IS NOT NULL").select("page_num", "s.*")


def kept_skills(pairs: DataFrame) -> DataFrame:
    """Skill names that stand on both sides: page_num, symbol."""
    both = lambda s: F.col("source").rlike(f"(?<![A-Za-z]){s}(?![A-Za-z])") & F.col("translation").rlike(f"(?<![A-Za-z]){s}(?![A-Za-z])")
    rows = F.filter(F.array(*(F.when(both(s), F.lit(s)) for s in SKILLS)), lambda x: x.isNotNull())
    return pairs.where("source <> '' AND translation <> ''").select((F.col("page_index") + 1).alias("page_num"), F.explode(rows).alias("symbol"))


def timeline(pairs: DataFrame) -> DataFrame:
    """Sentences with a time marker, of the translation or else the source, each once a page: page_num, ord, marker, event."""
    text = F.when(F.col("translation") != "", F.col("translation")).otherwise(F.col("source"))
    parts = F.transform(F.split(text, "(?<=[。.!?！？])\\s+|\\n+"), T.squeezed)
    df = pairs.select((F.col("page_index") + 1).alias("page_num"), F.posexplode(parts).alias("ord", "event")).where("event <> ''")
    df = df.withColumn("marker", F.regexp_extract("event", f"({TIME_MARKER})", 1)).where("marker <> ''")
    first = W.partitionBy("page_num", F.lower("marker"), "event").orderBy("ord")
    return df.withColumn("r", F.row_number().over(first)).where("r = 1").select("page_num", "ord", "marker", "event")
