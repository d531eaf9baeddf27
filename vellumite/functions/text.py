"""String, number and hash expressions over text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Java and RE2 agree on.
SPACES = "[ \\t\\r\\n\\x0b\\f]+"
#: Fixed value: how a stored failure begins.
FAILURE_PREFIX = "[Translation failed:"
#: Signatures of prompt text, any one of which is a leak.
PRIMARY_SIGNATURES = (
    "You are a professional TRPG translator",
    "professional TRPG translator",
    "Translation rules",
    "Translate each block below",
    "Previous context - DO NOT translate",
    "Glossary (this section)",
    "Translate ONLY the text content",
    "Return one translated block for each source block",
    "Do not merge blocks, remove markers",
    "您是专业的TRPG翻译",
    "你是专业的TRPG翻译",
    "专业的TRPG翻译",
    "正在处理Delta Green原始资料",
    "翻译规则包括",
    "翻译规则如下",
    "我将根据这些规则翻译",
)
#: Signatures of which two are a leak.
SECONDARY_SIGNATURES = (
    "Follow the glossary strictly",
    "Keep untranslated",
    "Output in Markdown format",
    "Professional, fluent Chinese",
    "Maintain horror atmosphere",
    "Do not translate page headers",
    "Preserve Markdown tables",
    "Preserve blockquotes",
    "Preserve [BLOCK",
    "严格遵循术语表",
    "保留未翻译",
    "输出Markdown",
    "专业流畅中文",
    "保持恐怖氛围",
    "简明翻译",
    "不翻译页眉页脚",
    "保留标题层级",
    "推测OCR错误",
    "保持上下文",
    "保留Markdown表格",
    "表格、卡片等标记",
    "待翻译文本",
)


def some(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    return F.btrim(some(c), F.lit(" \t\r\n\x0b\f"))


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(some(c), SPACES, " "))


def visible(c: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(some(c), SPACES, ""))


def cjk(c: Column) -> Column:
    return F.regexp_count(some(c), F.lit("[\\x{4e00}-\\x{9fff}]"))


def latin(c: Column) -> Column:
    return F.regexp_count(some(c), F.lit("[A-Za-z]"))


def latin_words(c: Column) -> Column:
    return F.regexp_count(some(c), F.lit("[A-Za-z]{3,}"))


def excerpt(c: Column, limit: int = 420) -> Column:
    """The squeezed text, cut to limit characters with an ellipsis."""
    s = squeezed(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit)), F.lit("...")))


def compact(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(some(c), "(?U)[\\W_]+", ""))


def failed(c: Column) -> Column:
    return F.regexp_replace(some(c), f"^{SPACES}", "").startswith(FAILURE_PREFIX)


def _pair_ok(source: Column, target: Column, layout: Column) -> Column:
    """Neither an art page nor a failure, both sides there, no contents page."""
    return (layout != "art") & ~failed(target) & (stripped(source) != "") & (stripped(target) != "") & ~source.contains("[[TOC]]")


def untranslated(source: Column, target: Column, layout: Column | None = None) -> Column:
    """A latin source whose target is latin still."""
    han, lat = cjk(target), latin(target)
    floor = F.greatest(F.lit(24), F.floor(visible(target) * 0.18))
    ratio = lat / F.greatest(lat + han, F.lit(1))
    enough = (latin(source) >= 80) & (latin_words(source) >= 20) & (lat >= 80)
    return _pair_ok(some(source), some(target), F.lit("") if layout is None else layout) & enough & (han < floor) & (ratio >= 0.72)


def ratio_floor(layout: Column) -> Column:
    return F.when(layout.isin("toc", "handout"), 0.18).otherwise(0.25)


def incomplete(source: Column, target: Column, layout: Column | None = None) -> Column:
    """A long latin source with a target that is far too short."""
    enough = (visible(source) >= 1200) & (latin(source) >= 700) & (latin_words(source) >= 120) & (cjk(target) >= 80)
    return _pair_ok(some(source), some(target), F.lit("") if layout is None else layout) & enough & (visible(target) / F.greatest(visible(source), F.lit(1)) < ratio_floor(F.lit("") if layout is None else layout))


def residue(c: Column) -> Column:
    """Text about latin characters that stayed, or the empty text."""
    han, lat = cjk(c), latin(c)
    ratio = lat / F.greatest(han + lat, F.lit(1))
    found = (visible(c) >= 160) & (lat >= 160) & (ratio >= 0.35)
    share = F.bround(ratio * 100, 0).cast("int").cast("string")
    return F.when(found, F.concat(F.lit("英文字符约 "), lat.cast("string"), F.lit(" 个，占中英文字符 "), share, F.lit("%"))).otherwise("")


def _plain(signature: str) -> str:
    return "".join(ch for ch in signature if ch.isalnum()).lower()


def prompt_leak(c: Column) -> Column:
    text = compact(c)
    any_primary = F.lit(False)
    for s in PRIMARY_SIGNATURES:
        any_primary = any_primary | text.contains(_plain(s))
    secondary = sum((text.contains(_plain(s)).cast("int") for s in SECONDARY_SIGNATURES), F.lit(0))
    return any_primary | (secondary >= 2)


def has_kana(c: Column) -> Column:
    return some(c).rlike("[\\x{3040}-\\x{30ff}]")


def has_elision(c: Column) -> Column:
    return some(c).rlike("[\\[\\(（【][ \\t\\r\\n]*(?:\\.{2,}|。{2,}|…+|省略[^\\]\\)）】]*)[ \\t\\r\\n]*[\\]\\)）】]")


def is_damaged(c: Column) -> Column:
    return some(c).rlike("(?i)\\[[ \\t\\r\\n]*damaged[ \\t\\r\\n]*\\]")


#: Labels that stay as they are.
KEPT_LABELS = ("STR", "CON", "DEX", "INT", "POW", "CHA", "SAN", "WP", "HP", "FBI", "CIA", "MJ-12", "A-CELL")


def leading_labels(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(some(c), F.lit("(?m)^[ \\t]*([A-Z][A-Z0-9 _-]*)[ \\t]*:"), F.lit(1)), lambda x: F.trim(x))


def copied_labels(source: Column, target: Column) -> Column:
    """Labels of the source that the target repeats, without those that stay."""
    kept = F.array(*(F.lit(x) for x in KEPT_LABELS))
    return F.array_sort(F.array_except(F.array_intersect(leading_labels(source), leading_labels(target)), kept))


def unusable(source: Column, target: Column) -> Column:
    """Any of the reasons for which a translation is not accepted."""
    soft = some(target).contains("­")
    return (stripped(target) == "") | prompt_leak(target) | has_kana(target) | has_elision(target) | is_damaged(target) | soft | (F.size(copied_labels(source, target)) > 0)


def no_soft_hyphens(c: Column) -> Column:
    return F.replace(some(c), F.lit("­"), F.lit(""))


def source_hash(c: Column) -> Column:
    return F.sha2(no_soft_hyphens(c), 256)


def label_key(c: Column) -> Column:
    """Key of an exact label: no bars or colons at the ends, lower case."""
    return F.lower(F.regexp_replace(no_soft_hyphens(c), "^[ \\t\\r\\n|:：]+|[ \\t\\r\\n|:：]+$", ""))


def variants(term: Column) -> Column:
    """Plural and verb forms of a lower-case term: s, es, ies, d or ed, ing."""
    n = F.length(term)
    stem = F.substring(term, F.lit(1), n - 1)
    ends = lambda x: term.endswith(x)
    forms = F.array(
        F.when(~ends("s"), F.concat(term, F.lit("s"))),
        F.when(~ends("es"), F.concat(term, F.lit("es"))),
        F.when(ends("y") & (n > 1) & ~F.substring(term, n - 1, F.lit(1)).isin(*"aeiou"), F.concat(stem, F.lit("ies"))),
        F.when(~ends("ed"), F.concat(term, F.when(ends("e"), "d").otherwise("ed"))),
        F.when(~ends("ing"), F.concat(F.when(ends("e") & ~ends("ee"), stem).otherwise(term), F.lit("ing"))),
    )
    return F.filter(forms, lambda x: x.isNotNull())


#: What optical recognition reads and what may be meant.
CONFUSED = {"0": "Oo", "O": "0", "o": "0", "1": "lIi", "l": "1Ii", "I": "1li", "i": "1lI", "5": "Ss", "S": "5", "s": "5", "8": "Bb", "B": "8", "b": "8"}


def confusions(candidate: Column, target: Column) -> Column:
    """Number of confused characters of two texts of one length; null if any other place differs or the lengths do."""
    pairs = [read + meant for read, meants in CONFUSED.items() for meant in meants]

    def cost(x: Column, y: Column) -> Column:
        return F.when(F.lower(x) == F.lower(y), 0).when(F.concat(x, y).isin(pairs), 1)

    parts = F.zip_with(F.split(candidate, ""), F.split(target, ""), cost)
    return F.when(F.length(candidate) == F.length(target), F.aggregate(parts, F.lit(0), lambda t, x: t + x))


def size_text(n: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    d = n.cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1 << 20, F.format_string("%.1f KB", F.bround(d / 1024, 1)))
        .when(n < 1 << 30, F.format_string("%.1f MB", F.bround(d / (1 << 20), 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(d / (1 << 30), 1)))
    )


def duration_text(seconds: Column) -> Column:
    """Seconds as "1h 2m", "3m 4s" or "5s"."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def any_of(c: Column, parts: Sequence[str]) -> Column:
    """Does the text hold any of the parts?"""
    found = F.lit(False)
    for p in parts:
        found = found | c.contains(p)
    return found


def hex_colour(n: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(n.bitwiseAND(0xFFFFFF)), 6, "0")))


def luminance(n: Column) -> Column:
    r, g, b = (F.shiftright(n, k).bitwiseAND(255) for k in (16, 8, 0))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def roman_value(c: Column) -> Column:
    """Value of a roman numeral; a smaller digit before a larger one counts against it."""
    digit = F.create_map(*[F.lit(x) for k, v in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in (k, v)])
    values = F.transform(F.split(F.upper(c), ""), lambda x: digit[x])
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("sum"))
    step = lambda a, v: F.struct(v.alias("last"), F.when(v > a["last"], a["sum"] - 2 * a["last"] + v).otherwise(a["sum"] + v).alias("sum"))
    return F.aggregate(values, start, step, lambda a: a["sum"])
