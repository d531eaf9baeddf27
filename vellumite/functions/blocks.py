"""Predicates and clean-ups of single lines and blocks of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumite.functions import text as T

#: Markers that stand on lines of their own.
MARKERS = ("[CARD]", "[/CARD]", "[STAT_BLOCK]", "[/STAT_BLOCK]", "[IMAGE]", "[/IMAGE]", "[FULL_WIDTH_TITLE]", "[/FULL_WIDTH_TITLE]")
HAN = "[\\x{4e00}-\\x{9fff}]"
#: Labels of cards, any letter case.
CARD_LABELS = (
    r"\b(?:YELLOW|GREEN|RED|BLUE|WHITE|BLACK)\s+CARD\b",
    r"\bPLAYER\s+AID\b",
    r"\bSUBJECT\s*:",
    r"\bPROFILE\s+OF\b",
    r"\b(?:Birth|Medical|Police|USMC|Military|News|School|Juvenile)\s+Records?\b",
    r"\A\s*(?:Timeline|Briefing|Report|Memo|Evidence|Clue|Handout|Photograph|Letter|Note)\b",
    r"^\s*DISINFORMATION\b",
    r"^\s*OPINT\s*:",
    r"^\s*IN\s+THE\s+FIELD\s*:",
    r"^\s*TRADECRAFT\s*:",
    r"^\s*CASE\s+FILE\b",
    r"^\s*FIELD\s+NOTES?\b",
    r"^\s*INTELLIGENCE\s+BRIEF\b",
    r"^\s*SITUATION\s+REPORT\b",
    r"^\s*AFTER[\s-]?ACTION\b",
    r"^\s*OPERATION(?:AL)?\s+(?:BRIEF|NOTES?|INTEL)\b",
)


def plain(c: Column) -> Column:
    """Without emphasis marks."""
    return F.regexp_replace(F.regexp_replace(T.stripped(c), "\\*\\*(.+?)\\*\\*", "$1"), "\\*(.+?)\\*", "$1")


def is_heading(c: Column) -> Column:
    return T.stripped(c).rlike("^#{1,6}\\s+")


def normal_heading(c: Column) -> Column:
    """A heading line without marks inside its title; other lines as they are."""
    s = T.stripped(c)
    title = F.regexp_extract(s, "^#{1,6}\\s+(.+)$", 1)
    title = F.regexp_replace(title, "\\s*#{1,6}\\s*", " ")
    title = T.squeezed(F.regexp_replace(F.regexp_replace(title, "\\*\\*(.+?)\\*\\*", "$1"), "\\*(.+?)\\*", "$1"))
    made = F.concat(F.regexp_extract(s, "^(#{1,6})", 1), F.lit(" "), title)
    return F.when(~s.rlike("^#{1,6}\\s+.+$"), c).when(title == "", s).otherwise(made)


def visible_length(c: Column) -> Column:
    """Length of what a reader sees: no comments, markers, list and heading marks, emphasis or white space."""
    t = F.regexp_replace(T.some(c), "(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, "(?m)^\\[/?(?:CARD|STAT_BLOCK|IMAGE|FULL_WIDTH_TITLE)\\]\\s*$", "")
    t = F.regexp_replace(t, "(?m)^#{1,6}\\s*", "")
    t = F.regexp_replace(t, "(?m)^\\s*[-*+]\\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, "\\*\\*(.+?)\\*\\*", "$1"), "\\*(.+?)\\*", "$1")
    return F.length(F.regexp_replace(t, T.SPACES, ""))


def list_item(c: Column) -> Column:
    """The item of a list line, or null."""
    s = T.stripped(c)
    item = T.squeezed(F.regexp_extract(s, "^(?:[-*+•]|\\d+[.)、])\\s+(.*)$", 1))
    return F.when(item != "", item)


def is_plain_heading(c: Column) -> Column:
    """A short line of 4 to 18 visible characters without CJK, digits or punctuation."""
    s = plain(c)
    n = F.length(F.regexp_replace(s, T.SPACES, ""))
    return ~s.isin(*MARKERS) & ~s.rlike("^(#|-|•|//|——|“|\")") & n.between(4, 18) & ~s.rlike(HAN) & ~s.rlike("[。！？!?；;：:，,、（）()《》\"“”\\d]")


def is_soft_subheading(c: Column) -> Column:
    """A line of 5 to 28 visible characters with CJK that ends in a question mark or colon."""
    s = plain(c)
    n = F.length(F.regexp_replace(s, T.SPACES, ""))
    return s.rlike(HAN) & list_item(s).isNull() & ~s.rlike("^[\\[#|>`]") & n.between(5, 28) & ~s.rlike("[。；：，、（）【】《》\"“”]$") & s.rlike("[？?：:]$")


def is_structural(c: Column) -> Column:
    """Lines that are never joined with their neighbours."""
    s = T.stripped(c)
    short = F.length(F.regexp_replace(s, T.SPACES, "")) <= 10
    return (s == "") | s.isin(*MARKERS, "[[TOC]]") | s.rlike("^(#|-|•|\\||>|```)") | list_item(s).isNotNull() | is_soft_subheading(s) | (short & is_plain_heading(s))


def is_exportable_heading(title: Column) -> Column:
    """1 to 32 visible characters, no punctuation inside, no attribute line, no broken characters."""
    s = T.squeezed(title)
    n = F.length(F.regexp_replace(s, T.SPACES, ""))
    stats = s.rlike("(?i)^\\d+\\s+(?:STR|CON|DEX|INT|POW|CHA|SIZ|APP|EDU|SAN|HP)\\b")
    return (s != "") & ~s.contains("�") & ~s.contains("]") & n.between(1, 32) & ~stats & ~s.rlike("[。！？!?；;，,、]")


def unquoted(c: Column) -> Column:
    return F.regexp_replace(T.stripped(c), "^(?:>\\s*)+", "")


def row_cells(c: Column) -> Column:
    inner = F.regexp_replace(F.trim(unquoted(c)), "^\\|+|\\|+$", "")
    return F.transform(F.split(inner, "\\|"), lambda x: F.trim(x))


def is_table_row(c: Column) -> Column:
    cells = row_cells(c)
    return unquoted(c).contains("|") & (F.size(cells) >= 2) & F.exists(cells, lambda x: x != "")


def is_table_separator(c: Column) -> Column:
    return unquoted(c).contains("|") & F.forall(row_cells(c), lambda x: x.rlike("^:?-{3,}:?$"))


def is_list_like(c: Column) -> Column:
    """Of at least two lines, half and more look like items."""
    lines = F.filter(F.transform(F.split(T.some(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    items = F.filter(lines, lambda x: x.rlike("^(\\d+[.)]\\s|[-•●◦▪]\\s|[a-zA-Z][.)]\\s)"))
    return (F.size(lines) >= 2) & (F.size(items) >= 0.5 * F.size(lines))


def is_table_like(c: Column) -> Column:
    """Of at least three lines, six tenths and more have a tab, or three blanks inside."""
    lines = F.split(T.stripped(c), "\n")
    tabs = F.size(F.filter(lines, lambda x: x.contains("\t")))
    wide = F.size(F.filter(lines, lambda x: F.trim(x).contains("   ")))
    return (F.size(lines) >= 3) & (F.greatest(tabs, wide) >= 0.6 * F.size(lines))


def is_fixed(c: Column, role: Column) -> Column:
    """Nothing to translate: blank, no letters, or a footer of digits."""
    s = T.stripped(c)
    return (s == "") | ((role == "footer") & s.rlike("^\\d+$")) | ~s.rlike("\\p{L}")


def is_contents_title(c: Column) -> Column:
    only = F.lower(F.regexp_replace(T.some(c), "[^A-Za-z]", ""))
    twice = only.startswith("contents") & only.endswith("contents") & (F.length(only) <= 64)
    return only.isin("contents", "index") | (T.some(c).contains("//") & only.startswith("contents")) | twice


def has_leaders(c: Column) -> Column:
    """Dotted lines to page numbers."""
    dots = F.length(T.some(c)) - F.length(F.replace(T.some(c), F.lit("."), F.lit("")))
    return (dots >= 20) & (F.regexp_count(T.some(c), F.lit("\\.{4,}\\s*\\d{1,3}")) >= 3)


def has_card_label(c: Column) -> Column:
    found = F.lit(False)
    for p in CARD_LABELS:
        found = found | T.some(c).rlike(f"(?im){p}")
    return found


def is_handout(c: Column, monospace: Column) -> Column:
    return monospace & T.some(c).rlike("(?i)\\b(SUBJECT|Records?|Stories?|Profile)\\b")


def is_stat_block(c: Column) -> Column:
    """Four attributes with numbers; or two with derived values; or one with game sections."""
    up = F.upper(T.some(c))
    hits = sum((up.rlike(f"\\b{a}\\s*\\d+").cast("int") for a in ("STR", "CON", "DEX", "INT", "POW", "CHA")), F.lit(0))
    derived = up.rlike("\\b(?:HP|WP|SAN)\\s*\\d+")
    sections = T.some(c).rlike("(?i)(?:SKILLS|ATTACKS|ARMOR|DISORDER|技能|攻击|护甲|障碍)\\s*[：:]")
    return (hits >= 4) | ((hits >= 2) & derived) | ((hits >= 1) & sections)


def is_red(r: Column, g: Column, b: Column) -> Column:
    return (r >= 120) & (r > 1.35 * g) & (r > 1.35 * b)


def cleaned(c: Column) -> Column:
    """Joined hyphenations, single blanks, no lines of page numbers, at most one blank line."""
    t = F.regexp_replace(T.some(c), "(?U)(\\w)-\\s*\\n\\s*(\\w)", "$1$2")
    t = F.regexp_replace(t, "  +", " ")
    t = F.regexp_replace(t, "(?m)^\\s*\\d{1,3}\\s*$", "")
    return T.stripped(F.regexp_replace(t, "\\n{3,}", "\n\n"))


def context_text(c: Column, layout: Column, n: int = 1200) -> Column:
    """The end of a page as context: no fenced blocks, markers or tables; quotes without their marks."""
    t = F.regexp_replace(T.some(c), "(?ms)^[ \\t]*```.*?^[ \\t]*```[^\\n]*$", "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: ~x.isin(*MARKERS, "[[TOC]]") & ~x.rlike("^\\|.*\\|"))
    joined = F.array_join(F.transform(lines, lambda x: F.when(x.startswith(">"), F.trim(F.regexp_replace(x, "^>+", ""))).otherwise(x)), "\n")
    return F.when(layout == "toc", "").otherwise(F.right(cleaned(joined), F.lit(n)))


def header_title(c: Column) -> Column:
    """A short running title out of a file's name."""
    t = F.trim(F.regexp_replace(T.some(c), "_+", " "))
    t = F.regexp_replace(t, "(?i)\\b(?:upload|z-library(?:\\.[a-z]+)?|1lib(?:\\.[a-z]+)?|z-lib(?:\\.[a-z]+)?|full proof \\d+)\\b", "")
    t = F.regexp_replace(F.regexp_replace(t, "(?i)\\bcn\\b$", ""), "(?i)\\b[a-f0-9]{8,}\\b", "")
    t = F.when(t.contains(" - "), F.trim(F.regexp_extract(t, "(?s)^.*? - (.*)$", 1))).otherwise(t)
    parts = F.filter(F.transform(F.split(t, "[.·]"), lambda x: F.trim(x)), lambda x: x != "")
    t = F.when(~t.rlike(HAN) & (F.size(parts) > 0), F.get(parts, F.lit(0))).otherwise(t)
    return F.left(F.btrim(T.squeezed(t), F.lit(" ._-")), F.lit(32))


def first_content_line(c: Column, n: int = 80) -> Column:
    lines = F.filter(F.transform(F.split(T.some(c), "\n"), T.squeezed), lambda x: x != "")
    return F.left(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.lit(n))


def safe_stem(c: Column) -> Column:
    return F.regexp_replace(T.some(c), "[^A-Za-z0-9._-]+", "_")


def json_string(c: Column) -> Column:
    """A JSON string as Python writes it without escaping non-ASCII characters."""
    t = T.some(c)
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), t, F.lit('"'))


def cache_key(model: Column, version: Column, system: Column, user: Column) -> Column:
    """Digest of the sorted JSON object of a request, with blanks after commas and colons."""
    pairs = (("model", model), ("prompt_version", version), ("system_prompt", system), ("user_prompt", user))
    body = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), json_string(v)) for k, v in pairs))
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def targeted_key(block_id: Column, source: Column, signature: Column) -> Column:
    """Digest of the compact JSON object of a block, its source's hash and its target's signature."""
    pairs = (("block_id", block_id), ("source_hash", T.source_hash(source)), ("target_signature", signature))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), json_string(v)) for k, v in pairs)), F.lit("}")), 256)


def colour_of(parts: Column) -> Column:
    """Hex colour of an array of 1 (gray), 3 (RGB) or 4 (CMYK) shares; null for anything else."""
    byte = lambda x: F.lpad(F.lower(F.hex(F.floor(x * 255 + F.lit(1e-12)).cast("bigint"))), 2, "0")
    at = lambda i: F.get(parts, F.lit(i))
    ink = lambda i: byte((1 - at(i)) * (1 - at(3)))
    made = F.when(F.size(parts) == 1, F.concat(byte(at(0)), byte(at(0)), byte(at(0)))).when(F.size(parts) == 3, F.concat(byte(at(0)), byte(at(1)), byte(at(2))))
    return F.concat(F.lit("#"), made.when(F.size(parts) == 4, F.concat(ink(0), ink(1), ink(2))))
