"""Table functions: texts to blocks and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T

#: Characters in the blocks that a task hands on at once, and the most blocks.
CUT_CHARS = 1 << 20
CUT_BLOCKS = 1 << 18

_BLOCK = "(?s)\\[BLOCK (\\d+)\\]\\s*(.*?)\\s*\\[/BLOCK \\1\\]"


def parsed_blocks(df: DataFrame, on_duplicate: str = "first") -> DataFrame:
    """Marked answers to blocks: id, block, text. Of blocks with one number the first counts, or two are an error."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("response", F.lit(_BLOCK), F.lit(1)).alias("n"), F.regexp_extract_all("response", F.lit(_BLOCK), F.lit(2)).alias("t")
    )
    out = df.select("id", F.posexplode(pairs).alias("pos", "b")).select("id", "pos", F.col("b.n").cast("int").alias("block"), F.col("b.t").alias("text"))
    out = out.withColumn("r", F.row_number().over(W.partitionBy("id", "block").orderBy("pos")))
    if on_duplicate == "error":
        twice = F.raise_error(F.concat(F.lit("block twice: "), F.col("block").cast("string")))
        return out.withColumn("block", F.when(F.col("r") > 1, twice).otherwise(F.col("block"))).select("id", "block", "text")
    return out.where("r = 1").select("id", "block", "text")


def built_blocks(df: DataFrame) -> DataFrame:
    """Blocks (id, block, text) to one marked text for each id."""
    one = F.concat(F.lit("[BLOCK "), F.col("block").cast("string"), F.lit("]\n"), F.col("text"), F.lit("\n[/BLOCK "), F.col("block").cast("string"), F.lit("]"))
    parts = F.sort_array(F.collect_list(F.struct("block", one.alias("t"))))
    return df.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("request"))


def marker_ids(expected: Column, found: Column) -> Column:
    """Missing and extra ids of a marked answer."""
    return F.struct(F.array_sort(F.array_except(expected, found)).alias("missing"), F.array_sort(F.array_except(found, expected)).alias("extra"))


def marked(df: DataFrame, name: str) -> DataFrame:
    """The contents between lines that begin with [NAME] and [/NAME]: id, pos, body."""
    body = F.regexp_extract_all("text", F.lit(f"(?ms)^\\[{name}\\]\\s*(.*?)^\\[/{name}\\]"), F.lit(1))
    return df.select("id", F.posexplode(body).alias("pos", "body")).withColumn("body", T.stripped(F.col("body")))


def headings(df: DataFrame, deepest: int = 4) -> DataFrame:
    """Lines that are headings: id, line, level, title."""
    lines = df.select("id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("t", T.stripped(F.col("t")))
    lines = lines.where(F.col("t").rlike(f"^#{{1,{deepest}}}[ \\t]+\\S"))
    return lines.select("id", "line", F.length(F.regexp_extract("t", "^(#+)", 1)).alias("level"), T.squeezed(F.regexp_extract("t", "^#+[ \\t]+(.*)$", 1)).alias("title"))


def rule_references(df: DataFrame, most: int = 12) -> DataFrame:
    """Sentences that speak of rules, each once a text and the first of them only: id, pos, excerpt."""
    parts = F.transform(F.split(T.some(F.col("text")), "(?<=[。.!?！？])\\s+|\\n+"), T.squeezed)
    rows = df.select("id", F.posexplode(parts).alias("pos", "s")).where(F.col("s").rlike("(?i)\\b\\d+d\\d+\\b|\\bSAN\\b|\\bHP\\b|\\bWP\\b|检定|技能|损失|roll|test"))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("id", F.lower("s")).orderBy("pos"))).where("r = 1")
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("pos"))).where(F.col("r") <= most)
    return rows.select("id", "pos", T.excerpt(F.col("s"), 180).alias("excerpt"))


def module_structure(df: DataFrame) -> DataFrame:
    """Headings, marked blocks and rule references of texts in one relation: id, kind, name."""
    from vellumite.functions.blocks import first_content_line

    named = lambda d, kind: d.select("id", F.lit(kind).alias("kind"), F.coalesce(F.nullif(first_content_line(F.col("body")), F.lit("")), F.lit(kind)).alias("name"))
    heads = headings(df).select("id", F.lit("标题").alias("kind"), F.col("title").alias("name"))
    refs = rule_references(df).select("id", F.lit("规则").alias("kind"), F.col("excerpt").alias("name"))
    return heads.unionByName(named(marked(df, "STAT_BLOCK"), "数据块")).unionByName(named(marked(df, "CARD"), "卡片")).unionByName(refs)


def without_images(c: Column) -> Column:
    """The text without [IMAGE]…[/IMAGE]; marks that do not pair are an error."""
    count = lambda mark: F.regexp_count(c, F.lit(mark))
    bad = count("\\[IMAGE\\]") != count("\\[/IMAGE\\]")
    return F.when(bad, F.raise_error(F.lit("image marks do not pair"))).otherwise(F.regexp_replace(c, "(?s)\\[IMAGE\\].*?\\[/IMAGE\\]", ""))


def table_cells(c: Column) -> Column:
    """Cells of a table line."""
    return F.transform(F.split(F.regexp_replace(F.trim(c), "^\\||\\|$", ""), "\\|"), lambda x: F.trim(x))


def is_separator(c: Column) -> Column:
    cells = table_cells(c)
    return (F.size(cells) > 0) & F.forall(cells, lambda x: x.rlike("^:?-{3,}:?$"))


def html_text(c: Column) -> Column:
    return F.regexp_replace(T.some(c), "<[^>]+>", " ")


def is_prose(c: Column, least: int = 30) -> Column:
    """More than `least` letters outside of tags."""
    return F.regexp_count(html_text(c), F.lit("\\p{L}")) > least


_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_LIST = re.compile(r"^(\s*)([-*+]|\d+\.)\s+(.+)$")
_QUOTE = re.compile(r"^(\s*>+\s?)(.*)")
_IMAGE = re.compile(r"^!\[[^\]]*\]\([^)]+\)\s*$")
_FENCE = re.compile(r"^\s*(```|~~~)")
_TABLE = re.compile(r"^\|.")
#: Tags that open a block.
_TAGS = "div table pre p ul ol dl fieldset form h1 h2 h3 h4 h5 h6 hr blockquote address article aside details figcaption figure footer header hgroup main nav section summary".split()
_HTML = re.compile(r"^<(" + "|".join(_TAGS) + r")\b", re.IGNORECASE)
#: Three marks and no more, as in the reference; a longer rule is text.
_RULE = re.compile(r"^\s*([-*_])\s*\1\s*\1\s*$")
#: What ends a list item or a paragraph without an empty line.
_ENDS_ITEM = (_HEADING, _RULE, _FENCE, _IMAGE)
_ENDS_PARAGRAPH = (*_ENDS_ITEM, _TABLE, _LIST, _QUOTE, _HTML)


def markdown_rows(text: str) -> list[tuple[int, str, str, int, int]]:
    """Blocks of a Markdown text: number, kind, content, first and last line."""
    return list(_markdown_rows(text))


def _markdown_rows(text: str) -> Iterator[tuple[int, str, str, int, int]]:
    """What follows the last line end is a line too, if only an empty one."""
    *lines, rest = _LINE_END.split(text or "")
    if rest:
        lines.append(rest)
    n = i = 0

    def run(first: int, test) -> int:
        last = first
        while last + 1 < len(lines) and test(lines[last + 1]):
            last += 1
        return last

    def closing(first: int, test) -> int:
        return min(run(first, lambda x: not test(x)) + 1, len(lines) - 1)

    while i < len(lines):
        line, last = lines[i], i
        if not line.strip():
            kind = "empty_line"
        elif i == 0 and line.rstrip() == "---":
            kind, last = "front_matter", closing(i, lambda x: x.rstrip() == "---")
        elif m := _FENCE.match(line):
            mark = m[1]
            kind, last = "code_block", closing(i, lambda x: x.strip().startswith(mark) and not x.strip().rstrip("`~"))
        elif _RULE.match(line):
            kind = "hr"
        elif _IMAGE.match(line):
            kind = "image"
        elif _HEADING.match(line):
            kind = "heading"
        elif _TABLE.match(line) and (last := run(i, _TABLE.match)) > i:
            kind = "table"
        elif _QUOTE.match(line):
            kind, last = "blockquote", run(i, _QUOTE.match)
        elif m := _LIST.match(line):
            indent, inner = len(m[1]), len(m[1]) + len(m[2]) + 1
            within = lambda x: (m := _LIST.match(x)) is None or len(m[1]) >= inner
            kind, last = "list_item", run(i, lambda x: x.strip() and len(x) - len(x.lstrip()) > indent and within(x) and not any(p.match(x) for p in _ENDS_ITEM))
        elif m := _HTML.match(line):
            kind, tag = "html_block", f"</{m[1]}"
            if tag not in line.lower():
                last = run(i, lambda x: x.strip() and tag not in x.lower())
                last += last + 1 < len(lines) and tag in lines[last + 1].lower()
        else:
            kind, last = "paragraph", run(i, lambda x: x.strip() and not any(p.match(x) for p in _ENDS_PARAGRAPH))
        yield n, kind, "\n".join(lines[i : last + 1]), i, last
        n, i = n + 1, last + 1
    if not rest:
        yield n, "empty_line", "", i, i


def markdown_text(kind: str, content: str) -> tuple[str, bool, str, str]:
    """Of a block: the text to translate, whether there is one, and the marks and the indent that were taken off it."""
    if kind == "heading":
        m = _HEADING.match(content)
        return m[2].strip(), True, f"{m[1]} ", ""
    if kind == "list_item":
        first, *more = content.split("\n")
        m = _LIST.match(first)
        return " ".join([m[3].strip(), *(x.lstrip() for x in more)]), True, f"{m[2]} ", m[1]
    if kind == "blockquote":
        return "\n".join(_QUOTE.match(x)[2] for x in content.split("\n")), True, "> ", ""
    if kind in ("paragraph", "table") or kind == "html_block" and _letters(content) > 30:
        return content, True, "", ""
    return "", False, "", ""


def _letters(html: str) -> int:
    """Letters outside of tags; behind the last > is no tag, and a search for one would go to the end from each <."""
    end = html.rfind(">") + 1
    return sum(c.isalpha() for part in (re.sub("<[^>]+>", " ", html[:end]), html[end:]) for c in part)


def cut_texts(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of the texts in frames of id and text, in parts of some CUT_CHARS and at most CUT_BLOCKS."""
    columns = ["id", "block", "kind", "content", "text", "translatable", "prefix", "indent", "line_start", "line_end"]
    for pdf in rows:
        made, size = [], 0
        for i, t in zip(pdf["id"], pdf["text"], strict=True):
            for n, kind, content, first, last in _markdown_rows(t):
                made.append((i, n, kind, content, *markdown_text(kind, content), first, last))
                size += len(content) + 1
                if size >= CUT_CHARS or len(made) >= CUT_BLOCKS:
                    yield pd.DataFrame(made, columns=columns)
                    made, size = [], 0
        if made:
            yield pd.DataFrame(made, columns=columns)


def markdown_blocks(df: DataFrame) -> DataFrame:
    """id, block, kind, content, text, translatable, prefix, indent, line_start, line_end: the blocks of each text, which together are the whole of it."""
    kind = df.schema["id"].dataType.simpleString()
    block = "block int, kind string, content string, text string, translatable boolean, prefix string, indent string, line_start int, line_end int"
    return df.select("id", "text").mapInPandas(cut_texts, f"id {kind}, {block}")
