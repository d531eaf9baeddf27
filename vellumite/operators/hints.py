"""Roles of lines by their style, entries of contents pages, columns around obstacles, and hints applied to pages.

Everything is said with column expressions, windows and joins by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import blocks as B
from vellumite.functions import text as T

#: Fixed value: a date that is a subheading.
DATE_HEADING = "(?i)^(?:JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)\\s+\\d{1,2}(?:\\s+\\([^)]+\\))?$"


def line_class(text: Column, size: Column, bold: Column, accent: Column, angle: Column, usual_accents: bool = True) -> Column:
    """struct(font_role, role) of a line (x0 to y1, page_width, page_height, median_size, max_size), the first that holds.

    usual_accents: the accent colours are those of all documents, in which case the colour alone makes a heading;
    others need a larger size or a short bold line.
    """
    c = F.col
    s = T.stripped(T.some(text))
    short_bold = (F.length(s) <= 48) & bold
    accented = accent & (F.lit(usual_accents) | (size >= c("median_size") * 1.15) | short_bold)
    larger = (size >= c("median_size") * 1.15) & (F.length(s) <= 72) & bold
    callout = (c("y0") >= c("page_height") * 0.75) & (F.abs((c("x0") + c("x1")) / 2 - c("page_width") / 2) <= c("page_width") * 0.10)
    of = lambda font, role: F.struct(F.lit(font).alias("font_role"), F.lit(role).alias("role"))
    return (
        F.when((c("y1") <= c("page_height") * 0.085) & (F.abs(F.coalesce(angle, F.lit(0.0))) < 1.0), of("running_header", "header"))
        .when((c("y0") >= c("page_height") * 0.90) & s.rlike("^\\p{Nd}+$"), of("footer", "footer"))
        .when((size >= c("max_size") * 0.85) & (size >= c("median_size") * 1.55), of("display", "title"))
        .when(accented, of("section", "subtitle"))
        .when(bold & s.rlike(DATE_HEADING), of("subsection", "subtitle"))
        .when(size >= c("median_size") * 1.75, of("section", "subtitle"))
        .when(larger & callout, of("callout", "subtitle"))
        .when(larger, of("subsection", "subtitle"))
        .otherwise(of("body", "body_column"))
    )


#: A title with its page behind a leader or blanks, and one with the page right at its end.
INLINE, COMPACT = "^(.+?)(?:\\.{3,}|-{3,}|\\s{2,}|\\s+)(\\d{1,4})$", "^(.*[A-Za-z][^\\d]*?)(\\d{1,4})$"


def contents_entries(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, entries: the lines (keys, line_no, line) of a contents block as "title ........ page"; a number on a line of its own belongs to the title before it."""
    w = W.partitionBy(*keys).orderBy("line_no")
    clean = T.squeezed(F.regexp_replace(F.replace(T.some(F.col("line")), F.lit("\b"), F.lit(" ")), "^[\\s•*\\-]+", ""))
    df = lines.select(*keys, "line_no", clean.alias("t")).where((F.col("t") != "") & ~B.is_contents_title(F.col("t")))
    kind = F.when(F.col("t").rlike("^\\d{1,4}$"), "number").when(F.col("t").rlike(INLINE), "inline").when(F.col("t").rlike(COMPACT), "compact").otherwise("plain")
    df = df.withColumn("kind", kind).withColumn("before", F.lag(F.struct("kind", "t")).over(w)).withColumn("after", F.lead("kind").over(w))
    paired = lambda p: F.concat(F.btrim(F.regexp_replace(F.regexp_extract("t", p, 1), "[.\\-]{3,}\\s*$", ""), F.lit(" -\t")), F.lit(" ........ "), F.regexp_extract("t", p, 2))
    entry = (
        F.when(F.col("kind") == "number", F.when(F.col("before.kind") == "plain", F.concat(F.col("before.t"), F.lit(" ........ "), "t")).otherwise(F.col("t")))
        .when(F.col("kind") == "inline", paired(INLINE))
        .when(F.col("kind") == "compact", paired(COMPACT))
        .when(F.coalesce(F.col("after") != "number", F.lit(True)), F.col("t"))
    )
    parts = F.sort_array(F.collect_list(F.when(F.col("entry").isNotNull(), F.struct("line_no", "entry"))))
    return df.withColumn("entry", entry).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["entry"]), "\n").alias("entries"))


def column_sections(columns: DataFrame, blocks: DataFrame, obstacles: DataFrame, page: str) -> DataFrame:
    """page, col, section, n, x0, y0, x1, y1, error: columns cut where boxes stand in them that overlap a fifth of the narrower width.

    columns: page, col and a box; blocks: page, col and a box; obstacles: page and a box. A block is in the section
    after the obstacles that end above its middle; a section reaches down to 3 points above the next one.
    """
    sides = ("x0", "y0", "x1", "y1")
    box = lambda df, p, *more: df.select(page, *more, *(F.col(k).alias(f"{p}{k}") for k in sides))
    c = box(columns, "c", "col")
    o = box(obstacles, "o").join(c, page)
    width = F.least(F.col("cx1") - F.col("cx0"), F.col("ox1") - F.col("ox0"))
    o = o.where((F.col("oy1") > F.col("cy0")) & (F.col("oy0") < F.col("cy1")) & (F.least("cx1", "ox1") - F.greatest("cx0", "ox0") >= width * 0.2)).select(page, "col", "oy0", "oy1")
    o = o.withColumn("section", F.row_number().over(W.partitionBy(page, "col").orderBy("oy0", "oy1")) - 1)
    b = blocks.select(page, "col", F.monotonically_increasing_id().alias("_id"), *sides)
    b = b.join(o.select(page, "col", "oy1"), [page, "col"], "left").groupBy(page, "col", "_id", *sides)
    b = b.agg(F.count_if((F.col("y0") + F.col("y1")) / 2 >= F.col("oy1")).cast("int").alias("section"))
    groups = b.groupBy(page, "col", "section").agg(F.count("*").alias("n"), F.min("y0").alias("top"), F.max("y1").alias("low"))
    df = groups.join(c, [page, "col"]).join(o.select(page, "col", "section", "oy0"), [page, "col", "section"], "left")
    y0 = F.greatest("cy0", "top")
    y1 = F.least("cy1", F.greatest(F.col("low"), F.coalesce("oy0", "cy1") - 3.0))
    return df.select(page, "col", "section", "n", F.col("cx0").alias("x0"), y0.alias("y0"), F.col("cx1").alias("x1"), y1.alias("y1"), F.when(y1 <= y0, "no height").alias("error"))


def hinted_pages(blocks: DataFrame, page_hints: DataFrame, skipped: DataFrame, order: DataFrame, page: str) -> DataFrame:
    """page, page_type, id, place, translatable: blocks (page, page_type, id, pos, translatable) with hints applied.

    page_hints: page, page_type (null: as it is); skipped: page, id of blocks that are not translated; order: page,
    pos, id. Where a page has an order its blocks come first in it and the others after them as they were. Hints for
    pages or blocks that are not there change nothing (see `review.broken_references`).
    """
    types = page_hints.select(page, F.col("page_type").alias("_type"))
    skip = skipped.select(page, "id").distinct().withColumn("_skip", F.lit(True))
    at = order.groupBy(page, "id").agg(F.min("pos").alias("_at"))
    df = blocks.join(types, page, "left").join(skip, [page, "id"], "left").join(at, [page, "id"], "left")
    place = F.row_number().over(W.partitionBy(page).orderBy(F.col("_at").asc_nulls_last(), "pos", "id")) - 1
    return df.select(page, F.coalesce("_type", "page_type").alias("page_type"), "id", place.alias("place"), (F.col("translatable") & F.col("_skip").isNull()).alias("translatable"))


def hinted_columns(members: DataFrame, blocks: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """page, col, n, x0, y0, x1, y1, error: columns (page, col, id) as the common box of their blocks' regions; a block without a region's box is an error."""
    df = members.join(blocks.select(page, "id", "region_id"), [page, "id"], "left").join(regions.select(page, "region_id", "x0", "y0", "x1", "y1"), [page, "region_id"], "left")
    lost = F.min(F.when(F.col("x0").isNull(), F.col("id").cast("string")))
    boxes = [(F.min if k[1] == "0" else F.max)(k).alias(k) for k in ("x0", "y0", "x1", "y1")]
    return df.groupBy(page, "col").agg(F.count("*").alias("n"), *boxes, F.when(lost.isNotNull(), F.concat(F.lit("no box of block "), lost)).alias("error"))
