"""Reading order of the blocks of a page, its layout, and its blocks joined to paragraphs.

Blocks have page, id, x0, y0, x1, y1, page_width, page_height, text, n_lines, font_size (mean of the block) and
median_size (of the page); reading orders also take is_text, which is false for images. Everything is said with
windows, joins and aggregates by page; ties of place are broken by id. Blocks without a corner belong to no column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import blocks as B
from vellumite.functions import text as T
from vellumite.operators import boxes, pages

#: Parts of the names of fonts with serifs.
SERIFS = ("Sabon", "Times", "Garamond", "Minion", "Caslon")


def title_card(longest: int | None = 120) -> Column:
    c = F.col
    return F.coalesce(pages.is_title_card(c("text"), c("font_size"), c("median_size"), c("x0"), c("y0"), c("x1"), c("page_width"), c("page_height"), longest), F.lit(False))


def starts_lower(c: Column) -> Column:
    """Is the first letter of A-Z a small one?"""
    return F.regexp_extract(T.some(c), "[A-Za-z]", 0).rlike("[a-z]")


def ends_sentence(c: Column) -> Column:
    """Does a text end with a sentence's, quotation's or bracket's closing sign?"""
    return T.stripped(T.some(c)).rlike("[.!?。！？”\"’')\\]]$")


def three_columns(blocks: DataFrame, page: str, longest_title: int | None = 120) -> DataFrame:
    """page: those with three columns of narrow blocks that have three lines each and lie 0.42 page widths apart."""
    narrow = blocks.where((F.col("x1") - F.col("x0") <= F.col("page_width") * 0.46) & ~title_card(longest_title)).select(page, "id", "x0", "x1", "page_width", "n_lines")
    member = boxes.with_clusters(narrow, [page], F.lit(True)).where("cluster IS NOT NULL")
    column = member.groupBy(page, "cluster").agg(F.sum(F.greatest("n_lines", F.lit(1))).alias("lines"), F.avg(boxes.centre(F.col("x0"), F.col("x1"))).alias("c"), F.max("page_width").alias("w"))
    whole = column.where("lines >= 3").groupBy(page).agg(F.count("*").alias("n"), (F.max("c") - F.min("c")).alias("span"), F.max("w").alias("w"))
    return whole.where((F.col("n") >= 3) & (F.col("span") >= F.col("w") * 0.42)).select(page)


def _with_many(df: DataFrame, page: str) -> DataFrame:
    """df with many: has the page of a block three columns (see three_columns)?"""
    narrow = F.col("is_text") & ~F.col("title_card") & (F.col("x1") - F.col("x0") <= F.col("page_width") * 0.46)
    member = F.col("cluster").isNotNull()
    column, place = W.partitionBy(page, "cluster"), W.partitionBy(page, "cluster").orderBy("id")
    df = boxes.with_clusters(df, [page], narrow)
    df = df.withColumn("_c", F.avg(boxes.centre(F.col("x0"), F.col("x1"))).over(column)).withColumn("_w", F.max("page_width").over(column))
    df = df.withColumn("_whole", member & (F.sum(F.greatest("n_lines", F.lit(1))).over(column) >= 3)).withColumn("_first", F.row_number().over(place) == 1)
    whole, of_page = (lambda c: F.when(F.col("_whole"), F.col(c))), W.partitionBy(page)
    n, span = F.count_if(F.col("_whole") & F.col("_first")).over(of_page), F.max(whole("_c")).over(of_page) - F.min(whole("_c")).over(of_page)
    return df.withColumn("many", F.coalesce((n >= 3) & (span >= F.max(whole("_w")).over(of_page) * 0.42), F.lit(False))).drop("cluster", "_c", "_w", "_whole", "_first")


def _with_two_columns(df: DataFrame, page: str) -> DataFrame:
    """df with k (place in the own column of the section) and into: sort keys of blocks in two columns, the left one first.

    Where a left block breaks off and a heading follows it, blocks of the right column that go on with a small
    letter are read before the heading, if they stand above it. Only the right column's beginning can be taken, up to
    its first block without a small letter; each block goes to the first such place below it.
    """
    df = df.withColumn("right", F.col("narrow") & (boxes.centre(F.col("x0"), F.col("x1")) >= F.col("page_width") / 2)).withColumn("left", F.col("narrow") & ~F.col("right"))
    part = [page, "section"]
    own = W.partitionBy(*part, "left", "right").orderBy("y0", "x0", "id")
    df = df.withColumn("k", F.row_number().over(own)).withColumn("_next_y", F.lead("y0").over(own)).withColumn("_next_heading", F.lead("heading").over(own))
    low = F.when(F.col("right"), ~F.col("lower"))
    goes_on = F.col("two") & F.col("right") & ~F.coalesce(F.bool_or(low).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(False))
    df = df.withColumn("_goes_on", goes_on)
    gate = F.col("two") & F.col("left") & F.coalesce("_next_heading", F.lit(False)) & F.coalesce(~F.col("ends"), F.lit(False))
    # A block that is a gate stands a second time at the heading's top; at one height the gate comes first and takes nothing.
    df = df.withColumn("_block", F.explode(F.when(gate, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))))
    df = df.withColumn("_y", F.when(F.col("_block"), F.col("y0")).otherwise(F.col("_next_y"))).withColumn("_gate", F.when(~F.col("_block"), F.col("k")))
    below = W.partitionBy(*part).orderBy("_y", "_block", "k").rowsBetween(1, W.unboundedFollowing)
    df = df.withColumn("into", F.min("_gate").over(below)).where("_block").withColumn("into", F.when(F.col("_goes_on"), F.col("into")))
    return df.drop("_next_y", "_next_heading", "_goes_on", "_block", "_y", "_gate")


def reading_order(blocks: DataFrame, page: str) -> DataFrame:
    """page, id, place (from 0), title_card: the order in which blocks are read.

    From the top down; wide blocks and title cards stand by themselves and end what is above them, the blocks between
    two of them are read by columns: three and more where the page has them, else a left and a right one. Pages
    of two columns leave images out; pages of one column are read from the top down. Every step keeps the rows of a page
    together and nothing is joined, so that they are shuffled once.
    """
    df = blocks.select(
        page, "id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "page_width", "page_height")), "n_lines", "is_text", (F.col("is_text") & title_card()).alias("title_card"),
        starts_lower(F.col("text")).alias("lower"), ends_sentence(F.col("text")).alias("ends"), F.coalesce(pages.is_heading_block(F.col("text"), F.col("font_size"), F.col("median_size")), F.lit(False)).alias("heading"),
    )
    df = _with_many(df, page)
    wide = F.coalesce(F.col("x1") - F.col("x0") > F.col("page_width") * 0.6, F.lit(False))
    df = df.withColumn("narrow", F.col("is_text") & ~wide & ~F.col("title_card"))
    on_left = boxes.centre(F.col("x0"), F.col("x1")) < F.col("page_width") / 2
    whole = W.partitionBy(page)
    df = df.withColumn("two", ~F.col("many") & (F.count_if(F.col("narrow") & on_left).over(whole) > 0) & (F.count_if(F.col("narrow") & ~on_left).over(whole) > 0))
    df = df.where(F.col("is_text") | ~F.col("two"))
    # Each block that stands by itself is a section; what lies between two of them is one, and so is a page of one column.
    down = W.partitionBy(page).orderBy("y0", "x0", "id")
    alone, columns = ~F.col("narrow"), F.col("two") | F.col("many")
    section = F.sum(F.when(alone, 2).otherwise(0)).over(down) - alone.cast("int")
    df = df.withColumn("section", F.when(columns, section).otherwise(F.lit(0).cast("bigint")))
    df = _with_two_columns(df, page)
    # Three columns and more: one after the other, then the rest from the top.
    narrow = F.col("many") & F.col("narrow") & (F.col("x1") - F.col("x0") <= F.col("page_width") * 0.52)
    df = boxes.with_clusters(df, [page, "section"], narrow)
    part = W.partitionBy(page, "section")
    df = df.withColumn("cluster", F.when(F.max("cluster").over(part) >= 2, F.col("cluster"))).withColumn("in_part", F.row_number().over(part.orderBy("y0", "x0", "id")))
    last, two, right = F.lit(1 << 30), F.col("two"), F.col("right")
    a = F.when(two, F.when(right, F.coalesce("into", last)).otherwise(F.col("k"))).when(F.col("many"), F.coalesce("cluster", last)).otherwise(0)
    df = df.withColumn("a", a).withColumn("b", F.when(two, right.cast("int")).otherwise(0)).withColumn("c", F.when(two, F.col("k")).otherwise(F.col("in_part")))
    order = W.partitionBy(page).orderBy("section", "a", "b", "c")
    return df.withColumn("place", F.row_number().over(order) - 1).select(page, "id", "place", "title_card")


def stitched(items: DataFrame, key: str, order: str) -> DataFrame:
    """key, paragraphs (array of texts): blocks (text, title_card, kind) joined in their order.

    Tables stand by themselves; title cards join to one title; headings of one level join unless the first ends a
    sentence; a text goes on with the one before it that ends in , : ; or - (which goes) or where it starts with a
    small letter, unless that one is a heading. What is joined depends on the text so far, so it is folded.
    """
    item = F.struct(order, T.stripped(T.some(F.col("text"))).alias("text"), F.coalesce("title_card", F.lit(False)).alias("title"), (F.coalesce("kind", F.lit("")) == "table").alias("table"))
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(False).alias("title"), F.lit(False).alias("table"))
    bare = lambda c: T.stripped(F.regexp_replace(c, "^#\\s*", ""))
    marks = lambda c: F.regexp_extract(c, "^(#{1,4})\\s+.+$", 1)
    name = lambda c: T.stripped(F.regexp_extract(c, "^#{1,4}\\s+(.+)$", 1))
    state = lambda done, now, title, table: F.struct(done.alias("done"), now.alias("now"), title.alias("title"), table.alias("table"))

    def fold(a: Column, x: Column) -> Column:
        now, text, both = a["now"], x["text"], a["title"] & x["title"]
        joined = F.concat(F.lit("# "), F.concat_ws(" ", F.nullif(bare(now), F.lit("")), F.nullif(bare(text), F.lit(""))))
        headings = (marks(now) != "") & (marks(now) == marks(text)) & ~name(now).rlike("[.!?。！？；;]$")
        goes_on = ~now.rlike("^#{1,4}\\s+") & (now.rlike("[,:;-]$") | starts_lower(text))
        glued = F.when(now.endswith("-"), F.concat(F.rtrim(F.regexp_replace(now, "-$", "")), text)).otherwise(F.concat(now, F.lit(" "), text))
        apart = state(F.array_append(a["done"], now), text, x["title"], x["table"])
        return (
            F.when(text == "", a)
            .when(now == "", state(a["done"], text, x["title"], x["table"]))
            .when(a["table"] | x["table"], apart)
            .when(both, state(a["done"], joined, a["title"], a["table"]))
            .when(headings, state(a["done"], F.concat(marks(now), F.lit(" "), name(now), F.lit(" "), name(text)), both, a["table"]))
            .when(goes_on, state(a["done"], glued, both, a["table"]))
            .otherwise(apart)
        )

    parts = items.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("i"))
    done = F.aggregate("i", begin, fold, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))
    return parts.select(key, done.alias("paragraphs"))


def page_layouts(blocks: DataFrame, sheets: DataFrame, page: str, longest_title: int | None = 120, compact: bool = True) -> DataFrame:
    """page, layout: toc, art, handout, credits, document, character, three_columns, columns or single, the first that holds.

    sheets: page, width, height, n_drawings, n_images. blocks also have fonts (array); without blocks a page is art or columns.
    """
    d = blocks.join(sheets.select(page, "width", "height"), page)
    down = F.struct("y0", "x0", "id")
    text = T.stripped(T.some(F.col("text")))
    top = d.withColumn("_k", F.row_number().over(W.partitionBy(page).orderBy("y0", "x0", "id"))).where("_k <= 3").groupBy(page).agg(F.bool_or(B.is_contents_title(F.col("text"))).alias("contents"))
    lines = F.slice(F.split(T.some(F.col("text")), "\n"), 1, 3)
    listed = F.exists(lines, lambda x: B.is_contents_title(T.squeezed(F.regexp_replace(x, "^[\\s•*\\-]+", "")))) | B.has_leaders(F.col("text"))
    c = d.where(~boxes.marginal(F.col("text"), F.col("y0"), F.col("y1"), F.col("height"), compact=compact))
    w, mid, h = F.col("x1") - F.col("x0"), boxes.centre(F.col("x0"), F.col("x1")), F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    across = (w >= F.col("width") * 0.72) & (F.col("x0") <= F.col("width") * 0.20) & (F.col("x1") >= F.col("width") * 0.80)
    side = ~across & (w <= F.col("width") * 0.62)
    n = c.groupBy(page).agg(
        F.count("*").alias("n"), F.bool_or(listed).alias("listed"), F.min_by(text, down).alias("top"), F.count_if(B.is_handout(F.col("text"), boxes.one_width(F.col("fonts")))).alias("handouts"),
        F.sum(F.length(text)).alias("chars"), F.count_if(text != "").alias("texts"), F.count_if((text != "") & (F.length(text) <= 60)).alias("short"), F.count_if(F.col("n_lines") == 1).alias("ones"),
        F.count_if(side & (mid < F.col("width") / 2)).alias("left"), F.count_if(side & ~(mid < F.col("width") / 2)).alias("right"), F.sum(h).alias("tall"), F.sum(F.when(across, h).otherwise(0.0)).alias("across"),
        F.bool_or(F.col("n_lines") >= 3).alias("body"), F.bool_or((w <= F.col("width") * 0.55) & (F.col("n_lines") >= 3) & F.exists("fonts", lambda f: f != "")).alias("body_font"),
        F.bool_or(F.exists("fonts", lambda f: f.rlike("|".join(SERIFS)))).alias("serif"),
    )
    three = three_columns(c.withColumn("page_width", F.col("width")).withColumn("page_height", F.col("height")), page, longest_title).withColumn("three", F.lit(True))
    df = sheets.join(n, page, "left").join(top, page, "left").join(three, page, "left")
    no = lambda k: F.coalesce(k, F.lit(False))
    two, three_, body = (F.col("left") > 0) & (F.col("right") > 0), no(F.col("three")), no(F.col("body"))
    full = F.col("across") / F.greatest(F.col("tall"), F.lit(1.0))
    ones, short = F.col("ones") / F.greatest(F.col("n"), F.lit(1)), F.col("short") / F.greatest(F.col("texts"), F.lit(1))
    chars, draws, images, count = F.col("chars"), F.col("n_drawings"), F.col("n_images"), F.col("n")
    kind = (
        F.when(no(F.col("contents")), "toc")
        .when(count.isNull(), F.when((draws >= 8) | (images >= 1), "art").otherwise("columns"))
        .when(F.col("listed"), "toc")
        .when((F.col("handouts") >= 3) | F.col("top").rlike("(?i)^\\s*Player Aid\\b"), "handout")
        .when((chars <= 500) & ((images >= 4) | (draws >= 8) | (count <= 4)), "art")
        .when(chars.between(700, 2600) & (ones >= 0.50) & (short >= 0.85) & (draws <= 10), "credits")
        .when(chars.between(900, 2400) & (count <= 28) & (draws >= 12) & (images >= 4), "document")
        .when((chars >= 1200) & (draws >= 8) & (ones >= 0.45) & (short >= 0.35) & ~two, "character")
        .when(three_ & (full < 0.45), "three_columns")
        .when(two & (full < 0.45), "columns")
        .when(~no(F.col("body_font")) & (count >= 3) & ~two & body, "single")
        .when((count >= 15) & (F.col("ones") >= count * 0.7) & ~two, "single")
        .when(~no(F.col("serif")) & body & (count >= 3) & ~two, "single")
        .when(full >= 0.45, "single")
        .when(three_, "three_columns")
        .when(two, "columns")
        .when((count <= 3) & (F.col("across") > F.col("height") * 0.18), "single")
        .otherwise("columns")
    )
    return df.select(page, kind.alias("layout"))
