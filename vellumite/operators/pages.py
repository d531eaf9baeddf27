"""Classification of pages, regions and lines from their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import blocks as B
from vellumite.functions import text as T


def page_types(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """page, page_type of pages (page, width, height, image_coverage) with regions (page, x0, y0, x1, y1)."""
    r = regions.join(pages.select("page", "width", "height"), "page")
    mid = (F.col("x0") + F.col("x1")) / 2
    wide = (F.col("x1") - F.col("x0")) > F.col("width") * 0.65
    left = ~wide & (mid < F.col("width") / 2 - F.col("width") * 0.08)
    right = ~wide & (mid > F.col("width") / 2 + F.col("width") * 0.08)
    tall = (F.col("y1") - F.col("y0")) >= F.col("height") * 0.20
    centred = F.abs(mid - F.col("width") / 2) < F.col("width") * 0.15
    n = r.groupBy("page").agg(
        F.count("*").alias("n"), F.count_if(centred).alias("n_centred"), F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"),
        F.count_if(~left & ~right).alias("n_full"), F.coalesce(F.bool_or(left & tall), F.lit(False)).alias("tall_left"), F.coalesce(F.bool_or(right & tall), F.lit(False)).alias("tall_right"),
    )
    df = pages.join(n, "page", "left").fillna(0, ["n", "n_centred", "n_left", "n_right", "n_full"])
    two = (F.col("n_left") > 0) & (F.col("n_right") > 0) & ((F.col("n_left") + F.col("n_right") >= 3) | (F.col("tall_left") & F.col("tall_right")))
    art = ((F.col("image_coverage") > 0.5) & (F.col("n") <= 2)) | ((F.col("image_coverage") > 0.3) & (F.col("n") <= 1))
    kind = F.when(art, "art").when(F.col("n") <= 1, "single").when((F.col("n") <= 3) & (F.col("n_centred") >= F.col("n") * 0.6), "cover")
    return df.select("page", kind.when(two & (F.col("n_full") > 0), "mixed").when(two, "columns").otherwise("single").alias("page_type"))


def layout_label(page_type: Column, columns: Column) -> Column:
    """The reading layout that a page type and its number of columns stand for."""
    many = F.when(columns >= 3, "three_columns")
    return (
        F.when(page_type == "art", "art")
        .when(page_type.isin("cover", "single"), "single")
        .when(page_type == "columns", many.otherwise("columns"))
        .when(page_type == "mixed", many.when(columns >= 2, "columns").otherwise("single"))
        .otherwise("columns")
    )


def template(page_type: Column, hero: Column, columns: Column, tracks: Column) -> Column:
    """The page template by type, hero title, number of columns, and whether all body regions have lines."""
    return (
        F.when(page_type.isin("art", "cover"), "fixed_art").when(hero, "full_width_hero").when((columns >= 2) & tracks, "line_track_columns").when(columns >= 2, "source_columns").otherwise("single_source_flow")
    )


def region_role(y0: Column, y1: Column, height: Column, size: Column, median: Column, accent: Column, text: Column) -> Column:
    """Header, footer, subtitle, title, footnote, table, list or body column, the first that holds."""
    small = (y0 > height * 0.8) & (size < median * 0.85)
    return (
        F.when((y0 < height * 0.10) & (y1 < height * 0.15), "header")
        .when(y0 > height * 0.90, "footer")
        .when(accent & (size >= median * 0.95), "subtitle")
        .when(size >= median * 1.5, "title")
        .when(small, "footnote")
        .when(B.is_table_like(text), "table")
        .when(B.is_list_like(text), "list")
        .otherwise("body_column")
    )


def heading_level(text: Column, size: Column, body: Column, bold: Column, red: Column) -> Column:
    """1 to 4, or null for a line that is no heading."""
    s = T.squeezed(text)
    n = F.length(F.regexp_replace(s, " ", ""))
    caps = (s == F.upper(s)) & (s != F.lower(s))
    ratio = size / body
    no = ~n.between(2, 70) | s.rlike("^(#|-|•|//|\\||>|\\[|`)") | (s.rlike("[.!?。！？；;]$") & (ratio < 1.75))
    return (
        F.when(no, None).when(red & (ratio >= 1.35), 2).when(ratio >= 2.55, 1).when(ratio >= 1.75, 3).when(bold & (ratio >= 1.18), 4).when(caps & (ratio >= 1.08), 4)
    )


def is_heading_block(text: Column, size: Column, median: Column) -> Column:
    s = T.stripped(text)
    return (s != "") & (F.length(s) <= 90) & ~s.rlike("[.!?。！？]$") & (size >= median * 1.25)


def best_headings(df: DataFrame) -> DataFrame:
    """page, title: the heading of the highest rank on each page, the first of equals."""
    return df.groupBy("page").agg(F.min_by("title", F.struct("level", "pos")).alias("title"))


def chapters(lines: DataFrame) -> DataFrame:
    """Headings of documents by size against the upper median: 1 from 1.8 times on, 2 from 1.4, 3 from 1.3; bold capitals are 2 from 1.1 on.

    lines: doc, page, pos, text, size, bold, caps. Gives doc, page, pos, title, level.
    """
    body = lines.groupBy("doc").agg(F.expr("element_at(array_sort(collect_list(size)), cast(count(size) div 2 + 1 as int))").alias("body"))
    ratio = F.col("size") / F.col("body")
    level = F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).when(ratio >= 1.3, 3).when(F.col("bold") & F.col("caps") & (ratio >= 1.1), 2)
    return lines.join(body, "doc").select("doc", "page", "pos", F.col("text").alias("title"), level.alias("level")).where("level IS NOT NULL")


def contents(headings: DataFrame) -> DataFrame:
    """doc, text: an indented Markdown list of each document's headings."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), F.col("title"), F.lit("](#page-"), (F.col("page") + 1).cast("string"), F.lit(")"))
    parts = F.sort_array(F.collect_list(F.struct("page", "pos", line.alias("t"))))
    return headings.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def is_title_card(text: Column, size: Column, median: Column, x0: Column, y0: Column, x1: Column, width: Column, height: Column, longest: int | None = 120) -> Column:
    """A line of up to `longest` characters (None: any) and twice the median size that stands centred near the top, or begins at the left of the top band."""
    s = T.stripped(F.regexp_replace(T.stripped(text), "^#\\s*", ""))
    fits = (s != "") & ((F.length(s) <= longest) if longest else F.lit(True)) & ~s.rlike("[.!?。！？]$") & (size >= median * 2.0)
    centred = (F.abs((x0 + x1) / 2 - width / 2) <= width * 0.16) & (x0 <= width * 0.42) & (x1 >= width * 0.58)
    return fits & (((y0 < height * 0.22) & centred) | ((y0 < height * 0.13) & (x0 <= width * 0.20) & (x1 >= width * 0.50)))


def body_fonts(blocks: DataFrame) -> DataFrame:
    """page, font: fonts of narrow blocks (page, width, page_width, n_lines, fonts) of three lines and more that have three tenths of the most lines."""
    df = blocks.where((F.col("width") <= F.col("page_width") * 0.55) & (F.col("n_lines") >= 3)).select("page", "n_lines", F.explode("fonts").alias("font"))
    n = df.groupBy("page", "font").agg(F.sum("n_lines").alias("n"))
    return n.withColumn("most", F.max("n").over(W.partitionBy("page"))).where(F.col("n") >= F.col("most") * 0.3).select("page", "font")


def background(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """page, colour: the first fill (page, seq, colour, box) that covers nine tenths of the page and is not white, else null."""
    d = drawings.join(pages.select("page", "width", "height"), "page")
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    hit = d.where(F.col("colour").isNotNull() & (F.col("colour") != "#ffffff") & (area >= F.col("width") * F.col("height") * 0.9))
    return pages.select("page").join(hit.groupBy("page").agg(F.min_by("colour", "seq").alias("colour")), "page", "left")


def role_notes(blocks: DataFrame) -> DataFrame:
    """page, roles: how many blocks of each role a page has, as "body=3, title=1"."""
    n = blocks.groupBy("page", "role").count()
    parts = F.sort_array(F.collect_list(F.concat("role", F.lit("="), F.col("count").cast("string"))))
    return n.groupBy("page").agg(F.array_join(parts, ", ").alias("roles"))


def line_pitch(lines: DataFrame, *keys: str, least: float = 3.0, most: float = 40.0) -> DataFrame:
    """Median distance of neighbouring line tops, of those between the bounds."""
    w = W.partitionBy(*keys).orderBy("y0")
    d = lines.withColumn("d", F.col("y0") - F.lag("y0").over(w)).where((F.col("d") > least) & (F.col("d") < most))
    return d.groupBy(*keys).agg(F.median("d").alias("pitch"))


def dominant_angle(lines: DataFrame, *keys: str) -> DataFrame:
    """Mean angle of the lines with text that are turned by half a degree and more, else 0."""
    a = F.degrees(F.atan2("dy", "dx"))
    turned = F.when((F.abs(a) >= 0.5) & (T.stripped(F.col("text")) != ""), a)
    return lines.groupBy(*keys).agg(F.coalesce(F.bround(F.avg(turned), 2), F.lit(0.0)).alias("angle"))


def merged_regions(regions: DataFrame) -> DataFrame:
    """Regions (page, pos, size, pitch, x0, y0, x1, y1) in painting order with those that go on a paragraph joined to the one before: page, grp, boxes' union, n.

    Whether a region goes on depends on the box joined so far, so a page's regions are folded.
    """
    region = F.struct("pos", *(F.col(c).cast("double").alias(c) for c in ("size", "pitch", "x0", "y0", "x1", "y1")))
    kind = "struct<x0:double,y0:double,x1:double,y1:double,n:int,size:double,pitch:double,left:double>"
    begin = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"))
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))
    made = lambda *c: F.struct(*(x.alias(k) for x, k in zip(c, ("x0", "y0", "x1", "y1", "n", "size", "pitch", "left"), strict=True)))

    def fold(a: Column, r: Column) -> Column:
        p = a["now"]
        one = made(r["x0"], r["y0"], r["x1"], r["y1"], F.lit(1), r["size"], r["pitch"], r["x0"])
        both = made(F.least(p["x0"], r["x0"]), F.least(p["y0"], r["y0"]), F.greatest(p["x1"], r["x1"]), F.greatest(p["y1"], r["y1"]), p["n"] + 1, p["size"], p["pitch"], F.least(p["left"], r["x0"]))
        return F.when(p.isNull(), state(a["done"], one)).when(_goes_on(p, r), state(a["done"], both)).otherwise(state(F.array_append(a["done"], p), one))

    pages = regions.groupBy("page").agg(F.aggregate(F.sort_array(F.collect_list(region)), begin, fold, lambda a: F.array_append(a["done"], a["now"])).alias("g"))
    found = pages.select(F.col("page").cast("int").alias("page"), F.posexplode("g").alias("grp", "g"))
    return found.select("page", "grp", *(f"g.{c}" for c in ("x0", "y0", "x1", "y1", "n")))


def _goes_on(p: Column, r: Column) -> Column:
    """Does a region go on the paragraph so far? Unknown sizes and sides do not part them, unknown heights and pitches do."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    sized = no((p["size"] <= 0) | (r["size"] <= 0)) & no(F.abs(p["size"] - r["size"]) > F.greatest(p["size"], r["size"]) * 0.12)
    beside = no(F.least(p["x1"], r["x1"]) <= F.greatest(p["x0"], r["x0"])) & no(r["x0"] < p["left"] - p["size"] * 0.8)
    pitch = F.when(p["pitch"] != 0, p["pitch"]).when((p["pitch"] == 0) & (r["pitch"] != 0), r["pitch"]).when((p["pitch"] == 0) & (r["pitch"] == 0), p["size"] * 1.6)
    return sized & beside & F.coalesce((r["y0"] - p["y1"]).between(F.lit(0.0), pitch * 0.6), F.lit(False))
