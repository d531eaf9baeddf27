"""Boxes on pages: bands, columns, containment, clusters, and what is summed over a page or a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T

#: Titles that run along the margins of the pages.
RUNNING_TITLES = ("DELTA GREEN", "PISCES", "THE MILLENNIUM", "THE NEW AGE", "THE LABYRINTH")
#: Parts of the names of fonts of one width.
ONE_WIDTH = ("VT323", "Mono", "Courier")


def centre(x0: Column, x1: Column) -> Column:
    return (x0 + x1) / 2


def marginal(text: Column, y0: Column, y1: Column, height: Column, band: float = 0.08, compact: bool = True) -> Column:
    """Is a block a header or a footer: blank, a page number, or marginal by its place and words? Its length counts runs of white space once if compact."""
    line = T.squeezed(T.some(text))
    title = F.regexp_replace(F.upper(line), "[^A-Z0-9 ]+", "")
    above, below = y1 < height * band, y0 > height * (1 - band)
    named = title.rlike("|".join(RUNNING_TITLES)) | F.contains(line, F.lit("//"))
    return (line == "") | line.rlike("^\\d{1,4}$") | ((above | below) & named) | (below & (F.length(line if compact else T.stripped(text)) <= 80))


def one_width(fonts: Column) -> Column:
    """Does an array of font names hold one of fixed width?"""
    return F.exists(fonts, lambda f: f.rlike("|".join(ONE_WIDTH)))


def central(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Does an image of middle size stand across the middle of the page, off its top and bottom edges?"""
    w, h = F.greatest(x1 - x0, F.lit(0.0)), F.greatest(y1 - y0, F.lit(0.0))
    sized = (w >= width * 0.18) & (h >= height * 0.18) & ~((w >= width * 0.9) & (h >= height * 0.9))
    return sized & (x0 < width / 2) & (x1 > width / 2) & (y0 > height * 0.04) & (y1 < height * 0.96)


def contained(boxes: DataFrame, regions: DataFrame, page: str, tolerance: float = 4.0) -> DataFrame:
    """page, id, region: each box with every region of its page that holds it, within a tolerance."""
    r = regions.select(page, F.col("id").alias("region"), *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    low = (F.col("x0") >= F.col("rx0") - tolerance) & (F.col("y0") >= F.col("ry0") - tolerance)
    high = (F.col("x1") <= F.col("rx1") + tolerance) & (F.col("y1") <= F.col("ry1") + tolerance)
    return boxes.join(r, page).where(low & high).select(page, "id", "region")


def sharing_column(boxes: DataFrame, page: str, width: str = "page_width") -> DataFrame:
    """page, id, other: pairs of boxes of a page (id < other) that stand in one column."""
    a = boxes.select(page, "id", width, "x0", "x1")
    b = boxes.select(page, F.col("id").alias("other"), F.col("x0").alias("ox0"), F.col("x1").alias("ox1"))
    common = F.least("x1", "ox1") - F.greatest("x0", "ox0")
    narrow = F.greatest(F.least(F.col("x1") - F.col("x0"), F.col("ox1") - F.col("ox0")), F.lit(1.0))
    mine, its, middle = centre(F.col("x0"), F.col("x1")), centre(F.col("ox0"), F.col("ox1")), F.col(width) / 2
    beside = ((mine < middle) == (its < middle)) & (F.abs(mine - its) <= F.col(width) * 0.22)
    return a.join(b, page).where((F.col("id") < F.col("other")) & ((common / narrow >= 0.2) | beside)).select(page, "id", "other")


def nearest_column(boxes: DataFrame, columns: DataFrame, page: str) -> DataFrame:
    """page, id, column: the column of the page whose centre is nearest, the first of equally near ones, of all boxes of one id together. columns: page, column, centre."""
    of_page = columns.groupBy(page).agg(F.collect_list(F.struct("column", "centre")).alias("_columns"))
    middle = centre(F.col("x0"), F.col("x1"))
    away = F.transform("_columns", lambda c: F.struct(F.abs(c["centre"] - middle).alias("d"), c["column"].alias("column")))
    best = boxes.select(page, "id", "x0", "x1").join(of_page, page).select(page, "id", F.array_min(away).alias("m"))
    return best.groupBy(page, "id").agg(F.min("m").alias("m")).select(page, "id", "m.column")


def column_clusters(boxes: DataFrame, page: str, gap: float = 0.13, widest: float = 0.46, least: int = 3) -> DataFrame:
    """page, id, cluster: narrow boxes by their centres; one that is far from the mean of the cluster so far begins the next.

    Pages of fewer than `least` narrow boxes have no clusters.
    """
    return with_clusters(boxes, [page], F.col("x1") - F.col("x0") <= F.col("page_width") * widest, gap, least).where("cluster IS NOT NULL").select(page, "id", "cluster")


def with_clusters(boxes: DataFrame, keys: list[str], narrow: Column, gap: float = 0.13, least: int = 3) -> DataFrame:
    """boxes with cluster (see column_clusters), null for those that are not narrow and where the keys have fewer than `least` narrow ones.

    Rows travel with their box through the fold, so that nothing is joined to them afterwards.
    """
    own = boxes.columns
    item = F.struct(F.coalesce(narrow, F.lit(False)).alias("narrow"), centre(F.col("x0"), F.col("x1")).alias("c"), F.col("id"), (F.col("page_width") * gap).alias("far"), F.struct(*own).alias("row"))
    begin = F.struct(F.lit(0).alias("number"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def fold(a: Column, x: Column) -> Column:
        new = (a["n"] > 0) & (F.abs(x["c"] - a["total"] / a["n"]) >= x["far"])
        number = F.when(new, a["number"] + 1).otherwise(a["number"])
        total, n = F.when(new, x["c"]).otherwise(a["total"] + x["c"]), F.when(new, 1).otherwise(a["n"] + 1)
        return F.struct(number.alias("number"), total.alias("total"), n.alias("n"), F.array_append(a["out"], number).alias("out"))

    # Narrow boxes come last in their list, as their flag is true.
    groups = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("i"), F.count_if(F.coalesce(narrow, F.lit(False))).cast("int").alias("k"))
    rest = F.size("i") - F.col("k")
    numbers = F.when(F.col("k") >= least, F.aggregate(F.transform(F.slice("i", rest + 1, F.col("k")), lambda x: F.struct(x["c"].alias("c"), x["far"].alias("far"))), begin, fold, lambda a: a["out"]))
    dealt = groups.select("i", rest.alias("rest"), numbers.alias("numbers"), *keys).select(*keys, "rest", "numbers", F.posexplode("i").alias("p", "x"))
    others = [c for c in own if c not in keys]
    return dealt.select(*keys, *(F.col("x.row")[c].alias(c) for c in others), F.when(F.col("p") >= F.col("rest"), F.get("numbers", F.col("p") - F.col("rest"))).alias("cluster"))


def line_style(spans: DataFrame, *keys: str) -> DataFrame:
    """keys, mean_size (of sized spans), colour: the colour of most spans with text, the smallest of equally frequent ones."""
    sized = F.avg(F.when(F.col("font_size") > 0, F.col("font_size")))
    shown = spans.where((T.stripped(T.some(F.col("text"))) != "") & F.col("color").isNotNull())
    often = shown.groupBy(*keys, "color").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("color"))).alias("m"))
    return spans.groupBy(*keys).agg(F.coalesce(sized, F.lit(0.0)).alias("mean_size")).join(often, list(keys), "left").select(*keys, "mean_size", F.col("m.color").alias("colour"))


def page_cover(images: DataFrame, page: str, dense: int = 80) -> DataFrame:
    """page, coverage (images' area as a share of the page's, 1 at most), n_lines (rows thin enough for lines of a grid), grid (at least `dense` of them)."""
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    share = F.least(F.sum(w * h) / F.max(F.col("page_width") * F.col("page_height")), F.lit(1.0))
    thin = F.count_if(F.least(w, h) <= 2)
    return images.groupBy(page).agg(share.alias("coverage"), thin.alias("n_lines"), (thin >= dense).alias("grid"))


def one_size(pages: DataFrame, key: str) -> DataFrame:
    """key, width, height of documents; pages of different sizes are an error in the column `error`."""
    sizes = F.countDistinct("page_width", "page_height")
    return pages.groupBy(key).agg(F.min("page_width").alias("width"), F.min("page_height").alias("height"), F.when(sizes > 1, F.lit("pages of several sizes")).alias("error"))


def painted_style(spans: DataFrame, *keys: str, order: str = "span_no") -> DataFrame:
    """keys, size, bold, italic, colour of lines from their spans with text (text, font_size, flags, color as a number).

    The size is the mean weighted by the visible length, to two decimals (halves to even); bold and italic hold if one span has
    the flag; the colour is the first that is not black. Lines without text are 11 points and plain black; a missing
    size counts as 11, missing flags and colours as 0.
    """
    shown = T.stripped(T.some(F.col("text")))
    weight = F.when(shown != "", F.length(shown))
    size = F.coalesce(F.col("font_size"), F.lit(11.0)).cast("double")
    flag = lambda bit: F.coalesce(F.bool_or(F.when(shown != "", F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(bit)) != 0)), F.lit(False))
    hue = F.coalesce(F.col("color"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFF))
    first = F.min_by(F.when((shown != "") & (hue != 0), hue), F.when((shown != "") & (hue != 0), F.col(order)))
    colour = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.coalesce(first, F.lit(0)))), 6, "0"))
    mean = F.bround(F.sum(size * weight) / F.sum(weight), 2)
    return spans.groupBy(*keys).agg(F.coalesce(mean, F.lit(11.0)).alias("size"), flag(16).alias("bold"), flag(2).alias("italic"), colour.alias("colour"))
