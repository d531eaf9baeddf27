"""Images among the blocks of a page: letters that belong to them, regions that show pictures, places for those that are missing, and pages as Markdown.

Images and blocks have page, page_width, page_height and a box. Blocks without text or box lie on no image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumite.functions import text as T
from vellumite.operators.merging import merged_boxes
from vellumite.operators.ordered import page_ranges

_CORNERS = ("x0", "y0", "x1", "y1")
#: Fixed value: what stands for an image in a text.
PLACEHOLDER = "[IMAGE]\nIllustration placeholder\n[/IMAGE]"
#: Layout modes of blocks that no renderer owns.
NOT_RENDERED = ("image_overlay_text", "hidden_source_text")


def _area(p: str = "") -> Column:
    return F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(0.0)) * F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(0.0))


def _common(a: str, b: str) -> Column:
    side = lambda c: F.greatest(F.least(F.col(f"{a}{c}1"), F.col(f"{b}{c}1")) - F.greatest(F.col(f"{a}{c}0"), F.col(f"{b}{c}0")), F.lit(0.0))
    return side("x") * side("y")


def _boxes(df: DataFrame, page: str, prefix: str, *more: str) -> DataFrame:
    return df.select(page, *more, *(F.col(c).cast("double").alias(f"{prefix}{c}") for c in _CORNERS))


def overlay_texts(blocks: DataFrame, images: DataFrame, page: str) -> DataFrame:
    """page, id of body blocks (role, text, layout_mode) of one or two characters of which 0.35 lies on an image of 0.02 to 0.9 pages, and of those marked so."""
    marked = blocks.where(F.col("layout_mode") == "image_overlay_text").select(page, "id")
    n = F.length(T.stripped(T.some(F.col("text"))))
    small = blocks.where((F.col("role") == "body_column") & n.between(1, 2) & (_area() > 0))
    sheet = F.greatest(F.col("page_width") * F.col("page_height"), F.lit(1.0))
    i = _boxes(images.where((_area() > sheet * 0.02) & (_area() < sheet * 0.9)), page, "i")
    hit = _boxes(small, page, "b", "id").join(i, page).where(_common("b", "i") / _area("b") >= 0.35)
    return hit.select(page, "id").union(marked).distinct()


def picture_regions(images: DataFrame, cards: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """page, box, n: images that show pictures, merged where they lie within 8 points.

    They are 0.025 to 0.55 pages large, a fifth of the page wide and 0.08 high; at an edge of the page 0.06 pages at
    most; cards (page, box) share a fifth of the smaller of the two at most; and no text is laid over them: three
    blocks with 240 characters inside, or blocks over a quarter with 120 characters in blocks that lie on them by 0.15.
    """
    c = F.col
    w, h, sheet = c("x1") - c("x0"), c("y1") - c("y0"), c("page_width") * c("page_height")
    edge = (c("x0") <= 2) | (c("y0") <= 2) | (c("x1") >= c("page_width") - 2) | (c("y1") >= c("page_height") - 2)
    fits = (w * h >= sheet * 0.025) & (w * h <= sheet * 0.55) & (w >= c("page_width") * 0.20) & (h >= c("page_height") * 0.08) & ~(edge & (w * h > sheet * 0.06))
    i = _boxes(images.where(fits), page, "i")
    key = [page, *(f"i{c}" for c in _CORNERS)]
    # Joined and grouped by the page alone, so that rows that are dealt by page are shuffled no more.
    share = _common("i", "k") / F.greatest(F.least(_area("i"), _area("k")), F.lit(1.0))
    met = i.join(_boxes(cards, page, "k").withColumn("k", F.lit(True)), page, "left")  # least and greatest pass over nulls, so k says whether there is a card
    free = met.groupBy(key).agg(F.coalesce(F.bool_or(c("k") & (share > 0.20)), F.lit(False)).alias("on_card")).where("NOT on_card").drop("on_card")
    text = T.stripped(T.some(F.col("text")))
    b = _boxes(blocks.where(text != "").withColumn("chars", F.length(text)), page, "b", "chars")
    x, y = (c("bx0") + c("bx1")) / 2, (c("by0") + c("by1")) / 2
    inside = (x >= c("ix0")) & (x < c("ix1")) & (y >= c("iy0")) & (y < c("iy1"))
    lies = (_common("b", "i") > 0) & (_common("b", "i") / F.greatest(_area("b"), F.lit(1.0)) >= 0.15)
    laid = free.join(b, page, "left").groupBy(key).agg(
        F.count_if(inside).alias("n"), F.coalesce(F.sum(F.when(inside, c("chars"))), F.lit(0)).alias("chars"), F.sum(F.when(c("chars").isNotNull(), _common("b", "i"))).alias("over"), F.coalesce(F.sum(F.when(lies, c("chars"))), F.lit(0)).alias("lying")
    )
    texts = ((c("n") >= 3) & (c("chars") >= 240)) | ((c("over") / F.greatest(_area("i"), F.lit(1.0)) >= 0.25) & (c("lying") >= 120))
    left = laid.where(~F.coalesce(texts, F.lit(False)))
    return merged_boxes(left.select(page, *(F.col(f"i{c}").alias(c) for c in _CORNERS)), page, 8.0)


def with_placeholders(translated: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key, text: translations with a placeholder at the end for each image mark that the source (key, source) has more."""
    marks = lambda t: F.regexp_count(T.some(t), F.lit("\\[IMAGE\\]"))
    df = translated.join(sources.select(key, "source"), key, "left")
    missing = marks(F.col("source")) - marks(F.col("text"))
    extra = F.array_join(F.array_repeat(F.lit(PLACEHOLDER), F.greatest(missing, F.lit(0))), "\n\n")
    return df.select(key, F.when(missing > 0, F.concat(F.regexp_replace(F.col("text"), f"{T.SPACES}$", ""), F.lit("\n\n"), extra)).otherwise(F.col("text")).alias("text"))


def rendered_blocks(blocks: DataFrame, hidden: DataFrame) -> DataFrame:
    """block_id, page of blocks (block_id, page, translatable, translated, layout_mode) that need an owner: translated, shown and not hidden (block_id)."""
    mode = F.coalesce(F.col("layout_mode"), F.lit(""))
    shown = blocks.where(F.col("translatable") & (T.some(F.col("translated")) != "") & ~mode.isin(*NOT_RENDERED))
    return shown.join(hidden.select("block_id").distinct(), "block_id", "left_anti").select("block_id", "page")


def reading_markdown(blocks: DataFrame, key: str) -> DataFrame:
    """key, reading_page, text: blocks (key, reading_page, pos, layout, source_page, text) of each reading page under a comment with its number, layout and source pages."""
    ranges = page_ranges(blocks, [key, "reading_page"], "source_page", 1)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", T.some(F.col("text")).alias("t")))), lambda x: F.concat(x["t"], F.lit("\n\n")))
    body = blocks.groupBy(key, "reading_page").agg(F.array_join(parts, "").alias("body"), F.min_by("layout", "pos").alias("layout")).join(ranges, [key, "reading_page"])
    head = F.concat(F.lit("<!-- Reading Page "), (F.col("reading_page") + 1).cast("string"), F.lit("; Layout: "), F.coalesce("layout", F.lit("columns")), F.lit("; Source PDF Pages: "), F.col("ranges"), F.lit(" -->\n\n"))
    return body.select(key, "reading_page", F.concat(head, "body", F.lit("---\n\n")).alias("text"))
