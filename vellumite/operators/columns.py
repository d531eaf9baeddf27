"""Two columns of a page: their gutter, which blocks are in which, blocks beside images, and paragraphs with a drop cap.

Regions and blocks have page and a box; those without one belong nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T
from vellumite.operators import boxes

_CORNERS = ("x0", "y0", "x1", "y1")


def _upper_middle(side: Column, edge: str, n: str, rank: str) -> Column:
    return F.max(F.when(side & (F.col(rank) == F.floor(F.col(n) / 2) + 1), F.col(edge)))


def gutters(regions: DataFrame, page: str) -> DataFrame:
    """page, gutter: halfway between the upper medians of the left regions' right edges and the right regions' left edges, if there is a gap; null elsewhere.

    Regions of over 0.65 page widths and those within 0.08 of the middle count for neither side; fewer than three
    regions have no gutter. Medians are read off ranks, so no page is gathered in one value.
    """
    r = regions.dropna(subset=list(_CORNERS))
    pw, mid = F.col("page_width"), boxes.centre(F.col("x0"), F.col("x1"))
    narrow = F.col("x1") - F.col("x0") <= pw * 0.65
    side = F.when(narrow & (mid < pw / 2 - pw * 0.08), 0).when(narrow & (mid > pw / 2 + pw * 0.08), 1)
    edge = F.when(side == 0, F.col("x1")).when(side == 1, F.col("x0"))
    r = r.select(page, side.alias("side"), edge.alias("edge"))
    of_side = W.partitionBy(page, "side")
    r = r.withColumn("n", F.count("*").over(of_side)).withColumn("rank", F.row_number().over(of_side.orderBy("edge")))
    m = r.groupBy(page).agg(F.count("*").alias("all"), _upper_middle(F.col("side") == 0, "edge", "n", "rank").alias("l"), _upper_middle(F.col("side") == 1, "edge", "n", "rank").alias("r"))
    found = F.when((F.col("all") >= 3) & (F.col("r") > F.col("l")), (F.col("l") + F.col("r")) / 2)
    return regions.select(page).distinct().join(m.select(page, found.alias("gutter")), page, "left")


#: Font roles of blocks that stand across the columns.
ACROSS = ("display", "running_header", "footer", "callout", "table")


def column_id(gutter: Column, width: Column) -> Column:
    """left, right or null: the column of a block (x0, x1, font_role); centred subheadings and wide blocks have none."""
    mid = boxes.centre(F.col("x0"), F.col("x1"))
    centred = (F.col("font_role") == "subsection") & (F.abs(mid - width / 2) <= width * 0.08)
    none = F.col("font_role").isin(*ACROSS) | centred | gutter.isNull() | (F.col("x1") - F.col("x0") >= width * 0.65)
    return F.when(~F.coalesce(none, F.lit(False)), F.when(mid < gutter, "left").otherwise("right"))


def column_boxes(blocks: DataFrame, gutter: DataFrame, page: str) -> DataFrame:
    """page, side, n, box of the columns of pages (page_type columns or mixed); headers and footers do not count."""
    df = blocks.where(F.col("page_type").isin("columns", "mixed") & ~F.coalesce(F.col("role").isin("header", "footer"), F.lit(False))).dropna(subset=list(_CORNERS)).join(gutter, page)
    df = df.withColumn("side", column_id(F.col("gutter"), F.col("page_width"))).where("side IS NOT NULL")
    return df.groupBy(page, "side").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def beside_images(blocks: DataFrame, images: DataFrame, page: str, share: float = 0.12) -> DataFrame:
    """page, id of body paragraphs that an image in the middle of the page overlaps in height by the share of the lower of the two."""
    c = F.col
    i = images.where(boxes.central(c("x0"), c("y0"), c("x1"), c("y1"), c("page_width"), c("page_height"))).select(page, F.col("y0").alias("iy0"), F.col("y1").alias("iy1"))
    b = blocks.where((F.col("role") == "body_column") & (F.col("layout_mode") == "paragraph")).select(page, "id", "y0", "y1")
    common = F.greatest(F.least("y1", "iy1") - F.greatest("y0", "iy0"), F.lit(0.0))
    low = F.least(F.col("y1") - F.col("y0"), F.col("iy1") - F.col("iy0"))
    return b.join(i, page).where((low > 0) & (common / low >= share)).select(page, "id").distinct()


def with_drop_caps(blocks: DataFrame, page: str) -> DataFrame:
    """Blocks (page, pos, id, font_role, role, text, box) with single decorative letters put before their paragraph: page, pos, id, drop_cap, n, text, box.

    A display letter takes the body block after it, if that begins with a small letter right of it and not above it,
    and body blocks that follow within 4 points. The box is that of the paragraph. Only display blocks lead, so no
    block can be claimed twice, and windows say all of it.
    """
    w = W.partitionBy(page).orderBy("pos")
    letter = T.stripped(T.some(F.col("text")))
    after = lambda c: F.lead(c).over(w)
    leads = (
        (F.col("font_role") == "display") & letter.rlike("^\\p{L}$") & (after("font_role") == "body") & F.coalesce(after("text"), F.lit("")).rlike("^\\p{Ll}")
        & (F.col("x0") <= after("x0")) & (F.col("y0") <= after("y0") + 2.0)
    )
    df = blocks.select(page, "pos", "id", "font_role", "role", "text", *_CORNERS).withColumn("leads", F.coalesce(leads, F.lit(False)))
    led = F.coalesce(F.lag("leads").over(w), F.lit(False))
    follows = F.coalesce((F.col("font_role") == "body") & (F.col("role") == "body_column") & (F.col("y0") - F.lag("y1").over(w) <= 4.0), F.lit(False))
    df = df.withColumn("grp", F.sum((~(led | (follows & ~F.col("leads")))).cast("int")).over(w))
    df = df.withColumn("cap", F.first("leads").over(W.partitionBy(page, "grp").orderBy("pos")))
    df = df.withColumn("grp", F.when(F.col("cap"), F.col("grp")).otherwise(-F.col("pos").cast("long") - 1))
    body = ~F.col("leads")
    rest = F.filter(F.sort_array(F.collect_list(F.when(body, F.struct("pos", T.stripped(T.some(F.col("text"))).alias("t"))))), lambda x: x.isNotNull())
    joined = F.array_join(F.transform(rest, lambda x: x["t"]), " ")
    return df.groupBy(page, "grp", "cap").agg(
        F.min("pos").alias("pos"), F.min_by("id", "pos").alias("id"), F.count("*").alias("n"), F.when(F.col("cap"), F.concat(F.max(F.when(F.col("leads"), letter)), joined)).otherwise(F.first("text")).alias("text"),
        *((F.min if c[1] == "0" else F.max)(F.when(body | ~F.col("cap"), F.col(c))).alias(c) for c in _CORNERS),
    ).select(page, "pos", "id", F.col("cap").alias("drop_cap"), "n", "text", *_CORNERS)
