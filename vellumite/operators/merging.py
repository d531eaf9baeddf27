"""Boxes that touch, merged until no two of a page touch any more."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.stages import Rounds

#: Side of the grid cells in which boxes meet.
CELL = 128.0
#: A page of so many different boxes at most is merged in one row.
ROW_BOXES = 32
_CORNERS = ("x0", "y0", "x1", "y1")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _apart(a: Callable[[str], Column], b: Callable[[str], Column], tolerance: float) -> Column:
    return (a("x1") < b("x0") - tolerance) | (b("x1") < a("x0") - tolerance) | (a("y1") < b("y0") - tolerance) | (b("y1") < a("y0") - tolerance)


def touches(a: str, b: str, tolerance: float) -> Column:
    """Are the boxes with these prefixes at most the tolerance apart on both axes?"""
    return ~_apart(lambda n: F.col(f"{a}{n}"), lambda n: F.col(f"{b}{n}"), tolerance)


def merged_in_row(boxes: Column, tolerance: float) -> Column:
    """An array of boxes (x0 to y1, n), merged until none touch: a fold over boxes that are apart, into which each next one takes those that it touches.

    A box that has grown looks again, until it grows no more; the work is up to the cube of the array's size.
    """
    touch = lambda a, b: ~_apart(lambda n: a[n], lambda n: b[n], tolerance)
    corners = lambda of: F.struct(*(of(c).alias(c) for c in _CORNERS))
    hull = lambda a, b: corners(lambda c: (F.least if c[1] == "0" else F.greatest)(a[c], b[c]))

    def fold(held: Column, box: Column) -> Column:
        looked = lambda g: F.aggregate(held, g, lambda h, s: F.when(touch(s, h), hull(h, s)).otherwise(h))
        again = lambda a: F.when(a["done"], a).otherwise(_let(looked(a["box"]), lambda g: F.struct(g.alias("box"), (g == a["box"]).alias("done"))))
        begin = F.struct(corners(lambda c: box[c]).alias("box"), F.lit(False).alias("done"))
        grown = F.aggregate(held, begin, lambda a, _: again(a))["box"]
        count = lambda g: F.aggregate(F.filter(held, lambda s: touch(s, g)), box["n"], lambda n, s: n + s["n"])
        taken = lambda g: F.array_append(F.filter(held, lambda s: ~touch(s, g)), F.struct(*(g[c].alias(c) for c in _CORNERS), count(g).alias("n")))
        return F.when(F.exists(held, lambda s: touch(s, box)), _let(grown, taken)).otherwise(F.array_append(held, box))

    return F.aggregate(boxes, F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,n:bigint>>"), fold)


def _in_cells(boxes: DataFrame, cell: float, more: float = 0.0) -> DataFrame:
    """Each box once for every grid cell that it (with a margin) reaches into."""
    steps = lambda low, high: F.sequence(F.floor((F.least(low, high) - more) / cell), F.floor((F.greatest(low, high) + more) / cell))
    df = boxes.withColumn("cx", F.explode(steps(F.col("x0"), F.col("x1"))))
    return df.withColumn("cy", F.explode(steps(F.col("y0"), F.col("y1"))))


def nearest_of(boxes: DataFrame, page: str, tolerance: float, number: int, cell: float = CELL) -> DataFrame:
    """page, id, target: of each box that others touch, and of those, the one that comes first in this round's order."""
    order = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("o"), F.col(c).alias("id"))
    side = lambda p: _in_cells(boxes, cell, tolerance).select(page, "cx", "cy", *(F.col(c).alias(f"{p}{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    near = side("a").join(side("b"), [page, "cx", "cy"]).where(touches("a", "b", tolerance) & (F.col("aid") != F.col("bid")))  # both sides alike, so that one shuffle serves both
    first = near.groupBy(page, F.col("aid").alias("id")).agg(F.min(order("bid")).alias("o"))
    return first.select(page, "id", F.least(F.col("o"), order("id"))["id"].alias("target"))


def merged_boxes(boxes: DataFrame, page: str, tolerance: float = 8.0, cell: float = CELL) -> DataFrame:
    """page, x0, y0, x1, y1, n: what is left when boxes that touch have been replaced by their common box, again and again; n counts the boxes in it.

    The result does not depend on the order of the steps. Equal boxes are counted together before. A page of ROW_BOXES
    boxes at most is folded in one row; those of larger pages go through rounds: every box looks in its grid cells for the
    first of the boxes that touch it, in an order drawn anew; those that are first around themselves take in all
    that chose them. As the first box of all that touch others is always among these, rounds end, usually after the
    logarithm of the longest chain. A page on which nothing touched in a round is done and takes part in no other; of
    each round its done pages stay in the shared folder as the result. Boxes without a page or a coordinate are left out.
    """
    rounds = Rounds(boxes.sparkSession, "merged_boxes")
    df = boxes.select(page, *(F.col(c).cast("double").alias(c) for c in _CORNERS)).dropna(subset=[page, *_CORNERS]).groupBy(page, *_CORNERS).agg(F.count("*").alias("n"))
    df = df.withColumn("id", F.monotonically_increasing_id()).withColumn("busy", F.count("*").over(W.partitionBy(page)) > ROW_BOXES)
    rows = df.groupBy(page, "busy", F.when(F.col("busy"), F.col("id")).alias("id")).agg(F.collect_list(F.struct(*_CORNERS, "n")).alias("b"))
    rows = rows.select(page, "id", "busy", F.explode(F.when(F.col("busy"), F.col("b")).otherwise(merged_in_row(F.col("b"), tolerance))).alias("b"))
    table = rounds.step(rows.select(page, "b.*", "id", "busy"), keep=True)
    done = []
    while True:
        done.append(table.where("not busy").select(page, *_CORNERS, "n"))
        df = table.where("busy").drop("busy")
        if df.isEmpty():
            return reduce(DataFrame.unionByName, done)
        chosen = nearest_of(df, page, tolerance, rounds.number, cell)
        heads = chosen.where("id = target").select(page, F.col("id").alias("target"), F.lit(True).alias("head"))
        into = chosen.join(heads, [page, "target"], "left").select(page, "id", F.when(F.col("head"), F.col("target")).otherwise(F.col("id")).alias("into"))
        moved = df.join(into, [page, "id"], "left").withColumn("moves", F.col("into").isNotNull()).withColumn("into", F.coalesce("into", "id")).drop("id")
        joined = moved.repartition(page).groupBy(page, F.col("into").alias("id"))  # one shuffle for these groups and the window
        joined = joined.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n"), F.bool_or("moves").alias("moves"))
        table = rounds.step(joined.select(page, *_CORNERS, "n", "id", F.max("moves").over(W.partitionBy(page)).alias("busy")), keep=True)


def card_regions(shapes: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """Boxes of drawings and images (kind) that frame cards, merged where they lie within 14 points.

    shapes: page, page_width, page_height, kind (drawing or image), x0 to y1. blocks: page, x0 to y1, n_lines,
    is_table, is_card, is_monospace, has_label. A frame needs a block inside, no share of table lines that reaches
    two lines and six tenths of its monospace lines, and card text, a label or four monospace lines.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    pw, ph = F.col("page_width"), F.col("page_height")
    drawn = F.col("kind") == "drawing"
    area = (w * h >= pw * ph * F.when(drawn, 0.015).otherwise(0.02)) & (w * h <= pw * ph * 0.78)
    sized = area & (w >= pw * F.when(drawn, 0.20).otherwise(0.22)) & (h >= ph * F.when(drawn, 0.05).otherwise(0.06))
    frames = shapes.where(sized).select(page, "x0", "y0", "x1", "y1").distinct()
    b = blocks.select(page, *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")), "n_lines", "is_table", "is_card", "is_monospace", "has_label")
    inside = (F.col("bx0") >= F.col("x0") - 8) & (F.col("by0") >= F.col("y0") - 8) & (F.col("bx1") <= F.col("x1") + 8) & (F.col("by1") <= F.col("y1") + 8)
    lines = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n_lines"))), F.lit(0))
    held = frames.join(b, page).where(inside).groupBy(page, "x0", "y0", "x1", "y1")
    held = held.agg(lines("is_table").alias("table"), lines("is_monospace").alias("mono"), F.bool_or("is_card").alias("card"), F.bool_or("has_label").alias("label"))
    table = (F.col("table") > 0) & (F.col("table") >= F.greatest(F.lit(2.0), F.col("mono") * 0.60))
    return merged_boxes(held.where(~table & (F.col("card") | F.col("label") | (F.col("mono") >= 4))), page, 14.0)
