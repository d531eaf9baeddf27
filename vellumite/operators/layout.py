"""Boxes on pages: unions, occlusion, reading order, medians and precedence of layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import geometry as G


def union_boxes(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def occlusion(texts: DataFrame, images: DataFrame) -> DataFrame:
    """id, covered: the largest share of a text box under an image of its page that is painted later."""
    i = images.select("page", F.col("seq").alias("iseq"), *(F.col(c).alias(f"i{c}") for c in ("x0", "y0", "x1", "y1")))
    hit = texts.join(i, "page").where("iseq > seq AND ix0 < x1 AND ix1 > x0 AND iy0 < y1 AND iy1 > y0")
    best = hit.withColumn("c", G.covered_share(G.box(), G.box("i"))).groupBy("id").agg(F.max("c").alias("covered"))
    return texts.select("id").join(best, "id", "left").select("id", F.coalesce("covered", F.lit(0.0)).alias("covered"))


def hidden_duplicates(texts: DataFrame, images: DataFrame, share: float = 0.85, least: int = 5) -> DataFrame:
    """Texts of a page that occur twice, are covered, and of which another is not: id."""
    norm = F.regexp_replace("text", "[ \\t\\r\\n]+", "")
    df = texts.withColumn("norm", norm).join(occlusion(texts, images), "id").where(F.length("norm") >= least)
    w = W.partitionBy("page", "norm")
    open_ = F.max((F.col("covered") < share).cast("int")).over(w)
    return df.withColumn("n", F.count("*").over(w)).withColumn("open", open_).where((F.col("n") > 1) & (F.col("covered") >= share) & (F.col("open") == 1)).select("id")


def column_order(df: DataFrame, page_width: float) -> DataFrame:
    """Two-column reading order: sections end at boxes of the whole width; in a section left, then right, from the top: id, section, side, rank."""
    wide = ((F.col("x1") - F.col("x0")) >= 0.6 * page_width).cast("int")
    by_place = W.partitionBy("page").orderBy("y0", "x0", "id")
    side = F.when(F.col("wide") == 1, 0).when((F.col("x0") + F.col("x1")) / 2 < page_width / 2, 1).otherwise(2)
    df = df.withColumn("wide", wide).withColumn("section", F.sum("wide").over(by_place.rowsBetween(W.unboundedPreceding, W.currentRow)))
    df = df.withColumn("side", side)
    return df.select("id", "section", "side", F.row_number().over(W.partitionBy("page").orderBy("section", "side", "y0", "x0", "id")).alias("rank"))


def weighted_size(df: DataFrame, *keys: str) -> DataFrame:
    """Mean font size weighted by text length; 11 where there is no text."""
    n = F.length(F.trim("text"))
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("font_size") * n), F.sum(n)), F.lit(11.0)).alias("font_size"))


def dominant_font(df: DataFrame, *keys: str) -> DataFrame:
    """The font with the most stripped characters, the first seen of equals."""
    sums = df.groupBy(*keys, "font").agg(F.sum(F.length(F.trim("text"))).alias("n"), F.min("span_no").alias("first"))
    return sums.groupBy(*keys).agg(F.max_by("font", F.struct("n", -F.col("first"))).alias("font"))


def merged_layout(base: DataFrame, semantic: DataFrame) -> DataFrame:
    """page_index, layout: a specialised base layout stands, else an ordinary semantic one, else the base."""
    df = base.select("page_index", F.col("layout").alias("b")).join(semantic.select("page_index", F.col("layout").alias("s")), "page_index", "full_outer")
    special = F.col("b").isin("toc", "art", "handout", "credits", "document", "character")
    ordinary = F.col("s").isin("single", "columns", "three_columns", "art")
    return df.select("page_index", F.when(special, F.col("b")).when(ordinary, F.col("s")).otherwise(F.coalesce("b", F.lit("columns"))).alias("layout"))
