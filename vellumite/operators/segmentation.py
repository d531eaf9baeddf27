"""Lines of a region into paragraphs: the left edge of hanging indents, and segments by style, indent and line advance.

Lines have the columns line_no (unique in a region), x0, y0, x1, y1, text, font_role, role and body_size (one value a
region). Lines without a left edge count for no baseline; null sizes leave the rules that need them unmet. A region
without lines has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T

#: Shares of the body size for an indent and for the first advance, and how much wider a gap is than an advance.
INDENT, ADVANCE, GAP = 0.8, 1.35, 1.35


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def median_of(values: Column) -> Column:
    """The interpolated median of an array, null if it is empty."""
    at = lambda s, i: F.get(s, F.floor(i).cast("int"))
    return _let(F.sort_array(values), lambda s: (at(s, (F.size(s) - 1) / 2) + at(s, F.size(s) / 2)) / 2)


def hanging_baselines(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, baseline: the left edge of the body in regions whose paragraphs start left of it, null elsewhere.

    The edge is the one that most body lines are nearer to than the tolerance (the first of equal ones). Only
    different edges meet, in buckets as wide as the tolerance, so lines at one edge are counted together before.
    """
    body = lines.where((F.col("font_role") == "body") & F.col("x0").isNotNull()).select(*keys, "line_no", F.col("x0").cast("double").alias("x0"), (F.col("body_size") * INDENT).cast("double").alias("tol"))
    edges = body.groupBy(*keys, "x0").agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.max("tol").alias("tol"))
    bucket = F.floor(F.col("x0") / F.when(F.col("tol") > 0, F.col("tol")).otherwise(1.0))
    near = edges.select(*keys, F.col("x0").alias("near"), F.col("n").alias("m"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    counted = edges.withColumn("bucket", bucket).join(near, [*keys, "bucket"]).where(F.abs(F.col("x0") - F.col("near")) < F.col("tol"))
    counted = counted.groupBy(*keys, "x0").agg(F.sum("m").alias("m"), F.first("first").alias("first"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("m")).alias("m"), F.col("first"), F.col("x0"))).alias("b")).select(*keys, F.col("b.x0").alias("edge"), (-F.col("b.m")).alias("at"))
    w = W.partitionBy(*keys).orderBy("line_no")
    df = body.withColumn("after", F.lead("x0").over(w)).join(best, list(keys))
    left = F.col("x0") <= F.col("edge") - F.col("tol")
    goes_on = left & F.coalesce(F.col("after") > F.col("edge") - F.col("tol"), F.lit(False))
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), F.first("edge").alias("edge"), F.first("at").alias("at"), F.count_if(left).alias("left"), F.count_if(goes_on).alias("on"))
    hangs = (F.col("n") >= 3) & (F.col("at") * 2 > F.col("n")) & (F.col("left") > 0) & (F.col("on") * 2 > F.col("left"))
    return lines.select(*keys).distinct().join(found.select(*keys, F.when(hangs, F.col("edge")).alias("baseline")), list(keys), "left")


def segmented(lines: DataFrame, *keys: str) -> DataFrame:
    """The lines with segment (from 1 in each region), body_x0 and baseline.

    A line starts a segment where style or role change, where it is no body line, and where it is indented (or, with
    a hanging indent, stands out); those breaks are a window. Between them a gap wider than the median advance of
    the open segment does so too: that median follows from earlier decisions, so it is folded over the lines
    between two breaks.
    """
    of_region, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("line_no")
    df = lines.join(hanging_baselines(lines, *keys), list(keys))
    edge = F.coalesce(F.min(F.when(F.col("font_role") == "body", F.col("x0"))).over(of_region), F.min("x0").over(of_region))
    step = F.col("body_size") * INDENT
    df = df.withColumn("body_x0", edge)
    indented = F.when(F.col("baseline").isNotNull(), F.col("x0") <= F.col("baseline") - step).otherwise(F.col("x0") - F.col("body_x0") >= step)
    changed = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    breaks = first | changed("font_role") | changed("role") | ~F.col("font_role").eqNullSafe(F.lit("body")) | F.coalesce(indented, F.lit(False))
    df = df.withColumn("_part", F.sum(breaks.cast("int")).over(w))

    item = F.struct("line_no", F.col("y0").cast("double").alias("y"), F.greatest(F.col("body_size") * ADVANCE, F.lit(1.0)).cast("double").alias("advance"))
    out_kind = f"array<struct<line_no:{lines.schema['line_no'].dataType.simpleString()},n:int>>"
    begin = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("y"), F.array().cast("array<double>").alias("steps"), F.array().cast(out_kind).alias("out"))

    def fold(a: Column, x: Column) -> Column:
        usual = F.coalesce(median_of(a["steps"]), x["advance"])
        new = F.coalesce(x["y"] - a["y"] > usual * GAP, F.lit(False))
        steps = F.when(new, F.array().cast("array<double>")).when(x["y"] > a["y"], F.array_append(a["steps"], x["y"] - a["y"])).otherwise(a["steps"])
        return _let(a["n"] + new.cast("int"), lambda n: F.struct(n.alias("n"), x["y"].alias("y"), steps.alias("steps"), F.array_append(a["out"], F.struct(x["line_no"].alias("line_no"), n.alias("n"))).alias("out")))

    parts = df.groupBy(*keys, "_part").agg(F.sort_array(F.collect_list(item)).alias("i"))
    dealt = parts.select(*keys, "_part", F.explode(F.aggregate("i", begin, fold, lambda a: a["out"])).alias("x")).select(*keys, "_part", "x.line_no", "x.n")
    number = F.dense_rank().over(W.partitionBy(*keys).orderBy("_part", "n"))
    return df.join(dealt.select(*keys, "line_no", number.alias("segment")), [*keys, "line_no"]).drop("_part")


def paragraphs(lines: DataFrame, *keys: str) -> DataFrame:
    """One row per segment: its styles, box, text, number of lines, indent of its first line and median advance of its lines."""
    w = W.partitionBy(*keys, "segment").orderBy("line_no")
    df = segmented(lines, *keys).withColumn("_step", F.col("y0") - F.lag("y0").over(w))
    shown = F.transform(F.sort_array(F.collect_list(F.struct("line_no", T.stripped(T.some(F.col("text"))).alias("t")))), lambda x: x["t"])
    head = F.min_by("x0", "line_no")
    return df.groupBy(*keys, "segment").agg(
        F.first("font_role").alias("font_role"), F.first("role").alias("role"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        T.stripped(F.array_join(shown, "\n")).alias("text"), F.count("*").alias("n_lines"), F.greatest(F.lit(0.0), head - F.first("body_x0")).alias("first_indent"),
        F.round(F.median(F.when(F.col("_step") > 0, F.col("_step"))), 3).alias("line_height"),
    )
