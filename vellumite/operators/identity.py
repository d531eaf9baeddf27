"""Which paint operations and which image records belong to what stands on a page, by exact identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the bit of font flags for superscript, which only one side may have.
SUPERSCRIPT = 1


def _places(origins: Column) -> Column:
    """Different origins (arrays of x and y), to three decimals."""
    return F.array_distinct(F.transform(origins, lambda o: F.struct(F.bround(o["x"], 3).alias("x"), F.bround(o["y"], 3).alias("y"))))


def trace_matches(spans: DataFrame, traces: DataFrame, page: str) -> DataFrame:
    """page, span, trace, n_shared, error: each span with every paint operation of its font and flags that shares a glyph origin.

    spans: page, span, font, flags, origins (array of structs x, y); traces: the same with trace. A span without
    origins, or one that no operation matches, has one row with an error. Places are joined with font and flags in
    the key; a pair is counted before it is shuffled again, so a long run of shared origins costs one row.
    """
    style = [F.coalesce(F.col("font"), F.lit("")).alias("font"), F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(~SUPERSCRIPT)).alias("flags")]
    a = spans.select(page, "span", *style, F.explode(_places(F.col("origins"))).alias("o"))
    b = traces.select(page, "trace", *style, F.explode(_places(F.col("origins"))).alias("o"))
    pairs = a.join(b, [page, "font", "flags", "o"]).groupBy(page, "span", "trace").agg(F.count("*").alias("n_shared"))
    all_ = spans.select(page, "span", (F.coalesce(F.size("origins"), F.lit(0)) > 0).alias("placed"))
    error = F.when(~F.col("placed"), "no glyph origins").when(F.col("trace").isNull(), "no matching trace")
    return all_.join(pairs, [page, "span"], "left").select(page, "span", "trace", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), error.alias("error"))


def image_matches(blocks: DataFrame, infos: DataFrame, references: DataFrame, page: str, more: list[str]) -> DataFrame:
    """page, block, info, error: each image block with its record.

    blocks: page, block, transform, width, height, digest (of what is painted), source_digest. infos: page, info
    (their order), transform, width, height, xref, digest and the columns `more`. references: page, source_digest,
    xref. Records of the same transform and size count; if the source bytes are known under some reference only records
    with such a reference do, else only those with the painted digest. No record, or several that differ in
    anything but their number, is an error; of equal ones the first is taken.
    """
    size = ["transform", "width", "height"]
    r = infos.select(page, "info", *(F.col(c).alias(f"i_{c}") for c in size), F.col("xref").alias("i_xref"), F.col("digest").alias("i_digest"), *(F.col(c).alias(f"i_{c}") for c in more))
    known = references.select(page, "source_digest", F.lit(True).alias("known")).distinct()
    named = references.select(page, "source_digest", F.col("xref").alias("i_xref"), F.lit(True).alias("named")).distinct()
    on = [F.col(f"b.{page}") == F.col(f"r.{page}")] + [F.col(f"b.{c}").eqNullSafe(F.col(f"r.i_{c}")) for c in size]
    b = blocks.select(page, "block", *size, "digest", "source_digest")
    df = b.alias("b").join(r.alias("r"), on[0] & on[1] & on[2] & on[3]).select("b.*", *(F.col(f"r.{c}") for c in r.columns if c != page))
    df = df.join(known, [page, "source_digest"], "left").join(named, [page, "source_digest", "i_xref"], "left")
    fits = F.when(F.col("known"), F.coalesce(F.col("named"), F.lit(False))).otherwise(F.col("digest").eqNullSafe(F.col("i_digest")))
    record = F.to_json(F.struct(*(F.col(f"i_{c}") for c in size), "i_xref", F.hex("i_digest").alias("d"), *(F.col(f"i_{c}") for c in more)), {"ignoreNullFields": "false"})
    found = df.where(fits).groupBy(page, "block").agg(F.min("info").alias("info"), F.min(record).alias("least"), F.max(record).alias("most"))
    error = F.when(F.col("info").isNull(), "no record").when(F.col("least") != F.col("most"), "conflicting records")
    out = blocks.select(page, "block").join(found, [page, "block"], "left").withColumn("error", error)
    return out.select(page, "block", F.when(F.col("error").isNull(), F.col("info")).alias("info"), "error")
