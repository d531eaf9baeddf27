"""Operators over ordered rows: contexts, ranges, islands, packing, pagination."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Ordered scans whose state depends on earlier decisions: fn sees each group in order. A group has to fit one task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return fn(group.sort_values(list(order), kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def page_ranges(df: DataFrame, keys: Sequence[str], page: str, shift: int = 0) -> DataFrame:
    """Distinct page numbers of each key as "1-3, 5"."""
    w = W.partitionBy(*keys).orderBy("p")
    islands = df.select(*keys, (F.col(page) + shift).alias("p")).distinct().withColumn("g", F.col("p") - F.row_number().over(w))
    runs = islands.groupBy(*keys, "g").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    name = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    parts = F.sort_array(F.collect_list(F.struct("a", name.alias("t"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), ", ").alias("ranges"))


def page_selection(specs: DataFrame, total: str = "total") -> DataFrame:
    """Zero-based pages of specs such as "8, 12-15" (reversed ranges count too): id, page_index; a page out of range is an error."""
    part = F.explode(F.filter(F.split(F.trim("spec"), "[, \\t，、]+"), lambda x: x != ""))
    df = specs.select("id", total, part.alias("part")).withColumn("ends", F.split("part", "-"))
    a, b = F.element_at("ends", 1).cast("int"), F.element_at("ends", -1).cast("int")
    df = df.select("id", total, F.explode(F.sequence(F.least(a, b), F.greatest(a, b))).alias("n")).distinct()
    bad = (F.col("n") < 1) | (F.col("n") > F.col(total))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("page out of range: "), F.col("n").cast("string")))).otherwise(F.col("n") - 1)
    return df.select("id", checked.cast("int").alias("page_index"))


def tail(c: Column, n: int) -> Column:
    return F.right(T.some(c), F.lit(n))


def neighbours(df: DataFrame, key: str, page: str, text: str, n: int = 900) -> DataFrame:
    """The end of the page before and the start of the page after, by page number and not by rank."""
    at = lambda d, c, name: df.select(key, (F.col(page) + d).alias(page), c.alias(name))
    before, after = at(1, tail(F.col(text), n), "before"), at(-1, F.left(T.some(F.col(text)), F.lit(n)), "after")
    out = df.select(key, page).join(before, [key, page], "left").join(after, [key, page], "left")
    return out.select(key, page, *(F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after")))


def preceding_context(df: DataFrame, keys: Sequence[str], order: str, text: str, n: int = 500) -> DataFrame:
    """The end of the last text before each row that is not blank."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = F.when(T.stripped(F.col(text)) != "", tail(F.col(text), n))
    return df.select(*keys, order, F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("")).alias("context"))


def carried_heading(df: DataFrame, keys: Sequence[str], order: str, heading: str, source: Column) -> DataFrame:
    """The last heading up to each row, taken only from rows where source holds."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.when(source & (T.some(F.col(heading)) != ""), F.col(heading))
    return df.select(*keys, order, F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("")).alias("running"))


def joined_lines(df: DataFrame, keys: Sequence[str], order: str, line: str, structural: Column) -> DataFrame:
    """Runs of lines that are not structural become one line, without a blank next to CJK: keys, block, text."""
    w = W.partitionBy(*keys).orderBy(order)
    df = df.select(*keys, order, F.col(line).alias("line"), structural.alias("s"))
    df = df.withColumn("head", (F.col("s") | F.coalesce(F.lag("s").over(w), F.lit(True))).cast("int"))
    df = df.withColumn("block", F.sum("head").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"])
    han = "[\\x{4e00}-\\x{9fff}]"
    tight = lambda a, b: a.rlike(f"{han}$") | b.rlike(f"^{han}")
    text = F.aggregate(parts, F.lit(""), lambda a, b: F.when(a == "", b).when(tight(a, b), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b)))
    return df.groupBy(*keys, "block").agg(text.alias("text"))


#: Kinds of blocks that always go alone.
ALONE = ("heading", "table", "blockquote", "html_block")


def packed_blocks(df: DataFrame, keys: Sequence[str], order: str, kind: str, size: str, most: int = 3000) -> DataFrame:
    """Consecutive blocks in groups of at most `most` characters; some kinds go alone: keys, order, grp."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        out, number, filled, open_ = [], -1, 0, False
        for k, n in zip(g[kind], g[size], strict=True):
            if k in ALONE:
                number, filled, open_ = number + 1, 0, False
            else:
                if not open_ or filled + n > most:
                    number, filled, open_ = number + 1, 0, True
                filled += n
            out.append(number)
        return g[[*keys, order]].assign(grp=out)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, order).schema)
    return fold_groups(df.select(*keys, order, kind, size), keys, [order], fold, f"{kinds}, grp long")


def paginated(df: DataFrame, keys: Sequence[str], order: str, least: int = 1000, most: int = 1500, split_on_layout: bool = False) -> DataFrame:
    """Reading pages of blocks (size, is_title, is_heading, layout): a title starts a page, and once a page is full enough a heading or a block too many does."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        out, page, filled, empty, layout = [], 0, 0, True, None
        for row in g.itertuples():
            full = filled >= least and (row.is_heading or filled + row.size > most)
            if not empty and (row.is_title or full or (split_on_layout and row.layout != layout)):
                page, filled, empty = page + 1, 0, True
            layout = row.layout if empty else layout
            filled, empty = filled + row.size, False
            out.append(page)
        return g[[*keys, order]].assign(reading_page=out)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, order).schema)
    return fold_groups(df.select(*keys, order, "size", "is_title", "is_heading", "layout"), keys, [order], fold, f"{kinds}, reading_page long")


def adjacent_duplicates_dropped(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Rows whose value is not that of the row before."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_v", value).withColumn("_p", F.lag("_v").over(w)).where(~F.col("_v").eqNullSafe(F.col("_p"))).drop("_v", "_p")


def gaps(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """What the spans (id, begin, stop) of each text (id, n) leave uncovered: id, begin, stop."""
    all_ = spans.select("id", "begin", "stop").union(texts.select("id", F.col("n").alias("begin"), F.col("n").alias("stop")))
    w = W.partitionBy("id").orderBy("begin", "stop").rowsBetween(W.unboundedPreceding, -1)
    df = all_.withColumn("from", F.coalesce(F.max("stop").over(w), F.lit(0)))
    return df.where("begin > `from`").select("id", F.col("from").cast("int").alias("begin"), F.col("begin").cast("int").alias("stop"))


def upper_median(c: str) -> Column:
    """The upper of two middle values, which the interpolated median is not."""
    return F.expr(f"element_at(array_sort(collect_list({c})), cast(count({c}) div 2 + 1 as int))")


