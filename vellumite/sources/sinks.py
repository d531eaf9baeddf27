"""Reports and files out of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    """Text for a Markdown table cell."""
    return F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_report(items: DataFrame, title: str, columns: list[str], order: list[Column], pages: str = "page_num") -> DataFrame:
    """One row (text): a heading, the numbers of items and pages, and a table in the given order. For reports of a bounded number of items."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(c)) for c in columns)), F.lit(" |"))
    made = items.select(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), line.alias("line")).alias("x"), F.col(pages).alias("p"))
    head = [f"# {title}", "", "{}", "{}", "", f"| {' | '.join(columns)} |", "|" + " --- |" * len(columns)]
    body = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
    counts = [F.concat(F.lit("- items: "), F.count("*").cast("string")), F.concat(F.lit("- pages: "), F.countDistinct("p").cast("string"))]
    first = [F.lit(head[0]), F.lit(""), *counts, F.lit(""), F.lit(head[5]), F.lit(head[6])]
    return made.agg(F.array_join(F.concat(F.array(*first), body), "\n").alias("text"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def preserved_markdown(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """id, text: blocks (id, block, content, translatable) with their translations in place; a missing one is an error."""
    df = blocks.join(translations.select("id", "block", F.col("text").alias("t")), ["id", "block"], "left")
    missing = F.raise_error(F.concat(F.lit("no translation of block "), F.col("block").cast("string")))
    text = F.when(~F.col("translatable"), F.col("content")).when(F.col("t").isNull(), missing).otherwise(F.col("t"))
    parts = F.array_sort(F.collect_list(F.struct("block", text.alias("t"))))
    return df.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "\u0000").csv(path)
