"""Text, JSON, zip and listing sources."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from vellumite.functions import text as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number: path, line, text. A file is read whole, so that numbers are exact."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return df.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))


def glossary(lines: DataFrame) -> DataFrame:
    """Dictionary lines (line, text) as ord, target, term: cut at tabs, else at two blanks and more; comments and blank lines go.

    A target with a question mark, or one term with two targets, is an error that names them.
    """
    kept = lines.where((T.stripped(F.col("text")) != "") & ~F.ltrim("text").startswith("#"))
    cells = F.when(F.col("text").contains("\t"), F.split("text", "\t")).otherwise(F.split(F.trim("text"), " {2,}"))
    df = kept.select(F.col("line").alias("ord"), F.transform(cells, lambda x: F.trim(x)).alias("c")).where(F.size("c") >= 2)
    df = df.select("ord", F.col("c")[0].alias("target"), F.col("c")[1].alias("term")).where("target <> '' AND term <> ''")
    w = W.partitionBy("term").orderBy("ord")
    whole = W.partitionBy("term")
    df = df.withColumn("least", F.min("target").over(whole)).withColumn("most", F.max("target").over(whole)).withColumn("r", F.row_number().over(w))
    broken = F.raise_error(F.concat(F.lit("damaged target of "), F.col("term")))
    twice = F.raise_error(F.concat(F.lit("two targets of "), F.col("term"), F.lit(": "), F.col("least"), F.lit(", "), F.col("most")))
    checked = F.when(F.col("target").contains("?"), broken).when(F.col("least") != F.col("most"), twice).otherwise(F.col("target"))
    return df.select("ord", checked.alias("target"), "term", "r").where("r = 1").drop("r")


PROGRESS = S.StructType(
    [
        S.StructField("schema_version", S.IntegerType()),
        S.StructField("metadata", S.MapType(S.StringType(), S.StringType())),
        S.StructField("completed", S.ArrayType(S.IntegerType())),
        S.StructField("translations", S.MapType(S.StringType(), S.StringType())),
        S.StructField("failed", S.MapType(S.StringType(), S.StringType())),
    ]
)


def parsed_json(df: DataFrame, column: str, schema: S.StructType, version: int) -> DataFrame:
    """Columns of a versioned JSON document; another version is an error."""
    parsed = df.withColumn("_j", F.from_json(column, schema, {"mode": "FAILFAST"}))
    bad = F.raise_error(F.concat(F.lit("schema version "), F.coalesce(F.col("_j.schema_version").cast("string"), F.lit("missing"))))
    return parsed.withColumn("_j", F.when(F.coalesce(F.col("_j.schema_version"), F.lit(-1)) != version, bad).otherwise(F.col("_j"))).select("_j.*")


def translations(progress: DataFrame) -> DataFrame:
    """page_index, text of a progress document's translations that are not blank."""
    df = progress.select(F.explode("translations").alias("k", "text"))
    return df.where(T.stripped(F.col("text")) != "").select(F.col("k").cast("int").alias("page_index"), "text")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, length, modified. Contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.col("length").alias("length"), F.col("modificationTime").alias("modified"))


def folder_sizes(files: DataFrame, root: str) -> DataFrame:
    """top, bytes, files, modified of the entries right below the root."""
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return files.groupBy(F.split(rel, "/")[0].alias("top")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"), F.max("modified").alias("modified"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def word_rows(content: bytes) -> list[tuple[int, str, str, str]]:
    """Paragraphs of a Word file in order: number, place (body or table), style, text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    inside = {p for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    out = []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        out.append((len(out), "table" if p in inside else "body", "" if style is None else style.get(f"{_W}val", ""), text))
    return out


def word_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of Word files: path, block, place, style, text."""

    def read(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            made = [(p, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in word_rows(c)]
            yield pd.DataFrame(made, columns=["path", "block", "place", "style", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, block int, place string, style string, text string")
