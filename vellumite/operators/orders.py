"""Deterministic orders and limits of reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: Sequence[Column], name: str = "ord") -> DataFrame:
    """Number the (few) rows of a report in its order."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first rows of each key: a top-k report."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def review_order() -> list[Column]:
    """Pages first, rows without a page last, then category and title."""
    return [F.col("page_num").asc_nulls_last(), F.col("category").asc(), F.col("title").asc()]


def numeric_first(c: str) -> list[Column]:
    """Numbers in their order before text in its own."""
    n = F.expr(f"try_cast({c} AS INT)")
    return [n.isNull().asc(), n.asc(), F.col(c).asc()]


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ord") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
