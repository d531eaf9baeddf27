"""Reading the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of one partition of rows that are dealt by a key.
DEALT_ROWS = 200_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df, rows of a key together, in so many partitions that one holds some DEALT_ROWS rows, however large the table is.

    Shuffled rows of numbers are packed to a tenth of what they take in a sort, so partitions that Spark joins by
    their bytes on disk can be too large for several sorts of one task.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // DEALT_ROWS)), key)
