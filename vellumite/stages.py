"""Tables between the rounds of an operator, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="vellumite_")


class Rounds:
    """Written tables of a loop: `step` writes one and drops the one before it, so that lineage and disk stay bounded."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.last = spark, f"{shared_dir(spark)}/vellumite/{name}-{uuid.uuid4().hex}", None
        self.number = 0

    def step(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """The table as written; one to keep is not dropped by the next step."""
        path = f"{self.folder}/{self.number}"
        df.write.parquet(path)
        self.number, before, self.last = self.number + 1, self.last, None if keep else path
        if before:
            self._drop(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
