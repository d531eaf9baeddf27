"""What the operators of this subpackage share: arrow mapping, written stages, row identity."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Stands for a null doc_id inside Python tasks; it sorts after every other id.
NULL_ID = (1 << 63) - 1

ROW = "_vellumite_row"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see (spark.checkpoint.dir); a temporary one only where none is set and all runs in one process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="vellumite_")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellumite/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._vellumite_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete written tables from which nothing is read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._vellumite_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Leaves of plans that give the same rows in the same splits each time they are read.
_STEADY = re.compile(r"^(FileScan|LocalTableScan|Range)\b")
_LEAF = re.compile(r"^[\s:+|\-*()\d]*")


def stable(docs: DataFrame) -> DataFrame:
    """docs itself if it only filters and projects files or local rows, so that each reading finds the same rows in the same splits; else written once."""
    rows = docs._jdf.queryExecution().sparkPlan().toString().splitlines()
    nodes = [_LEAF.sub("", x) for x in rows if x.strip()]
    simple = all(re.match(r"(Project|Filter|ColumnarToRow)\b", x) or _STEADY.match(x) for x in nodes) and sum(bool(_STEADY.match(x)) for x in nodes) == 1
    draws = any(re.search(r"\b(rand|randn|uuid|shuffle)\(", x) for x in nodes)
    return docs if simple and not draws else written(docs, "input")


def with_row(docs: DataFrame) -> DataFrame:
    """Add a row identity that depends only on how the (stable) input is split, so that repeated rows stay apart."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _bounded(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows or, unless a single row is larger, bytes."""
    if batch.num_rows <= rows and batch.nbytes <= size or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from _bounded(part, rows, size)


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """The worker's object of this key, made by its first task and shared by later ones; objects of other keys go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Let go of what earlier tasks of other stages left in this worker."""
    _KEPT.clear()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 2500, size: int = 16 << 20, keeps: bool = False) -> DataFrame:
    """mapInArrow whose function sees batches of bounded size; where the session does not bound those that it hands to Python, it gets bounds.

    keeps: the function uses `kept`; any other one starts by freeing what a worker kept.
    """
    conf = df.sparkSession.conf
    for k, v in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if conf.get(f"spark.sql.execution.arrow.{k}", None) is None:
            conf.set(f"spark.sql.execution.arrow.{k}", str(v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        return fn(part for b in batches for part in _bounded(b, rows, size))

    return df.mapInArrow(run, schema)


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


class Store:
    """A bounded map in two generations: what was used since the last turn is kept when the older half goes.

    limit: entries of a generation; keys of over `longest` characters are not kept, so that bytes are bounded too.
    """

    def __init__(self, limit: int, longest: int = 64) -> None:
        self.limit, self.longest, self.new, self.old = limit, longest, {}, {}

    def known(self, keys: Iterable[str]) -> tuple[dict, list[str]]:
        """Values of the keys that are here, and the other keys."""
        found, missing = {}, []
        for k in keys:
            if (v := self.new.get(k)) is None:
                if (v := self.old.get(k)) is None:
                    missing.append(k)
                    continue
                self.new[k] = v
            found[k] = v
        return found, missing

    def put(self, values: dict) -> None:
        self.new.update(values if max(map(len, values), default=0) <= self.longest else {k: v for k, v in values.items() if len(k) <= self.longest})
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
