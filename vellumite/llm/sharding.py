"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws -ln(u) / weight, u being hashed from
the key and the child's name, and the smallest draw wins. Raising one child's weight can only move keys to that
child, so movement is confined to the subtree whose weight changed. A shard that opens a region of its own takes
rows only into itself. Every draw is a built-in expression over the key; texts are measured in the scan and never
move. Slots inside a shard are dealt by hash buckets of bounded size: numbers inside a bucket plus the sizes of the
buckets before it, so that no task holds a whole shard.

Defined results: a null text has size 1 (no bytes plus one) and the checksum of the empty text; a null doc_id is
hashed as the empty text; repeated rows go to the same shard and take a slot each; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.tables import table


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


#: Shards to a rack and racks to a region when a tree is laid out from a number of shards.
RACK_SHARDS, REGION_RACKS = 4, 2
#: Rows that a slot bucket holds on average.
BUCKET_ROWS = 2_000


def tree(shards: int) -> list[Leaf]:
    """Shard i is in rack i // 4 and that rack in region i // 8, all of weight 1; a full region never changes when shards are added."""
    return [Leaf(f"r{i // (RACK_SHARDS * REGION_RACKS)}", f"k{i // RACK_SHARDS}", i) for i in range(shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    # 52 bits of an MD5 digest as a number in (0, 1).
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _winner(key: Column, children: Sequence[tuple[str, float]]) -> Column:
    """Index of the child with the smallest draw; of equal draws the first."""
    if len(children) == 1:
        return F.lit(0)
    return F.array_min(F.array(*(F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, w) in enumerate(children))))["i"]


def assigned(df: DataFrame, key: Column, leaves: Sequence[Leaf], out: str) -> DataFrame:
    """Add the shard (int) that the tree of leaves gives to each key."""
    regions: dict[str, dict[str, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for leaf in leaves:
        regions[leaf.region][leaf.rack].append(leaf)
    total = lambda racks: sum(x.weight for rack in racks.values() for x in rack)
    region, rack = f"_{out}_region", f"_{out}_rack"
    df = df.withColumn(region, _winner(key, [(f"region:{r}", total(racks)) for r, racks in regions.items()]))

    def within(level: str, options: list[Column]) -> Column:
        choice = F.when(F.col(level) == 0, options[0])
        for i, o in enumerate(options[1:], 1):
            choice = choice.when(F.col(level) == i, o)
        return choice

    df = df.withColumn(
        rack,
        within(region, [_winner(key, [(f"rack:{r}/{k}", sum(x.weight for x in v)) for k, v in racks.items()]) for r, racks in regions.items()]),
    )

    def shards(racks: dict[str, list[Leaf]]) -> Column:
        picks = []
        for v in racks.values():
            ids = F.array(*(F.lit(x.shard) for x in v))
            picks.append(F.get(ids, _winner(key, [(f"shard:{x.shard}", x.weight) for x in v])))
        return within(rack, picks)

    return df.withColumn(out, within(region, [shards(racks) for racks in regions.values()]).cast("int")).drop(region, rack)


def _slots(df: DataFrame, rows: int, shards: int, bucket_rows: int) -> DataFrame:
    """Gapless numbers from 0 within each shard, in the order of hash bucket, doc_id, checksum and size."""
    key = F.concat(F.lit("slot|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    df = df.withColumn("bucket", F.crc32(key.cast("binary")) % F.lit(max(1, -(-rows // (shards * bucket_rows)))))
    sizes = df.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "bucket", before.alias("start"))
    order = W.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    numbered = df.withColumn("at", F.row_number().over(order) - 1)
    return numbered.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("at")).cast("bigint")).drop("start", "at", "bucket")


def sharded(docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, and its shard in the grown tree if one is given."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    df = docs.select("doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    df = assigned(df, key, leaves, "shard")
    df = assigned(df, key, grown, "grown_shard") if grown else df.withColumn("grown_shard", F.lit(None).cast("int"))
    return _slots(df, docs.count(), len(leaves), bucket_rows)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sharded(table(spark, sf_dir, "documents"), tree(16), tree(17))
    return df.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
