"""Tables that hold progress: upserts, resuming, completeness, caches, limits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T
from vellumite.operators.ordered import fold_groups


def upserted(state: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state with the changes' rows in place of those with equal keys."""
    return state.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def deleted(state: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return state.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def pending(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """Blocks with text of which no completed row has the same id and source hash (or "*")."""
    df = blocks.where(T.stripped(F.col("text")) != "").withColumn("src_hash", T.source_hash(F.col("text")))
    exact = df.join(done.where("src_hash <> '*'").select("block_id", "src_hash"), ["block_id", "src_hash"], "left_anti")
    return exact.join(done.where("src_hash = '*'").select("block_id"), "block_id", "left_anti")


def completeness(expected: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: expected, translated, failed and missing pages, pages that come twice and pages that nobody expected."""
    one = lambda df, c: df.agg(F.count("*").alias(c))
    e, d, f = (x.select("page_index").distinct() for x in (expected, done, failed))
    missing = e.subtract(d).subtract(f)
    twice = done.groupBy("page_index").count().where("count > 1")
    strange = d.subtract(e)
    parts = [one(e, "n_expected"), one(d, "n_translated"), one(f, "n_failed"), one(missing, "n_missing"), one(twice, "n_twice"), one(strange, "n_strange")]
    names = [p.columns[0] for p in parts]
    long = parts[0].select(F.lit(names[0]).alias("k"), F.col(names[0]).alias("v"))
    for p, n in zip(parts[1:], names[1:], strict=True):
        long = long.union(p.select(F.lit(n).alias("k"), F.col(n).alias("v")))
    return long.groupBy().agg(*(F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names))


def metadata_diff(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Expected keys (key, value) whose stored value differs or is not there."""
    s = stored.select("key", F.col("value").alias("stored"))
    return expected.join(s, "key", "left").where(~F.col("value").eqNullSafe(F.col("stored"))).select("key", "value", "stored")


def reused_by_hash(rows: DataFrame) -> DataFrame:
    """Each row (id, text) with the hash of its text and the first row that has the same: what a cache would answer."""
    df = rows.withColumn("hash", T.source_hash(F.col("text")))
    first = df.groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return df.select("id", "hash").join(first, "hash").select("id", "hash", "first_id", "n", (F.col("id") != F.col("first_id")).alias("hit"))


def complete_units(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """unit_id, complete: are all blocks of the unit completed?"""
    d = done.select("block_id", F.lit(True).alias("d")).distinct()
    return blocks.join(d, "block_id", "left").groupBy("unit_id").agg(F.bool_and(F.coalesce("d", F.lit(False))).alias("complete"))


def calls_in_window(calls: DataFrame, key: str, seconds: int) -> DataFrame:
    """How many calls of the key lie in the window that ends with each call: an upper bound of those admitted."""
    w = W.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("in_window", F.count("*").over(w))


def admitted(calls: DataFrame, key: str, ident: str, most: int, seconds: int) -> DataFrame:
    """Sliding-window admission: key, ident, ok, wait (seconds until the oldest admitted call leaves the window)."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        taken: list[float] = []
        ok, wait = [], []
        for ts in g["us"] / 1e6:
            taken = [t for t in taken if t > ts - seconds]
            if len(taken) < most:
                taken.append(ts)
                ok.append(True)
                wait.append(0.0)
            else:
                ok.append(False)
                wait.append(max(0.0, taken[0] + seconds - ts))
        return g[[key, ident]].assign(ok=ok, wait=wait)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in calls.select(key, ident).schema)
    df = calls.select(key, ident, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return fold_groups(df, [key], ["us", ident], fold, f"{kinds}, ok boolean, wait double")


def failure_runs(events: DataFrame, key: str, order: Sequence[str], failed: Column, threshold: int = 3) -> DataFrame:
    """Runs of consecutive failures: key, first (of the first order column), n, trips (how often a breaker of the threshold opens)."""
    w = W.partitionBy(key).orderBy(*order)
    df = events.select(key, *order, failed.alias("f"))
    df = df.withColumn("g", F.sum((~F.col("f")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = df.where("f").groupBy(key, "g").agg(F.min(order[-1]).alias("first"), F.count("*").alias("n"))
    return runs.select(key, "first", "n", F.floor(F.col("n") / threshold).cast("bigint").alias("trips"))


def split_retry(blocks: list[int], translate, depth: int = 0, most: int = 10) -> tuple[dict[int, str], list[int]]:
    """Translate a group; what is missing from a partial answer is tried again, a group without any answer in halves, down to a depth: (done, failed)."""
    if not blocks or depth > most:
        return {}, list(blocks)
    done = translate(blocks)
    rest = [b for b in blocks if b not in done]
    if not rest or len(blocks) == 1:
        return done, rest
    if len(rest) < len(blocks):
        more, failed = split_retry(rest, translate, depth + 1, most)
        return done | more, failed
    half = len(blocks) // 2
    a, fa = split_retry(blocks[:half], translate, depth + 1, most)
    b, fb = split_retry(blocks[half:], translate, depth + 1, most)
    return a | b, fa + fb


def loaded(progress: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """Rows of stored progress, none of them if any key of the fingerprint (key, value) differs from the stored metadata (columns meta, id, text)."""
    want = fingerprint.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("want"))
    one = want.first()["want"] or {}
    same = F.lit(True)
    for k, v in sorted(one.items()):
        same = same & F.col("meta")[k].eqNullSafe(F.lit(v))
    return progress.where(same).drop("meta")


def cleared(state: DataFrame, cache: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State without the pages, and the cache without entries that hold a cleared page's text."""
    gone = state.join(pages.select("page_index").distinct(), "page_index", "left_semi")
    return deleted(state, pages, ["page_index"]), cache.join(gone.select(F.col("text").alias("value")).distinct(), "value", "left_anti")


def cached_answers(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (id, key) with the cached value (key, value) if there is one that is usable: id, value."""
    good = cache.where((T.stripped(F.col("value")) != "") & ~T.prompt_leak(F.col("value")) & ~T.has_kana(F.col("value")))
    return requests.join(good.select("key", "value"), "key").select("id", "value")


def progress_summary(pages: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: pages, completed, failed, and pages with text."""
    df = pages.join(done.select("page_index", F.lit(1).alias("d")).distinct(), "page_index", "left").join(failed.select("page_index", F.lit(1).alias("f")).distinct(), "page_index", "left")
    return df.agg(F.count("*").alias("n"), F.count("d").alias("n_done"), F.count("f").alias("n_failed"), F.count_if(T.stripped(F.col("text")) != "").alias("n_text"))
