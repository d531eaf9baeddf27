"""Small operators over records: page windows, addresses, listings, orders, signatures, answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T

#: Hosts that plain HTTP may reach.
LOCAL = ("localhost", "127.0.0.1", "::1")


def page_window(start: Column, stop: Column, total: Column) -> Column:
    """struct(start, stop, error): a half-open range of pages; an open start is 0, an open or too late stop is the number of pages."""
    a, b = F.coalesce(start, F.lit(0)), F.least(F.coalesce(stop, total), total)
    wrong = F.when(total < 1, "no pages").when(a < 0, "start below 0").when(a >= total, "start beyond the last page").when(b <= a, "stop not after start")
    return F.struct(F.when(wrong.isNull(), a).alias("start"), F.when(wrong.isNull(), b).alias("stop"), wrong.alias("error"))


def endpoint(url: Column) -> Column:
    """struct(address, error): the address without a slash at the end and in lower case, and what is wrong with it."""
    u = F.trim(T.some(url))
    host = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)", 1)
    name = F.lower(F.regexp_replace(host, "^\\[|\\]$", ""))
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    wrong = (
        F.when(u == "", "empty").when(~scheme.isin("http", "https"), "neither http nor https").when(name == "", "no host")
        .when((scheme == "http") & ~name.isin(*LOCAL), "plain http to a remote host")
    )
    return F.struct(F.lower(F.regexp_replace(u, "/+$", "")).alias("address"), wrong.alias("error"))


def excerpt_around(text: Column, needle: Column, limit: int = 160) -> Column:
    """The text around the first occurrence of a needle, whatever its case; else the beginning."""
    body, half = T.some(text), limit // 2
    at = F.position(F.lower(needle), F.lower(body))
    begin = F.greatest(at - 1 - half, F.lit(0))
    stop = F.least(at - 1 + F.length(needle) + half, F.length(body))
    return T.excerpt(F.when(at > 0, F.substr(body, begin + 1, stop - begin)).otherwise(body), limit)


#: Fixed value: a title, a leader of dots, dashes or blanks, and a page number.
_ENTRY = r"^(.*?)\s*(?:[.\-]{3,}|\s{2,})\s*(\d{1,4})\s*$"


def contents_entry(line: Column) -> Column:
    """struct(title, page) of a line of a table of contents, null for other lines."""
    one = T.stripped(T.some(line))
    title = F.btrim(F.regexp_replace(F.regexp_extract(one, _ENTRY, 1), r"[.\-]{3,}\s*$", ""), F.lit(" -\t"))
    return F.when(one.rlike(_ENTRY) & (title != ""), F.struct(title.alias("title"), F.regexp_extract(one, _ENTRY, 2).alias("page")))


def after_article(text: Column, start: Column) -> Column:
    """Does an English article and a blank stand right before a place (counted from 0)?"""
    before = F.substr(text, F.greatest(start - 4, F.lit(0)) + 1, F.least(start, F.lit(4)))
    return (start >= 2) & before.rlike("(?i)\\b(the|a|an)\\s+$")


def first_of_each(rows: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """Of rows with one key the first in an order, as for paths that resolve alike."""
    w = W.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_key")


def resolved(path: Column) -> Column:
    """A path without empty and single-dot steps, and with its double-dot steps taken; relative ones start at the root."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")
    taken = F.aggregate(steps, none, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.concat(F.lit("/"), F.array_join(taken, "/"))


def not_ignored(items: DataFrame, ignored: DataFrame, page: str) -> DataFrame:
    """Items of pages that are not in the ignored set; items without a page stay."""
    return items.join(ignored.select(page).distinct(), page, "left_anti")


def hinted_order(blocks: DataFrame, hints: DataFrame, keys: Sequence[str], block: str, order: str) -> DataFrame:
    """place: blocks that a hint lists (block, at) come first and in its order, the others after them as they were."""
    w = W.partitionBy(*keys).orderBy(F.col("at").asc_nulls_last(), order)
    return blocks.join(hints.select(*keys, block, "at"), [*keys, block], "left").withColumn("place", F.row_number().over(w)).drop("at")


def issue_place(key: str, page: Column, rest: Sequence[Column]) -> Column:
    """The place of an issue within its key: numbered pages by number, others after them by name, then by the rest."""
    name = F.coalesce(page.cast("string"), F.lit(""))
    number = F.when(name.rlike("^[0-9]+$"), name.cast("long"))
    return F.row_number().over(W.partitionBy(key).orderBy(number.asc_nulls_last(), name, *rest))


def file_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def signature(*parts: Column) -> Column:
    """SHA-256 of named parts in compact JSON, keys in the order given."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def group_signatures(blocks: DataFrame, keys: Sequence[str], block: str, order: str, text: str, target: str) -> DataFrame:
    """keys, cache_key: of each group's blocks in order, of the hashes of their texts, and of the layout target."""
    item = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(block).cast("string").alias("b"), F.sha2(T.some(F.col(text)), 256).alias("h"))))
    df = blocks.groupBy(*keys).agg(item.alias("i"), F.min(target).alias("target_signature"))
    ids, hashes = F.transform("i", lambda x: x["b"]).alias("block_ids"), F.transform("i", lambda x: x["h"]).alias("source_hashes")
    return df.select(*keys, signature(ids, hashes, F.col("target_signature")).alias("cache_key"))


def cached_groups(groups: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks (keys, block, cache_key, unusable) whose whole group is in the cache (cache_key, block, translation) and usable: keys, block, translation.

    One block that the cache lacks, has besides, or has in an unusable form leaves its whole group out.
    """
    both = groups.join(cache, ["cache_key", "block"], "full")
    fine = F.every(F.col("translation").isNotNull() & F.col("wanted").isNotNull() & ~F.coalesce("unusable", F.lit(False)))
    whole = both.withColumn("fine", fine.over(W.partitionBy("cache_key")))
    return whole.where("fine").select(*keys, "block", "translation")


def completion_fault(text: Column, reason: Column) -> Column:
    """Why an answer is rejected: cut off, empty, leaking its instructions, or with kana; null for a good one."""
    t = T.stripped(T.some(text))
    return F.when(F.coalesce(reason == "length", F.lit(False)), "truncated").when(t == "", "empty").when(T.prompt_leak(t), "prompt leak").when(T.has_kana(t), "kana")
