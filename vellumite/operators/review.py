"""Reviewing dictionaries, checking references, labels of pages, emphasis and runs of styled text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T


def reviewed(glossary: DataFrame, decisions: DataFrame) -> DataFrame:
    """The dictionary (term, target) after decisions (term, target, action): add, update or ignore.

    Adding a term that is there, or updating one that is not, is an error.
    """
    d = decisions.where("action <> 'ignore'").select("term", F.col("target").alias("new"), "action")
    df = glossary.join(d, "term", "full_outer")
    there = F.raise_error(F.concat(F.lit("term exists: "), F.col("term")))
    lost = F.raise_error(F.concat(F.lit("no such term: "), F.col("term")))
    bad_add = (F.col("action") == "add") & F.col("target").isNotNull()
    bad_update = (F.col("action") == "update") & F.col("target").isNull()
    return df.select("term", F.when(bad_add, there).when(bad_update, lost).otherwise(F.coalesce("new", "target")).alias("target"))


def overlaid(base: DataFrame, own: DataFrame) -> DataFrame:
    """The base dictionary with the terms of the own one in place of equal terms."""
    return base.join(own.select("term"), "term", "left_anti").unionByName(own)


def prompt_terms(relevant: DataFrame, core: DataFrame) -> DataFrame:
    """id, section: lines of the relevant terms (id, match_rank, term, target) that are not in the core list already."""
    df = relevant.join(core.select("term"), "term", "left_anti")
    line = F.concat(F.lit("- "), F.col("term"), F.lit(" -> "), F.col("target"))
    parts = F.sort_array(F.collect_list(F.struct("match_rank", line.alias("l"))))
    return df.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["l"]), "\n").alias("section"))


def broken_references(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """What a renderer would refuse: problem, block_id. Ids that come twice, regions that are not there, hashes that differ."""
    twice = blocks.groupBy("block_id").count().where("count > 1").select(F.lit("twice").alias("problem"), "block_id")
    lost = blocks.join(regions.select("region_id"), "region_id", "left_anti").select(F.lit("no region").alias("problem"), "block_id")
    stale = blocks.where(T.source_hash(F.col("source")) != F.col("source_hash")).select(F.lit("stale").alias("problem"), "block_id")
    return twice.union(lost).union(stale)


def ownership(expected: DataFrame, found: DataFrame) -> DataFrame:
    """problem, block_id for blocks (block_id, page) that no owner, several owners, or an owner on another page has."""
    f = found.groupBy("block_id").agg(F.count("*").alias("n"), F.min("page").alias("on"))
    df = expected.join(f, "block_id", "left")
    what = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "multiple").when(F.col("on") != F.col("page"), "wrong page")
    return df.select(what.alias("problem"), "block_id").where("problem IS NOT NULL")


def label_key(c: Column) -> Column:
    """struct(kind, prefix, value) of a page label that ends in a number or is a roman numeral; null for any other."""
    s = T.stripped(c)
    number = F.struct(F.lit("number").alias("kind"), F.regexp_extract(s, "^(.*?)(\\d+)$", 1).alias("prefix"), F.regexp_extract(s, "^(.*?)(\\d+)$", 2).cast("int").alias("value"))
    roman = F.struct(F.lit("roman").alias("kind"), F.lit("").alias("prefix"), T.roman_value(s).alias("value"))
    return F.when(s.rlike("^.*?\\d+$"), number).when(s.rlike("^[ivxlcdmIVXLCDM]+$"), roman)


def labelled_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pages (keys, page, label) as ranges of labels; a range ends where pages or labels do not follow one another."""
    w = W.partitionBy(*keys).orderBy("page")
    df = df.withColumn("k", label_key(F.col("label")))
    follows = (F.lag("page").over(w) + 1 == F.col("page")) & (F.lag("k").over(w)["kind"] == F.col("k")["kind"]) & (F.lag("k").over(w)["prefix"] == F.col("k")["prefix"])
    follows = follows & (F.lag("k").over(w)["value"] + 1 == F.col("k")["value"])
    df = df.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int"))
    df = df.withColumn("g", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = df.groupBy(*keys, "g").agg(F.min_by("label", "page").alias("a"), F.max_by("label", "page").alias("b"), F.count("*").alias("n"))
    name = F.when(F.col("n") == 1, F.col("a")).otherwise(F.concat_ws("-", "a", "b"))
    parts = F.sort_array(F.collect_list(F.struct("g", name.alias("t"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), ", ").alias("ranges"))


_TAG = re.compile(r"<(/?)([a-zA-Z]+)[^>]*>")


def emphasis_error(text: str | None) -> str:
    """Why emphasis tags are not accepted: other tags, or strong and em that do not nest; empty if they are."""
    open_: list[str] = []
    for close, name in _TAG.findall(text or ""):
        if name not in ("strong", "em"):
            return f"tag {name}"
        if not close:
            open_.append(name)
        elif not open_ or open_.pop() != name:
            return f"unpaired {name}"
    return f"open {open_[-1]}" if open_ else ""


def checked_emphasis(df: DataFrame) -> DataFrame:
    """id, error of each text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"], "error": [emphasis_error(t) for t in pdf["text"]]})

    return df.select("id", "text").mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, error string")


def marked_runs(df: DataFrame) -> DataFrame:
    """id, text of styled runs (id, pos, text, bold, italic): marked with <b>, <i>, <bi> where the styles of a paragraph differ; an unset style is not false."""
    w = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumn("first_b", F.first("bold").over(w)).withColumn("first_i", F.first("italic").over(w))
    differs = ~(F.col("bold").eqNullSafe(F.col("first_b")) & F.col("italic").eqNullSafe(F.col("first_i")))
    df = df.withColumn("mixed", F.max(differs.cast("int")).over(W.partitionBy("id")))
    b, i = F.coalesce("bold", F.lit(False)), F.coalesce("italic", F.lit(False))
    tag = F.when(b & i, "bi").when(b, "b").when(i, "i")
    made = F.when((F.col("mixed") == 1) & tag.isNotNull(), F.concat(F.lit("<"), tag, F.lit(">"), "text", F.lit("</"), tag, F.lit(">"))).otherwise(F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("pos", made.alias("t"))))
    return df.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))


def kept_overprints(spans: DataFrame) -> DataFrame:
    """Of neighbouring spans (id, pos, text, luminance) with one text the brightest stays, the later of equals: id, pos."""
    w = W.partitionBy("id").orderBy("pos")
    df = spans.withColumn("new", F.coalesce(~F.col("text").eqNullSafe(F.lag("text").over(w)), F.lit(True)).cast("int"))
    df = df.withColumn("g", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return df.groupBy("id", "g").agg(F.max_by("pos", F.struct("luminance", "pos")).alias("pos")).select("id", "pos")


def date_groups(lines: DataFrame, is_date: Column) -> DataFrame:
    """Timeline entries of lines (id, pos, text): a date line begins one, the rest describes it: id, entry, date, text."""
    w = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    df = lines.withColumn("d", is_date).withColumn("entry", F.sum(F.col("d").cast("int")).over(w)).where("entry > 0")
    rest = F.sort_array(F.collect_list(F.when(~F.col("d"), F.struct("pos", "text"))))
    return df.groupBy("id", "entry").agg(F.max(F.when(F.col("d"), F.col("text"))).alias("date"), F.array_join(F.transform(rest, lambda x: x["text"]), " ").alias("text"))


def first_owner_groups(issues: DataFrame) -> DataFrame:
    """Disjoint repair groups of issues (ord, blocks): an issue that has a block of an earlier group is left out: ord, blocks. For one document's issues."""
    item = F.struct("ord", "blocks")
    kind = "struct<owned:array<string>,kept:array<struct<ord:int,blocks:array<string>>>>"
    start = F.struct(F.array().cast("array<string>").alias("owned"), F.array().cast("array<struct<ord:int,blocks:array<string>>>").alias("kept")).cast(kind)
    step = lambda a, x: F.when(F.arrays_overlap(a["owned"], x["blocks"]), a).otherwise(F.struct(F.array_union(a["owned"], x["blocks"]).alias("owned"), F.array_append(a["kept"], x).alias("kept")).cast(kind))
    lists = issues.groupBy("doc").agg(F.sort_array(F.collect_list(item)).alias("all"))
    return lists.select("doc", F.explode(F.aggregate("all", start, step)["kept"]).alias("k")).select("doc", "k.*")


def run_effect(df: DataFrame) -> DataFrame:
    """Rates of runs (run, input_tokens, cached_tokens, cost_usd, translated_pages), without dividing by nothing."""
    rate = F.coalesce(F.try_divide(F.col("cached_tokens"), F.col("input_tokens")), F.lit(0.0))
    return df.select("run", rate.cast("double").alias("cache_hit_rate"), F.try_divide(F.col("cost_usd"), F.col("translated_pages")).cast("double").alias("cost_per_page"))


def cost_text(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.format_string("$%.3f", c.cast("double")))


def age_days(modified: Column, now: Column) -> Column:
    """Days since a time in seconds, not below zero."""
    return F.greatest(F.lit(0.0), now - modified) / 86_400


def labels_follow(left: Column, right: Column) -> Column:
    """Is the right page label of the kind and prefix of the left one, and the next in number?"""
    a, b = label_key(left), label_key(right)
    return F.coalesce((a["kind"] == b["kind"]) & (a["prefix"] == b["prefix"]) & (b["value"] == a["value"] + 1), F.lit(False))
