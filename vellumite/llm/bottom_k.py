"""Document fingerprints: bottom-k sketches of word shingles, in built-in expressions only.

A sketch is the sorted array of the k smallest distinct hashes (twelve hex digits of MD5) of a text's shingles of
five words; fewer words are one shingle, no words an empty sketch. A sketch of fewer than k hashes holds all of them.
Sketches of parts merge into that of the whole set, and two sketches give the resemblance and containment of their
sets, both from the hashes up to the smaller of the two largest, so that more than k may count. Texts move once, for
their neighbours; shingles never leave their row.

Defined results: a null text counts as empty; two empty sketches resemble each other fully (1.0), an empty and a
filled one not at all; containment of an empty set is 1.0, and null where b's hashes say nothing about a's range;
documents follow each other by descending doc_id, null ones last, equal ones by a hash of their texts; the only
document follows itself; an empty table gives no rows; other columns are ignored. Rows of one doc_id with one text
are ordered in one task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.llm.common import stable
from vellumite.tables import table

WORDS, K = 5, 128
#: Hex digits of a hash.
DIGITS = 12
#: Rows that a block of neighbours holds on average, most blocks, and keys that are drawn for each block's border.
BLOCK_ROWS, MOST_BLOCKS, DRAWN = 500, 20_000, 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound to a variable, so that it is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, words: int = WORDS, k: int = K) -> Column:
    """The sketch of a text as array<string>."""
    digest = lambda x: F.left(F.md5(x.cast("binary")), F.lit(DIGITS))

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - words)
        each = F.transform(at, lambda i: digest(F.concat_ws(" ", *(F.get(w, i + j) for j in range(words)))))
        few = F.when(F.size(w) > 0, F.array(digest(F.array_join(w, " ")))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) >= words, each).otherwise(few)

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.slice(F.sort_array(F.array_distinct(_let(found, hashes))), 1, k)


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sets together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """keys and the sketch of all rows of a key. Each task passes on k hashes of a key at most."""
    each = df.select(*keys, F.explode(column).alias("_h")).distinct()
    first = each.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    found = first.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias("_s"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    on = same[0]
    for c in same[1:]:
        on &= c
    all_ = df.select(*keys).distinct().alias("l").join(found.alias("r"), on, "left")
    return all_.select(*(F.col(f"l.{c}").alias(c) for c in keys), F.coalesce(F.col("r._s"), F.array().cast("array<string>")).alias(column))


def _shared(a: Column, b: Column, k: int, body: Callable[[Column, Column, Column], Column]) -> Column:
    """body of (hashes of a, of b, of both), counted where both sketches know them."""
    last = lambda s: F.when(F.size(s) >= k, F.element_at(s, -1))
    within = lambda s, most: F.filter(s, lambda h: most.isNull() | (h <= most))
    pair = _let(F.least(last(a), last(b)), lambda most: F.struct(within(a, most).alias("a"), within(b, most).alias("b")))
    return _let(pair, lambda p: body(F.size(p["a"]), F.size(p["b"]), F.size(F.array_intersect(p["a"], p["b"]))))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of the two sets' shingles that both have."""
    return _shared(a, b, k, lambda x, y, both: F.when(x + y == 0, F.lit(1.0)).otherwise(both / (x + y - both)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has too."""
    return _shared(a, b, k, lambda x, y, both: F.when(F.size(a) == 0, F.lit(1.0)).when(x > 0, both / x))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles."""
    largest = F.conv(F.element_at(s, -1), 16, 10).cast("double") + 1
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / largest * float(16**DIGITS))


def _fixed(values: list, kind: str) -> Column:
    """A list as a constant."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def dealt_with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, W]:
    """doc_id and text of every row in blocks, and the window in which lead() finds the next row by descending doc_id.

    Keys that occur are drawn as the borders of blocks, so the first row of each block is known beforehand: it is
    also sent to the block before it as a guest (the very first one to the last block). Rows with `guest` are
    only there to be found by lead() and have to go afterwards.
    """
    docs = stable(docs).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("i"), F.xxhash64("text").alias("h"))
    keyed = docs.select(key.alias("key"))
    rows, top = keyed.agg(F.count("*"), F.max("key")).first()
    blocks = max(1, min(MOST_BLOCKS, rows // block_rows))
    drawn = keyed.where(F.pmod(F.xxhash64("key.i", "key.h", F.lit("border")), F.lit(max(rows, 1))) < (DRAWN * blocks if blocks > 1 else 0)).distinct().collect()
    top = top or (0, 0)
    firsts = [tuple(top), *sorted({tuple(r.key) for r in drawn} - {tuple(top)}, reverse=True)[DRAWN - 1 :: DRAWN]]
    n, side = len(firsts), math.isqrt(len(firsts)) + 1
    pair = lambda x: {"i": x[0], "h": x[1]}
    heads = _fixed([pair(x) for x in firsts[::side]], "array<struct<i:bigint,h:bigint>>")
    parts = _fixed([[pair(x) for x in firsts[a : a + side]] for a in range(0, n, side)], "array<array<struct<i:bigint,h:bigint>>>")
    upto = lambda borders, k: F.size(F.filter(borders, lambda x: x >= k)) - 1
    part = lambda k: _let(upto(heads, k), lambda p: _let(F.get(parts, p), lambda borders: _let(upto(borders, k), lambda q: F.struct((p * side + q).alias("block"), (F.get(borders, q) == k).alias("opens")))))
    df = docs.select("doc_id", "text", key.alias("key")).withColumn("at", part(F.col("key")))
    stay = F.struct(F.col("at.block").alias("block"), F.lit(False).alias("guest"))
    visit = F.struct(((F.col("at.block") + (n - 1)) % n).alias("block"), F.lit(True).alias("guest"))
    df = df.select("doc_id", "text", "key", F.explode(F.when(F.col("at.opens"), F.array(stay, visit)).otherwise(F.array(stay))).alias("to"))
    df = df.select("doc_id", "text", F.col("key.i").alias("_i"), F.col("key.h").alias("_h"), "to.block", "to.guest")
    return df, W.partitionBy("block").orderBy("guest", F.desc("_i"), F.desc("_h"))


def fingerprints_with_next(docs: DataFrame, words: int = WORDS, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document: doc_id, n_chars, edited (its last half, rounded down, replaced by the start of the next document), sketch, edited_sketch and next_sketch."""
    df, w = dealt_with_next(docs, block_rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("next", F.coalesce(F.lead("text").over(w), F.lit("")))
    df = df.select("block", "guest", "_i", "_h", "doc_id", "text", n.cast("bigint").alias("n_chars"), F.concat(F.left(F.col("text"), n - half), F.left(F.col("next"), half)).alias("edited"))
    df = df.select("block", "guest", "_i", "_h", "doc_id", "n_chars", "edited", sketch(F.col("text"), words, k).alias("sketch"), F.when(~F.col("guest"), sketch(F.col("edited"), words, k)).alias("edited_sketch"))
    df = df.withColumn("next_sketch", F.lead("sketch").over(w)).where(~F.col("guest"))
    return df.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fingerprints_with_next(table(spark, sf_dir, "documents"))
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array_join(own, "").alias("fingerprint"), F.array_join(edited, "").alias("edited_fingerprint"),
        resemblance(own, edited).alias("near_edited"), resemblance(own, after).alias("near_next"), containment(edited, own).alias("edited_contained"), distinct_shingles(own).alias("n_shingles"),
    )


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_HASHES = f"""CASE WHEN len({{0}}) >= {WORDS} THEN list_transform(range(len({{0}}) - {WORDS - 1}), lambda i: left(md5(array_to_string({{0}}[i + 1:i + {WORDS}], ' ')), {DIGITS}))
  WHEN len({{0}}) > 0 THEN [left(md5(array_to_string({{0}}, ' ')), {DIGITS})] ELSE [] END"""
_SKETCH = f"list_sort(list_distinct({_HASHES}))[1:{K}]"
_MOST = f"least(CASE WHEN len({{0}}) >= {K} THEN {{0}}[-1] END, CASE WHEN len({{1}}) >= {K} THEN {{1}}[-1] END, repeat('g', {DIGITS}))"
_PART = "list_filter({0}, lambda h: h <= {1})"

#: The same in SQL, with one window over all rows.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER o, first_value(text) OVER (ORDER BY doc_id DESC)) AS after, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id
  FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT *, left(text, n - n // 2) || left(after, n // 2) AS edited FROM n),
w AS (SELECT *, {_WORDS.format("text")} AS w, {_WORDS.format("edited")} AS v FROM e),
s AS (SELECT doc_id, next_id, n, edited, {_SKETCH.format("w")} AS a, {_SKETCH.format("v")} AS b FROM w),
m AS (SELECT s.*, t.a AS c, {_MOST.format("s.a", "s.b")} AS ab, {_MOST.format("s.a", "t.a")} AS ac FROM s JOIN s t ON t.doc_id = s.next_id),
p AS (SELECT *, {_PART.format("a", "ab")} AS x, {_PART.format("b", "ab")} AS y, {_PART.format("a", "ac")} AS u, {_PART.format("c", "ac")} AS v FROM m),
q AS (SELECT *, len(list_intersect(x, y)) AS xy, len(list_intersect(u, v)) AS uv FROM p)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE xy::DOUBLE / (len(x) + len(y) - xy) END AS near_edited, CASE WHEN len(u) + len(v) = 0 THEN 1.0::DOUBLE ELSE uv::DOUBLE / (len(u) + len(v) - uv) END AS near_next,
  CASE WHEN len(b) = 0 THEN 1.0::DOUBLE WHEN len(y) > 0 THEN xy::DOUBLE / len(y) END AS edited_contained,
  CASE WHEN len(a) < {K} THEN len(a)::DOUBLE ELSE {K - 1}::DOUBLE / (('0x' || a[-1])::BIGINT::DOUBLE + 1) * {float(16**DIGITS)!r}::DOUBLE END AS n_shingles
FROM q"""
