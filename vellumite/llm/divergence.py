"""Source divergence audit: how the term shares of each source differ from those of the other sources of its language.

1. Tasks count terms per (language, source) and pass on sums; terms in at least `least` documents of a language stay.
2. The terms of a language are cut into slices of bounded size. In each slice a group's counts are one compressed
   vector, and a local heap picks the terms in which the group is furthest above its language.
3. The groups of a language sit down as in a round-robin tournament (circle method). The group that is at home stays
   in its partition; the vector of its peer travels there for the round. What meets is evaluated for both groups at
   once, peers pass one after the other, in the order of the rounds, and only sums leave. A job runs `ROUNDS` rounds,
   so that the vectors in flight stay a fixed multiple of all vectors however many sources there are.

All arithmetic is in integers and exact at every size. No task holds more than a slice of two groups.

Defined results: null text, lang and source count as ''; a group without kept terms still has pairs; where a language
keeps no terms its pairs have value 0; repeated rows count each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.llm.common import discard, map_arrow, written
from vellumite.tables import table

#: Documents of a language that a kept term is in at least, and ranks of the term part.
LEAST, TOP = 10, 10
#: Counts that a task holds before it passes them on, rows of counts in a slice on average, rounds of a job.
HELD, SLICE_ROWS, ROUNDS = 500_000, 40_000, 16
#: Rows up to which a table of groups or languages is broadcast; larger ones are joined by shuffles.
FEW = 10_000

#: ASCII letters in lower case and all bytes of other characters stay, the rest becomes blanks.
_LETTERS = bytes(x if x >= 128 else ord(chr(x).lower()) if chr(x).isalpha() else 32 for x in range(256))
UNIT = 1_000_000_000


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), by long division where 64 bits hold the steps."""
    whole = total + 2 * kept
    if whole >= 9 * 10**15:
        return np.array([1 + UNIT * (int(c) + 2) // whole for c in counts], np.int64)
    rest, out = counts.astype(np.int64) + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def packed(index: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: steps between its places, and its counts."""
    return zlib.compress(np.diff(index, prepend=0).astype("<u4").tobytes() + counts.astype("<i8").tobytes(), 1)


def unpacked(data: bytes | None, size: int) -> np.ndarray:
    """Counts at all places."""
    out = np.zeros(size, np.int64)
    if data:
        raw = zlib.decompress(data)
        n = len(raw) // 12
        out[np.cumsum(np.frombuffer(raw, "<u4", n)).astype(np.int64)] = np.frombuffer(raw, "<i8", n, 4 * n)
    return out


def _few(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _counted(docs: DataFrame, held: int) -> DataFrame:
    """lang, source, term, n (occurrences), docs (texts with the term); a group's term can occur in several rows."""
    names = ["lang", "source", "term", "n", "docs"]

    def rows(found: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in found.items():
            items = iter(terms.items())
            while part := list(islice(items, 50_000)):
                both = np.array([x for _, x in part], np.int64)
                term = pa.array([t for t, _ in part], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), term, pa.array(both >> 24), pa.array(both & 0xFFFFFF)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], dict[bytes, int]] = {}
        size = texts = 0
        for b in batches:
            for lang, source, raw in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "raw")), strict=True):
                own = found.setdefault((lang, source), {})
                size, texts = size - len(own), texts + 1
                get = own.get
                for t, n in Counter(raw.translate(_LETTERS).split()).items():
                    own[t] = get(t, 0) + (n << 24) + 1  # occurrences above, texts in the low 24 bits
                size += len(own)
                if size > held or texts == 0xFFFFFF:
                    yield from rows(found)
                    found, size, texts = {}, 0, 0
        yield from rows(found)

    return map_arrow(docs, run, "lang string, source string, term string, n long, docs long")


def _resident(batch: pa.Table) -> pa.Table:
    """One slice of one group: its vector, and the terms furthest above the language."""
    batch = batch.combine_chunks().sort_by("place")
    one = {c: batch.column(c)[0].as_py() for c in ("lang", "slice", "source", "group_total", "lang_total", "kept", "top")}
    n, total, place = (batch.column(c).to_numpy() for c in ("n", "total", "place"))
    p, q = shares(n, one["group_total"], one["kept"]), shares(total, one["lang_total"], one["kept"])
    above = np.flatnonzero(p > q)
    values, terms = distances(p, q)[above].tolist(), batch.column("term").take(pa.array(above)).to_pylist()
    best = heapq.nsmallest(one["top"], ((-v, t.encode()) for v, t in zip(values, terms, strict=True)))
    k = 1 + len(best)
    return pa.table({
        "lang": [one["lang"]] * k, "slice": pa.array([one["slice"]] * k, pa.int64()), "source": [one["source"]] * k, "vector": pa.array([packed(place, n)] + [None] * (k - 1), pa.binary()),
        "item": pa.array([None] + [t.decode() for _, t in best], pa.string()), "value": pa.array([None] + [-v for v, _ in best], pa.int64()),
    })


def _seats(m: Column) -> Column:
    """Seats at the table: an even number, one may stay empty."""
    return m + m % 2


def opponent(seat: Column, rnd: Column, seats: Column) -> Column:
    """Whom a seat meets in a round (from 0): the last seat stays, the others turn."""
    last = seats - 1
    other = F.pmod(rnd - seat, last)
    return F.when(seat == last, F.pmod(rnd * F.floor(seats / 2), last)).when(other == seat, last).otherwise(other)


def travels(seat: Column, other: Column) -> Column:
    """Does this one of the two go to the other? Each goes about half the time."""
    return F.when((seat + other) % 2 == 0, seat > other).otherwise(seat < other)


def _met(vectors: DataFrame, begin: int, end: int) -> DataFrame:
    """lang, source, item, value of the meetings in the rounds from begin to before end, a row for each slice and direction."""
    seats = _seats(F.col("m"))
    rounds = F.sequence(F.lit(begin).cast("bigint"), F.least(F.lit(end), seats - 1).cast("bigint") - 1)
    away = vectors.where(seats - 1 > begin).withColumn("round", F.explode(rounds))
    away = away.withColumn("host", opponent(F.col("seat"), F.col("round"), seats)).where((F.col("host") < F.col("m")) & travels(F.col("seat"), F.col("host")))
    cols = ["lang", "slice", "host", "round", "source", "group_total", "kept", "places", "vector"]
    home = vectors.withColumn("round", F.lit(-1).cast("bigint")).withColumn("host", F.col("seat"))
    dealt = home.select(cols).union(away.select(cols)).repartition("lang", "slice", "host").sortWithinPartitions("lang", "slice", "host", "round")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident, p = {}, np.zeros(0, np.int64)
        for b in batches:
            out: list[tuple[str, str, str, int]] = []
            for row in b.to_pylist():
                q = shares(unpacked(row["vector"], row["places"]), row["group_total"], row["kept"]) if row["places"] else np.zeros(0, np.int64)
                if row["round"] < 0:
                    resident, p = row, q
                    continue
                there, back = int(distances(p, q).sum()), int(distances(q, p).sum())
                out += [(row["lang"], resident["source"], row["source"], there), (row["lang"], row["source"], resident["source"], back)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["lang", "source", "item", "value"])

    return map_arrow(dealt, run, "lang string, source string, item string, value long", 200)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, slice_rows: int = SLICE_ROWS, held: int = HELD, rounds: int = ROUNDS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: all other sources of the language, and the `top` terms that a source is furthest above its language in."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(some("lang"), some("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    counts = _counted(docs, held).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    counts = counts.select("*", F.sum("docs").over(of_term).alias("in_docs"), F.sum("n").over(of_term).alias("total"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    kept = written(counts.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total", "first"), "kept_terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"), F.count_if("first").alias("firsts"), F.count("*").alias("rows"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["group_total", "firsts", "rows"])
    of_lang = W.partitionBy("lang")
    groups = groups.select(
        "lang", "source", "group_total", (F.row_number().over(of_lang.orderBy("source")) - 1).cast("bigint").alias("seat"), F.count("*").over(of_lang).alias("m"),
        F.sum("firsts").over(of_lang).alias("kept"), F.sum("group_total").over(of_lang).alias("lang_total"), F.greatest(F.ceil(F.sum("rows").over(of_lang) / slice_rows), F.lit(1)).alias("slices"),
    )
    groups = written(groups, "groups")

    placed = kept.join(_few(groups), ["lang", "source"]).withColumn("slice", F.pmod(F.xxhash64("term"), "slices"))
    placed = placed.withColumn("place", (F.dense_rank().over(W.partitionBy("lang", "slice").orderBy("term")) - 1).cast("bigint"))
    placed = placed.select("lang", "slice", "source", "term", "place", "n", "total", "group_total", "lang_total", "kept", F.lit(top).alias("top"))
    made = placed.groupBy("lang", "slice", "source").applyInArrow(_resident, "lang string, slice long, source string, vector binary, item string, value long")
    made = written(made, "resident_groups")

    # A slice has as many places as first rows of its terms.
    sizes = kept.where("first").join(_few(groups.select("lang", "slices").distinct()), "lang").groupBy("lang", F.pmod(F.xxhash64("term"), "slices").alias("slice")).agg(F.count("*").alias("places"))
    seated = groups.select("lang", "source", "seat", "m", "group_total", "kept", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    vectors = seated.join(sizes, ["lang", "slice"], "left").na.fill(0, ["places"]).join(made.where("vector IS NOT NULL").select("lang", "slice", "source", "vector"), ["lang", "slice", "source"], "left")
    vectors = written(vectors, "seated_vectors")

    most = groups.agg(F.max(_seats(F.col("m")))).first()[0] or 0
    pairs = [written(_met(vectors, a, a + rounds).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "meetings") for a in range(0, most - 1, rounds)]
    place = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    out = ranked(made.where("item IS NOT NULL").select("lang", "source", "item", "value"), "term").where(F.col("rank") <= top)
    if pairs:
        met = pairs[0]
        for x in pairs[1:]:
            met = met.union(x)
        out = ranked(met, "pair").union(out)
    out = written(out, "divergence")
    discard(kept, groups, made, vectors, *pairs)
    return out


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: The same in SQL, with every kept term of every group.
ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT a.lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY a.lang, source) + 2 * v) AS p,
  1 + 1000000000::HUGEINT * (sum(n) OVER (PARTITION BY a.lang, term) + 2) // (sum(n) OVER (PARTITION BY a.lang) + 2 * v) AS q FROM a JOIN v ON v.lang = a.lang),
m AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN m ON m.lang = x.lang AND m.source = x.source AND m.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 10"""
