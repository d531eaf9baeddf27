"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Each rule bounds one metric of a text. Metrics are lengths, symbol, stop-word and line ratios, all built from
Spark's own functions; the table is folded into a single boolean column, so the scan is the only pass and nothing
is shuffled. Defined results: a null text counts as empty (no words, base_failed); an empty text has no words;
repeated rows are judged one by one; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm.common import SPACE_CHARS, SPACE_CLASS
from vellumite.tables import table

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as was this by are from or an at not a "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es für sie werden aus er hat dass "
    "de la le et les des en un du une que est pour qui dans par sur pas au plus ne se ce "
    "el y los del las por con una su para al lo como más pero sus o"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if low <= metric <= high (a missing bound is open)."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table in production use.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("max_word_chars", None, 1000.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("stop_ratio", 0.07, None),
    Rule("dup_line_ratio", None, 0.5),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound to a variable, so that it is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _twins(arr: Column, *keys: str) -> Callable[[Column, Column], Column]:
    """Does an element of a sorted array agree with a neighbour in the keys?"""

    def same(x: Column, other: Column) -> Column:
        hit = F.lit(True)
        for k in keys:
            hit = hit & F.coalesce(x[k] == other[k], F.lit(False))
        return hit

    return lambda x, i: same(x, F.get(arr, i - 1)) | same(x, F.get(arr, i + 1))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""
    hashes = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    spelled = lambda x: F.struct(
        x["h"].alias("h"), F.concat_ws(" ", F.get(words, x["i"]), F.get(words, x["i"] + 1), F.get(words, x["i"] + 2)).alias("t"), x["i"].alias("i")
    )
    # Windows with equal hashes end up side by side; among those, the words themselves are compared.
    alike = _let(F.when(n >= 4, F.sort_array(hashes)).otherwise(none), lambda s: F.filter(s, _twins(s, "h")))
    equal = _let(F.sort_array(F.transform(alike, spelled)), lambda e: F.filter(e, _twins(e, "h", "t")))
    return F.aggregate(
        F.sort_array(F.transform(equal, lambda x: x["i"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("total")),
        lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total")),
        lambda a: a["total"],
    )


def _counts(text: Column) -> Column:
    body = F.btrim(text, F.lit(SPACE_CHARS))
    words = _let(body, lambda b: F.when(F.length(b) == 0, F.array().cast("array<string>")).otherwise(F.split(b, f"{SPACE_CLASS}+")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            _let(F.size(w), lambda n: _repeat_words(w, n)).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("bigint").alias("n_stop"),
            F.aggregate(w, F.lit(0), lambda a, x: F.greatest(a, F.length(x))).cast("bigint").alias("max_word_chars"),
        )

    def of_lines(v: Column) -> Column:
        return F.struct(F.size(v).cast("bigint").alias("n_lines"), (F.size(v) - F.size(F.array_distinct(v))).cast("bigint").alias("n_dup_lines"))

    return F.struct(
        F.length(F.translate(text, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        _let(words, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules are made of, from one projection over the scan.

    The row number in the projection keeps the optimiser from copying it into filters that stand above.
    """
    row = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    df = docs.select("doc_id", _let(row, lambda r: F.struct(r["row"].alias("row"), _counts(r["text"]).alias("c"))).alias("m"))
    return df.select("doc_id", "m.c.w.*", "m.c.l.*", "m.c.word_chars", "m.c.n_symbols")


def metrics() -> dict[str, Column]:
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
        "max_word_chars": F.col("max_word_chars").cast("double"),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_ratio": _ratio(F.col("n_stop"), F.col("n_words")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
    }


def compiled(rules: Sequence[Rule]) -> Column:
    """The whole table as one boolean expression."""
    known, verdict = metrics(), F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (known[r.metric] >= F.lit(float(r.low)))
        if r.high is not None:
            verdict = verdict & (known[r.metric] <= F.lit(float(r.high)))
    return verdict


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: counts, base_failed, kept. Whole texts, no user functions, no shuffle."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = measured(docs).withColumn("base_failed", base)
    return df.withColumn("kept", ~F.col("base_failed") & compiled(rules))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = []
    for r in RULES:
        col = f"m_{r.metric}"
        tests += [f"{col} >= {r.low}"] * (r.low is not None) + [f"{col} <= {r.high}"] * (r.high is not None)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws,
             [x FOR x IN string_split(text, chr(10)) IF regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> ''] AS ls FROM d),
t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
             len([x FOR x IN ws IF x IN ({stop})]) AS n_stop,
             coalesce(list_max([length(x) FOR x IN ws]), 0)::DOUBLE AS m_max_word_chars
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS m_mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS m_symbol_ratio,
             CASE WHEN n_words > 0 THEN n_stop::DOUBLE / n_words ELSE 0 END AS m_stop_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS m_dup_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept FROM f
"""


ORACLE = _oracle()
