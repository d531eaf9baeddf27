"""Bottom-k sketches against whole shingle sets, neighbours across blocks, merged parts."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from vellumite.llm import bottom_k as B

SMALL = "doc_id long, text string"


def hashes(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    parts = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    return {hashlib.md5(p.encode()).hexdigest()[:12] for p in parts}


def smallest(found, k):
    return sorted(found)[:k]


def near(a, b, k):
    most = min([s[-1] for s in (a, b) if len(s) >= k], default="g")
    x, y = ({h for h in s if h <= most} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def expected(rows, k=128):
    """rows have different ids: each row with the next one by descending id, null last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (smallest(hashes(x), k) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), near(a, b, k), near(a, c, k)))
    return out


def fields(df):
    return [tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]


@pytest.mark.parametrize("block_rows", [500, 3, 1])
def test_rough_rows(spark, rough_rows, tmp_path, monkeypatch, block_rows):
    monkeypatch.setattr(B, "BLOCK_ROWS", block_rows)
    seen, rows = set(), []
    for i, t, *_ in rough_rows:
        if i not in seen:
            rows.append((i, t))
            seen.add(i)
    spark.createDataFrame(rows, SMALL).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    blocks = B.dealt_with_next(docs, block_rows)[0]
    assert blocks.where("NOT guest").count() == len(rows)
    assert blocks.where("guest").count() == blocks.select("block").distinct().count()
    assert blocks.select("block").distinct().count() > (block_rows == 1) * 5
    assert sorted(map(str, fields(B.op12_fingerprints(spark, str(tmp_path))))) == sorted(map(str, expected(rows)))


def test_repeated_ids_and_clashing_columns(rough):
    """Every row stays; rows that are equal are neighbours."""
    for block_rows in (500, 2):
        got = B.fingerprints_with_next(rough, block_rows=block_rows).collect()
        assert len(got) == rough.count()
        twins = [r for r in got if r.doc_id == 34]
        assert len(twins) == 2 and any(r.edited == "a" * 3000 for r in twins)


def test_none_and_one_row(spark, nothing):
    assert B.fingerprints_with_next(nothing).count() == 0
    one = B.fingerprints_with_next(spark.createDataFrame([(5, "a b c d e f")], SMALL)).first()
    assert one.next_sketch == one.sketch and one.edited == "a b c d e f"[:6] + "a b c"[:5]


def test_native(spark, sf_dir):
    plan = B.op12_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


def pairs(rng, n=60):
    for _ in range(n):
        a = [str(rng.randrange(10**9)) for _ in range(rng.choice([0, 3, 40, 900]))]
        cut = rng.randrange(len(a) + 1)
        yield " ".join(a), " ".join(a[:cut] + [str(rng.randrange(10**9)) for _ in range(rng.choice([0, 5, 700]))])


def test_estimates(spark):
    rng = random.Random(5)
    rows = list(pairs(rng))
    a, b = B.sketch(F.col("a")), B.sketch(F.col("b"))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", a.alias("x"), b.alias("y")).select("a", "b", "x", B.resemblance(F.col("x"), F.col("y")).alias("j"), B.containment(F.col("x"), F.col("y")).alias("c"), B.distinct_shingles(F.col("x")).alias("n")).collect()
    for r in got:
        x, y = hashes(r.a), hashes(r.b)
        small = len(x) < B.K and len(y) < B.K
        assert abs(r.j - (len(x & y) / len(x | y) if x | y else 1.0)) <= (1e-9 if small else 0.2)
        assert r.c is None or abs(r.c - (len(x & y) / len(x) if x else 1.0)) <= (1e-9 if small else 0.25)
        assert r.n == len(x) if len(x) < B.K else abs(r.n / len(x) - 1) < 0.4


def test_parts_merge(spark):
    """The sketch of all rows of a key is that of their shingles together; a null key is a key, one without shingles stays."""
    rng = random.Random(6)
    rows = [(None if i % 5 == 0 else i % 3, " ".join(str(rng.randrange(3000)) for _ in range(rng.randrange(200)))) for i in range(60)] + [(9, None), (9, "")]
    df = spark.createDataFrame(rows, "part long, text string").select("part", B.sketch(F.col("text"), k=50).alias("s"))
    got = {r.part: r.s for r in B.merged(df, ["part"], "s", 50).collect()}
    assert got == {p: smallest(set().union(*(hashes(t) for q, t in rows if q == p)), 50) for p in {p for p, _ in rows}}
    assert B.merged(df.limit(0), ["part"], "s").count() == 0
    both = df.groupBy().agg(F.first("s").alias("a"), F.last("s").alias("b")).select("a", "b", B.union(F.col("a"), F.col("b"), 50).alias("u")).first()
    assert both.u == smallest({*both.a, *both.b}, 50)


def test_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = B.op12_fingerprints(spark, sf_dir)
    assert {tuple(r) for r in df.collect()} == set(con.sql(f"SELECT {', '.join(df.columns)} FROM ({B.ORACLE})").fetchall())
