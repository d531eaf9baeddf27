"""Divergence of sources against plain integers, on rough rows and on the driver's table."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumite.llm import divergence as D

SMALL = "doc_id long, text string, lang string, source string"


def expected(rows, least=10, top=10):
    counts, in_docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        langs[lang].add(source)
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731,B023
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(far(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found if part == "pair" else found[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("slice_rows", "held", "rounds"), [(40_000, 500_000, 16), (30, 20, 2), (7, 1, 1)])
def test_against_plain_integers(spark, slice_rows, held, rounds):
    rng = random.Random(slice_rows)
    vocab = {"en": ["the", "Of", "and", "x9y", "it's", "naïve", "ÀB", "àb", "\U0001f642z", "q"], "de": ["der", "und", "ß"], None: ["w"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) + rng.choice("0 .-") for _ in range(rng.randrange(30))), lang, rng.choice([None, "", "a", "b", "c", "é", "Z"][: 2 + 3 * (lang == "en") + rng.randrange(2)])) for i, lang in enumerate(rng.choice(["en", "en", "de", None]) for _ in range(160))]
    rows += [(900, None, "en", "only nulls"), (901, "rare words", "xx", "s"), (902, "", "xx", "t"), (903, "one", "alone", "s"), (None, "the the the", "en", "a"), (None, "the the the", "en", "a")]
    df = spark.createDataFrame(rows, SMALL).repartition(3)
    assert found(D.divergence(df, slice_rows=slice_rows, held=held, rounds=rounds)) == expected(rows)


def test_clashing_columns_and_no_rows(rough, rough_rows, nothing):
    rows = [(i, t, lang, source) for i, t, lang, source, *_ in rough_rows]
    assert found(D.divergence(rough, least=3)) == expected(rows, least=3)
    assert D.divergence(nothing).count() == 0


@pytest.mark.parametrize("m", range(1, 12))
def test_every_pair_meets_once(spark, m):
    """In each round a seat meets one other; over all rounds every two meet once, and one of them travels."""
    seats = D._seats(F.lit(m))
    df = spark.range(m).withColumnRenamed("id", "seat").withColumn("round", F.explode(F.sequence(F.lit(0), F.greatest(seats - 2, F.lit(0)))))
    df = df.withColumn("host", D.opponent(F.col("seat"), F.col("round"), seats)).withColumn("goes", D.travels(F.col("seat"), F.col("host")))
    rows = [r for r in df.collect() if r.host < m]
    assert len({(r.seat, r["round"]) for r in rows}) == len(rows)
    assert sorted((r.seat, r.host) for r in rows) == [(a, b) for a in range(m) for b in range(m) if a != b]
    goes = {(r.seat, r.host): r.goes for r in rows}
    assert all(goes[a, b] != goes[b, a] for a, b in goes)
    meets = {(r.seat, r["round"]): r.host for r in rows}
    assert all(meets[host, rnd] == seat for (seat, rnd), host in meets.items())


def test_shares_are_exact():
    rng = random.Random(1)
    for most, kept in ((50, 3), (10**9, 10**6), (10**13, 10**9), (10**15, 10**9), (10**17, 10**6)):
        counts = [0, 1, most, *(rng.randrange(most) for _ in range(500))]
        total = most + rng.randrange(most)
        want = [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in counts]
        assert D.shares(np.array(counts, np.int64), total, kept).tolist() == want
        p, q = np.array(want, np.int64), np.array(want[::-1], np.int64)
        assert D.distances(p, q).tolist() == [(a - b) ** 2 // (a + b) for a, b in zip(want, want[::-1], strict=True)]


def test_vectors_pack():
    rng = np.random.default_rng(0)
    for size in (0, 1, 5000):
        full = np.where(rng.random(size) < 0.2, rng.integers(1, 2**45, size), 0)
        at = np.flatnonzero(full)
        assert D.unpacked(D.packed(at, full[at]), size).tolist() == full.tolist()
    assert D.unpacked(None, 3).tolist() == [0, 0, 0]


def test_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = D.op13_divergence(spark, sf_dir)
    assert {tuple(r) for r in df.collect()} == set(con.sql(f"SELECT {', '.join(df.columns)} FROM ({D.ORACLE})").fetchall())
