"""Runs of words against brute force, on rough rows and on the driver's table."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import pytest

from vellumite.llm import periodic_runs as P

SMALL = "doc_id long, text string"


def plain(words, least, exponent):
    """Every period by itself; of one stretch the smallest."""
    out, n = {}, len(words)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((a, n, p) for (a, n), p in out.items()), key=lambda r: (r[0], r[2]))


def sequence(rng):
    letters, n = rng.choice([1, 2, 2, 3, 4]), rng.randrange(0, 70)
    s = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), 1 + rng.randrange(9)
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
    return s + s[: rng.randrange(n)] + s if n and rng.random() < 0.4 else s


@pytest.mark.parametrize(("least", "exponent"), [(2, 2), (5, 2), (6, 3), (24, 3), (8, 4)])
def test_all_runs(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(1500):
        s = sequence(rng)
        assert P.runs_of(s, least, exponent) == plain(s, least, exponent)
        words = [b"%d" % x for x in s]
        assert P.text_runs(words, least, exponent) == plain(words, least, exponent)


def test_factors_are_longest():
    rng = random.Random(4)
    for _ in range(300):
        s = sequence(rng)
        at = 0
        for start, length, source in P.factors(s):
            earlier = lambda n: any(s[i : i + n] == s[start : start + n] for i in range(start))
            assert start == at and (source < 0 and not earlier(1) or source < start and s[source : source + length] == s[start : start + length])
            assert source < 0 or start + length == len(s) or not earlier(length + 1)
            at += length
        assert at == len(s)


def test_collapsed():
    words = b"a b c a b c a b c x x x x y".split()
    assert P.collapsed(words, plain(words, 3, 3)) == b"a b c x y"
    assert P.collapsed([], []) == b""


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words, 24, 3)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_rough_rows(spark, rough_rows, tmp_path):
    rng = random.Random(8)
    odd = [(1000 + i, " ".join(rng.choice(["x", "y\u0085z", " ", "é"]) for _ in range(rng.randrange(120)))) for i in range(150)]
    rows = [(i, t) for i, t, *_ in rough_rows if t is None or len(t) < 20_000] + odd + [(None, " ".join(["a b c"] * 20)), (7, "w " * 1000)]
    spark.createDataFrame(rows, SMALL).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in P.op11_periodic_runs(spark, str(tmp_path)).collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_clashing_columns_and_no_rows(rough, nothing):
    assert P.periodic_runs(rough).count() == rough.count()
    assert P.periodic_runs(P.planted(nothing)).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(nothing, exponent=1)


def test_long_texts_in_linear_time():
    """A text of few words is searched whole; twice the words take about twice the time."""
    rng = random.Random(2)
    took = []
    for n in (40_000, 80_000):
        words = [b"%d" % rng.randrange(4) for _ in range(n)] + [b"1", b"2", b"3"] * n
        began = time.process_time()
        runs = P.text_runs(words)
        took.append(time.process_time() - began)
        assert max(r[1] for r in runs) >= 3 * n
    assert took[1] < 4 * took[0] + 1


def test_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {tuple(r) for r in P.op11_periodic_runs(spark, sf_dir).select(*names).collect()}
    want = set(con.sql(f"SELECT {', '.join(names)} FROM ({P.ORACLE})").fetchall())
    assert got == want and any(r[1] for r in got)
