"""Byte-level BPE over distinct long words, and words of Han characters, against the plain library; quality rules at odd line ends."""

import random
import resource

import duckdb
import pytest
import tiktoken

import public_tokenizers
from vellumite.llm import byte_bpe, quality_rules


@pytest.fixture(scope="module")
def plain():
    ranks = byte_bpe.load_ranks(byte_bpe.vocabulary_path())
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("letters, length, n", [("abcdefghijklmnopqrstuvwxyz", 180, 30_000), ("".join(map(chr, range(0x4E00, 0x5E00))), 40, 6_000), ("abcdefghijklmnopqrstuvwxyz", 60, 3_000), ("aé日", 20, 3_000)])
def test_distinct_long_words(plain, letters, length, n):
    rng = random.Random(length)
    texts = [" ".join("".join(rng.choices(letters, k=length)) for _ in range(100)) for _ in range(n // 100)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    codec = byte_bpe.BpeCodec(byte_bpe.vocabulary_path(), public_tokenizers.PATTERN)
    got = codec.encode(texts)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700 << 10  # KB
    for t, (ids, raw) in zip(texts, got):
        assert raw == t.encode()
        assert ids == ",".join(map(str, plain.encode_ordinary(t)))


def test_quality_rules_at_odd_ends(spark):
    rows = [(i, t) for i, t in enumerate(["a b \x85", "a b \u2028", " \u2029", "\x0b\fa b\u2029 ", "x " * 49 + "\x85", "\u2028", "a\x85b c", "\x1c a \x1d", "", None])]
    df = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"))
    got = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(quality_rules.ORACLE).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert got.astype(str).equals(want.astype(str))
    assert got.n_words.tolist()[:2] == [3, 3]
