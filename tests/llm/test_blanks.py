"""Byte-level BPE of texts with single blanks and with runs of white space, against the plain library."""

import random

import public_tokenizers
import pyarrow as pa
import tiktoken

from vellumite.llm.byte_bpe import BpeCodec, load_ranks, vocabulary_path


def test_runs_of_blanks_and_single_ones():
    codec = BpeCodec(vocabulary_path(), public_tokenizers.PATTERN, limit=50)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(vocabulary_path()), special_tokens={})
    draw = random.Random(7)
    atoms = ["a", "Zebra", "queltho", "it's", "1234", ",", "!?", "\n", "\r\n", "\t", " ", "  ", " ", " ", "　", "\u0085", " ", "語", "é", "\U0001f642", "​", "\x00"]
    texts = ["", " ", "  ", " a", "a ", "a b", " a b", "a  b", "a \n b", "a\n b", "a 　b", "　 b", None]
    texts += ["".join(draw.choice(atoms) for _ in range(draw.randrange(1, 12))) for _ in range(3000)]
    texts += [" ".join(draw.choice(atoms[:9]) for _ in range(draw.randrange(1, 12))) for _ in range(1000)]
    for given in (texts, pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string()).slice(1)):
        for t, (ids, raw) in zip(texts, codec.encode(given), strict=True):
            assert ids == ",".join(map(str, plain.encode_ordinary(t or "")))
            assert raw == (t or "").encode()


def test_no_rows():
    codec = BpeCodec(vocabulary_path(), public_tokenizers.PATTERN)
    assert codec.encode([]) == []
    assert codec.encode([None, None]) == [("", b""), ("", b"")]
