"""Packing: ids of the plain library call, and limits on loss-bearing tokens."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumite.llm import packing
from vellumite.tables import table


def test_ids_are_those_of_the_plain_call():
    rng = random.Random(8)
    pieces = [*"aebé ßzÀÉ.,;:!?'\"()[]<>|%$#0123 \n\t\r\x0b\x85\xa0\x1cªºµ²¼日本語İǅ\u0301", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'LL", "don't", "l'an", "word.", "über", "\U0001f600"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["hello <|endoftext|> x", "", None]
    encoder = packing.PartEncoder(packing.tokenizer_path(), limit=50)
    plain = Tokenizer.from_file(packing.tokenizer_path())
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        for t, ids in zip(some, encoder.encode(some)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_conversations_within_a_loss_limit(spark, sf_dir):
    limits = packing.Limits(tokens=1024, segments=64, loss=300)
    turns = table(spark, sf_dir, "conversations")
    got = packing.pack_conversations(turns, limits).collect()
    plain = Tokenizer.from_file(packing.tokenizer_path())
    ids, bears = defaultdict(list), defaultdict(list)
    for r in turns.orderBy("conv_id", "turn", "role", "text").collect():
        new = plain.encode(r.text or "", add_special_tokens=False).ids
        ids[r.conv_id] += new
        bears[r.conv_id] += [r.role == "assistant"] * len(new)
        last = r.role == "assistant"
        bears[r.conv_id, "end"] = last
    tokens, loss, at = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        whole, mask = [*ids[r.doc_id], packing.END_ID], [*bears[r.doc_id], bears[r.doc_id, "end"]]
        assert r.start == at[r.doc_id] and np.frombuffer(r.ids, "<u4").tolist() == whole[r.start : r.start + r.length]
        at[r.doc_id] += r.length
        tokens[r.sequence_id] += r.length
        loss[r.sequence_id] += sum(mask[r.start : r.start + r.length])
    assert all(at[k] == len(v) + 1 for k, v in ids.items())
    assert max(tokens.values()) <= 1024 and max(loss.values()) <= 300
    assert sum(v > 290 for v in loss.values()) > len(loss) / 2  # it binds


def test_conversations_with_nulls(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "two words"), (None, None, "assistant", "x"), (2, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.doc_id: r.doc_tokens for r in packing.pack_conversations(turns).collect()}
    assert got == {1: 3, None: 2, 2: 1}
    assert packing.pack_conversations(turns.limit(0)).collect() == []
