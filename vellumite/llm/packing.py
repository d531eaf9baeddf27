"""Packing of tokenised examples by vector bin packing with the dot-product heuristic.

An example asks for three resources at once: tokens, one segment, and loss-bearing tokens. A sequence offers fixed
amounts of each. The open sequence takes the example that fits and has the largest dot product of its demand with
what the sequence has left, each resource as a share of the whole; when nothing fits and more than min_cut tokens
are left, the next longest example is cut to fill the rest. Examples longer than a sequence give whole pieces first
and their rest is packed. Packing runs over windows of a bounded number of examples inside each input split, so
nothing is shuffled and memory does not grow with the input; a window ends with at most one partly filled sequence.

Tokens come from the `tokenizers` library. A text is encoded by its parts between blanks: the vocabulary's
pre-tokenizer never joins characters over white space, so the ids of the parts, one after another, are those of the
whole text; parts that were seen before come from a bounded store. Parts of lower-case letters alone skip the
vocabulary's normaliser and pattern, which leave them as they are. A text that may name a special token is encoded whole.

Instruction data has a column of parts, each with its text and whether its tokens bear loss; an example's ids are
those of its parts one after another, and the end id bears loss like the last part.

Defined results: a null text counts as empty and has only the end id; a sequence's id is its split and its number
there; rows that repeat a doc_id are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm.common import Store, kept, map_arrow
from vellumite.tables import table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


@dataclass(frozen=True)
class Limits:
    """What one sequence holds."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass(frozen=True)
class Piece:
    example: int
    start: int
    length: int
    sequence: int
    offset: int


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Punctuation behind a letter is a token of its own.
_BORDER = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])(?=[!-@\[-`{-~])")


def _parts(text: str | None) -> list[str]:
    """Parts of a text between blanks, in few spellings where that cannot change an id: Latin-1 text in lower case, which the vocabulary's normaliser makes of it anyway, with punctuation behind words apart."""
    if not text:
        return []
    try:
        text.encode("latin-1")
        text = _BORDER.sub(" ", text.lower())
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _plain(part: str) -> bool:
    """Does the vocabulary's pattern take the part as one token, as it is?"""
    return part.isalpha() and part.islower() and max(part) <= "\xff"


class PartEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, part by part."""

    def __init__(self, path: str, limit: int = 550_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = "<|" if all(t["content"].startswith("<|") for t in spec["added_tokens"]) else ""
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}}
        self.words = Tokenizer.from_str(json.dumps(spec))
        self.store = Store(limit)

    def _encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        e = self.words.encode(" ".join(words), add_special_tokens=False)
        ids, owner = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
        raw, cuts = ids.tobytes(), [*np.flatnonzero(np.append(True, owner[1:] != owner[:-1])).tolist(), len(ids)]
        for i, w in enumerate(words):
            yield w, raw[4 * cuts[i] : 4 * cuts[i + 1]]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        whole = {i: t for i, t in enumerate(texts) if t and self.special in t}
        parts = [() if i in whole else _parts(t) for i, t in enumerate(texts)]
        known, new = self.store.known({p for x in parts for p in x})
        plain = [p for p in new if _plain(p)]
        other = [p for p in new if not _plain(p)]
        fresh: dict[str, bytes] = {}
        for i in range(0, len(plain), 4096):
            fresh.update(self._encode_words(plain[i : i + 4096]))
        for i in range(0, len(other), 4096):
            some = other[i : i + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                fresh[p] = array("I", e.ids).tobytes()
        self.store.put(fresh)
        known |= fresh
        get = known.__getitem__
        made = [b"".join(map(get, x)) for x in parts]
        for i, t in whole.items():
            made[i] = array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
        return made


def packed(tokens: Sequence[int], loss: Sequence[Sequence[int] | None], limits: Limits = Limits(), min_cut: int = 16) -> list[Piece]:
    """Pieces of examples in sequences.

    tokens: the length of each example. loss: for each example the cumulative number of loss-bearing tokens before
    each position (length + 1 entries), or None if every token bears loss.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    pieces: list[Piece] = []
    sequence = 0

    def bearing(e: int, a: int, b: int) -> int:
        return b - a if loss[e] is None else int(loss[e][b] - loss[e][a])

    def longest(e: int, a: int, most: int, most_loss: int) -> int:
        """The most tokens from a on that keep within both limits."""
        most = min(most, tokens[e] - a)
        if bearing(e, a, a + most) <= most_loss:
            return most
        if loss[e] is None:
            return max(0, most_loss)
        return int(np.searchsorted(np.asarray(loss[e]), loss[e][a] + most_loss, side="right")) - 1 - a

    rest: list[tuple[int, int]] = []  # (example, start)
    for e, n in enumerate(tokens):
        a = 0
        while n - a >= limits.tokens:
            length = longest(e, a, limits.tokens, limits.loss)
            pieces.append(Piece(e, a, length, sequence, 0))
            a, sequence = a + length, sequence + 1
        if a < n:
            rest.append((e, a))
    # Demands sorted by size; equal demands of one kind come first in, first out.
    demand = np.array([[tokens[e] - a, 1, bearing(e, a, tokens[e])] for e, a in rest], np.float64).reshape(-1, 3)
    free = np.ones(len(rest), bool)
    left_count = len(rest)
    while left_count:
        if left_count < 0.5 * len(rest):
            keep = np.flatnonzero(free)
            rest, demand, free = [rest[i] for i in keep], demand[keep], np.ones(len(keep), bool)
        left, offset = cap.copy(), 0
        while left_count and left[0] > 0 and left[1] > 0 and left[2] >= 0:
            fits = free & (demand[:, 0] <= left[0]) & (demand[:, 2] <= left[2])
            if fits.any():
                i = int(np.where(fits, demand @ (left / (cap * cap)), -1.0).argmax())
                e, a = rest[i]
                length = int(demand[i, 0])
                free[i], left_count = False, left_count - 1
            else:
                if left[0] <= min_cut:
                    break
                i = int(np.where(free, demand[:, 0], -1.0).argmax())
                e, a = rest[i]
                length = longest(e, a, int(left[0]), int(left[2]))
                if length <= 0:
                    break
                rest[i] = (e, a + length)
                demand[i] = (tokens[e] - a - length, 1, bearing(e, a + length, tokens[e]))
            pieces.append(Piece(e, a, length, sequence, offset))
            left -= (length, 1, bearing(e, a, a + length))
            offset += length
        if not offset:
            raise ValueError("an example has a token that no sequence can hold")
        sequence += 1
    return pieces


def encoder_of(path: str) -> PartEncoder:
    """The worker's encoder with its store; a function of the module, so that tasks share it (what a closure names itself is copied into each task)."""
    return kept((PartEncoder, path), lambda: PartEncoder(path))


_OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, limits: Limits = Limits(), min_cut: int = 16, window: int = 4000, path: str | None = None, parts: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    window: how many examples are packed together at most. parts: a column, array of struct (text, loss), that is
    packed in place of text, so that limits.loss counts only tokens of parts with loss; a null array or part has no
    tokens, a null loss is none.
    """
    path = path or tokenizer_path()
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
    end = np.array([END_ID], "<u4").tobytes()

    def examples(b: pa.RecordBatch, encoder: PartEncoder) -> tuple[list[bytes], list]:
        """Ids of each row, and its cumulative number of loss-bearing tokens or None."""
        if parts is None:
            made = [x + end for x in encoder.encode(b.column("text").to_pylist())]
            return made, [None] * len(made)
        rows = [[p or {"text": None, "loss": False} for p in x or ()] for x in b.column("text").to_pylist()]
        flat = iter(encoder.encode([p["text"] for x in rows for p in x]))
        made, bearing = [], []
        for x in rows:
            ids, loss = [], []
            for p in x:
                ids.append(next(flat))
                loss.append(np.full(len(ids[-1]) // 4, bool(p["loss"])))
            loss.append(np.full(1, bool(x and x[-1]["loss"])))
            made.append(b"".join(ids) + end)
            bearing.append(np.concatenate([[0], np.cumsum(np.concatenate(loss))]))
        return made, bearing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        first = TaskContext.get().partitionId() << 32

        def flushed(ids: list, held: list[bytes], bearing: list) -> Iterator[pa.RecordBatch]:
            nonlocal first
            pieces = packed([len(x) // 4 for x in held], bearing, limits, min_cut)
            for i in range(0, len(pieces), 4000):
                some = pieces[i : i + 4000]
                cols = ([ids[p.example] for p in some], [p.start for p in some], [p.length for p in some], [held[p.example][4 * p.start : 4 * (p.start + p.length)] for p in some],
                        [len(held[p.example]) // 4 for p in some], [first + p.sequence for p in some], [p.offset for p in some])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            first += max(p.sequence for p in pieces) + 1

        ids: list = []
        held: list[bytes] = []
        bearing: list = []
        size = 0
        for b in batches:
            made, loss = examples(b, encoder)
            ids += b.column("doc_id").to_pylist()
            held += made
            bearing += loss
            size += sum(map(len, made))
            while len(held) >= window or size > 64 << 20:
                n = min(window, len(held))
                yield from flushed(ids[:n], held[:n], bearing[:n])
                ids, held, bearing = ids[n:], held[n:], bearing[n:]
                size = sum(map(len, held))
        if held:
            yield from flushed(ids, held, bearing)

    return map_arrow(docs.select("doc_id", F.col(parts or "text").alias("text")), run, _OUT, keeps=True)


def pack_conversations(turns: DataFrame, limits: Limits = Limits(), role: str = "assistant", **options) -> DataFrame:
    """Each conversation (conv_id, turn, role, text) as one example, in the order of turns, with loss on the turns of a role.

    A conversation's turns meet in one task; conversations never do. Rows of one turn come in the order of their role and text.
    """
    own = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    df = turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(own.alias("turns"))
    each = F.transform("turns", lambda t: F.struct(t["text"].alias("text"), F.coalesce(t["role"] == role, F.lit(False)).alias("loss")))
    return pack_documents(df.select("doc_id", each.alias("parts")), limits, parts="parts", **options)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pack_documents(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
