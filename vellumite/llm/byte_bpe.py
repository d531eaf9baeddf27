"""Byte-level BPE with DuckDB: recursive contraction of token-position rows, ordered aggregation to decode.

Inside each task, the pieces that the vocabulary's pattern makes of a text and that are not tokens themselves become
rows (word, position, token, previous position, previous token). One recursive query joins each row with the merge
table, finds each word's leftmost pair of minimum rank and contracts it, until no pair of the word can be merged;
words leave the recursion as they finish. The final rows are joined with the vocabulary and aggregated in order of
position to ids and to bytes. The recursion sees a bounded number of distinct words at a time; what it found stays
in a store of bounded size in the worker, from which texts are put together. Texts themselves never move. A text
whose blanks all stand alone is split at them, and its ids and bytes are gathered, in Arrow; others part by part.

The recursion of a word takes one round a merge and keeps the rows of all rounds, so its cost and memory grow with
the square of the word's bytes: a query gets words of at most `rows` rows over all rounds, and words of over
long_bytes bytes (very long ones, runs of base64 or of Han characters) are merged with a heap instead, by the same rule.

Defined results: a null text counts as empty (no tokens, the hash of nothing); a piece that is itself a token is
that token; repeated rows are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from vellumite.llm.common import Store, kept, map_arrow
from vellumite.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Unicode's White_Space characters.
_WS = "\t-\r \x85\xa0  -     　"
#: No piece of the pattern reaches over the borders of these parts.
_PARTS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: A blank that need not be the border of a part.
_RUN = f" [{_WS}]| \\z"

_CONTRACT = """
WITH RECURSIVE tokens(wid, pos, tok, ppos, ptok, code, done) AS (
    SELECT s.wid, s.pos, s.tok, s.ppos, s.ptok, (m.merged << 40) | (s.ppos << 20) | s.pos, false
    FROM start s LEFT JOIN merges m ON m.l = s.ptok AND m.r = s.tok
  UNION ALL
    SELECT x.wid, x.pos, x.tok, x.ppos, x.ptok, (m.merged << 40) | (x.ppos << 20) | x.pos, x.done
    FROM (SELECT t.wid, t.pos,
                 CASE WHEN t.pos = ((b.best >> 20) & 1048575) THEN (b.best >> 40)::INTEGER ELSE t.tok END AS tok,
                 CASE WHEN t.ppos = (b.best & 1048575) THEN (b.best >> 20) & 1048575 ELSE t.ppos END AS ppos,
                 CASE WHEN t.ppos = (b.best & 1048575) THEN (b.best >> 40)::INTEGER ELSE t.ptok END AS ptok,
                 b.best IS NULL AS done
          FROM tokens t JOIN (SELECT wid, min(code) AS best FROM tokens WHERE NOT done GROUP BY wid) b ON b.wid = t.wid
          WHERE NOT t.done AND (b.best IS NULL OR t.code IS DISTINCT FROM b.best)) x
    LEFT JOIN merges m ON m.l = x.ptok AND m.r = x.tok AND NOT x.done
)
SELECT t.wid, string_agg(t.tok::VARCHAR, ',' ORDER BY t.pos) AS ids, string_agg(v.bytes, '' ORDER BY t.pos) AS bytes
FROM tokens t JOIN vocabulary v ON v.id = t.tok WHERE t.done GROUP BY t.wid
"""


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _joined(got: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    return got[0] if len(got) == 1 else (",".join([g[0] for g in got]), b"".join([g[1] for g in got]))


class BpeCodec:
    """Encodes pieces of bytes to ids and back, distinct pieces at a time."""

    def __init__(self, path: str, pattern: str, limit: int = 350_000, long_bytes: int = 64, rows: int = 2_500_000) -> None:
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.long_bytes, self.rows = long_bytes, rows
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int64())})
        words = pa.table({"id": pa.array(self.bytes_of.keys(), pa.int32()), "bytes": pa.array([t.hex() for t in self.bytes_of.values()])})
        for name, data in (("merges", merges), ("vocabulary", words)):
            self.db.register("given", data)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.pieces, self.parts = Store(limit), Store(max(1, limit * 6 // 7))

    def _contract(self, words: list[bytes]) -> Iterator[tuple[int, str, bytes]]:
        lengths = np.array([len(w) for w in words], np.int64)
        wid = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = 1 + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        before = np.concatenate([[-1], tok[:-1]]).astype(np.int32)
        before[pos == 1] = -1
        self.db.register("start", pa.table({"wid": wid, "pos": pos, "tok": tok, "ppos": pos - 1, "ptok": before}))
        for i, ids, hexed in self.db.execute(_CONTRACT).fetchall():
            yield i, ids, bytes.fromhex(hexed)
        self.db.unregister("start")

    def _heap(self, word: bytes) -> tuple[str, bytes]:
        """The same rule with a heap of pairs and a linked list of tokens."""
        toks: list[int | None] = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(toks)
        ends = list(range(1, n + 1))
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (r := self.ranks.get(word[i : ends[j]])) is not None:
                heap.append((r, i, ends[j])) if not started else heapq.heappush(heap, (r, i, ends[j]))

        started = False
        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        started = True
        while heap:
            r, i, end = heapq.heappop(heap)
            j = right[i] if toks[i] is not None else n
            if j >= n or ends[j] != end:
                continue
            toks[i], toks[j], ends[i] = r, None, end
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        ids = [t for t in toks if t is not None]
        return ",".join(map(str, ids)), b"".join(self.bytes_of[t] for t in ids)

    def _made(self, pieces: Iterable[str]) -> dict[str, tuple[str, bytes]]:
        """(ids joined by commas, decoded bytes) of each piece."""
        made: dict[str, tuple[str, bytes]] = {}
        rest: list[str] = []
        for p in pieces:
            raw = p.encode()
            if (r := self.ranks.get(raw)) is not None:
                made[p] = (str(r), self.bytes_of[r])
            elif len(raw) > self.long_bytes:
                made[p] = self._heap(raw)
            else:
                rest.append(p)
        words = [p.encode() for p in rest]
        # A word of n bytes has at most n + (n - 1) + ... + 1 rows, and as many when it is done.
        cost = np.cumsum([len(w) * (len(w) + 3) // 2 for w in words])
        i = 0
        while i < len(rest):
            before = cost[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(cost, before + self.rows, side="right")))
            for k, ids, raw in self._contract(words[i:j]):
                made[rest[i + k]] = (ids, raw)
            i = j
        return made

    def _of_parts(self, parts: Iterable[str]) -> dict[str, tuple[str, bytes]]:
        """(ids joined by commas, decoded bytes) of each part; a part may hold several pieces."""
        found, new = self.parts.known(parts)
        split = {p: self.pattern.findall(p) for p in new}
        pieces, unknown = self.pieces.known({q for x in split.values() for q in x})
        made = self._made(unknown)
        self.pieces.put(made)
        pieces |= made
        fresh = {p: _joined([pieces[q] for q in x]) for p, x in split.items()}
        self.parts.put(fresh)
        return found | fresh

    def _by_blanks(self, texts: pa.Array) -> list[tuple[str, bytes]]:
        """encode() for texts whose every blank is followed by something else than white space: each blank is a border."""
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        first = place[at[:-1]]
        # A part begins with its blank, save each text's first one.
        names = coded.dictionary.to_pylist()
        opening, first = np.unique(first, return_inverse=True)
        place[at[:-1]] = len(names) + first
        used = np.zeros(len(names) + len(opening), bool)
        used[place] = True
        keys = [" " + p for p in names] + [names[i] for i in opening]
        got = self._of_parts({k for k, u in zip(keys, used.tolist(), strict=True) if u})
        table = [got.get(k, ("", b"")) for k in keys]
        made = []
        for values in ([i + "," if i else "" for i, _ in table], [raw for _, raw in table]):
            row = pa.array(values, pa.large_string() if isinstance(values[0], str) else pa.large_binary()).take(pa.array(place))
            ends = np.frombuffer(row.buffers()[1], np.int64)[at].tolist()
            data = memoryview(row.buffers()[2] or b"")
            made.append([data[i:j] for i, j in zip(ends, ends[1:], strict=False)])
        return [(str(ids[:-1], "ascii"), bytes(raw)) for ids, raw in zip(*made, strict=True)]

    def encode(self, texts: list[str | None] | pa.Array) -> list[tuple[str, bytes]]:
        """(ids joined by commas, decoded bytes) of every text."""
        rows = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        runs = pc.match_substring_regex(rows, _RUN).to_numpy(zero_copy_only=False).astype(bool)
        out: list[tuple[str, bytes]] = [("", b"")] * len(rows)
        plain, other = np.flatnonzero(~runs), np.flatnonzero(runs)
        if len(plain):
            for i, x in zip(plain.tolist(), self._by_blanks(rows.take(pa.array(plain))), strict=True):
                out[i] = x
        found = [_PARTS.findall(t) for t in rows.take(pa.array(other)).to_pylist()]
        parts = self._of_parts({p for x in found for p in x})
        for i, x in zip(other.tolist(), found, strict=True):
            out[i] = _joined([parts[p] for p in x])
        return out


def codec_of(path: str, pattern: str) -> BpeCodec:
    """The worker's codec with its stores; a function of the module, so that tasks share it (what a closure names itself is copied into each task)."""
    return kept((BpeCodec, path, pattern), lambda: BpeCodec(path, pattern))


def byte_bpe(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (joined by commas) and decoded bytes as their SHA-256 digests."""
    import public_tokenizers

    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern)
        for b in batches:
            made = codec.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in made], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in made]),
                    pa.array([hashlib.sha256(raw).hexdigest() for _, raw in made]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 5000, 32 << 20, keeps=True)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))
