"""Exact deduplication by Grace hashing.

Each task keeps an open-addressing table that compares complete contents. When the table's contents outgrow its
budget, the task deals all its records out to spill files by bits of their hash and treats every file in the same
way with the next bits, until each bucket fits. The operator runs that twice: over every input split, so that a
group of copies of any size shrinks to one record per split before it moves, and then over the records of one hash
after a shuffle. Only distinct contents of a split are shuffled; the members of a group never meet in one task.

Spill files live in the task's own temporary folder and go with it; a task that is run again spills again.

Defined results: a null text counts as empty; a null doc_id counts as larger than every other and stays null;
rows that repeat a doc_id are separate members of their group and the first of them (in split order) stays; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import struct
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm.common import NULL_ID, ROW, discard, map_arrow, stable, with_row, written
from vellumite.tables import table

SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_HEAD = struct.Struct("<QII")


class OpenTable:
    """Open addressing with linear probing; a slot matches when hash and complete content are equal."""

    def __init__(self, slots: int = 1 << 10) -> None:
        self.mask = slots - 1
        self.slots = array("l", [-1]) * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.members: list[array] = []
        self.bytes = 0

    def add(self, h: int, content: bytes, members: array) -> None:
        """members: flat triples of (doc_id, row, count)."""
        i = h & self.mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                self.members[e].extend(members)
                self.bytes += 8 * len(members)
                return
            i = (i + 1) & self.mask
        self.slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.members.append(members)
        self.bytes += len(content) + 8 * len(members) + 120
        if 2 * len(self.hashes) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = array("l", [-1]) * (self.mask + 1)
        for e, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e

    def records(self) -> Iterator[tuple[int, bytes, array]]:
        return zip(self.hashes, self.contents, self.members, strict=True)


class GraceGroups:
    """Groups records by complete content within a budget of resident bytes."""

    def __init__(self, budget: int = 96 << 20, bits: int = 4, depth: int = 0, folder: str | None = None) -> None:
        self.budget, self.bits, self.depth, self.folder = budget, bits, depth, folder
        self.table = OpenTable()
        self.files: list | None = None
        self.own: str | None = None

    def _bucket(self, h: int) -> int:
        # The top bits choose the file; the table's probes use the low ones.
        return (h >> (64 - self.bits * (self.depth + 1))) & ((1 << self.bits) - 1)

    def _put(self, h: int, content: bytes, members: array) -> None:
        f = self.files[self._bucket(h)]
        f.write(_HEAD.pack(h, len(content), len(members)))
        f.write(content)
        f.write(members.tobytes())

    def add(self, h: int, content: bytes, members: array) -> None:
        if self.files is not None:
            self._put(h, content, members)
            return
        self.table.add(h, content, members)
        # Past the last hash bits only equal hashes are left, and one table has to hold them.
        if self.table.bytes > self.budget and len(self.table.hashes) > 1 and self.bits * (self.depth + 1) < 64:
            self.own = tempfile.mkdtemp(prefix="grace_", dir=self.folder)
            self.files = [open(os.path.join(self.own, str(i)), "wb") for i in range(1 << self.bits)]  # noqa: SIM115
            for record in self.table.records():
                self._put(*record)
            self.table = OpenTable()

    def groups(self) -> Iterator[tuple[int, bytes, array]]:
        """(hash, content, members) of every distinct content."""
        if self.files is None:
            yield from self.table.records()
            return
        try:
            for f in self.files:
                f.close()
            for i in range(len(self.files)):
                path = os.path.join(self.own, str(i))
                part = GraceGroups(self.budget, self.bits, self.depth + 1, self.own)
                try:
                    with open(path, "rb") as f:
                        while head := f.read(_HEAD.size):
                            h, size, n = _HEAD.unpack(head)
                            content, members = f.read(size), array("q")
                            members.frombytes(f.read(8 * n))
                            part.add(h, content, members)
                    os.unlink(path)
                    yield from part.groups()
                finally:
                    part.close()
        finally:
            self.close()

    def close(self) -> None:
        for f in self.files or ():
            f.close()
        if self.own:
            shutil.rmtree(self.own, ignore_errors=True)


def _flushed(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)


_LOCAL = pa.schema([("doc_id", pa.int64()), (ROW, pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("content", pa.binary())])
_FINAL = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _within_split(budget: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grace = GraceGroups(budget, bits)
        try:
            for b in batches:
                texts = b.column("text").cast(pa.binary()).to_pylist()
                for doc_id, row, text in zip(b.column("doc_id").to_pylist(), b.column(ROW).to_pylist(), texts, strict=True):
                    content = SPACES.sub(b" ", text or b"")
                    grace.add(xxhash.xxh3_64_intdigest(content), content, array("q", (NULL_ID if doc_id is None else doc_id, row, 1)))
            cols, held = [[] for _ in _LOCAL], 0
            for h, content, members in grace.groups():
                ids, rows = members[0::3], members[1::3]
                first = min(zip(ids, rows, strict=True))
                for doc_id, row in zip(ids, rows, strict=True):
                    mine = (doc_id, row) == first
                    for c, v in zip(cols, (doc_id, row, first[1], len(ids), _signed(h), content if mine else None), strict=True):
                        c.append(v)
                    if len(cols[0]) >= 20_000:
                        yield _flushed(cols, _LOCAL)
                        cols, held = [[] for _ in _LOCAL], 0
                held += len(content)
                if held > 8 << 20:
                    yield _flushed(cols, _LOCAL)
                    cols, held = [[] for _ in _LOCAL], 0
            yield _flushed(cols, _LOCAL)
        finally:
            grace.close()

    return run


def _across_splits(budget: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grace = GraceGroups(budget, bits)
        try:
            for b in batches:
                cols = (b.column(c).to_pylist() for c in ("h", "content", "doc_id", "rep", "n"))
                for h, content, doc_id, rep, n in zip(*cols, strict=True):
                    grace.add(h & 0xFFFFFFFFFFFFFFFF, content, array("q", (doc_id, rep, n)))
            cols = [[] for _ in _FINAL]
            for _, content, members in grace.groups():
                ids, reps, counts = members[0::3], members[1::3], members[2::3]
                keep_id, keep_row = min(zip(ids, reps, strict=True))
                digest, total = hashlib.sha256(content).hexdigest(), sum(counts)
                for rep in reps:
                    for c, v in zip(cols, (rep, keep_id, keep_row, total, digest), strict=True):
                        c.append(v)
                if len(cols[0]) >= 20_000:
                    yield _flushed(cols, _FINAL)
                    cols = [[] for _ in _FINAL]
            yield _flushed(cols, _FINAL)
        finally:
            grace.close()

    return run


def _grouped(docs: DataFrame, budget: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The written members of each split, and the result that is read from them."""
    rows = with_row(stable(docs.select("doc_id", "text")))
    local = written(map_arrow(rows, _within_split(budget, bits), f"doc_id long, {ROW} long, rep long, n long, h long, content binary"), "exact_dedup")
    first = local.where("content IS NOT NULL").select("h", "content", "doc_id", "rep", "n").repartition("h")
    final = map_arrow(first, _across_splits(budget, bits), "rep long, keep_id long, keep_row long, group_size long, text_sha256 string")
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    found = local.select("doc_id", ROW, "rep").join(final, "rep").select(
        null("doc_id"), ROW, null("keep_id"), "group_size", (F.col(ROW) == F.col("keep_row")).alias("kept"), "text_sha256"
    )
    return local, found


def exact_dedup(docs: DataFrame, budget: int = 96 << 20, bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, row identity, keep_id, group_size, kept, text_sha256.

    budget: bytes of contents that a task's table may hold before it deals them out to 2**bits files.
    """
    return _grouped(docs, budget, bits)[1]


def without_copies(docs: DataFrame, budget: int = 96 << 20, bits: int = 4) -> DataFrame:
    """The rows that stay, with all their columns."""
    docs = stable(docs)
    local, found = _grouped(docs, budget, bits)
    stay = written(found.where("kept").select(ROW), "kept")
    discard(local)
    return with_row(docs).join(stay, ROW, "left_semi").drop(ROW)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop(ROW)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
