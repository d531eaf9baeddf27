"""Suffix-array removal of repeated passages, by bucket-pointer refinement.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the input. The suffix array is
cut into independent parts that need no common memory: every string of that length has a minimiser, the smallest
(by hash) of its 64-byte grams, and equal strings have equal minimisers. Strings with neighbouring starts and one
minimiser make a context (their starts and the bytes they span). Contexts that share a minimiser and are equal are
counted together before anything moves, so copies of any number shrink to one row a split. Where one minimiser has
different contexts, their bytes come to one task, and the suffixes at their starts are sorted to the needed depth by
bucket-pointer refinement: buckets of 8-grams first, then every bucket of more than one is sorted by the bucket
pointers at a later offset; refined pointers are written back and used by the next refinements, which doubles the
sorted depth each time. Starts left in one bucket are equal strings. A context of which there are several copies is
repeated at each of its starts as it is. A minimiser with more than CROWD contexts never comes to one task: its contexts
are cut by the place of the minimiser in their strings, 16 places together, and dealt anew by the bytes that all strings
of such a block share; equal parts are counted together, few different ones sorted, and where there still are more than
CROWD, they are cut into single strings, which are equal or in groups of their own.

Defined results: a null text counts as empty; texts shorter than `length` bytes keep everything; rows that repeat a
doc_id are different places, so that what they share goes from all of them; cuts are made at bytes, whole characters
or not; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm.common import ROW, discard, map_arrow, stable, with_row, written
from vellumite.tables import table

LENGTH = 400
GRAM = 64
#: Contexts of one minimiser that one task sorts; where there are more, they are cut into blocks of WIDTHS places.
CROWD = 4096
WIDTHS = (16, 1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 19
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _POWERS:
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at every start."""
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width keys, from minima to both sides of block borders."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], back[width - 1 : n])


def contexts(texts: Sequence[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, first start, last start, place of the minimiser, minimiser's hash) of each context of some texts, which are short together."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return
    hashes = gram_hashes(data, gram)
    # High bits decide, then the place: the leftmost of equal grams.
    keys = (hashes & ~np.uint64(0xFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    places = (window_minima(keys, length - gram + 1) & np.uint64(0xFFFFF)).astype(np.int64)
    starts = np.arange(len(places))
    owner = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[owner]
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(places) - 1)
    fine = inside[first]
    first, last = first[fine], last[fine]
    last = np.minimum(last, ends[owner[first]] - length)
    begin = (ends - sizes)[owner[first]]
    marks = hashes[places[first]].view(np.int64)
    yield from zip(owner[first].tolist(), (first - begin).tolist(), (last - begin).tolist(), (places[first] - begin).tolist(), marks.tolist(), strict=True)


def _all_contexts(texts: Sequence[bytes], length: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The same for texts of any size: short ones together, long ones in segments that overlap by length - 1 bytes."""
    batch: list[int] = []
    held = 0

    def done() -> Iterator[tuple[int, int, int, int, int]]:
        for k, *rest in contexts([texts[i] for i in batch], length, gram):
            yield (batch[k], *rest)

    for i, t in enumerate(texts):
        if len(t) > _SEGMENT:
            for s in range(0, len(t) - length + 1, _SEGMENT):
                for _, a, b, p, h in contexts([t[s : s + _SEGMENT + length - 1]], length, gram):
                    yield i, s + a, s + b, s + p, h
            continue
        if held + len(t) > _SEGMENT:
            yield from done()
            batch, held = [], 0
        if len(t) >= length:
            batch.append(i)
            held += len(t)
    yield from done()


def refined(data: np.ndarray, depth: int, starts: np.ndarray, gram: int = 8) -> np.ndarray:
    """Bucket pointers of suffixes sorted to the given depth; only those at starts, whose depth bytes are all their own, are sure."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(gram, np.uint8)])
    codes = np.zeros(n, np.uint64)
    for j in range(gram):
        codes = (codes << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    heads = np.append(True, ranked[1:] != ranked[:-1])
    first = np.flatnonzero(heads)
    pointer = np.empty(n, np.int64)
    pointer[order] = np.repeat(first, np.diff(np.append(first, n)))
    live = order[~(heads & np.append(heads[1:], True))]
    reached = gram
    while reached < depth and len(live):
        step = min(reached, depth - reached)
        if reached + step == depth:
            live = live[starts[live]]
        old = pointer[live]
        key = old * n + pointer[np.minimum(live + step, n - 1)]
        rank = np.argsort(key, kind="stable")
        live, key, old = live[rank], key[rank], old[rank]
        at = np.arange(len(live))
        new_head = np.append(True, key[1:] != key[:-1])[: len(live)]
        old_head = np.append(True, old[1:] != old[:-1])[: len(live)]
        shift = np.maximum.accumulate(np.where(new_head, at, 0)) - np.maximum.accumulate(np.where(old_head, at, 0))
        pointer[live] = old + shift  # the next refinements read the refined pointers
        alone = new_head & np.append(new_head[1:], True)[: len(live)]
        live = live[~alone]
        reached += step
    return pointer


def repeated(pieces: Sequence[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context's bytes, which of its starts (all with length bytes behind them) have an equal string at another start."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.zeros(len(data), bool)
    for e, s in zip(ends.tolist(), sizes.tolist(), strict=True):
        starts[e - s : e - length + 1] = True
    at = np.flatnonzero(starts)
    bucket = refined(data, length, starts)[at]
    _, inverse, counts = np.unique(bucket, return_inverse=True, return_counts=True)
    flags = np.zeros(len(data), bool)
    flags[at] = counts[inverse] > 1
    return [flags[e - s : e - length + 1] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last index of each run of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[0::2].tolist(), (edges[1::2] - 1).tolist()


def _tallied(found: DataFrame) -> DataFrame:
    """Contexts (mark, digest, row identity, at) counted: n equal ones, kinds of one minimiser; only those that may hold a repeated string.

    at: first start, starts after it and place of the minimiser in one long, so that rows stay small; returned as a, z, p.
    """
    one = [F.first(c).alias(c) for c in (ROW, "at")]  # both of the same row, whichever of the equal ones it is
    distinct = written(found.groupBy("mark", "digest").agg(F.count("*").alias("n"), *one), "distinct")
    several = distinct.groupBy("mark").agg(F.count("*").alias("kinds")).where("kinds > 1")
    both = distinct.join(several, "mark", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    a = F.shiftright("at", 32)
    place = [a.alias("a"), (a + F.shiftright("at", 16).bitwiseAND(0xFFFF)).alias("z"), F.col("at").bitwiseAND(0xFFFF).alias("p")]
    marked = written(both.where("kinds > 1 OR n > 1").select("mark", "digest", "n", "kinds", ROW, *place), "marks")
    discard(distinct)
    return marked


def _bodies(marked: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The contexts with the bytes they span."""
    body = F.substring(F.col("text").cast("binary"), (F.col("a") + 1).cast("int"), (F.col("z") - F.col("a") + length).cast("int"))
    return marked.join(rows.select(ROW, "text"), ROW).withColumn("body", body).drop("text")


def _solved(edge: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """mark, digest, begins, stops: runs of repeated starts of contexts, whose minimisers have few contexts each."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups of one mark
        group: list[tuple] = []
        size = group_size = 0

        def out(items: list[tuple]) -> pa.RecordBatch:
            flags = repeated([x[3] for x in items], length) if items else []
            begins, stops = [], []
            for x, f in zip(items, flags, strict=True):
                a, z = _runs(np.ones(len(f), bool) if x[2] > 1 else f)
                begins.append(a)
                stops.append(z)
            keys = [pa.array([x[i] for x in items], pa.int64()) for i in range(2)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(begins, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32()))], ["mark", "digest", "begins", "stops"])

        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("mark", "digest", "n", "body"))
            for x in zip(*cols, strict=True):
                if group and group[0][0] != x[0]:
                    if size + group_size > batch_bytes and held:
                        yield out(held)
                        held, size = [], 0
                    held += group
                    size += group_size
                    group, group_size = [], 0
                group.append(x)
                group_size += len(x[3])
        if size + group_size > batch_bytes and held:
            yield out(held)
            held = []
        yield out(held + group)

    dealt = edge.select("mark", "digest", "n", "body").repartition("mark").sortWithinPartitions("mark")
    return map_arrow(dealt, solve, "mark long, digest long, begins array<int>, stops array<int>").where("size(begins) > 0")


def parts(body: bytes, p: int, width: int, length: int = LENGTH) -> Iterator[tuple[int, int, bytes, bytes]]:
    """A context cut by the place of the minimiser (p) in its strings, `width` places together: first and last start, block and what all strings of the block share, bytes.

    Equal strings have the minimiser at one place, so they are in one block and share its core.
    """
    last = len(body) - length
    for k in range((p - last) // width, p // width + 1):
        first, final = max(0, p - (k + 1) * width + 1), min(last, p - k * width)
        core = b"%d " % k + body[p - k * width : p - (k + 1) * width + 1 + length]
        yield first, final, core, body[first : final + length]


def _repeats(marked: DataFrame, rows: DataFrame, length: int, crowd: int, batch_bytes: int, widths: Sequence[int] = WIDTHS) -> tuple[DataFrame, list[DataFrame]]:
    """mark, digest, begins, stops: runs of repeated starts of the contexts, which may be in several rows; and the written tables."""
    key = ["mark", "digest"]
    whole = marked.where((F.col("kinds") == 1) | (F.col("kinds") > crowd) & (F.col("n") > 1))
    whole = whole.select(*key, F.array(F.lit(0)).alias("begins"), F.array((F.col("z") - F.col("a")).cast("int")).alias("stops"))
    found = whole.union(_solved(_bodies(marked.where(F.col("kinds").between(2, crowd)), rows, length), length, batch_bytes))
    crowded = marked.where(F.col("kinds") > crowd)
    if not widths or crowded.isEmpty():
        return found, [marked]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mark", "digest", "shift", "mark2", "digest2", ROW, "at"]
        for b in batches:
            got = []
            for mark, digest, row, a, p, body in zip(*(b.column(c).to_pylist() for c in (*key, ROW, "a", "p", "body")), strict=True):
                for first, final, core, piece in parts(body, p, widths[0], length):
                    group = xxhash.xxh3_64_intdigest(core, mark & 0xFFFFFFFFFFFFFFFF)
                    got.append((mark, digest, first, _signed(group), _signed(xxhash.xxh3_64_intdigest(piece, p - first)), row, _at(a + first, a + final, p - first)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*got, strict=True) if got else [()] * len(names))], names)

    kinds = f"mark long, digest long, shift long, mark2 long, digest2 long, {ROW} long, at long"
    split = written(map_arrow(_bodies(crowded, rows, length), cut, kinds), "parts")
    inner = _tallied(split.select(F.col("mark2").alias("mark"), F.col("digest2").alias("digest"), ROW, "at"))
    deeper, tables = _repeats(inner, rows, length, crowd, batch_bytes, widths[1:])
    moved = [F.transform(c, lambda x: x + F.col("shift").cast("int")).alias(c) for c in ("begins", "stops")]
    back = split.select(*key, "shift", "mark2", "digest2").join(deeper.toDF("mark2", "digest2", "begins", "stops"), ["mark2", "digest2"])
    return found.union(back.select(*key, *moved)), [marked, split, *tables]


def _at(a: int, z: int, p: int) -> int:
    """First start, starts after it and the minimiser's place after the first start, in one long."""
    return a << 32 | (z - a) << 16 | p


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, batch_bytes: int = 2 << 20) -> tuple[DataFrame, list[DataFrame]]:
    """Row identity and spans (array of begin, end; they may overlap and are not in order) of rows that have any, and the written tables they are read from."""
    if length > 0xFFFF:
        raise ValueError("lengths of up to 65535 bytes")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(ROW).to_pylist(), [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            got = [(ids[i], _at(a, z, p - a), h, xxhash.xxh3_64_intdigest(texts[i][a : z + length])) for i, a, z, p, h in _all_contexts(texts, length, gram)]
            cols = list(zip(*got, strict=True)) or [()] * 4
            digest = np.array(cols[3], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(digest)], [ROW, "at", "mark", "digest"])

    # A context is known by its minimiser's 64-bit hash and by its own.
    context = written(map_arrow(rows.select(ROW, "text"), found, f"{ROW} long, at long, mark long, digest long"), "contexts")
    repeats, tables = _repeats(_tallied(context), rows, length, crowd, batch_bytes)
    spans = context.join(repeats, ["mark", "digest"]).select(ROW, F.explode(F.arrays_zip("begins", "stops")).alias("s"), F.shiftright("at", 32).alias("a"))
    spans = spans.select(ROW, F.struct((F.col("a") + F.col("s.begins")).alias("begin"), (F.col("a") + F.col("s.stops") + length).alias("end")).alias("s"))
    return spans.groupBy(ROW).agg(F.collect_list("s").alias("spans")), [context, *tables]


def _kept(text: bytes, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The parts that stay and the number of maximal removed runs."""
    parts, at, runs, end = [], 0, 0, -1
    for begin, stop in sorted((s["begin"], s["end"]) for s in spans or ()):
        if begin > end:
            parts.append(text[at:begin])
            runs += 1
        end = max(end, stop)
        at = end
    parts.append(text[at:])
    return parts, runs


def suffix_dedup(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, row identity, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            kept = [_kept(t, s) for t, s in zip(texts, b.column("spans").to_pylist(), strict=True)]
            bodies = [b"".join(p) for p, _ in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column(ROW), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(t) - len(x) for t, x in zip(texts, bodies, strict=True)], pa.int64()),
                    pa.array([n for _, n in kept], pa.int64()), pa.array(bodies, pa.binary()),
                ],
                ["doc_id", ROW, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    rows = with_row(stable(docs.select("doc_id", "text")))
    found = rows.join(_spans(rows, length, crowd=crowd)[0], ROW, "left")
    return map_arrow(found, cut, f"doc_id long, {ROW} long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows, with all their columns, with repeated passages cut out of the text; characters that a cut broke become U+FFFD.

    A text of which nothing is left goes, unless it was empty or null before; n_chars follows the text.
    """
    docs = stable(docs)
    found, parts = _spans(with_row(docs.select("doc_id", "text")), length, gram)
    spans = written(found.withColumnRenamed("spans", "_vellumite_spans"), "spans")
    discard(*parts)
    own = docs.columns
    df = with_row(docs).join(spans, ROW, "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("_vellumite_spans").to_pylist()
            texts, left = b.column("text").to_pylist(), []
            for t, s in zip(texts, spans, strict=True):
                left.append(t if not s else b"".join(_kept(t.encode(), s)[0]).decode("utf-8", "replace"))
            stay = pa.array([not s or bool(x) for x, s in zip(left, spans, strict=True)])
            cols = [pa.array(left, b.column(c).type) if c == "text" else b.column(c) for c in own]
            if "n_chars" in own:
                sizes = [n if not s else len(x) for n, x, s in zip(b.column("n_chars").to_pylist(), left, spans, strict=True)]
                cols[own.index("n_chars")] = pa.array(sizes, b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(cols, own).filter(stay)

    return map_arrow(df, cut, kinds)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
