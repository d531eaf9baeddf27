"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors is never above the fingerprints' Hamming distance, so fingerprints within 3 bits are within Manhattan
distance 3. Of the two halves of the vector (16 counts each) one is then within distance 1. The join is a grid
range-join over each half: a fingerprint is put into its own cell and into the cells one step up in one coordinate;
two halves within distance 1 always meet in a cell. Inside a cell, pairs are held against the whole vectors'
Manhattan distance and verified by the exact Hamming distance.

Only distinct fingerprints take part, and a cell emits a spanning forest of its links instead of all of them: from a
member, the unvisited members within 3 bits are taken out and searched from in turn, so a dense family of
thousands costs little more than one scan a member and gives one link a member. Links between different
fingerprints are never lost; components come from the forest.

Defined results: a null or wordless text has fingerprint zero, linked like any other; fewer than three words give one
shingle of all of them; a null doc_id counts as larger than every other and stays null; repeated rows are listed one
by one; an empty table gives no rows.

one_of_each, the pipeline's stage, has no contract of its own and links more: besides fingerprints within 3 bits, all
texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates share one of 32 bands of
five minimum hashes each (a pair at 0.8 shares one with probability 0.999997, a closer one more surely); each
candidate pair is checked by its whole sets. Of a band's cell, each text is first held against the cell's smallest;
what these links leave in different components is then held against each other: pair by pair in cells of up to FEW
texts, and in larger cells block against block in one task each, which gives only links that connect components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm.common import NULL_ID, ROW, discard, map_arrow, stable, with_row, written
from vellumite.llm.components import components
from vellumite.tables import table

WORDS = 3
MAX_BITS = 3
SEED = 42
SHINGLE = 5
SIMILAR = (4, 5)  # a similarity of 4/5
BANDS, BAND_ROWS = 32, 5
FEW = 24  # cells of up to so many nodes are searched pair by pair
BLOCK = 256  # larger ones in blocks of about so many
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The text's fingerprint; shingles count as often as they occur."""
    parts = (text or b"").translate(_LOWER).split()  # bytes.split() splits at the contracts' six characters
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    else:
        body = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = (ends - [len(p) + 1 for p in parts]).tolist()
        stops = (ends - 1).tolist()[words - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(body[a:b], SEED) for a, b in zip(starts, stops, strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, row identity and fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(ROW), pa.array(found, pa.int64())], ["doc_id", ROW, "fp"])

    return map_arrow(with_row(docs.select("doc_id", "text")), run, f"doc_id long, {ROW} long, fp long")


#: The low bit of every segment.
_LOW = 0x5555555555555555


def embedded(fp: np.ndarray) -> np.ndarray:
    """The 32 counts of a fingerprint as one unsigned long, each in unary (00, 01, 11), so that the bits in which two embeddings differ are their Manhattan distance."""
    above = fp >> np.uint64(1)
    return ((fp | above) & np.uint64(_LOW)) | ((fp & above & np.uint64(_LOW)) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two embeddings."""
    return np.bitwise_count(a ^ b)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every cell a fingerprint is put into: cell (half and its 16 counts), fingerprint."""
    mask = np.uint64(0xFFFFFFFF)
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        whole = embedded(fp)
        cells, owners = [], []
        for half in range(2):
            part = ((whole >> np.uint64(32 * half)) & mask).astype(np.int64)
            tag = np.int64(half) << np.int64(32)
            cells.append(part | tag)
            owners.append(fp)
            for i in range(16):
                count = (part >> (2 * i)) & 3
                up = count < 3
                cells.append((part[up] | ((count[up] + 1) << (2 * i))) | tag)  # 00 to 01, 01 to 11 (as 01 | 10)
                owners.append(fp[up])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(owners).view(np.int64))], ["cell", "fp"])


def linked(members: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (unsigned), as pairs."""
    found: list[tuple[int, int]] = []
    rest = members
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                got = rest[near]
                rest = rest[~near]
                found.extend((int(x), int(y)) for y in got)
                frontier.extend(got)
    return found


def cell_links(cell: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS, small: int = 8) -> np.ndarray:
    """Links (rows of two, the smaller first) that connect what is linked inside each of some whole cells, given in order.

    Cells of up to `small` members are looked at side by side; each larger one gets a spanning forest of its own.
    """
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(cell)))
    shape, few = embedded(fp), np.repeat(sizes <= small, sizes)
    found = [np.empty((0, 2), np.uint64)]
    for step in range(1, min(small, int(sizes.max(initial=1)))):
        i = np.flatnonzero((cell[step:] == cell[:-step]) & few[:-step])
        i = i[manhattan(shape[i], shape[i + step]) <= max_bits]  # the lower bound first
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= max_bits]
        found.append(np.stack([fp[i], fp[i + step]], 1))
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        if forest := linked(fp[s : s + n], max_bits):
            found.append(np.array(forest, np.uint64))
    both = np.concatenate(found).view(np.int64)
    return np.unique(np.stack([both.min(1, initial=np.iinfo(np.int64).max), both.max(1, initial=np.iinfo(np.int64).min)], 1), axis=0)


def _forest(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(n: int) -> pa.RecordBatch:
            links = cell_links(cell[:n], fp[:n], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        for b in batches:
            cell = np.concatenate([cell, b.column("cell").to_numpy()])
            fp = np.concatenate([fp, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(cell) > 200_000 and (whole := int(np.searchsorted(cell, cell[-1]))):
                yield out(whole)  # the last cell may go on
                cell, fp = cell[whole:], fp[whole:]
        yield out(len(cell))

    return run


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct fingerprints (fp) within max_bits of one another."""
    cells = map_arrow(distinct.select("fp"), _cells, "cell long, fp long")
    shared = cells.repartition("cell").sortWithinPartitions("cell")
    return map_arrow(shared, _forest(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, row identity, fp, component_id (smallest doc_id), first_row (the row of that id)."""
    if max_bits > 3:
        raise ValueError("the grid joins halves within distance 1, which is exact up to 3 bits")
    rows = written(fingerprints(docs, words), "fingerprints")
    one = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col(ROW).alias("row"))
    distinct = rows.groupBy("fp").agg(F.min(one).alias("first"))
    groups = components(near_links(distinct.select("fp"), max_bits))
    joined = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    named = joined.select("fp", "component").join(least, "component").select("fp", "least")
    return rows.join(named, "fp").select(
        "doc_id", ROW, "fp", F.when(F.col("least.id") != NULL_ID, F.col("least.id")).alias("component_id"), F.col("least.row").alias("first_row")
    )


def shingles(text: bytes | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of all its words where they are fewer, none without words."""
    parts = (text or b"").translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    body = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: max(0, len(parts) - words)].tolist()]
    stops = (ends - 1)[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(body[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


_FLIPS, _FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 32, (2, BANDS * BAND_ROWS, 1), np.uint32)
_FACTORS |= np.uint32(1)


def bands(found: np.ndarray) -> np.ndarray:
    """One long for each band: the hash of its minimum hashes and its number; none for an empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint32).max, np.uint32)
    values = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(values), 1024):
        some = values[i : i + 1024] ^ _FLIPS
        some *= _FACTORS
        np.minimum(low, some.min(1), out=low)
    rows = low.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Have two sets of shingles, as sorted arrays, a similarity of at least SIMILAR?"""
    n, of = SIMILAR
    if min(len(a), len(b)) * of < n * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * of >= n * (len(a) + len(b) - both)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row identity, fingerprint, node (hash of the set of shingles) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            sets = [shingles(t) for t in texts]
            fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            cells = pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(ROW), pa.array(fps), pa.array(nodes), cells], ["doc_id", ROW, "fp", "node", "cells"])

    return map_arrow(with_row(docs.select("doc_id", "text")), run, f"doc_id long, {ROW} long, fp long, node long, cells array<bigint>")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            keep = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"s{k}"))
    return map_arrow(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb"), run, "a long, b long")


def similar_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes of similar sets that share a band; docs are the rows that were sketched."""
    nodes = rows.groupBy("node").agg(F.min(ROW).alias(ROW), F.first("cells").alias("cells"))
    spread = nodes.select("node", ROW, F.explode("cells").alias("cell"))
    shared = spread.join(spread.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "cell")
    cells = written(shared.select("cell", "node", "least", ROW), "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.binary())], ["node", "set"])

    texts = with_row(docs.select("text")).join(cells.select(ROW, "node").distinct(), ROW).select("node", "text")
    sets = written(map_arrow(texts, run, "node long, set binary"), "sets")
    tried = written(cells.where("least <> node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    first = written(_checked(tried, sets), "links")
    named = cells.select("cell", "node").join(components(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "named")
    tally = named.groupBy("cell").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"))
    # Of cells with the same members, one is looked at.
    apart = written(tally.where("x <> y").groupBy("n", "members").agg(F.min("cell").alias("cell")).drop("members"), "apart")
    open_ = named.join(apart, "cell")
    few = open_.where(F.col("n") <= FEW)
    other = few.select("cell", F.col("node").alias("b"), F.col("component").alias("other"))
    rest = few.select("cell", F.col("node").alias("a"), "component").join(other, "cell").where("a < b and component <> other").select("a", "b").distinct()
    links = written(first.union(_checked(rest, sets)).union(_block_links(open_.where(F.col("n") > FEW), sets)), "links")
    discard(cells, sets, tried, first, named, apart)
    return links


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a (sorted arrays of distinct elements) has in common with each of b."""
    found = np.zeros(len(a) * len(b), np.int64)
    values = np.concatenate(a)
    owner = np.repeat(np.arange(len(a)), [len(x) for x in a])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for k, x in enumerate(b):
        low, high = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        n = high - low
        if total := int(n.sum()):
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
            found += np.bincount(owner[at] * len(b) + k, minlength=len(found))
    return found.reshape(len(a), len(b))


def _block_links(members: DataFrame, sets: DataFrame, most: int = BLOCK, most_bytes: int = 8 << 20) -> DataFrame:
    """Links (a, b) that connect the similar nodes of different components in each large cell (cell, node, component, n).

    A cell's nodes are dealt to blocks of about `most` nodes and most_bytes bytes of shingles by their hash, and each
    pair of blocks meets in one task, so that what moves is a block's share of all pairs and no task holds a cell.
    """
    nodes = members.join(sets, "node")
    sizes = nodes.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / most, F.sum(F.octet_length("set")) / most_bytes)).cast("int").alias("m"))
    own = nodes.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    key = ["cell", "low", "high"]
    each = each.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component", "set")

    def linked_pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        low, high = rows[0][1], rows[0][2]
        arrays = [np.frombuffer(x[6], np.uint64) for x in rows]
        left = [i for i, x in enumerate(rows) if x[3] == low]
        right = left if low == high else [i for i, x in enumerate(rows) if x[3] == high]
        if not left or not right:
            return []
        both = common_counts([arrays[i] for i in left], [arrays[i] for i in right])
        size = np.array([len(x) for x in arrays])
        n, of = SIMILAR
        i, j = np.nonzero(both * of >= n * (size[left][:, None] + size[right][None, :] - both))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        found = []
        for x, y in zip((rows[left[k]] for k in i.tolist()), (rows[right[k]] for k in j.tolist()), strict=True):
            if (p := find(x[5])) != (q := find(y[5])):  # components that this pair is the first to connect
                root[p] = q
                found.append((x[4], y[4]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def out() -> pa.RecordBatch:
            found = linked_pairs(group) if group else []
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in (*key, "own", "node", "component", "set")), strict=True):
                if group and group[0][:3] != x[:3]:
                    yield out()
                    group = []
                group.append(x)
        yield out()

    return map_arrow(each.repartition(*key).sortWithinPartitions(*key), run, "a long, b long")


def one_of_each(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows, with all their columns, that come first (by doc_id, then in split order) in their group.

    Rows are linked by fingerprints within max_bits or by similar sets of five-word shingles.
    """
    if max_bits > 3:
        raise ValueError("the grid joins halves within distance 1, which is exact up to 3 bits")
    docs = stable(docs)
    rows = written(_sketches(docs, words), "sketches")
    one = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col(ROW).alias("row"))
    kinds = written(rows.groupBy("node", "fp").agg(F.min(one).alias("first")), "nodes")
    stands = kinds.groupBy("fp").agg(F.min("node").alias("stand"))  # a fingerprint's links go to one of its nodes
    by_bits = near_links(stands.select("fp"), max_bits)
    for k in ("a", "b"):
        by_bits = by_bits.join(stands.select(F.col("fp").alias(k), F.col("stand").alias(f"n{k}")), k)
    same = kinds.join(stands, "fp").select(F.col("node").alias("a"), F.col("stand").alias("b"))
    links = similar_links(docs, rows).union(by_bits.select(F.col("na").alias("a"), F.col("nb").alias("b"))).union(same)
    joined = kinds.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    stay = joined.groupBy("component").agg(F.min("first").alias("least")).select(F.col("least.row").alias(ROW))
    return with_row(docs).join(stay, ROW, "left_semi").drop(ROW)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
