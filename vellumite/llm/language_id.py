"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A trigram's vector binds its letters' vectors by elementwise product after
permuting (rotating) them by their distance from the end, so that order counts. A text bundles the vectors of all
its trigrams, one per occurrence; a language's prototype bundles the normalised texts of that language. A text goes
to the language whose prototype has the largest cosine with it.

Letters are those of Unicode, lower-cased; every run of other characters counts as one blank, also before the first
and after the last letter. Whole texts are read, in the scan's own tasks, and nothing is shuffled; a text's cost
follows its number of distinct trigrams.

Prototypes are learned from a sample of bounded expected size per language (per_language), drawn by a hash of
doc_id among the rows whose crc32(doc_id as text) mod 5 is not 0 and whose text and lang are present. What training
gathers is one vector per language, summed by Spark.

Defined results: a null, empty or letterless text is `und` with score 0; equal cosines go to the first language in
alphabetical order; a table without any labelled text gives `und` everywhere; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm.common import crc_bucket, map_arrow
from vellumite.tables import table

DIMS = 512
PER_LANGUAGE = 1500
RARE = 500  # a language's trigrams occur in one of so many of its sampled texts at least
UNDETERMINED = "und"
SURE = 0.3  # a cosine that texts of unlearned languages do not reach
_POINTS = 0x110000


@cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for everything else."""
    found = np.zeros(_POINTS, np.uint32)
    for i in range(_POINTS):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            found[i] = ord(low) if len(low) == 1 else i
    return found


class TrigramVectors:
    """Vectors of trigrams by key; the store is emptied when it has grown to its limit, and refilled from the letters."""

    def __init__(self, dims: int = DIMS, seed: int = 20_011, limit: int = 24_000) -> None:
        self.dims, self.seed, self.limit = dims, seed, limit
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.int64)
        self.rows = np.empty(0, np.int64)
        self.vectors = np.empty((0, self.dims), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dims)
            self.letters[point] = (2 * bits - 1).astype(np.float32)
        return self.letters[point]

    def vector(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct keys."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if not known.all():
            new = keys[~known]
            made = np.stack([self.vector(int(k)) for k in new])
            if len(self.keys) + len(new) > self.limit:
                self.clear()
                if len(keys) > self.limit:  # a text of very many trigrams is bundled without the store
                    return np.stack([self.vector(int(k)) for k in keys])
                made, new = np.stack([self.vector(int(k)) for k in keys]), keys
            order = np.argsort(both := np.concatenate([self.keys, new]), kind="stable")
            self.rows = np.concatenate([self.rows, len(self.vectors) + np.arange(len(new))])[order]
            self.keys = both[order]
            self.vectors = np.concatenate([self.vectors, made])
            at = np.searchsorted(self.keys, keys)
        return self.vectors[self.rows[at]]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a text's trigrams and their counts; none for a text without letters."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _letters()[points]
    low = np.concatenate([np.zeros(1, np.uint32), low, np.zeros(1, np.uint32)])
    low = low[np.concatenate([[True], (low[1:] != 0) | (low[:-1] != 0)])].astype(np.int64)
    if len(low) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique((low[:-2] << 42) | (low[1:-1] << 21) | low[2:], return_counts=True)


_STORES: dict[int, TrigramVectors] = {}


def _store(dims: int) -> TrigramVectors:
    return _STORES.setdefault(dims, TrigramVectors(dims))


def bundled(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """The text's bundle, scaled to length one; None without letters."""
    keys, counts = trigrams(text)
    if not len(keys):
        return None
    v = counts.astype(np.float32) @ _store(dims).of(keys)
    norm = float(np.sqrt(v.astype(np.float64) @ v))
    return v / norm if norm else None


def _sample(docs: DataFrame, per_language: int) -> DataFrame | None:
    """lang and text of the training sample; None without labelled texts."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_bucket(F.col("doc_id"), 5) != 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    return rows.where(draw < rates[F.col("lang")]).select("lang", "text")


def learn(docs: DataFrame, dims: int = DIMS, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototype of each language, of length one. per_language bounds the expected number of texts of one language."""
    sample = _sample(docs, per_language)
    if sample is None:
        return {}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if (v := bundled(text, dims)) is not None:
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        if total:
            # Sums are kept as integers, so that their order does not matter.
            whole = [np.rint(v * 1e9).astype(np.int64).tolist() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(whole, pa.list_(pa.int64()))], ["lang", "v"])

    parts = map_arrow(sample, sums, "lang string, v array<bigint>")
    cells = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    found: dict[str, np.ndarray] = {}
    for r in cells:
        found.setdefault(r["lang"], np.zeros(dims))[r["i"]] = r["x"] / 1e9
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(found.items()) if np.linalg.norm(v)}


def scorer(prototypes: dict[str, np.ndarray], dims: int = DIMS) -> Callable[[str | None], tuple[str, float]]:
    """A function from a text to its language and score (the cosine, not below 0)."""
    names, matrix = list(prototypes), np.stack(list(prototypes.values())) if prototypes else np.zeros((0, dims), np.float32)

    def score(text: str | None) -> tuple[str, float]:
        v = bundled(text, dims) if names else None
        if v is None:
            return UNDETERMINED, 0.0
        cosines = matrix @ v
        i = int(cosines.argmax())
        return names[i], min(1.0, max(0.0, float(cosines[i])))

    return score


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dims: int = DIMS, carry: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The carried columns, the language and the score under the names in out."""
    score = scorer(prototypes, dims)
    rows = docs.select(*carry, F.col("text").alias("_vellumite_text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "_vellumite_text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [score(text) for text in b.column("_vellumite_text").to_pylist()]
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kinds), langs, scores], [*kinds, *out])

    return map_arrow(rows, run, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + f", {out[0]} string, {out[1]} double")


def language_id(docs: DataFrame, dims: int = DIMS, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    found = predict(docs, learn(docs, dims, per_language), dims)
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def known_trigrams(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the trigrams of the training sample, and in which languages each is known (key x language)."""
    sample = _sample(docs, per_language)
    if sample is None:
        return np.empty(0, np.int64), np.zeros((0, 0), bool)

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if len(keys := trigrams(text)[0]):
                    total.setdefault(lang, []).extend((keys, np.array([-1])))  # -1 counts the texts
            for lang, found in total.items():
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "key", "n"])

    sums = map_arrow(sample, texts_of, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    lang, key, n = (sums.column(c).to_numpy() for c in ("lang", "key", "n"))
    names, column = np.unique(lang.astype(str), return_inverse=True)
    texts = np.zeros(len(names), np.int64)
    texts[column[key < 0]] = n[key < 0]
    often = (key >= 0) & (n * RARE >= texts[column])
    keys, row = np.unique(key[often], return_inverse=True)
    known = np.zeros((len(keys), len(names)), bool)
    known[row, column[often]] = True
    return keys, known


def in_known_language(docs: DataFrame, sure: float = SURE, min_share: float = 0.5, per_language: int = PER_LANGUAGE, dims: int = DIMS) -> DataFrame:
    """The rows, with all their columns, whose text the operator finds in a learned language.

    A cosine of `sure` decides. Below it lie unlearned texts, but also clean ones of one or two words or of few
    different words; of these the rows stay of whose trigrams at least min_share are known in one language. On sf0.01, 9 of 1,000
    clean texts have a cosine below 0.3; random words of any script have 0.21 or less. Clean texts have a share of known
    trigrams of 0.80 or more, random Latin letters 0.20 or less, unlearned scripts none.
    """
    score = scorer(learn(docs, dims, per_language), dims)
    keys, known = known_trigrams(docs, per_language)
    own, text = tuple(docs.columns), "_vellumite_text"
    rows = docs.select("*", F.col("text").alias(text))
    weight = known.astype(np.float64)

    def share(t: str) -> float:
        found, n = trigrams(t)
        if not len(keys):
            return 0.0
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        mine = keys[at] == found
        return float((n[mine] @ weight[at[mine]]).max()) / int(n.sum())

    def stays(t: str | None) -> bool:
        lang, cosine = score(t)
        return lang != UNDETERMINED and (cosine >= sure or share(t) >= min_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(list(own)).filter(pa.array([stays(t) for t in b.column(text).to_pylist()], pa.bool_()))

    return map_arrow(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
