"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon, second-person words and their proximity to
lexicon words, capitals, punctuation, and rates of obfuscated words (digits or symbols inside words, plain or after
undoing the usual substitutions). The learned lexicon holds the words whose document frequencies in the training
rows lean most towards label 1. Trees are grown on histograms of the features in numpy; isotonic regression on
out-of-fold margins turns margins into probabilities.

Labels are read only from rows whose crc32(doc_id as text) mod 5 is not 0, and of these a sample of bounded expected
size (max_rows), drawn by a hash of doc_id. Scoring is one pass over the scan: nothing is shuffled.

Defined results: a null text counts as empty and gets the score of all-zero features; without any labels of both
kinds every score is the share of label 1 (0 if there is no label); repeated rows are scored one by one; labels of
one doc_id that differ count as separate rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm.common import crc_bucket, map_arrow
from vellumite.tables import table

MAX_ROWS = 8000
#: Plain insults, by language.
LEXICON = (
    "idiot idiots stupid moron morons pathetic worthless loser losers trash garbage scum clown clowns dumb fool fools "
    "disgusting hate ugly shut useless imbecile jerk liar coward creep vermin filth kill die "
    "dumm dummkopf trottel abschaum wertlos idioten arschloch "
    "imbécile connard nul stupide crétin débile "
    "idiota estúpido imbécil basura tonto inútil"
).split()
#: Second-person words of the same languages.
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes tus".split()
#: Characters put for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""})
_EDGE = ".,;:!?\"'()[]{}<>#$%&*|-_/\\«»„“”¿¡~+="
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!*|.\-_]+[^\W\d_]+)+")
_RUNS = re.compile(r"[!?]{2,}")

FEATURES = (
    "base_density base_any learned_density learned_any learned_distinct near_second second_density caps_words upper_share bang_density "
    "question_density punct_density run_density mixed_rate undone_hits max_window long_words log_words"
).split()


def features(text: str | None, learned: frozenset[str], base: frozenset[str] = frozenset(LEXICON), second: frozenset[str] = frozenset(SECOND)) -> list[float]:
    """The feature vector of one whole text."""
    text = text or ""
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = [w.strip(_EDGE) for w in low.split()]
    lex = base | learned
    hits = [i for i, w in enumerate(words) if w in lex]
    base_hits = sum(words[i] in base for i in hits)
    learned_hits = [words[i] for i in hits if words[i] in learned]
    near = sum(any(words[j] in second for j in range(max(0, i - 3), min(n, i + 4))) for i in hits)
    you = sum(w in second for w in words)
    caps = sum(w.isupper() and len(w) > 2 for w in raw)
    upper = sum(map(str.isupper, raw)) if n < 8 else caps
    bang, question = text.count("!"), text.count("?")
    punct = sum(text.count(c) for c in "#$%&*|@")
    mixed = _MIXED.findall(low) if any(c in low for c in "0134578@$!*|.-_") else []
    undone = sum(m.translate(LEET) in lex for m in mixed)
    most = k = 0
    for j, i in enumerate(hits):  # lexicon words within 50 words
        while i - hits[k] >= 50:
            k += 1
        most = max(most, j - k + 1)
    d = 1.0 / n
    return [
        base_hits * d, float(base_hits), len(learned_hits) * d, float(len(learned_hits)), float(len(set(learned_hits))), float(near), you * d, caps * d, upper * d, bang * d,
        question * d, punct * d, len(_RUNS.findall(text)) * d if bang or question else 0.0, len(mixed) * d, float(undone), float(most), sum(len(w) > 20 for w in raw) * d, float(np.log1p(n)),
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, grown level by level on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: int = 12) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.prior = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c[c > c.min()] if (c > c.min()).any() else c, np.linspace(0, 1, self.bins)) - 1e-9) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        width = max(len(c) for c in self.cuts) + 1
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.prior = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            nodes = (1 << (self.depth + 1)) - 1
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            at = np.zeros(len(y), np.int64)
            for node in range(nodes):
                own = np.flatnonzero(at == node)
                if not len(own):
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                value[node] = gs / (hs + self.ridge)
                if node >= nodes // 2 or len(own) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for f in range(x.shape[1]):
                    b = binned[own, f]
                    gl, hl, cl = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g[own], h[own], np.ones(len(own))))
                    ok = (cl >= self.least) & (len(own) - cl >= self.least)
                    if ok.any():
                        gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                        k = int(np.where(ok, gain, -1).argmax())
                        best = max(best, (float(gain[k]) if ok[k] else -1.0, f, k))
                if best[1] >= 0:
                    _, f, k = best
                    feature[node], cut[node] = f, self.cuts[f][k]
                    at[own] = np.where(binned[own, f] <= k, 2 * node + 1, 2 * node + 2)
            tree = (feature, cut, self.rate * value)
            self.trees.append(tree)
            margin += self._leaves(tree, x)
        return self

    def _leaves(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
        return value[at]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((self._leaves(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing step fit, by pooling adjacent violators; equal x are pooled first."""
    xs, inverse = np.unique(x, return_inverse=True)
    weight, total = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for v, w, t in zip(xs, weight, total, strict=True):
        blocks.append([t, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, w2, _, last = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += w2
            blocks[-1][3] = last
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    level = np.array([(b[0] + 0.5 * 0.01) / (b[1] + 0.01) for b in blocks for _ in range(2)])
    return at, np.clip(level, 0.0, 1.0)


class Model:
    """Learned lexicon, trees and calibration; constant if training had no two classes."""

    def __init__(self, learned: Sequence[str] = (), constant: float = 0.0) -> None:
        self.learned, self.constant, self.trees = frozenset(learned), constant, None

    def fit(self, x: np.ndarray, y: np.ndarray, folds: int = 3) -> Model:
        self.constant = float(y.mean()) if len(y) else 0.0
        if len(y) < 30 or len(np.unique(y)) < 2:
            return self
        out = np.zeros(len(y))
        fold = np.arange(len(y)) % folds
        for k in range(folds):
            if len(np.unique(y[fold != k])) < 2:
                return self
            out[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margins(x[fold == k])
        self.trees = Trees().fit(x, y)
        self.at, self.level = isotonic(out, y)
        return self

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if self.trees is None:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.learned) for t in texts])
        return np.clip(np.interp(self.trees.margins(x), self.at, self.level), 0.0, 1.0)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text and y of a sample of the training rows; max_rows bounds its expected size."""
    rows = labels.where(F.col("toxic").isin(0, 1) & (crc_bucket(F.col("doc_id"), 5) != 0)).select("doc_id", F.col("toxic").cast("int").alias("y"))
    n = rows.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < F.lit(min(1.0, max_rows / max(1, n))))
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most about max_rows rows


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, lexicon_size: int = 60) -> Model:
    from vellumite.llm.common import written

    sample = written(labelled(docs, labels, max_rows).repartition(12), "toxicity_sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                for w in {w.strip(_EDGE) for w in (text or "").lower().split()}:
                    if 2 < len(w) < 25:
                        seen.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
                ["word", "clean", "toxic"],
            )

    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Model(constant=1.0 if totals.get(1) else 0.0)
    df = map_arrow(sample, words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lean = F.log((F.col("toxic") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1.0))
    df = df.where(F.col("toxic") >= max(4, 3 * totals[1] // 100)).withColumn("lean", lean).where("lean > 1.5")
    learned = [r["word"] for r in df.orderBy(F.desc(F.col("lean") * F.sqrt("toxic")), "word").limit(lexicon_size).collect()]
    found = frozenset(learned)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t, found) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sorted(map_arrow(sample, vectors, "doc_id long, y int, x array<double>").collect(), key=lambda r: (r["doc_id"], r["y"], r["x"]))
    return Model(learned).fit(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
