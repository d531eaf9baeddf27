"""Periodic runs of words: LZ factors from a suffix automaton, Main's search at their borders, copies of the rest.

A run is a stretch of words with smallest period q that neither neighbour extends. Every word of a run of `exponent`
periods occurs at least `exponent` times in it, so a text is first cut into stretches of words that occur so often
in them; stretches too short for a run go, and the others are searched one by one:

1. a suffix automaton over the words gives the longest factors that start earlier too (Lempel-Ziv),
2. at each border between factors the runs that touch it are found from longest common extensions (Main). A run that
   ends in a factor reaches less than twice the factor before and once this factor to the left, so that all windows
   together are linear in the text,
3. a run inside a factor, with the words around it, is a copy of an earlier one (Kolpakov and Kucherov).

Each text is handled whole by one task, the automaton lies in arrays (some 20 bytes a state), nothing is shuffled.
Defined results: a null text has no words; an empty text has no runs; repeated rows each get their own result; other
columns of the input are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.llm.common import map_arrow
from vellumite.tables import table

#: (first word, words, period)
Run = tuple[int, int, int]

#: How often stretches are cut again; cutting only saves work.
CUTS = 4


class Automaton:
    """Suffix automaton: link, longest length and first end of each state; most states have one edge, the others a dictionary."""

    def __init__(self, letters: Sequence[int]) -> None:
        self.link, self.size, self.first = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.letter, self.target, self.more = array("i", [-1]), array("i", [-1]), {}
        last = 0
        for at, c in enumerate(letters):
            last = self._longer(last, c, at)

    def _state(self, size: int, first: int, link: int, letter: int = -1, target: int = -1) -> int:
        self.size.append(size)
        self.first.append(first)
        self.link.append(link)
        self.letter.append(letter)
        self.target.append(target)
        return len(self.size) - 1

    def step(self, state: int, c: int) -> int:
        """The state after c, -1 if there is none."""
        if (edges := self.more.get(state)) is not None:
            return edges.get(c, -1)
        return self.target[state] if self.letter[state] == c else -1

    def _point(self, state: int, c: int, to: int) -> None:
        if (edges := self.more.get(state)) is not None:
            edges[c] = to
        elif self.letter[state] in (c, -1):
            self.letter[state], self.target[state] = c, to
        else:
            self.more[state] = {self.letter[state]: self.target[state], c: to}

    def _longer(self, last: int, c: int, at: int) -> int:
        new, p, to = self._state(at + 1, at, 0), last, -1
        while p >= 0 and (to := self.step(p, c)) < 0:
            self._point(p, c, new)
            p = self.link[p]
        if p < 0:
            return new
        if self.size[p] + 1 != self.size[to]:
            twin = self._state(self.size[p] + 1, self.first[to], self.link[to], self.letter[to], self.target[to])
            if to in self.more:
                self.more[twin] = dict(self.more[to])
            while p >= 0 and self.step(p, c) == to:
                self._point(p, c, twin)
                p = self.link[p]
            self.link[to] = twin
            to = twin
        self.link[new] = to
        return new


def factors(letters: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start or -1): each the longest that starts earlier too, overlaps allowed, or one new letter."""
    known, out, start, n = Automaton(letters), [], 0, len(letters)
    step, first = known.step, known.first
    while start < n:
        state, at = 0, start
        while at < n and (to := step(state, letters[at])) >= 0 and first[to] < at:
            state, at = to, at + 1
        out.append((start, at - start, first[state] - (at - start) + 1) if at > start else (start, 1, -1))
        start = max(at, start + 1)
    return out


def _prefixes(s: Sequence[int]) -> list[int]:
    """How long s and its suffix from each place on agree."""
    n = len(s)
    z = [0] * n
    a = b = 0
    for i in range(1, n):
        k = min(z[i - a], b - i) if i < b else 0
        if i + k >= b:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            a, b = i, i + k
        z[i] = k
    return z


def _touching(s: Sequence[int], border: int, left: int, right: int, least: int, exponent: int, found: dict[tuple[int, int], int]) -> None:
    """Runs that touch the border, reach at most `left` before it and end at most `right` behind it."""
    before, after = list(s[border - left : border]), list(s[border : border + right])
    reverse = before[::-1]
    forth = _prefixes([*after, -1, *before, *after])
    back = _prefixes([*reverse, -1, *after[::-1], *reverse])

    def offer(start: int, stop: int, period: int) -> None:
        if stop - start < max(least, exponent * period):
            return
        if start > 0 and s[start - 1] == s[start - 1 + period] or stop < len(s) and s[stop] == s[stop - period]:
            return
        found[start, stop] = min(period, found.get((start, stop), period))

    most = (left + right) // exponent
    for p in range(1, min(right, most) + 1):  # a period stands behind the border
        offer(border - back[left + 1 + right - p], border + p + (forth[p] if p < right else 0), p)
    for p in range(1, min(left, most) + 1):  # a period stands before it
        offer(border - p - (back[p] if p < left else 0), border + forth[right + 1 + left - p], p)


def runs_of(s: Sequence[int], least: int = 24, exponent: int = 3) -> list[Run]:
    """All runs of a sequence of non-negative numbers with at least `least` letters and `exponent` (2 or more) periods, by start and period."""
    pieces, n = factors(s), len(s)
    found: dict[tuple[int, int], int] = {}
    last = 0
    for start, length, _ in [*pieces, (n, 0, -1)]:
        left = min(start, 2 * last + length)
        if left + length >= least:
            _touching(s, start, left, length, least, exponent, found)
        last = length
    starting: dict[int, list[tuple[int, int]]] = {}
    for (start, stop), period in found.items():
        starting.setdefault(start, []).append((stop, period))
    for start, length, source in pieces:
        shift, stop = start - source, start + length
        if source < 0 or length < least + 2:
            continue
        for i in range(start + 1, stop - least):
            for e, period in starting.get(i - shift, ()):
                if e + shift < stop and (i, e + shift) not in found:
                    found[i, e + shift] = period
                    starting.setdefault(i, []).append((e + shift, period))
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def _stretches(words: list[bytes], least: int, exponent: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first word, words) of what can hold runs: stretches whose words occur `exponent` times in them, as far as CUTS rounds tell."""
    todo = [(0, words, CUTS)] if len(words) >= least else []
    while todo:
        at, part, rounds = todo.pop()
        counts = Counter(part)
        if not rounds or min(counts.values()) >= exponent:
            yield at, part
            continue
        often = {w for w, n in counts.items() if n >= exponent}
        begin = 0
        if often:
            marks = bytes(map(often.__contains__, part))
            while (begin := marks.find(b"\x01" * least, begin)) >= 0:
                stop = marks.find(b"\x00", begin)
                stop = len(part) if stop < 0 else stop
                todo.append((at + begin, part[begin:stop], rounds - 1))
                begin = stop


def text_runs(words: list[bytes], least: int = 24, exponent: int = 3) -> list[Run]:
    """All runs of a text's words."""
    out = []
    for at, part in _stretches(words, least, exponent):
        numbers: dict[bytes, int] = {}
        out += [(at + a, n, p) for a, n, p in runs_of([numbers.setdefault(w, len(numbers)) for w in part], least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run repeats after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    out, at = [], 0
    spans = sorted((a + p, a + n) for a, n, p in runs)
    for a, b in spans:
        out += words[at : max(at, a)]
        at = max(at, b)
    return b" ".join(out + words[at:])


def periodic_runs(docs: DataFrame, least: int = 24, exponent: int = 3) -> DataFrame:
    """One row per document: doc_id, runs (start, length and period in words, by start and period), collapsed (the text without repeated periods)."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, left = [], []
            for raw in b.column("raw").to_pylist():
                words = raw.split()  # the six white space characters of ASCII
                own = text_runs(words, least, exponent)
                runs.append([{"start": a, "length": n, "period": p} for a, n, p in own])
                left.append(collapsed(words, own))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, kind), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    raw = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(raw, run, f"doc_id {doc_id}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id as text) ends in 0, the words from one place on repeat with one period (a null id counts as the empty text)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " ")

    edited = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, edited).otherwise(F.col("text")).alias("text"))


#: The same in SQL: equal words of a text at a distance, neighbouring ones of one distance together.
ORACLE = r"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS edit FROM h),
e AS (SELECT doc_id, n, CASE WHEN edit THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= g % n THEN g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) ELSE i END]) ELSE w END AS w FROM g),
k AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM e),
q AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.w = b.w AND a.i < b.i WHERE (b.i - a.i) * 3 <= a.n),
s AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS s, i FROM q),
c AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, s HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM c GROUP BY ALL),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, (-length::DOUBLE / period, start, period)) AS b,
  sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS d FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
left_ AS (SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS d FROM k ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s AS start, b.l AS length, b.p AS period, (1000 * b.l // b.p)::BIGINT AS exponent_milli,
  coalesce(best.d, sha256('')) AS runs_sha256, coalesce(left_.d, sha256('')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN left_ USING (doc_id)"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = periodic_runs(planted(table(spark, sf_dir, "documents")))
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])  # noqa: E731  of equal ones the first stays
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda a, r: F.when(better(a, r), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    df = df.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("bigint")
    return df.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
