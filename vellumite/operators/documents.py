"""Folds over the lines of one document: marker chunks, headings that belong together, dictionaries without structure."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Markers that enclose a chunk.
ENCLOSING = ("CARD", "STAT_BLOCK", "IMAGE", "FULL_WIDTH_TITLE")
_OPEN = {f"[{m}]": f"[/{m}]" for m in ENCLOSING}
_HAN = re.compile(r"[一-鿿]")
_HEADING = re.compile(r"^(#{1,4})\s+(.+)$")


def _exploded(df: DataFrame, fn: Callable[[str], Sequence[tuple]], names: str, kinds: str) -> DataFrame:
    """id and a row for each tuple that fn makes of a text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = [(i, *r) for i, t in zip(pdf["id"], pdf["text"], strict=True) for r in fn(t or "")]
            yield pd.DataFrame(made, columns=["id", *names.split()], dtype=object)

    return df.select("id", "text").mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, {kinds}")


def chunked(text: str) -> list[tuple[int, str]]:
    """Structural chunks of a text: marked ones whole, the rest by blank lines. Marks that do not pair are an error."""
    out: list[str] = []
    loose: list[str] = []
    close, inside = "", []

    def settle() -> None:
        out.extend(p.strip() for p in re.split(r"\n\s*\n", "\n".join(loose)) if p.strip())
        loose.clear()

    for line in text.splitlines():
        mark = line.strip()
        if close:
            inside.append(line)
            if mark == close:
                out.append("\n".join([*inside[:-1], close]))
                close = ""
            elif mark in _OPEN or mark in _OPEN.values():
                raise ValueError(f"{close} expected, {mark} found")
        elif mark in _OPEN:
            settle()
            close, inside = _OPEN[mark], [mark]
        elif mark in _OPEN.values():
            raise ValueError(f"{mark} closes nothing")
        else:
            loose.append(line)
    if close:
        raise ValueError(f"{close} is missing")
    settle()
    return list(enumerate(out))


def chunks(df: DataFrame) -> DataFrame:
    """id, chunk, text, error: the chunks of each text; a text whose marks do not pair has one row with an error and no chunk."""

    def rows(text: str) -> list[tuple]:
        try:
            return [(*c, None) for c in chunked(text)]
        except ValueError as e:
            return [(None, None, str(e))]

    return _exploded(df, rows, "chunk text error", "chunk int, text string, error string")


def joined_headings(text: str) -> str:
    """Neighbouring headings of one level as one, unless the first ends a sentence."""
    out: list[str] = []
    for part in (p.strip() for p in re.split(r"\n\s*\n", text)):
        now, before = _HEADING.match(part), _HEADING.match(out[-1]) if out else None
        if now and before and now[1] == before[1] and before[2][-1] not in ".!?。！？；;":
            out[-1] = f"{before[1]} {before[2].strip()} {now[2].strip()}"
        elif part:
            out.append(part)
    return "\n\n".join(out)


def with_joined_headings(df: DataFrame) -> DataFrame:
    return _exploded(df, lambda t: [(joined_headings(t),)], "text", "text string")


def loose_pairs(text: str) -> list[tuple[str, str, str]]:
    """(target, term, problem) of lines where blocks with Chinese stand before the blocks that they translate.

    Lines of a block pair up in order; if the second has more, lines that go on the one before are joined first.
    """
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    out: list[tuple[str, str, str]] = []
    i = 0
    while i < len(lines):
        first = i
        while i < len(lines) and _HAN.search(lines[i]):
            i += 1
        second = i
        while i < len(lines) and not _HAN.search(lines[i]):
            i += 1
        left, right = lines[first:second], lines[second:i]
        if not left:
            out.extend(("", x, "no target") for x in right)
            continue
        if len(left) != len(right):
            whole: list[str] = []
            for x in right:
                goes_on = whole and (x[:1].islower() or x.startswith(("d'", "Inc")) or whole[-1].endswith((",", "-")))
                whole[len(whole) - bool(goes_on) :] = [f"{whole[-1]} {x}" if goes_on else x]
            right = whole
        problem = "" if len(left) == len(lines[second:i]) else "uneven block"
        out.extend((a, b, problem) for a, b in zip(left, right, strict=False))
        if not right:
            out.append((left[0], "", "no term"))
    return out


def loose_glossary(df: DataFrame) -> DataFrame:
    return _exploded(df, loose_pairs, "target term problem", "target string, term string, problem string")


def missing_emphasis(runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks (block_id, page, source, translation) whose runs (block_id, pos, text, bold, italic) mix styles that the translation does not show: page, block_id, absent."""
    seen = F.trim("text") != ""
    styles = runs.groupBy("block_id").agg(
        F.count_if(seen).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("joined"),
        (F.bool_or(F.when(seen, F.col("italic"))) & ~F.bool_and(F.when(seen, F.col("italic")))).alias("mixed_i"),
        (F.bool_or(F.when(seen, F.col("bold"))) & ~F.bool_and(F.when(seen, F.col("bold")))).alias("mixed_b"),
    )
    df = blocks.where("translation <> ''").join(styles.where("n >= 2"), "block_id").where("joined = source")
    absent = F.array(F.when(F.col("mixed_i") & ~F.contains("translation", F.lit("<em>")), F.lit("斜体")), F.when(F.col("mixed_b") & ~F.contains("translation", F.lit("<strong>")), F.lit("粗体")))
    return df.select("page", "block_id", F.array_join(absent, "、").alias("absent")).where("absent <> ''")
