"""Blocks of a page that belong to cards, in four passes, each over what the passes before it left.

Blocks have page, id, x0, y0, x1, y1, page_width, page_height, text, n_lines, is_card, has_label, is_monospace, is_table,
and is_other_font (none of its fonts is a body font). A page is folded in one row; blocks without a box are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import blocks as B
from vellumite.functions import text as T
from vellumite.stages import Rounds

#: Labels and abilities of characters.
STAT_LABELS = ("General Abilities", "Abilities", "Hypergeometry", "Hit Threshold", "Alertness Modifier", "Stealth Modifier", "Attack", "Armor", "Stability Loss", "Xin Energy")
STAT_NUMBERS = ("Athletics", "Fighting", "Health", "Melee Weapons", "Unarmed Combat", "Firearms", "Drive", "Alertness Modifier", "Stealth Modifier")
_CORNERS = ("x0", "y0", "x1", "y1")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stat_labels(c: Column) -> Column:
    """How many lines begin with a label and a colon."""
    return F.regexp_count(T.some(c), F.lit(f"(?im)^\\s*(?:{'|'.join(STAT_LABELS)})\\s*:"))


def stat_numbers(c: Column) -> Column:
    """How many abilities stand before a number."""
    return F.regexp_count(T.some(c), F.lit(f"(?i)\\b(?:{'|'.join(STAT_NUMBERS)})\\s*[+-]?\\d+\\b"))


def is_stat_text(c: Column) -> Column:
    """A character's data: attributes with numbers as in a stat block, two labels, or a label and two abilities."""
    return B.is_stat_block(c) | (stat_labels(c) >= 2) | ((stat_labels(c) >= 1) & (stat_numbers(c) >= 2))


def is_stat_title(text: Column, n_lines: Column, size: Column, median: Column) -> Column:
    """A name above character's data: one or two lines, 64 characters at most, no sentence, in capitals or a tenth larger than the text."""
    s = T.stripped(F.regexp_replace(T.stripped(T.some(text)), "^#{1,6}\\s*", ""))
    caps = (s == F.upper(s)) & s.rlike("[A-Z]")
    return (s != "") & (F.length(s) <= 64) & (n_lines <= 2) & ~s.rlike("[.!?。！？]$") & (caps | (size >= median * 1.10))


def _shared(a: Column, b: Column) -> Column:
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])


def _narrow(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["x1"] - a["x0"], b["x1"] - b["x0"]), F.lit(1.0))


def _middle(a: Column) -> Column:
    return (a["x0"] + a["x1"]) / 2


def _one_column(a: Column, b: Column, width: Column) -> Column:
    """Do two boxes overlap sideways, or lie near each other in one half of the page?"""
    near = ((_middle(a) < width / 2) == (_middle(b) < width / 2)) & (F.abs(_middle(a) - _middle(b)) <= width * 0.22)
    return (_shared(a, b) / _narrow(a, b) >= 0.20) | near


def banded(blocks: DataFrame, page: str) -> DataFrame:
    """page, id, band (from 0): blocks from the top down, each in the first band whose lower edge is near its top and that it overlaps by 0.35.

    A band's box grows with its blocks, so the choice depends on the choices before: a fold.
    """
    item = F.struct("y0", "x0", "id", "y1", "x1", (F.col("page_height") * 0.08).alias("far"))
    box = F.struct(*_CORNERS)
    kind = f"array<struct<x0:double,y0:double,x1:double,y1:double,ids:array<{blocks.schema['id'].dataType.simpleString()}>>>"

    def fold(bands: Column, b: Column) -> Column:
        fits = lambda g: (F.abs(b["y0"] - g["y1"]) <= b["far"]) & (_shared(b, g) / _narrow(b, g) >= 0.35)
        first = F.array_min(F.filter(F.transform(bands, lambda g, i: F.when(fits(g), i)), lambda i: i.isNotNull()))
        grown = lambda g: F.struct(F.least(g["x0"], b["x0"]).alias("x0"), F.least(g["y0"], b["y0"]).alias("y0"), F.greatest(g["x1"], b["x1"]).alias("x1"), F.greatest(g["y1"], b["y1"]).alias("y1"), F.array_append(g["ids"], b["id"]).alias("ids"))
        fresh = F.struct(*(b[c].alias(c) for c in _CORNERS), F.array(b["id"]).alias("ids"))
        return _let(first, lambda k: F.when(k.isNull(), F.array_append(bands, fresh)).otherwise(F.transform(bands, lambda g, i: F.when(i == k, grown(g)).otherwise(g))))

    df = blocks.dropna(subset=list(_CORNERS)).select(page, "id", "page_height", *(F.col(c).cast("double").alias(c) for c in _CORNERS))
    pages = df.groupBy(page).agg(F.sort_array(F.collect_list(item)).alias("i"))
    bands = pages.select(page, F.posexplode(F.aggregate("i", F.array().cast(kind), fold)).alias("band", "g"))
    return bands.select(page, "band", F.explode("g.ids").alias("id")).select(page, "id", "band")


def stat_groups(blocks: DataFrame, page: str) -> DataFrame:
    """page, id, grp (from 0): characters' data with what stands above and below them in their column.

    blocks also have is_stat (a label or ability with number), is_stat_title and goes_on (may follow below). From the
    top down each block with data that is in no group yet gathers the blocks of its column up to the first gap of
    over 0.045 page heights or a block that does not fit; the group counts if its text is a character's data.
    """
    item = F.struct("y0", "x0", "id", "y1", "x1", "text", "is_stat", (F.col("is_stat") | F.col("is_stat_title")).alias("leads"), (F.col("is_stat") | F.col("goes_on")).alias("follows"))
    df = blocks.dropna(subset=list(_CORNERS)).select(page, "id", T.some(F.col("text")).alias("text"), "is_stat", "is_stat_title", "goes_on", "page_width", "page_height", *(F.col(c).cast("double").alias(c) for c in _CORNERS))
    pages = df.groupBy(page).agg(F.sort_array(F.collect_list(item)).alias("all"), F.max("page_width").alias("w"), F.max("page_height").alias("h"))
    ids = f"array<{blocks.schema['id'].dataType.simpleString()}>"
    begin = F.struct(F.array().cast(ids).alias("taken"), F.array().cast(f"array<{ids}>").alias("groups"))
    last = lambda a: F.coalesce(F.array_max(a), F.lit(-1))

    def gathered(start: Column, column: Column) -> Column:
        at = F.array_min(F.filter(F.transform(column, lambda b, i: F.when(b["id"] == start["id"], i)), lambda i: i.isNotNull()))
        near = lambda above, below: below["y0"] - above["y1"] <= F.col("h") * 0.045
        get = lambda i: F.get(column, i)
        up = lambda k: last(F.filter(F.transform(column, lambda b, i: F.when((i < k) & ~(b["leads"] & near(b, get(i + 1))), i)), lambda i: i.isNotNull())) + 1
        stops = lambda k: F.filter(F.transform(column, lambda b, i: F.when((i > k) & ~(b["follows"] & near(get(i - 1), b)), i)), lambda i: i.isNotNull())
        down = lambda k: F.coalesce(F.array_min(stops(k)), F.size(column))
        return _let(at, lambda k: _let(F.struct(up(k).alias("a"), down(k).alias("b")), lambda e: F.slice(column, e["a"] + 1, e["b"] - e["a"])))

    def fold(s: Column, start: Column) -> Column:
        column = F.filter("all", lambda b: ~F.array_contains(s["taken"], b["id"]) & _one_column(start, b, F.col("w")))
        group = lambda g: F.transform(g, lambda b: b["id"])
        stat = lambda g: _let(F.array_join(F.transform(g, lambda b: b["text"]), "\n"), is_stat_text)
        grown = lambda g: F.when(stat(g), F.struct(F.concat(s["taken"], group(g)).alias("taken"), F.array_append(s["groups"], group(g)).alias("groups"))).otherwise(s)
        return F.when(F.array_contains(s["taken"], start["id"]), s).otherwise(_let(column, lambda c: _let(gathered(start, c), grown)))

    found = pages.select(page, F.posexplode(F.aggregate(F.filter("all", lambda b: b["is_stat"]), begin, fold, lambda s: s["groups"])).alias("grp", "ids"))
    return found.select(page, F.explode("ids").alias("id"), "grp")


def sidebars(blocks: DataFrame, page: str) -> DataFrame:
    """page, id, grp: runs of blocks in other fonts than the body's that are a sidebar: four lines, 0.30 to 0.52 page widths, or six lines and 0.65.

    Blocks are taken by half of the page, wide ones and what stands beside them by themselves; a run ends at a gap of
    0.03 page heights or where the next block is in another column.
    """
    df = blocks.where(F.coalesce("is_other_font", F.lit(False)) & ~F.coalesce("is_table", F.lit(False)) & (F.col("n_lines") >= 1)).dropna(subset=list(_CORNERS))
    pw, ph, mid = F.col("page_width"), F.col("page_height"), (F.col("x0") + F.col("x1")) / 2
    across = (F.abs(mid - pw / 2) <= pw * 0.16) & (F.col("x0") <= pw * 0.42) & (F.col("x1") >= pw * 0.58)
    df = df.withColumn("full", (F.col("x1") - F.col("x0") > pw * 0.62) | across)
    others = df.where("full").select(page, F.col("id").alias("other"), F.col("y0").alias("oy0"), F.col("y1").alias("oy1"))
    level = (F.col("id") != F.col("other")) & (F.col("x0") >= pw * 0.12) & (F.col("x1") <= pw * 0.92) & ~((F.col("y1") < F.col("oy0") - ph * 0.03) | (F.col("oy1") < F.col("y0") - ph * 0.03))
    beside = df.where("NOT full").join(others, page).where(level).select(page, "id").distinct().withColumn("beside", F.lit(True))
    df = df.join(beside, [page, "id"], "left")
    side = F.when(F.col("full") | F.col("beside"), 2).otherwise(F.when(mid < pw / 2, 0).otherwise(1))
    df = df.withColumn("side", side).withColumn("box", F.struct(*_CORNERS))
    down = W.partitionBy(page, "side").orderBy("y0", "x0", "id")
    before = F.lag("box").over(down)
    df = df.withColumn("before", before)
    goes_on = F.coalesce((F.col("y0") - F.col("before.y1") < ph * 0.03) & _one_column(F.col("before"), F.col("box"), pw), F.lit(False))
    df = df.withColumn("grp", F.sum((~goes_on).cast("int")).over(down) * 3 + F.col("side"))
    runs = df.groupBy(page, "grp").agg(F.sum("n_lines").alias("lines"), (F.max("x1") - F.min("x0")).alias("w"), F.max("page_width").alias("pw"))
    fits = (F.col("lines") >= 4) & (F.col("w").between(F.col("pw") * 0.30, F.col("pw") * 0.52) | ((F.col("w") >= F.col("pw") * 0.65) & (F.col("lines") >= 6)))
    return df.join(runs.where(fits).select(page, "grp"), [page, "grp"]).select(page, "id", "grp")


def card_blocks(blocks: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """page, id, card_pass, card: blocks in framed regions, then card texts in bands, then characters' data, then sidebars; card is a number within its pass.

    regions: page and boxes that do not touch (see merging.card_regions). A region's blocks (within 8 points) need two
    lines or a label, and card text, a label or four monospace lines.
    """
    place = W.partitionBy(page).orderBy("y0", "x0", "x1", "y1")
    r = regions.select(page, (F.row_number().over(place) - 1).alias("region"), *(F.col(c).alias(f"r{c}") for c in _CORNERS))
    inside = (F.col("x0") >= F.col("rx0") - 8) & (F.col("y0") >= F.col("ry0") - 8) & (F.col("x1") <= F.col("rx1") + 8) & (F.col("y1") <= F.col("ry1") + 8)
    held = blocks.join(r, page).where(inside).groupBy(page, "id").agg(F.min("region").alias("card"))
    held = held.join(blocks.select(page, "id", "n_lines", "is_card", "has_label", "is_monospace"), [page, "id"])
    sums = held.groupBy(page, "card").agg(F.sum("n_lines").alias("n"), F.bool_or("has_label").alias("l"), F.bool_or("is_card").alias("c"), F.coalesce(F.sum(F.when(F.col("is_monospace"), F.col("n_lines"))), F.lit(0)).alias("m"))
    framed = held.join(sums.where(((F.col("n") >= 2) | F.col("l")) & (F.col("c") | F.col("l") | (F.col("m") >= 4))), [page, "card"]).select(page, "id", "card")
    rounds = Rounds(blocks.sparkSession, "card_blocks")
    taken = lambda df, found, number: df.join(found.select(page, "id", F.col(found.columns[-1]).cast("int").alias("_c")), [page, "id"], "left").select(
        *(c for c in df.columns if c not in ("card_pass", "card")), F.coalesce("card_pass", F.when(F.col("_c").isNotNull(), number)).alias("card_pass"), F.coalesce("card", "_c").alias("card")
    )
    df = blocks.withColumn("card_pass", F.lit(None).cast("int")).withColumn("card", F.lit(None).cast("int"))
    passes = (lambda _: framed, lambda left: banded(left.where("is_card"), page), lambda left: stat_groups(left, page), lambda left: sidebars(left, page))
    for number, found in enumerate(passes, 1):  # written, as each pass reads what the one before left twice
        df = rounds.step(taken(df, found(df.where("card_pass IS NULL")), number))
    return df.where("card_pass IS NOT NULL").select(page, "id", "card_pass", "card")
