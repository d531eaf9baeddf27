"""Tables on pages: their grids, cells out of text fragments, and aligned words as Markdown tables.

Boxes have x0, y0, x1, y1. Pages without decorations have no grid; blocks without a box are in none. Everything is
grouped by page; only running positions of columns and rows are folded, over the words of one block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T

_CORNERS = ("x0", "y0", "x1", "y1")
#: Fills of the cells of shaded tables.
CELL_FILLS = ("#d1d2d4", "#000000")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_grid_line() -> Column:
    long = (F.abs(F.col("x1") - F.col("x0")) >= 8.0) | (F.abs(F.col("y1") - F.col("y0")) >= 8.0)
    return (F.col("kind") == "line") & (F.lower(T.some(F.col("stroke"))) == "#000000") & long


def is_grid_cell() -> Column:
    sized = (F.col("x1") - F.col("x0") >= 20.0) & (F.col("y1") - F.col("y0")).between(8.0, 32.0)
    return (F.col("kind") == "rect") & F.lower(T.some(F.col("fill"))).isin(*CELL_FILLS) & sized


def _hull(keep: Column, *more: Column) -> list[Column]:
    return [(F.min if c[1] == "0" else F.max)(F.when(keep, F.col(c))).alias(f"g{c}") for c in _CORNERS]


def grid_bounds(decorations: DataFrame, page: str) -> DataFrame:
    """page, gx0 to gy1 of tables made of at least 28 unpainted bands, with the black lines around them.

    decorations: page, page_width, page_height, kind, n_commands, only_lines, stroke, fill and a box. The bands have 24
    path commands, all of them lines; together they are half a page wide at least, and from 20 points to half a page high.
    """
    bare = (F.col("kind") == "line") & (F.col("n_commands") >= 24) & (T.some(F.col("stroke")) == "") & (T.some(F.col("fill")) == "") & F.col("only_lines")
    bands = decorations.groupBy(page).agg(F.count_if(bare).alias("n"), F.max("page_width").alias("w"), F.max("page_height").alias("h"), *_hull(bare))
    bands = bands.where((F.col("n") >= 28) & (F.col("gx1") - F.col("gx0") >= F.col("w") * 0.50) & (F.col("gy1") - F.col("gy0")).between(F.lit(20.0), F.col("h") * 0.50))
    near = (F.col("x1") >= F.col("gx0") - 4) & (F.col("x0") <= F.col("gx1") + 4) & (F.col("y0") <= F.col("gy1") + 40) & (F.col("y1") >= F.col("gy0") - 4)
    lines = decorations.where(is_grid_line()).select(page, *_CORNERS).join(bands.select(page, "gx0", "gy0", "gx1", "gy1"), page).where(near)
    edge = lines.groupBy(page).agg(F.min("x0").alias("lx0"), F.max("x1").alias("lx1"), F.max("y1").alias("ly1"))
    df = bands.join(edge, page, "left")
    return df.select(page, F.least("gx0", "lx0").alias("gx0"), "gy0", F.greatest("gx1", "lx1").alias("gx1"), F.greatest("gy1", "ly1").alias("gy1"))


def in_grid(regions: DataFrame, decorations: DataFrame, page: str, tolerance: float = 4.0) -> DataFrame:
    """page, id, inside: is the middle of a region in the grid of its page: that of the bands, else of 80 and more black lines, else of six and more shaded cells?"""
    banded = grid_bounds(decorations, page).withColumn("banded", F.lit(True))
    kinds = []
    for name, keep in (("l", is_grid_line()), ("c", is_grid_cell())):
        kinds += [F.count_if(keep).alias(f"{name}n"), F.struct(*_hull(keep)).alias(name)]
    found = decorations.groupBy(page).agg(*kinds).join(banded, page, "left")
    own = F.struct("gx0", "gy0", "gx1", "gy1")
    grid = F.when(F.col("banded"), own).when(F.col("ln") >= 80, F.col("l")).when(F.col("cn") >= 6, F.col("c"))
    df = regions.select(page, "id", *_CORNERS).join(found.select(page, grid.alias("g")), page, "left")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = x.between(F.col("g.gx0") - tolerance, F.col("g.gx1") + tolerance) & y.between(F.col("g.gy0") - tolerance, F.col("g.gy1") + tolerance)
    return df.select(page, "id", F.coalesce(inside, F.lit(False)).alias("inside"))


def assembled_cells(blocks: DataFrame, page: str) -> DataFrame:
    """Blocks (page, pos, region, role, text, box) with the fragments of table cells put together: page, place, kind, region, col, n, text, box.

    In each stretch of table blocks the regions are lines. The first line with the most blocks gives the columns; a
    block belongs to the one whose middle is nearest (the first of equally near ones). A line with a block in the first
    column begins a row, other lines go on in the open one; a line of one block of half the table's width stands by
    itself and closes the row. Kinds: plain (no table, a single column, or before the columns are known), wide, cell, and
    error for a line that goes on where no row is open.
    """
    table = F.coalesce(F.col("role") == "table", F.lit(False))
    down = W.partitionBy(page).orderBy("pos")
    df = blocks.select(page, "pos", "region", "text", *_CORNERS, table.alias("table"))
    df = df.withColumn("part", F.sum((~F.col("table").eqNullSafe(F.lag("table").over(down))).cast("int")).over(down))
    line, part = W.partitionBy(page, "part", "region"), W.partitionBy(page, "part")
    df = df.withColumn("first", F.min("pos").over(line)).withColumn("size", F.count("*").over(line)).withColumn("most", F.max("size").over(part))
    df = df.withColumn("anchor", F.min(F.when(F.col("size") == F.col("most"), F.col("first"))).over(part))
    df = df.withColumn("cells", F.col("table") & (F.col("most") >= 2) & (F.col("first") >= F.col("anchor")))
    middle = (F.col("x0") + F.col("x1")) / 2
    heads = df.where(F.col("cells") & (F.col("first") == F.col("anchor"))).groupBy(page, "part").agg(F.sort_array(F.collect_list(F.struct("x0", "pos", middle.alias("c")))).alias("heads"), F.min("x0").alias("tx0"), F.max("x1").alias("tx1"))
    df = df.join(heads, [page, "part"], "left")
    away = F.transform("heads", lambda h, i: F.struct(F.abs(h["c"] - middle).alias("d"), i.alias("i")))
    df = df.withColumn("col", F.when(F.col("cells"), F.array_min(away)["i"])).withColumn("wide", F.col("cells") & (F.col("size") == 1) & (F.col("x1") - F.col("x0") >= (F.col("tx1") - F.col("tx0")) * 0.5))
    df = df.withColumn("starts", F.coalesce(F.bool_or(F.col("col") == 0).over(line), F.lit(False)) & ~F.col("wide"))
    lines = df.where("cells").groupBy(page, "part", "first").agg(F.first("wide").alias("w"), F.first("starts").alias("s"))
    rows = W.partitionBy(page, "part").orderBy("first")
    lines = lines.withColumn("row", F.sum((F.col("w") | F.col("s")).cast("int")).over(rows)).withColumn("closed", F.first("w").over(W.partitionBy(page, "part", "row").orderBy("first")))
    df = df.join(lines.select(page, "part", "first", "row", "closed"), [page, "part", "first"], "left")
    lone = F.col("cells") & ~F.col("wide") & F.coalesce(F.col("closed"), F.lit(True))
    kind = F.when(~F.col("cells"), "plain").when(F.col("wide"), "wide").when(lone, "error").otherwise("cell")
    df = df.withColumn("kind", kind).withColumn("cell", F.col("kind") == "cell")
    # Lines before the columns are known keep the order of their regions; so do the blocks of a line, from the left.
    in_line = F.when(F.col("table") & (F.col("most") >= 2), F.struct(F.col("first").alias("a"), F.col("x0").alias("b"), F.col("pos").alias("c"))).otherwise(F.struct(F.col("pos").alias("a"), F.lit(0.0).alias("b"), F.col("pos").alias("c")))
    key = F.when(F.col("cell"), F.struct(F.col("row").cast("bigint").alias("r"), F.col("col").cast("bigint").alias("k"))).otherwise(F.struct(F.lit(-1).cast("bigint").alias("r"), F.col("pos").cast("bigint").alias("k")))
    shown = F.filter(F.transform(F.sort_array(F.collect_list(F.struct(in_line.alias("o"), F.col("text")))), lambda x: T.stripped(T.some(x["text"]))), lambda x: x != "")
    out = df.groupBy(page, "part", "kind", key.alias("key")).agg(
        F.min(in_line).alias("o"), F.min_by("region", in_line).alias("region"), F.min("row").alias("row"), F.min("col").alias("col"), F.count("*").alias("n"),
        F.when(F.count("*") > 1, F.array_join(shown, " ")).otherwise(F.first("text")).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    of_row = W.partitionBy(page, "part", "row")
    top = F.when(F.col("kind") == "cell", F.min("o").over(W.partitionBy(page, "part", "kind", "row"))).otherwise(F.col("o"))
    out = out.withColumn("top", top).withColumn("region", F.when(F.col("kind") == "cell", F.min_by("region", "o").over(of_row)).otherwise(F.col("region")))
    place = F.row_number().over(W.partitionBy(page).orderBy("part", "top", F.coalesce("col", F.lit(-1)), "o")) - 1
    return out.select(page, place.alias("place"), "kind", "region", F.when(F.col("kind") == "cell", F.col("col")).alias("col"), "n", "text", *_CORNERS)


def _averaged(values: Column, far: float) -> Column:
    """Positions of columns: each next value within `far` of the last position moves it halfway, others open a new one."""
    none = F.array().cast("array<double>")
    last = lambda a: F.element_at(a, -1)
    near = lambda a, x: F.when(F.size(a) == 0, F.lit(False)).otherwise(F.abs(x - last(a)) <= far)
    moved = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array((last(a) + x) / 2))
    return F.aggregate(values, none, lambda a, x: F.when(near(a, x), moved(a, x)).otherwise(F.array_append(a, x)))


def _opened(values: Column, far: float) -> Column:
    """First values of rows: one over `far` below the first of the open row opens the next."""
    none = F.array().cast("array<double>")
    return F.aggregate(values, none, lambda a, x: F.when(F.when(F.size(a) == 0, F.lit(True)).otherwise(x - F.element_at(a, -1) > far), F.array_append(a, x)).otherwise(a))


def aligned_tables(words: DataFrame, key: str) -> DataFrame:
    """key, title, n_rows, n_columns, markdown of blocks of aligned words (key, line_no, word_no, text, x, y).

    Lines of rules only are left out, the first line that begins with >> is the title. Columns are 34 points apart, rows
    14. Blocks of fewer than four words, two columns or two rows are no tables and have no row here.
    """
    order = F.struct("x", "word_no")
    shown = lambda col: F.array_join(F.transform(F.sort_array(F.collect_list(col)), lambda x: x["text"]), " ")
    lines = words.groupBy(key, "line_no").agg(T.stripped(shown(F.struct(order.alias("o"), F.col("text")))).alias("line"))
    lines = lines.where(~F.col("line").rlike("^[_+\\-\\s|]+$") & (F.col("line") != ""))
    named = lines.where(F.col("line").startswith(">>")).groupBy(key).agg(F.min_by("line", "line_no").alias("title"), F.min("line_no").alias("title_line"))
    lines = lines.join(named, key, "left").where(F.col("title_line").isNull() | (F.col("line_no") != F.col("title_line")))
    w = words.join(lines.select(key, "line_no", "title"), [key, "line_no"])
    number = lambda c: F.col(c).cast("double")
    grid = w.groupBy(key).agg(F.count("*").alias("n"), _averaged(F.sort_array(F.collect_list(number("x"))), 34.0).alias("columns"), _opened(F.sort_array(F.collect_list(number("y"))), 14.0).alias("tops")).where((F.col("n") >= 4) & (F.size("columns") >= 2))
    w = w.join(grid, key)
    row = F.size(F.filter("tops", lambda t: t <= number("y")))
    col = F.array_min(F.transform("columns", lambda c, i: F.struct(F.abs(c - number("x")).alias("d"), i.alias("i"))))["i"]
    clean = T.stripped(F.regexp_replace(F.col("text"), "^[| ]+|[| ]+$", ""))
    w = w.select(key, "title", F.size("columns").alias("n_columns"), row.alias("row"), col.alias("col"), F.struct(F.struct("x", "y", "line_no", "word_no").alias("o"), clean.alias("text")).alias("t")).where(F.col("t.text") != "")
    cells = w.groupBy(key, "title", "n_columns", "row", "col").agg(shown(F.col("t")).alias("cell"))
    rows = cells.groupBy(key, "title", "n_columns", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("m"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda i: F.coalesce(F.col("m")[i], F.lit(""))), " | "), F.lit(" |"))
    made = rows.groupBy(key, "title", "n_columns").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", line.alias("t")))), lambda x: x["t"]).alias("r")).where(F.size("r") >= 2)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n_columns")), " | "), F.lit(" |"))
    text = F.concat_ws("\n", F.get("r", F.lit(0)), rule, F.array_join(F.slice("r", 2, F.size("r")), "\n"))
    return made.select(key, "title", F.size("r").alias("n_rows"), "n_columns", F.concat(F.coalesce(F.concat("title", F.lit("\n\n")), F.lit("")), text).alias("markdown"))


def aligned_grids(words: DataFrame, key: str) -> DataFrame:
    """key, stable, compact, grid: do lines of three and more words with two wide gaps share three columns, and are two of them short?

    words: key, line_no, word_no, text, x, x1. A word belongs to the first column within 18 points, which it moves halfway.
    """
    w = W.partitionBy(key, "line_no").orderBy("x", "word_no")
    df = words.withColumn("_gap", (F.col("x") - F.lag("x1").over(w) >= 24).cast("int"))
    length = F.length("text")
    lines = df.groupBy(key, "line_no").agg(F.count("*").alias("n"), F.sum("_gap").alias("gaps"), (F.sum(length) + F.count("*") - 1).alias("long"), F.max(length).alias("widest"), F.sort_array(F.collect_list(F.struct("x", "word_no"))).alias("i"))
    lines = lines.where((F.col("n") >= 3) & (F.col("gaps") >= 2))
    item = F.struct("line_no", F.transform("i", lambda x: x["x"].cast("double")).alias("x"))
    rows = lines.groupBy(key).agg(F.count("*").alias("rows"), F.count_if((F.col("long") <= 120) & (F.col("widest") <= 48)).alias("compact"), F.sort_array(F.collect_list(item)).alias("lines")).where("rows >= 2")
    flat = F.flatten(F.transform("lines", lambda r, i: F.transform(r["x"], lambda x: F.struct(i.alias("row"), x.alias("x")))))
    none = F.array().cast("array<struct<c:double,row:int,hits:int>>")

    def fold(a: Column, w: Column) -> Column:
        hit = F.array_min(F.filter(F.transform(a, lambda k, i: F.when(F.abs(w["x"] - k["c"]) <= 18, i)), lambda i: i.isNotNull()))
        same = lambda k: F.struct(((k["c"] + w["x"]) / 2).alias("c"), w["row"].alias("row"), (k["hits"] + (k["row"] != w["row"]).cast("int")).alias("hits"))
        return _let(hit, lambda h: F.when(h.isNull(), F.array_append(a, F.struct(w["x"].alias("c"), w["row"].alias("row"), F.lit(1).alias("hits")))).otherwise(F.transform(a, lambda k, i: F.when(i == h, same(k)).otherwise(k))))

    stable = F.size(F.filter(F.aggregate(flat, none, fold), lambda k: k["hits"] >= 2))
    df = rows.select(key, stable.alias("stable"), "compact")
    return df.select(key, "stable", "compact", ((F.col("stable") >= 3) & (F.col("compact") >= 2)).alias("grid"))
