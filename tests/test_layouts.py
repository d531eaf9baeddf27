"""Layout operators against plain versions: ties, nulls, empty tables, and cases that the queries do not reach."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from vellumite.operators import boxes, cards, collectors, identity, merging, reading, segmentation, tables

LINES = "region long, line_no long, x0 double, y0 double, x1 double, y1 double, text string, font_role string, role string, body_size double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Segmentation


def plain_baseline(lines):
    xs = [r[2] for r in lines if r[7] == "body" and r[2] is not None]
    if len(xs) < 3:
        return None
    tol = lines[0][9] * 0.8
    near = [sum(abs(x - y) < tol for y in xs) for x in xs]
    edge, n = xs[near.index(max(near))], max(near)
    left = [i for i, x in enumerate(xs) if x <= edge - tol]
    on = sum(i + 1 < len(xs) and xs[i + 1] > edge - tol for i in left)
    return edge if n * 2 > len(xs) and left and on * 2 > len(left) else None


def plain_segments(lines):
    base = plain_baseline(lines)
    body = [r[2] for r in lines if r[7] == "body" and r[2] is not None]
    edge = min(body or [r[2] for r in lines if r[2] is not None], default=None)
    out, current, step = [], [], lines[0][9] * 0.8
    for r in lines:
        if current:
            p = current[-1]
            indented = r[2] is not None and (r[2] <= base - step if base is not None else r[2] - edge >= step)
            advances = [b[3] - a[3] for a, b in zip(current, current[1:], strict=False) if b[3] > a[3]]
            usual = median(advances) if advances else max(lines[0][9] * 1.35, 1.0)
            if r[7] != p[7] or r[8] != p[8] or r[7] != "body" or indented or r[3] - p[3] > usual * 1.35:
                current = []
                out.append(None)
        current.append(r)
        out.append((r[0], r[1]))
    number, made = 1, []
    for x in out:
        if x is None:
            number += 1
        else:
            made.append((*x, number))
    return made


@pytest.fixture(scope="module")
def regions():
    rng = random.Random(1)
    out = []
    for region in range(60):
        y = 0.0
        for line in range(rng.randrange(1, 25)):
            y += rng.choice([12.0, 12.0, 12.5, 20.0, 0.0, -3.0])
            x = rng.choice([40.0, 40.0, 51.0, 48.0, 39.5, None])
            out.append((region, line, x, y, 200.0, y + 10, rng.choice(["a ", None, "b"]), rng.choice(["body"] * 6 + ["display", None]), rng.choice(["t"] * 6 + [None]), 10.0))
    return out


def test_baselines_and_segments(spark, regions):
    df = spark.createDataFrame(regions, LINES).repartition(3)
    by_region = {}
    for r in regions:
        by_region.setdefault(r[0], []).append(r)
    assert rows(segmentation.hanging_baselines(df, "region")) == sorted(((k, plain_baseline(v)) for k, v in by_region.items()), key=str)
    assert any(plain_baseline(v) is not None for v in by_region.values())
    want = [x for v in by_region.values() for x in plain_segments(v)]
    assert rows(segmentation.segmented(df, "region").select("region", "line_no", "segment")) == sorted(want, key=str)
    assert segmentation.paragraphs(df, "region").agg(F.sum("n_lines")).first()[0] == len(regions)
    assert segmentation.paragraphs(df.limit(0), "region").count() == 0


def test_hanging_indent_is_found(spark):
    lines = [(1, i, 40.0 if i % 3 == 0 else 52.0, 12.0 * i, 200.0, 12.0 * i + 9, f"l{i}", "body", "t", 10.0) for i in range(9)]
    df = spark.createDataFrame(lines, LINES)
    assert segmentation.hanging_baselines(df, "region").first().baseline == 52.0
    assert [r.n_lines for r in segmentation.paragraphs(df, "region").orderBy("segment").collect()] == [3, 3, 3]


# Boxes that touch


def plain_merge(found, tolerance):
    found = set(found)
    apart = lambda a, b: a[2] < b[0] - tolerance or b[2] < a[0] - tolerance or a[3] < b[1] - tolerance or b[3] < a[1] - tolerance
    while True:
        for a in found:
            b = next((b for b in found if b != a and not apart(a, b)), None)
            if b:
                found = (found - {a, b}) | {(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))}
                break
        else:
            return found


@pytest.mark.parametrize("tolerance", [0.0, 8.0, 30.0])
def test_merged_boxes(spark, tolerance):
    rng = random.Random(int(tolerance))
    data = [(p, *(lambda x, y: (x, y, x + rng.randrange(40), y + rng.randrange(40)))(rng.randrange(-50, 500), rng.randrange(700))) for p in range(6) for _ in range(40)]
    data += [(9, 12 * i, 0, 12 * i + 6, 5) for i in range(60)] + [(10, 5, 5, 6, 6)] * 4 + [(11, 0, 0, 10, 10), (11, 10 + int(tolerance), 10, 20, 20), (None, 1, 1, 2, 2)]
    df = spark.createDataFrame([(p, *map(float, b)) for p, *b in data] + [(12, None, 1.0, 2.0, 3.0)], "page long, x0 double, y0 double, x1 double, y1 double")
    got = merging.merged_boxes(df.where("page IS NOT NULL"), "page", tolerance, cell=50.0)
    want = {(p, *b) for p in {d[0] for d in data} - {None} for b in plain_merge([tuple(map(float, d[1:])) for d in data if d[0] == p], tolerance)}
    assert {tuple(r)[:5] for r in got.collect()} == want
    assert got.agg(F.sum("n")).first()[0] == len(data) - 1
    assert merging.merged_boxes(df.limit(0), "page").count() == 0


# Identity


def test_traces(spark):
    at = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    kind = "page int, {} int, font string, flags int, origins array<struct<x:double,y:double>>"
    spans = spark.createDataFrame([(0, 1, "A", 5, at((1, 1), (2, 2))), (0, 2, "A", 4, at((1.0004, 1))), (0, 3, "B", 4, at((9, 9))), (0, 4, "A", 4, []), (0, 5, "A", 4, None), (1, 6, "A", 4, at((1, 1))), (0, 7, None, None, at((3, 3)))], kind.format("span"))
    traces = spark.createDataFrame([(0, 1, "A", 4, at((1, 1), (2, 2), (2, 2))), (0, 2, "A", 6, at((1, 1))), (0, 3, "B", 4, at((8, 9))), (0, 4, "A", 5, at((2, 2))), (0, 5, None, None, at((3, 3)))], kind.format("trace"))
    got = rows(identity.trace_matches(spans, traces, "page"))
    none, empty = "no matching trace", "no glyph origins"
    assert got == sorted([(0, 1, 1, 2, None), (0, 1, 4, 1, None), (0, 2, 1, 1, None), (0, 3, None, 0, none), (0, 4, None, 0, empty), (0, 5, None, 0, empty), (1, 6, None, 0, none), (0, 7, 5, 1, None)], key=str)
    assert identity.trace_matches(spans.limit(0), traces, "page").count() == 0


def test_images(spark):
    b = spark.createDataFrame(
        [(0, 1, [1.0], 4, 4, b"d", b"s"), (0, 2, [1.0], 4, 4, b"d", None), (0, 3, [2.0], 4, 4, b"d", None), (0, 4, None, None, 4, b"e", b"q"), (0, 5, [3.0], 4, 4, b"d", b"s")],
        "page int, block int, transform array<double>, width int, height int, digest binary, source_digest binary",
    )
    i = spark.createDataFrame(
        [(0, 1, [1.0], 4, 4, 7, b"x", "m"), (0, 2, [1.0], 4, 4, 8, b"d", "m"), (0, 3, [1.0], 4, 4, 8, b"d", "m"), (0, 4, None, None, 4, 7, b"e", "m"), (0, 5, None, None, 4, 7, b"e", "other"), (0, 6, [3.0], 4, 4, 9, b"d", None)],
        "page int, info int, transform array<double>, width int, height int, xref int, digest binary, m string",
    )
    refs = spark.createDataFrame([(0, b"s", 7), (0, b"s", 7)], "page int, source_digest binary, xref int")
    got = rows(identity.image_matches(b, i, refs, "page", ["m"]))
    assert got == sorted([(0, 1, 1, None), (0, 2, 2, None), (0, 3, None, "no record"), (0, 4, None, "conflicting records"), (0, 5, None, "no record")], key=str)
    assert identity.image_matches(b.limit(0), i, refs, "page", ["m"]).count() == 0


def test_painted_style(spark):
    s = spark.createDataFrame(
        [(1, 1, "ab", 10.0, 2, 0), (1, 2, " abcdef ", 20.0, 16, 255), (1, 3, "x", None, None, 0xFF0000), (2, 1, "  ", 9.0, 16, 5), (3, 1, None, 9.0, 16, 5), (4, 1, "a", 8.0, 0, None)],
        "line int, span_no int, text string, font_size double, flags int, color int",
    )
    assert rows(boxes.painted_style(s, "line")) == [(1, 16.78, True, True, "#0000ff"), (2, 11.0, False, False, "#000000"), (3, 11.0, False, False, "#000000"), (4, 8.0, False, False, "#000000")]


# Reading order

BLOCKS = "page int, id int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, text string, n_lines int, font_size double, median_size double, is_text boolean"


def block(page, i, x0, y0, x1, text="Text.", size=10.0, n=3, is_text=True):
    return (page, i, float(x0), float(y0), float(x1), float(y0) + 10, 600.0, 800.0, text, n, size, 10.0, is_text)


def order(spark, data):
    got = reading.reading_order(spark.createDataFrame(data, BLOCKS), "page")
    out = {}
    for r in got.orderBy("page", "place").collect():
        out.setdefault(r.page, []).append(r.id)
    return out


def test_right_column_goes_on_before_a_heading(spark):
    data = [
        block(0, 1, 20, 300, 280, "the sentence breaks"), block(0, 2, 20, 400, 280, "HEADING", 14.0), block(0, 3, 20, 450, 280), block(0, 4, 320, 300, 580, "off here"), block(0, 5, 320, 390, 580, "and here."),
        block(0, 6, 320, 395, 580, "New start"), block(0, 7, 320, 399, 580, "small again"), block(0, 8, 20, 250, 580, "wide one"), block(0, 9, 320, 500, 580, "x", is_text=False),
        # the heading is as high as the block: it is not above; a sentence that ends lets nothing in
        block(1, 1, 20, 300, 280, "breaks"), block(1, 2, 20, 400, 280, "HEADING", 14.0), block(1, 3, 320, 400, 580, "level"), block(2, 1, 20, 300, 280, "Ends."), block(2, 2, 20, 400, 280, "HEADING", 14.0), block(2, 3, 320, 310, 580, "small"),
    ]
    assert order(spark, data) == {0: [8, 1, 4, 5, 2, 3, 6, 7], 1: [1, 2, 3], 2: [1, 2, 3]}


def test_three_columns_and_one(spark):
    three = [block(0, 10 * c + k, 20 + 200 * c, 300 + 10 * k, 170 + 200 * c) for k in range(3) for c in range(3)]
    data = [*three, block(0, 99, 20, 200, 580), block(0, 98, 20, 600, 170, is_text=False), block(1, 2, 20, 10, 580), block(1, 1, 20, 10, 580), block(1, 3, 0, 5, 10, is_text=False)]
    assert order(spark, data) == {0: [99, 0, 1, 2, 10, 11, 12, 20, 21, 22, 98], 1: [3, 1, 2]}
    assert order(spark, data[:0]) == {}


def test_stitched(spark):
    items = [
        (0, 1, "# BIG", True, "normal"), (0, 2, "# TITLE", True, "normal"), (0, 3, "## one", False, "normal"), (0, 4, "## two", False, "normal"), (0, 5, "A line that is bro-", False, "normal"), (0, 6, "ken, then", False, "normal"),
        (0, 7, "goes on", False, None), (0, 8, "New:", None, "normal"), (0, 9, "| t |", False, "table"), (0, 10, "lower after table", False, "normal"), (0, 11, None, False, "normal"), (1, 1, " ", False, "normal"),
    ]
    got = {r.page: r.paragraphs for r in reading.stitched(spark.createDataFrame(items, "page int, pos int, text string, title_card boolean, kind string"), "page", "pos").collect()}
    assert got == {0: ["# BIG TITLE", "## one two", "A line that is broken, then goes on", "New:", "| t |", "lower after table"], 1: []}


def test_layouts(spark):
    sheets = spark.createDataFrame([(p, 600.0, 800.0, d, i) for p, d, i in [(0, 0, 0), (1, 9, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 0, 0)]], "page int, width double, height double, n_drawings int, n_images int")
    long = "word " * 150
    data = [
        (*block(2, 1, 20, 100, 280, "Contents"), ["Sabon"]), (*block(3, 1, 20, 100, 280, long), ["Sabon"]), (*block(3, 2, 320, 100, 580, long), ["Sabon"]), (*block(4, 1, 20, 100, 580, long), ["Sabon"]), (*block(5, 1, 20, 100, 280, "Player Aid 4"), None),
        *((*block(0, 10 * c + k, 20 + 200 * c, 300 + 10 * k, 170 + 200 * c, long), ["Sabon"]) for k in range(3) for c in range(3)),
    ]
    got = dict(rows(reading.page_layouts(spark.createDataFrame(data, BLOCKS + ", fonts array<string>"), sheets, "page")))
    assert got == {0: "three_columns", 1: "art", 2: "toc", 3: "columns", 4: "single", 5: "handout"}


# Tables


def test_cells(spark):
    b = lambda pos, region, x0, x1, text, role="table": (0, pos, region, role, text, float(x0), pos * 10.0, float(x1), pos * 10.0 + 9)
    data = [
        b(0, "t", 0, 300, "before", "body"), b(1, "h", 0, 300, "Head"), b(2, "a", 150, 190, "A2"), b(3, "a", 0, 40, "A1"), b(4, "b", 155, 180, " more "), b(5, "c", 0, 30, "C1"), b(6, "c", 150, 170, "C2"),
        b(7, "w", 0, 200, "across"), b(8, "o", 150, 170, "orphan"), b(9, "z", 0, 300, "after", None), b(10, "s", 0, 40, "lone"),
    ]
    df = spark.createDataFrame(data, "page int, pos int, region string, role string, text string, x0 double, y0 double, x1 double, y1 double")
    got = [(r.kind, r.region, r.col, r.text) for r in tables.assembled_cells(df, "page").orderBy("place").collect()]
    assert got == [("plain", "t", None, "before"), ("plain", "h", None, "Head"), ("cell", "a", 0, "A1"), ("cell", "a", 1, "A2 more"), ("cell", "c", 0, "C1"), ("cell", "c", 1, "C2"), ("wide", "w", None, "across"), ("error", "o", None, "orphan"), ("plain", "z", None, "after"), ("plain", "s", None, "lone")]
    assert tables.assembled_cells(df.limit(0), "page").count() == 0


def test_aligned_words(spark):
    w = [(0, 0, 0, ">> Title", 0.0, 0.0), (0, 1, 1, "a", 0.0, 20.0), (0, 1, 2, "| b |", 100.0, 21.0), (0, 2, 3, "----", 0.0, 30.0), (0, 3, 4, "c", 30.0, 40.0), (0, 3, 5, "d", 95.0, 40.0), (0, 3, 6, "e", 101.0, 40.0), (1, 1, 1, "x", 0.0, 0.0), (2, 1, 1, None, 0.0, 0.0)]
    got = {r.key: r for r in tables.aligned_tables(spark.createDataFrame(w, "key int, line_no int, word_no int, text string, x double, y double"), "key").collect()}
    assert list(got) == [0] and got[0].markdown == ">> Title\n\n| a | b |\n| --- | --- |\n| c | d e |"


def test_strict_tables_and_dossiers(spark):
    lines = ["| a | b |", "| c | d |", "|---|---|", "| 1 | |", "no", "| x | y |", "|---|", "|  |  |", None]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "|---|---|"), (2, 1, "|---|---|"), (3, 0, None)], "id int, line_no int, line string").repartition(3)
    assert rows(collectors.strict_tables(df).select("id", "table", "line_no")) == [(1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 2, 5), (1, 2, 6), (2, 1, 0), (2, 1, 1)]
    text = ["x", "## 目标档案", "", "**甲**：话", "年龄：4", "**乙**。岛屿", "注记：no", "目标档案", "# end"]
    got = rows(collectors.dossiers(spark.createDataFrame(list(enumerate(text)), "line_no int, line string").selectExpr("7 AS id", "*")).select("dossier", "line_no"))
    assert got == [(1, 1), (1, 3), (1, 4), (2, 7)]
    assert collectors.strict_tables(df.limit(0)).count() == 0


# Cards


def test_bands_take_the_first_that_fits(spark):
    data = [(0, i, *map(float, b), 800.0) for i, b in enumerate([(0, 0, 100, 50), (200, 0, 300, 50), (20, 60, 90, 100), (50, 110, 260, 150), (210, 60, 280, 90), (0, 500, 10, 510)])] + [(0, 9, None, 1.0, 2.0, 3.0, 800.0)]
    got = dict((r.id, r.band) for r in cards.banded(spark.createDataFrame(data, "page int, id int, x0 double, y0 double, x1 double, y1 double, page_height double"), "page").collect())
    assert got == {0: 0, 1: 1, 2: 0, 4: 1, 3: 0, 5: 2}


def test_stat_text(spark):
    texts = [("STR 10 CON 9 DEX 3 INT 2", True), ("STR 10 CON 9", False), ("STR 10 CON 9 HP 3", True), ("Armor: 2\nAttack: 1", True), ("Armor: 2", False), ("Abilities: none\nAthletics 4, Drive 2", True), (None, False)]
    assert [r.s for r in spark.createDataFrame(texts, "t string, want boolean").select(cards.is_stat_text(F.col("t")).alias("s")).collect()] == [w for _, w in texts]
