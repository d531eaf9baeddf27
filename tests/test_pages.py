"""Columns, drop caps, contents entries, hints and single lines: ties, nulls, empty tables."""

import pytest
from pyspark.sql import functions as F

from vellumite.functions import lines
from vellumite.operators import columns, documents, hints, review, terms

BOX = "x0 double, y0 double, x1 double, y1 double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_gutters(spark):
    r = [(0, 600.0, 20.0, 0.0, 280.0, 9.0), (0, 600.0, 20.0, 0.0, 270.0, 9.0), (0, 600.0, 320.0, 0.0, 580.0, 9.0), (0, 600.0, 0.0, 0.0, 600.0, 9.0), (1, 600.0, 20.0, 0.0, 280.0, 9.0), (1, 600.0, 320.0, 0.0, 580.0, 9.0)]
    r += [(2, 600.0, 20.0, 0.0, 340.0, 9.0), (2, 600.0, 320.0, 0.0, 580.0, 9.0), (2, 600.0, 20.0, 0.0, 350.0, 9.0), (3, 600.0, None, 0.0, 1.0, 2.0)]
    df = spark.createDataFrame(r, f"page int, page_width double, {BOX}")
    assert rows(columns.gutters(df, "page")) == [(0, 300.0), (1, None), (2, None), (3, None)]
    assert columns.gutters(df.limit(0), "page").count() == 0


def test_column_ids(spark):
    b = spark.createDataFrame([(20.0, 280.0, "body", 300.0), (320.0, 580.0, "body", 300.0), (0.0, 400.0, "body", 300.0), (20.0, 280.0, "table", 300.0), (20.0, 280.0, "body", None), (290.0, 330.0, "subsection", 300.0), (20.0, 80.0, None, 300.0)], "x0 double, x1 double, font_role string, g double")
    assert [r.c for r in b.select(columns.column_id(F.col("g"), F.lit(600.0)).alias("c")).collect()] == ["left", "right", None, None, None, None, "left"]


def test_drop_caps(spark):
    b = lambda pos, font, text, x0=40.0, y0=None, role="body_column": (0, pos, f"b{pos}", font, role, text, x0, pos * 10.0 if y0 is None else y0, 200.0, pos * 10.0 + 9)
    data = [b(0, "display", " T ", 30.0), b(1, "body", "he rain "), b(2, "body", " fell."), b(3, "body", "Quote", role="quote"), b(4, "body", "alone"), b(5, "display", "No"), b(6, "body", "caps"), b(7, "display", "A"), b(8, "body", "Big"), b(9, "display", "B", 90.0), b(10, "body", "left of it"), b(11, "display", "É"), b(12, "body", "t"), b(13, "body", "far", y0=140.0), b(14, "display", None), b(15, None, None)]
    df = spark.createDataFrame(data, f"page int, pos int, id string, font_role string, role string, text string, {BOX}")
    got = {r.id: (r.drop_cap, r.n, r.text) for r in columns.with_drop_caps(df, "page").collect()}
    assert got["b0"] == (True, 3, "The rain fell.") and got["b11"] == (True, 2, "Ét")
    assert set(got) == {f"b{i}" for i in range(16)} - {"b1", "b2", "b12"} and not any(c for i, (c, *_) in got.items() if i not in ("b0", "b11"))
    assert columns.with_drop_caps(df.limit(0), "page").count() == 0


def test_contents_entries(spark):
    text = ["CONTENTS", "First", "12", "13", "Pending", "Next .... 4", "Sub5", "", None, "Last"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, 0, None)], "block int, line_no int, line string")
    assert rows(hints.contents_entries(df, "block")) == [(1, "First ........ 12\n13\nPending\nNext ........ 4\nSub ........ 5\nLast")]


def test_column_sections(spark):
    col = spark.createDataFrame([(0, "left", 0.0, 0.0, 100.0, 500.0)], f"page int, col string, {BOX}")
    blocks = spark.createDataFrame([(0, "left", 0.0, 10.0, 90.0, 50.0), (0, "left", 0.0, 220.0, 90.0, 260.0), (0, "left", 0.0, 400.0, 90.0, 450.0)], f"page int, col string, {BOX}")
    obstacles = spark.createDataFrame([(0, 20.0, 100.0, 80.0, 200.0), (0, 95.0, 300.0, 400.0, 350.0), (0, 50.0, 270.0, 90.0, 390.0)], f"page int, {BOX}")
    assert rows(hints.column_sections(col, blocks, obstacles, "page")) == [(0, "left", 0, 1, 0.0, 10.0, 100.0, 97.0, None), (0, "left", 1, 1, 0.0, 220.0, 100.0, 267.0, None), (0, "left", 2, 1, 0.0, 400.0, 100.0, 497.0, None)]
    assert rows(hints.column_sections(col, blocks, obstacles.limit(0), "page")) == [(0, "left", 0, 3, 0.0, 10.0, 100.0, 497.0, None)]


def test_hints(spark):
    b = spark.createDataFrame([(0, "single", i, i, True) for i in range(4)] + [(1, None, 0, 0, None)], "page int, page_type string, id int, pos int, translatable boolean")
    got = hints.hinted_pages(b, spark.createDataFrame([(0, "columns"), (9, "art")], "page int, page_type string"), spark.createDataFrame([(0, 2), (0, 2)], "page int, id int"), spark.createDataFrame([(0, 0, 3), (0, 1, 1), (0, 5, 3)], "page int, pos int, id int"), "page")
    assert rows(got) == [(0, "columns", 0, 2, True), (0, "columns", 1, 1, True), (0, "columns", 2, 3, False), (0, "columns", 3, 0, True), (1, None, 0, 0, None)]
    regions = spark.createDataFrame([(0, "r", 1.0, 2.0, 3.0, 4.0)], f"page int, region_id string, {BOX}")
    owners = spark.createDataFrame([(0, 1, "r"), (0, 2, "lost")], "page int, id int, region_id string")
    members = spark.createDataFrame([(0, "left", 1), (0, "right", 1), (0, "right", 2), (0, "far", 7)], "page int, col string, id int")
    assert rows(hints.hinted_columns(members, owners, regions, "page")) == [(0, "far", 1, None, None, None, None, "no box of block 7"), (0, "left", 1, 1.0, 2.0, 3.0, 4.0, None), (0, "right", 2, 1.0, 2.0, 3.0, 4.0, "no box of block 2")]


@pytest.mark.parametrize(
    ("fn", "yes", "no"),
    [(lines.is_roll_marker, ["1", " d10 ", "1-2", "iv–ix.", "3、"], ["", None, "1 x", "1234", "q"]), (lines.is_result_file, ["a.pdf", "x.md"], ["a_timeline.md", "a.txt", ""]), (lines.is_dossier_entry, ["**甲乙**：化名：丙，年龄 3，职业 x"], ["甲乙：化名：丙，年龄 3", None])],
)
def test_lines(spark, fn, yes, no):
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    assert [bool(r.r) for r in df.select(fn(F.col("t")).alias("r")).collect()] == [True] * len(yes) + [False] * len(no)


def test_forms(spark):
    df = spark.createDataFrame([(" [卡片] ", "WROTH HEAD；Title", "iv", "v"), (None, "MISREAD [原文损坏]", "A9", "A10"), ("[x]", None, "iv", "5"), ("", "Plain", None, "")], "m string, d string, a string, b string")
    got = df.select(lines.canonical_marker(F.col("m")).alias("m"), lines.without_damage(F.col("d")).alias("d"), review.labels_follow(F.col("a"), F.col("b")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("[CARD]", "Title", True), ("", "[原文损坏]", True), ("[x]", "", False), ("", "Plain", False)]


def test_unpaired_marks_are_an_error_row(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, "[CARD]\nx"), (3, None), (4, "[/CARD]")], "id int, text string")
    assert rows(documents.chunks(df)) == [(1, 0, "a", None), (1, 1, "b", None), (2, None, None, "[/CARD] is missing"), (4, None, None, "[/CARD] closes nothing")]


def test_matches_with_many_first_words(spark):
    """The join without a broadcast of first words finds the same."""
    texts = spark.createDataFrame([(1, "The  Old-Gate opened. (Raven) raven's old gate; THE RAVEN"), (2, None), (3, "")], "id int, text string")
    book = spark.createDataFrame([(1, "a", "old-gate"), (2, "b", "(raven)"), (3, "c", "The Raven"), (4, "d", "raven"), (5, "e", "!!")], "ord int, target string, term string")
    few, many = rows(terms.matches(texts, book)), rows(terms.matches(texts, book, heads_at_most=1))
    assert few == many and {(r[1], r[3]) for r in few} == {(1, "old-gate"), (4, "(raven)"), (5, "raven"), (9, "The Raven"), (10, "raven")}
    assert terms.matches(texts, book.limit(0)).count() == 0
