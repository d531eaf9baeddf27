"""Folds over documents and page operators on small relations."""

import pytest
from pyspark.sql import functions as F

from vellumite.operators import documents, pages


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_chunks(spark):
    text = "one\nstill one\n\ntwo\n[CARD]\na\n\nb\n[/CARD]\nthree"
    assert documents.chunked(text) == [(0, "one\nstill one"), (1, "two"), (2, "[CARD]\na\n\nb\n[/CARD]"), (3, "three")]
    for bad in ("[CARD]\nx", "[/CARD]", "[CARD]\n[IMAGE]\n[/CARD]"):
        with pytest.raises(ValueError):
            documents.chunked(bad)
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    assert documents.chunks(df).count() == 4


def test_headings_that_belong_together(spark):
    assert documents.joined_headings("# A\n\n# B\n\n## C\n\ntext\n\n# D.\n\n# E") == "# A B\n\n## C\n\ntext\n\n# D.\n\n# E"
    assert documents.with_joined_headings(spark.createDataFrame([(1, "# A\n\n# B")], "id int, text string")).first().text == "# A B"


def test_loose_glossary(spark):
    text = "特工\n探员\nAgent\ndetective\n\n公司\nAcme,\nInc of\n绿\nunmatched one\nUnmatched two\n尾"
    got = documents.loose_pairs(text)
    assert got[:2] == [("特工", "Agent", ""), ("探员", "detective", "")]
    assert got[2] == ("公司", "Acme, Inc of", "uneven block") and got[3][:2] == ("绿", "unmatched one") and got[-1] == ("尾", "", "no term")
    assert documents.loose_glossary(spark.createDataFrame([(1, text)], "id int, text string")).count() == len(got)


def test_missing_emphasis(spark):
    runs = spark.createDataFrame([("a", 0, "x ", False, False), ("a", 1, "y", True, False), ("b", 0, "x", True, True), ("b", 1, "y", True, False), ("c", 0, "x", True, True), ("d", 0, "q", True, False), ("d", 1, "r", False, False)], "block_id string, pos int, text string, bold boolean, italic boolean")
    blocks = spark.createDataFrame([("a", 0, "x y", "t"), ("b", 0, "xy", "<em>t</em>"), ("c", 0, "x", "t"), ("d", 1, "other", "t")], "block_id string, page int, source string, translation string")
    assert rows(documents.missing_emphasis(runs, blocks)) == [(0, "a", "粗体")]


def test_page_operators(spark):
    sheets = spark.createDataFrame([(0, 100.0, 100.0), (1, 100.0, 100.0)], "page int, width double, height double")
    fills = spark.createDataFrame([(0, 2, "#112233", 0.0, 0.0, 100.0, 95.0), (0, 1, "#ffffff", 0.0, 0.0, 100.0, 100.0), (1, 0, "#000000", 0.0, 0.0, 50.0, 50.0)], "page int, seq int, colour string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.page, r.colour) for r in pages.background(fills, sheets).orderBy("page").collect()] == [(0, "#112233"), (1, None)]
    blocks = spark.createDataFrame([(0, 40.0, 100.0, 10, ["A", "B"]), (0, 40.0, 100.0, 3, ["B", "C"]), (0, 90.0, 100.0, 99, ["D"]), (0, 40.0, 100.0, 2, ["E"])], "page int, width double, page_width double, n_lines int, fonts array<string>")
    assert rows(pages.body_fonts(blocks)) == [(0, "A"), (0, "B")]
    cards = spark.createDataFrame([("A Title", 24.0, 30.0, 10.0, 70.0), ("A Title.", 24.0, 30.0, 10.0, 70.0), ("Left", 24.0, 5.0, 10.0, 60.0), ("Low", 24.0, 30.0, 50.0, 70.0), ("Small", 12.0, 30.0, 10.0, 70.0)], "t string, s double, x0 double, y0 double, x1 double")
    c = F.col
    got = cards.select("t", pages.is_title_card(c("t"), c("s"), F.lit(10.0), c("x0"), c("y0"), c("x1"), F.lit(100.0), F.lit(100.0)).alias("y"))
    assert {r.t: r.y for r in got.collect()} == {"A Title": True, "A Title.": False, "Left": True, "Low": False, "Small": False}
    lines = spark.createDataFrame([(0, "", 1.0, 0.0), (0, "x", 1.0, 1.0), (0, "y", 1.0, 0.0)], "page int, text string, dx double, dy double")
    assert rows(pages.dominant_angle(lines, "page")) == [(0, 45.0)]
    assert pages.is_heading_block(F.lit("Head"), F.lit(13.0), F.lit(10.0)) is not None
