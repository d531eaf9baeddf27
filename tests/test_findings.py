"""Cases in which results differed from SQL, ran out of memory or grew faster than their input."""

import pandas as pd
from pyspark.sql import functions as F

from vellumite import stages
from vellumite.functions import lines
from vellumite.operators import boxes, merging, reading, rules, segments, terms
from vellumite.plans import catalogue
from vellumite.tables import table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_markers_end_where_the_line_does(spark):
    df = spark.createDataFrame([(" [卡片] ", "footer"), ("[卡片]\n", "footer"), (" Title.\n", "footer"), ("12\n", "footer"), (" 12 ", "footer")], "m string, r string")
    got = df.select(lines.canonical_marker(F.col("m")).alias("m"), lines.is_page_number(F.col("r"), F.col("m")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("[CARD]", False), ("[卡片]\n", False), ("Title.\n", False), ("12\n", False), ("12", True)]


def test_marginal_lengths_count_inner_blanks(spark):
    wide, narrow = "12 more   " * 8 + "12 more", " ".join(["12 more"] * 9)
    df = spark.createDataFrame([(wide, 740.0), (narrow, 740.0), (f"\n{narrow} ", 740.0)], "t string, y double")
    got = [r.m for r in df.select(boxes.marginal(F.col("t"), F.col("y"), F.col("y") + 8, F.lit(800.0), compact=False).alias("m")).collect()]
    assert got == [False, True, True]


def test_long_titles_count_where_they_may(spark):
    """A title of over 120 characters is a narrow block of the middle column, unless titles may have any length."""
    base = [(i, x, 200.0 + 9 * i, "a", 10.0) for i, x in enumerate([20.0, 20.0, 20.0, 420.0, 420.0, 420.0])]
    data = [(0, i, t, x, y, x + 150, y + 8, size, 10.0, 600.0, 800.0, 1) for i, x, y, t, size in [*base, (6, 221.0, 100.0, "a", 10.0), (7, 221.0, 120.0, "a", 10.0), (8, 221.0, 150.0, "word " * 40, 24.0)]]
    df = spark.createDataFrame(data, "page int, id int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, median_size double, page_width double, page_height double, n_lines int")
    assert rows(reading.three_columns(df, "page")) == [(0,)] and rows(reading.three_columns(df, "page", longest_title=None)) == []


def test_symbols_are_kept_as_written(spark):
    """Case and ASCII borders decide: other letters beside a symbol are none of it."""
    pairs = spark.createDataFrame([(0, "1D6 or é2d4, ñSTR", "1d6 2d4é STRñ"), (1, "HP", "HP_"), (2, "3d6", "x3d6"), (3, "1/1d6 san", "1/1d6 SAN")], "page_index int, source string, translation string")
    assert rows(rules.missing_symbols(pairs, any_case=False)) == [(1, "骰子", "1D6"), (3, "骰子", "3d6"), (4, "损失", "1/1d6 san")]
    assert rows(rules.missing_symbols(pairs)) == [(3, "骰子", "3d6")]


def test_names_of_any_length(spark):
    """The pattern that goes back word by word overflows the stack of a thread here."""
    long = " & ".join(["Old Gate."] * 20_000)
    df = spark.createDataFrame([(i, f"the {long} closes. The Black Sea. of A. & Ba- x Rain9") for i in range(2)], "id int, text string")
    assert rows(terms.candidates(df)) == [("Black Sea. of A. & Ba", 2, 2), (long[:-1], 2, 2)]


def test_matches_in_a_long_text(spark):
    """A row of a place held the whole text before: some GB for this one."""
    texts = spark.createDataFrame([(0, "gate old Gate; " * 8_000), (1, " old gate"), (2, None)], "id int, text string")
    book = spark.createDataFrame([(i, f"t{i}", "Old  Gate" if i else "gate old gate") for i in range(40)], "ord int, target string, term string")
    found = terms.matches(texts, book, forms=False)
    assert rows(found.groupBy("id", "term", "target").count()) == [(0, "Old  Gate", "t1", 8_000), (0, "gate old gate", "t0", 8_000), (1, "Old  Gate", "t1", 1)]
    assert rows(found.where("id = 0").agg(F.expr("max(start)"), F.expr("sum(start)")).select("*")) == [(23_998, sum(3 * i + 1 for i in range(8_000)) + sum(3 * i for i in range(8_000)))]


def test_done_pages_take_part_in_no_other_round(spark, monkeypatch):
    """Pages without boxes that touch were joined again in every round before."""
    seen, step = [], stages.Rounds.step
    monkeypatch.setattr(stages.Rounds, "step", lambda self, df, **k: [t := step(self, df, **k), seen.append((t.count(), "busy" in t.columns and t.where("busy").count()))][0])
    chain = [(0, 10.0 * i, 0.0, 10.0 * i + 8, 5.0) for i in range(40)]
    apart = [(p, 100.0 * i, 0.0, 100.0 * i + 8, 5.0) for p in range(1, 50) for i in range(3)]
    df = spark.createDataFrame(chain + apart, "page int, x0 double, y0 double, x1 double, y1 double")
    got = rows(merging.merged_boxes(df, "page"))
    assert got[0] == (0, 0.0, 0.0, 398.0, 5.0, 40) and len(got) == 148
    assert len(seen) > 3 and seen[0][0] == 187 and all(n < 40 for n, _ in seen[2:])


def test_blocks_are_handed_on_whole(spark, sf_dir):
    """The query gave numbers of blocks and characters only."""
    got = {}
    for r in sorted(catalogue.QUERIES["markdown_blocks"](spark, sf_dir).collect(), key=lambda r: (r.id, r.block)):
        got.setdefault(r.id, []).append(r.content)
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert {i: "\n".join(c) for i, c in got.items()} == texts


def test_blocks_have_what_is_translated(spark):
    """Text, marks and indents were left out, and blocks cut by other rules than the reference's."""
    prose = "<p>" + "word " * 8 + "</p>"
    data = [
        "---\na\n\n---\n##  Top \n# \n* * *\n----",
        "1. one \n   two\n   - in\n - out\n1) no\n  > q\n>> r\n>s\n",
        "```py\na\n```no\n```\n|a|\nb\n|a|\n|-|\n~~~\nopen\n",
        f"<div>\nx\n</div> y\nz\n{prose}\nz\n<DIV>\n</div>\n\n![a](b) ",
        "# A\r\nb\rc\u2028- d\r\n",
        "",
        None,
    ]
    df = segments.markdown_blocks(spark.createDataFrame(list(enumerate(data)), "id int, text string"))
    want = [
        (0, 0, "front_matter", "---\na\n\n---", "", False, "", "", 0, 3),
        (0, 1, "heading", "##  Top ", "Top", True, "## ", "", 4, 4),
        (0, 2, "paragraph", "# ", "# ", True, "", "", 5, 5),
        (0, 3, "hr", "* * *", "", False, "", "", 6, 6),
        (0, 4, "paragraph", "----", "----", True, "", "", 7, 7),
        (1, 0, "list_item", "1. one \n   two\n   - in", "one two - in", True, "1. ", "", 0, 2),
        (1, 1, "list_item", " - out", "out", True, "- ", " ", 3, 3),
        (1, 2, "paragraph", "1) no", "1) no", True, "", "", 4, 4),
        (1, 3, "blockquote", "  > q\n>> r\n>s", "q\nr\ns", True, "> ", "", 5, 7),
        (1, 4, "empty_line", "", "", False, "", "", 8, 8),
        (2, 0, "code_block", "```py\na\n```no\n```", "", False, "", "", 0, 3),
        (2, 1, "paragraph", "|a|\nb", "|a|\nb", True, "", "", 4, 5),
        (2, 2, "table", "|a|\n|-|", "|a|\n|-|", True, "", "", 6, 7),
        (2, 3, "code_block", "~~~\nopen", "", False, "", "", 8, 9),
        (2, 4, "empty_line", "", "", False, "", "", 10, 10),
        (3, 0, "html_block", "<div>\nx\n</div> y", "", False, "", "", 0, 2),
        (3, 1, "paragraph", "z", "z", True, "", "", 3, 3),
        (3, 2, "html_block", prose, prose, True, "", "", 4, 4),
        (3, 3, "paragraph", "z", "z", True, "", "", 5, 5),
        (3, 4, "html_block", "<DIV>\n</div>", "", False, "", "", 6, 7),
        (3, 5, "empty_line", "", "", False, "", "", 8, 8),
        (3, 6, "image", "![a](b) ", "", False, "", "", 9, 9),
        (4, 0, "heading", "# A", "A", True, "# ", "", 0, 0),
        (4, 1, "paragraph", "b\nc", "b\nc", True, "", "", 1, 2),
        (4, 2, "list_item", "- d", "d", True, "- ", "", 3, 3),
        (4, 3, "empty_line", "", "", False, "", "", 4, 4),
        (5, 0, "empty_line", "", "", False, "", "", 0, 0),
        (6, 0, "empty_line", "", "", False, "", "", 0, 0),
    ]
    assert sorted(map(tuple, df.collect())) == want


def test_blocks_of_one_text_leave_in_parts():
    """All blocks of a text were gathered in one frame before."""
    text = "\n" * segments.CUT_BLOCKS + "<p\n" * 100_000  # a search for tags from each < would take minutes
    parts = list(segments.cut_texts(iter([pd.DataFrame({"id": [1], "text": [text]})])))
    assert [len(p) for p in parts] == [segments.CUT_BLOCKS, 2]
    assert list(pd.concat(parts)["block"]) == list(range(segments.CUT_BLOCKS + 2))
