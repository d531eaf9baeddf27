"""What keeps a task's rows, memory and shuffles bounded as tables grow."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellumite import stages, tables
from vellumite.operators import boxes, collectors, images, merging, pages, reading, segments
from vellumite.plans import layouts, records
from vellumite.plans.derived import given


def _nodes(df, name: str) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count(name) if name != "Exchange" else df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ")


def _most(df) -> int:
    return max(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(tables, "DEALT_ROWS", 100)


@pytest.mark.parametrize("rows", [lambda s, d: layouts._rows(s, d), lambda s, d: layouts._lines(s, d), lambda s, d: records._boxes(s, d), lambda s, d: given(s, "boxes", d), lambda s, d: given(s, "flowing", d)])
def test_rows_of_a_partition_do_not_grow_with_the_table(spark, sf_dir, small_parts, rows):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert n > 4000 and _most(rows(spark, sf_dir)) < 400


def test_nearest_columns_takes_all_boxes_of_an_id(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 20.0), (1, 2, 40.0, 60.0), (1, 3, 90.0, 110.0), (1, 3, 88.0, 90.0), (1, 4, 0.0, 1.0), (1, 4, 91.0, 91.0), (2, 1, 0.0, 1.0)], "page int, id int, x0 double, x1 double")
    c = spark.createDataFrame([(1, 2, 90.0), (1, 1, 10.0), (3, 1, 0.0)], "page int, column int, centre double")
    assert sorted(map(tuple, boxes.nearest_column(b, c, "page").collect())) == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2)]


def test_reading_order_shuffles_its_rows_once(spark, sf_dir):
    assert _nodes(reading.reading_order(layouts._blocks(spark, sf_dir), "page"), "Exchange") == 1


def test_three_columns_shuffle_their_rows_once(spark, sf_dir):
    assert _nodes(reading.three_columns(layouts._blocks(spark, sf_dir).where("is_text"), "page"), "Exchange") == 1


def test_merged_regions_need_no_python(spark):
    rows = [(1, 2, 10.0, 15.0, 40.0, 14.0, 300.0, 25.0), (1, 1, 10.0, 15.0, 41.0, 0.0, 200.0, 11.0), (1, 3, 10.0, 15.0, 40.0, 60.0, 300.0, 71.0), (2, 1, 0.0, 15.0, 1.0, 0.0, 9.0, 5.0), (2, 2, 9.0, 15.0, 1.0, 5.0, 9.0, 9.0), (2, 3, 9.0, 15.0, None, 10.0, 9.0, 12.0)]
    df = pages.merged_regions(spark.createDataFrame(rows, "page int, pos int, size double, pitch double, x0 double, y0 double, x1 double, y1 double"))
    assert _nodes(df, "Pandas") == 0
    want = [(1, 0, 40.0, 0.0, 300.0, 25.0, 2), (1, 1, 40.0, 60.0, 300.0, 71.0, 1), (2, 0, 1.0, 0.0, 9.0, 5.0, 1), (2, 1, 1.0, 5.0, 9.0, 12.0, 2)]
    assert sorted(map(tuple, df.collect())) == want


def test_markdown_leaves_in_parts():
    text = "a line\n\n" * (segments.CUT_CHARS // 16)
    frame = pd.DataFrame({"id": range(6), "text": [text] * 5 + [None]})
    parts = list(segments.cut_texts(iter([frame])))
    assert max(p["content"].str.len().sum() for p in parts) <= 2 * segments.CUT_CHARS and len(parts) == 3
    assert list(pd.concat(parts)["id"].unique()) == list(range(6))


def test_small_pages_merge_without_rounds(spark, monkeypatch):
    """Pages of few boxes went through rounds in grid cells before, with a row shuffled for each cell of a box."""
    seen, step = [], stages.Rounds.step
    monkeypatch.setattr(stages.Rounds, "step", lambda self, df, **k: [seen.append(_nodes(df, "Exchange")), step(self, df, **k)][1])
    rng = random.Random(3)
    data = [(p, *(lambda x, y: (x, y, x + rng.randrange(300), y + rng.randrange(9)))(rng.randrange(400), rng.randrange(200))) for p in range(40) for _ in range(rng.randrange(merging.ROW_BOXES))]
    data += [(50, 12 * i, 0, 12 * i + 5, 5) for i in reversed(range(20))] + [(51, 0, 0, 5, 5)] * 100 + [(None, 1, 1, 2, 2)]
    df = spark.createDataFrame([(p, *map(float, b)) for p, *b in data], "page int, x0 double, y0 double, x1 double, y1 double")
    small = sorted(map(tuple, merging.merged_boxes(df.repartition(4, "page"), "page").collect()))
    assert seen == [1]  # the one that deals the rows by page
    monkeypatch.setattr(merging, "ROW_BOXES", 0)
    assert small == sorted(map(tuple, merging.merged_boxes(df, "page").collect())) and len(seen) > 2
    assert small[-2:] == [(50, 0.0, 0.0, 233.0, 5.0, 20), (51, 0.0, 0.0, 5.0, 5.0, 100)]


def test_pictures_are_shuffled_once_by_page(spark, monkeypatch):
    """Three relations by page need three exchanges; what is on cards or under texts was shuffled by page and box before."""
    got = []
    monkeypatch.setattr(images, "merged_boxes", lambda df, page, tolerance: got.append(_nodes(df, "Exchange")) or df)
    box = "x0 double, y0 double, x1 double, y1 double"
    sheet = [(p, 600.0, 800.0, 100.0, 100.0, 300.0, 400.0) for p in range(5)]
    pictures = spark.createDataFrame(sheet, f"page int, page_width double, page_height double, {box}")
    held = spark.createDataFrame([(1, 90.0, 100.0, 300.0, 400.0), (2, 290.0, 100.0, 500.0, 400.0)], f"page int, {box}")
    texts = spark.createDataFrame([(3, 100.0, y, 300.0, y + 30, "x" * 80) for y in (120.0, 160.0, 200.0)] + [(4, 100.0, 120.0, 300.0, 140.0, "x" * 240)], f"page int, {box}, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = images.picture_regions(*(d.repartition(4, "page") for d in (pictures, held, texts)), "page")
        assert sorted(r.page for r in left.collect()) == [0, 2, 4] and got == [3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plain_tables(lines: list[str]) -> list[tuple]:
    def cells(line):
        bare = re.sub(r"^(?:>\s*)+", "", line).strip()
        return [c.strip() for c in bare.strip("|").split("|")] if "|" in bare else []

    out, table, is_open, head = [], 0, False, None
    for i, line in enumerate(x.strip() for x in lines):
        c = cells(line)
        row, rule = len(c) >= 2 and any(c), bool(c) and all(re.fullmatch(r":?-{3,}:?", x) for x in c)
        if is_open and row or head and rule and not is_open:
            if not is_open:
                table, is_open = table + 1, True
                out.append((table, *head))
            out.append((table, i, line))
            head = None
            continue
        is_open, head = False, (i, line) if row else None
    return out


def _plain_dossiers(lines: list[str]) -> list[tuple]:
    out, number, is_open = [], 0, False
    for i, line in enumerate(x.strip() for x in lines):
        named = re.match(r"\*\*[^*]+?\*\*[。.:：]", line)
        entry = "岛屿" not in line if named else re.match("(?:年龄|职业)[：:]", line)
        if is_open and (not line or entry):
            out += [(number, i, line)] if line else []
            continue
        is_open = re.sub(r"^#{1,6}\s*", "", line) == "目标档案"
        number += is_open
        out += [(number, i, "目标档案")] if is_open else []
    return out


_LINES = ["| a | b |", "|---|", "| --- | :---: |", "|---|", "no", "> > | x | y", "  | | ", "> --- | ---", "|", "||", "", "\u3000| c\x1f|d |\xa0", ">| :--- |", "| -- | --- |"]
_NOTES = ["## 目标档案", "**甲。乙**：话", "年龄：4", "", "职业:x", "**丙**：岛屿", "text", "目标档案\u3000", "# 年龄：1", "#目标档案", " \x1c", "**a*b**.", "####### 目标档案"]


@pytest.mark.parametrize("collected, plain, kinds", [(collectors.strict_tables, _plain_tables, _LINES), (collectors.dossiers, _plain_dossiers, _NOTES)])
def test_collectors_need_no_python(spark, collected, plain, kinds):
    """Each line went through a Python table function before."""
    rng = random.Random(7)
    texts = [[rng.choice(kinds[: rng.choice((4, len(kinds)))]) for _ in range(rng.randrange(60))] for _ in range(300)]
    df = spark.createDataFrame([(k, i, x) for k, t in enumerate(texts) for i, x in enumerate(t)], "id int, line_no int, line string").repartition(3, "id")
    got = collected(df)
    assert _nodes(got, "Python") == _nodes(got, "UDTF") == 0 and _nodes(got, "Exchange") == 1
    assert sorted(map(tuple, got.collect())) == sorted((k, *x) for k, t in enumerate(texts) for x in plain(t))
