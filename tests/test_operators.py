"""Operators that SQL does not express, against plain versions."""

import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vellumite.operators import ordered, segments, state, terms
from vellumite.plans.fixtures import given
from vellumite.sources import readers, sinks
from vellumite.streaming import limits


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_matches_and_selection(spark):
    found = terms.matches(given(spark, "chunks"), given(spark, "glossary"))
    assert {(r.id, r.term, r.kind) for r in found.where("id = 1").collect()} == {(1, "Agent", "exact"), (1, "agent", "plural"), (1, "Delta Green", "exact"), (1, "Green", "exact")} or found.where("id = 1").count() == 4
    picked = terms.selected(found)
    first = [(r.term, r.n_words) for r in picked.where("id = 1").orderBy("match_rank").collect()]
    assert first[0] == ("Delta Green", 2) and all(t != "Green" for t, _ in first)
    spans = {}
    for r in picked.collect():
        own = set(range(r.start, r.start + r.n_words))
        assert not own & spans.get(r.id, set())
        spans[r.id] = spans.get(r.id, set()) | own


def test_case_preferred_entry(spark):
    found = {(r.id, r.start): r.term for r in terms.matches(given(spark, "chunks"), given(spark, "glossary")).collect()}
    assert found[(1, 0)] == "Agent" and found[(3, 1)] == "agent"


def test_candidates(spark):
    texts = spark.createDataFrame([(1, "Old John Smith of the Hill met The Raven. NASA"), (2, "John Smith of the Hill again, The Raven too. NASA"), (3, "Raven")], "id int, text string")
    assert "Raven" in {r.term for r in terms.candidates(texts).collect()}
    assert "NASA" not in {r.term for r in terms.candidates(texts).collect()}


def test_packed_blocks(spark):
    df = spark.createDataFrame([("d", i, k, n) for i, (k, n) in enumerate([("paragraph", 2000), ("list_item", 900), ("paragraph", 200), ("heading", 10), ("paragraph", 5000), ("paragraph", 1)])], "doc string, i int, kind string, size int")
    got = [r.grp for r in ordered.packed_blocks(df, ["doc"], "i", "kind", "size").orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3, 4]


def test_pagination(spark):
    data = [(900, False, False, "a"), (700, False, True, "a"), (400, False, True, "a"), (10, True, False, "a"), (990, False, False, "b"), (600, False, False, "b"), (1, False, False, "b")]
    df = spark.createDataFrame([("d", i, *x) for i, x in enumerate(data)], "doc string, i int, size int, is_title boolean, is_heading boolean, layout string")
    pages = lambda **kw: [r.reading_page for r in ordered.paginated(df, ["doc"], "i", **kw).orderBy("i").collect()]
    assert pages() == [0, 0, 1, 2, 2, 3, 3]
    assert pages(split_on_layout=True) == [0, 0, 1, 2, 3, 3, 4]


def test_page_selection_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        ordered.page_selection(spark.createDataFrame([(1, "9", 4)], "id int, spec string, total int")).collect()


def test_blocks(spark):
    assert rows(segments.parsed_blocks(given(spark, "answers"))) == [(1, 0, "first"), (1, 1, "second"), (2, 3, "a")]
    with pytest.raises(Exception, match="block twice"):
        segments.parsed_blocks(given(spark, "answers"), "error").collect()
    df = spark.createDataFrame([(1, 0, "x\ny"), (1, 1, "z")], "id int, block int, text string")
    assert rows(segments.parsed_blocks(segments.built_blocks(df).withColumnRenamed("request", "response"))) == [(1, 0, "x\ny"), (1, 1, "z")]


def test_markdown_is_lossless():
    assert [k for _, k, *_ in segments.markdown_rows("---\na: 1\n---\n![x](y)\n---")] == ["front_matter", "image", "hr"]
    text = "# T\n\npara one\npara two\n- a\n  more\n- b\n| x | y |\n| --- | --- |\n> q\n```\ncode\n\n```\n---\n<div>\nz\n</div>\n"
    found = segments.markdown_rows(text)
    assert "\n".join(c for _, _, c, _, _ in found) == text
    assert [k for _, k, _, _, _ in found] == ["heading", "empty_line", "paragraph", "list_item", "list_item", "table", "blockquote", "code_block", "hr", "html_block", "empty_line"]


def test_text_clean_ups(spark):
    from vellumite.functions import blocks as B
    from vellumite.functions import text as T

    page = "A hyphen-\nated  word\n 12 \n\n\n\nend\n```\ncode\n```\n| a | b |\n> quote\n[CARD]"
    df = spark.createDataFrame([(page, "my_file - The Title.v2 z-library")], "t string, f string")
    got = df.select(B.context_text(F.col("t"), F.lit("single")), B.header_title(F.col("f")), B.first_content_line(F.col("t")), B.safe_stem(F.lit("a b/ü.md")), B.colour_of(F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.0)))).first()
    assert tuple(got) == ("A hyphenated word\n\nend\n\nquote", "The Title", "A hyphen-", "a_b_.md", "#ff0000")
    lines = spark.createDataFrame([("# **B** ## x",), ("1. a\n2) b\ntext",), ("a\tb\nc\td\ne",), ("42",)], "t string").select(
        B.normal_heading(F.col("t")), B.is_list_like(F.col("t")), B.is_table_like(F.col("t")), B.is_fixed(F.col("t"), F.lit("footer"))
    )
    assert [tuple(r) for r in lines.collect()] == [("# B x", False, False, False), ("1. a\n2) b\ntext", True, False, False), ("a\tb\nc\td\ne", False, True, False), ("42", False, False, True)]
    assert spark.range(1).select(T.size_text(F.lit(3 << 20)), T.duration_text(F.lit(3725))).first()[:] == ("3.0 MB", "1h 2m")


def test_images_and_tables(spark):
    df = spark.createDataFrame([("a [IMAGE]x[/IMAGE] b", "| :--- | ---: |"), ("c", "| a | b |")], "t string, line string")
    assert [r[0] for r in df.select(segments.without_images(F.col("t"))).collect()] == ["a  b", "c"]
    assert [r[0] for r in df.select(segments.is_separator(F.col("line"))).collect()] == [True, False]
    with pytest.raises(Exception, match="do not pair"):
        spark.createDataFrame([("[IMAGE]",)], "t string").select(segments.without_images(F.col("t"))).collect()


def admitted_plain(times, most, seconds):
    taken, out = [], []
    for t in times:
        taken = [x for x in taken if x > t - seconds]
        out.append(len(taken) < most)
        if out[-1]:
            taken.append(t)
    return out


TIMES = [0, 1, 2, 30, 59, 60, 61, 62, 130, 131, 132, 133]


def calls(spark):
    return spark.createDataFrame([("u", i, datetime(2024, 1, 1, 0, t // 60, t % 60), i % 4 > 0) for i, t in enumerate(TIMES)], "user string, i long, ts timestamp, failed boolean")


def test_admission(spark):
    got = state.admitted(calls(spark), "user", "i", 3, 60).orderBy("i").collect()
    assert [r.ok for r in got] == admitted_plain(TIMES, 3, 60)
    assert got[3].wait == 30.0


def test_streamed_admission_and_breaker(spark, tmp_path):
    calls(spark).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, i long, ts timestamp, failed boolean").parquet(str(tmp_path / "in"))
    for name, df, mode in (("limited", limits.limited(stream, "user", "i", 3, 60), "append"), ("broken", limits.breaker(stream, "user", "i", 3), "append"), ("rates", limits.windowed_rates(stream, "user"), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [r.ok for r in spark.sql("SELECT * FROM limited ORDER BY i").collect()] == admitted_plain(TIMES, 3, 60)
    assert rows(spark.sql("SELECT * FROM broken")) == [("u", 3, True)]
    assert spark.sql("SELECT sum(n) FROM rates").first()[0] == len(TIMES)


def test_split_retry():
    tried = []

    def translate(blocks):
        tried.append(list(blocks))
        return {b: str(b) for b in blocks} if len(blocks) <= 2 else {}

    done, failed = state.split_retry(list(range(8)), translate)
    assert sorted(done) == list(range(8)) and not failed and len(tried) == 7
    assert state.split_retry([1, 2], lambda b: {})[1] == [1, 2]


def test_upsert_and_delete(spark):
    assert rows(state.upserted(given(spark, "state"), given(spark, "changes"), ["id"])) == [(1, "a"), (2, "B"), (3, "c"), (4, "D")]
    assert rows(state.deleted(given(spark, "state"), given(spark, "changes"), ["id"])) == [(1, "a"), (3, "c")]


def test_glossary_source(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("# comment\n特工\tAgent\n\n探员  agent\n特工\tAgent\n", encoding="utf-8")
    lines = readers.numbered_lines(spark, str(tmp_path / "g.tsv"))
    assert rows(readers.glossary(lines)) == [(1, "特工", "Agent"), (3, "探员", "agent")]
    bad = spark.createDataFrame([(0, "甲\tX"), (1, "乙\tX")], "line int, text string")
    with pytest.raises(Exception, match="two targets of X"):
        readers.glossary(bad).collect()


def test_progress_source(spark):
    df = spark.createDataFrame([('{"schema_version": 2, "translations": {"1": "b", "0": " ", "2": "c"}}',)], "j string")
    assert rows(readers.translations(readers.parsed_json(df, "j", readers.PROGRESS, 2))) == [(1, "b"), (2, "c")]
    with pytest.raises(Exception, match="schema version"):
        readers.parsed_json(df, "j", readers.PROGRESS, 3).collect()


def test_word_source(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>ce</w:t></w:r><w:r><w:t>ll</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    got = [(r.block, r.place, r.style, r.text) for r in readers.word_blocks(spark, str(tmp_path)).orderBy("block").collect()]
    assert got == [(0, "body", "Heading1", "Top"), (1, "table", "", "cell")]
    files = readers.listing(spark, str(tmp_path))
    assert [(r.top, r.files) for r in readers.folder_sizes(files, str(tmp_path)).collect()] == [("a.docx", 1)]


def test_report_and_preserved_markdown(spark):
    items = spark.createDataFrame([(2, "b|c"), (1, "a")], "page_num int, title string")
    text = sinks.markdown_report(items, "T", ["page_num", "title"], [F.col("page_num")]).first().text
    assert text.split("\n") == ["# T", "", "- items: 2", "- pages: 2", "", "| page_num | title |", "| --- | --- |", "| 1 | a |", "| 2 | b\\|c |"]
    blocks = spark.createDataFrame([(1, 0, "# A", True), (1, 1, "", False)], "id int, block int, content string, translatable boolean")
    done = spark.createDataFrame([(1, 0, "# 甲")], "id int, block int, text string")
    assert sinks.preserved_markdown(blocks, done).first().text == "# 甲\n"
    with pytest.raises(Exception, match="no translation"):
        sinks.preserved_markdown(blocks, done.where("false")).collect()
    assert rows(sinks.json_lines(items)) == [('{"page_num":1,"title":"a"}',), ('{"page_num":2,"title":"b|c"}',)]


def test_word_text_boxes(spark, tmp_path):
    from vellumite.sources import word

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    box = "<w:p><w:r><w:pict><w:txbxContent><w:p><w:r><w:rPr><w:b/><w:sz w:val='21'/><w:rFonts w:ascii='A'/><w:color w:val='FF0000'/></w:rPr><w:t> in </w:t></w:r><w:r><w:t>side</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p>"
    for name, body in (("a.docx", box * 2), ("sub/b.docx", "<w:p><w:r><w:t>none</w:t></w:r></w:p>"), ("c.docx", box)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "note.txt").write_text("no Word file")
    df = word.word_text_boxes(spark, f"file://{tmp_path}")
    got = sorted((r.path.rsplit("/", 1)[1], r.block, r.textbox, r.para, r.text) for r in df.collect())
    assert got == [("a.docx", 0, 0, 0, "in side"), ("a.docx", 1, 0, 2, "two"), ("a.docx", 2, 1, 0, "in side"), ("a.docx", 3, 1, 2, "two"), ("c.docx", 0, 0, 0, "in side"), ("c.docx", 1, 0, 2, "two")]
    first = df.where("block = 0").first().runs[0]
    assert (first.text, first.bold, first.italic, first.font, first.size, first.color) == (" in ", True, False, "A", 10.5, "FF0000")
    assert df.rdd.getNumPartitions() == 1
    assert spark.read.format("word_textboxes").option("filesPerPartition", 1).load(f"file://{tmp_path}").rdd.getNumPartitions() == 3
