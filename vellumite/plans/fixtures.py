"""Literal relations that Spark and DuckDB both read as written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ENGLISH = "The agents walked slowly through the abandoned station while distant thunder rolled across the valley and nobody answered. "
_HAN = "特工们慢慢地穿过废弃的车站，远处的雷声滚过山谷，没有人回答。"

FIXTURES = {
    "pages(page_index, source, layout)": f"""(0, 'Roll 1d6 and lose 1/1d6 SAN. The Armor 3 vest stops 40% of STR damage at 20 m.', ''), (1, 'Agent Smith waits.', ''), (2, '', ''),
        (3, '{_ENGLISH * 20}', ''), (4, '{_ENGLISH * 20}', ''), (5, '{_ENGLISH * 20}', 'toc'), (6, '{_ENGLISH * 3}', 'art'), (7, 'Firearms 40% and Dodge 30%, DEX 12', '')""",
    "translations(page_index, translation)": f"""(0, '掷 1d6，失去 1/1d6 SAN。护甲 5 背心挡住 40% 的力量伤害。'), (1, '[Translation failed: timeout]'), (3, '{_ENGLISH * 20}'), (4, '{_HAN * 8}'),
        (5, '{_HAN * 8}'), (6, '{_ENGLISH * 3}'), (7, 'Firearms 40%，闪避 30%，敏捷 12'), (8, '多余的一页')""",
    "failures(page_index, failed_reason)": "(2, 'API timeout'), (9, 'refused')",
    "glossary(ord, target, term)": "(1, '特工', 'Agent'), (2, '探员', 'agent'), (3, '绿色三角洲', 'Delta Green'), (4, '绿色', 'Green'), (5, '实体', 'entity'), (6, '手表', 'watch'), (7, '表', 'watch'), (8, '处理', 'handle')",
    "chunks(id, text)": "(1, 'Agent Smith met two agents of Delta Green.'), (2, 'Delta Green handles entities; the AGENT was watching watches.'), (3, 'An agent, a green light, Green Delta, Delta  Green.'), (4, '')",
    "misread(candidate, target, max_edits)": "('De1ta', 'Delta', 2), ('DE1TA', 'DELTA', 2), ('Agent', 'Agent', 2), ('0b5cure', 'Obscure', 2), ('0b5cure', 'Obscure', 1), ('Gr33n', 'Green', 2), ('8ooks', 'Books', 2), ('1l', 'lI', 2), ('a', 'ab', 2)",
    "sentences(page_index, source, translation)": """(0, 'D-1: the agents arrive. Nothing happens. The next dawn they leave', ''), (1, 'x', '第二天，他们来到车站。 午夜时分有人敲门！ 没有。'),
        (2, 'Monday at 10:30 AM the call comes. Monday at 10:30 AM the call comes. Night 3 is quiet? Day 4 is not.', '')""",
    "lines(page_index, line_no, line, structural)": "(0, 1, '# Title', true), (0, 2, 'one two', false), (0, 3, 'three', false), (0, 4, '中文', false), (0, 5, '行', false), (0, 6, '- item', true), (0, 7, 'tail', false), (1, 1, 'x', false)",
    "heads(page_index, heading, layout)": "(0, '', ''), (1, 'One', ''), (2, '', ''), (3, 'Contents', 'toc'), (4, '', ''), (5, 'Two', ''), (6, NULL, '')",
    "answers(id, response)": """(1, 'intro [BLOCK 0]
first
[/BLOCK 0] [BLOCK 1] second [/BLOCK 1]'), (2, '[BLOCK 3] a [/BLOCK 3][BLOCK 3] b [/BLOCK 3] [BLOCK 4] open'), (3, 'nothing')""",
    "cards(id, text)": """(1, 'a
[CARD] one
[/CARD] b
[CARD]two
lines
[/CARD]'), (2, 'none [CARD]x[/CARD]'), (3, '[STAT_BLOCK]
STR 10
[/STAT_BLOCK]
Roll 1d6. Lose SAN! Roll 1d6. Nothing')""",
    "marks(id, text)": """(1, '# A
text
 ## B  c
#no
##### Deep
#### Four'), (2, 'plain')""",
    "line_kinds(id, line)": """(1, '# **Bold** ## title'), (2, '[CARD]'), (3, '- item one'), (4, 'Short Head'), (5, '这里有什么人吗？'), (6, '| a | b |'), (7, '> | --- | :---: |'), (8, 'STR 10 CON 11 HP 12'),
        (9, 'An ordinary sentence, with punctuation.'), (10, ''), (11, 'CONTENTS // CONTENTS'), (12, 'Yellow Card number two'), (13, '技能：隐匿 STR 12'), (14, '12 STR 标题'), (15, '42')""",
    "specs(id, spec, total)": "(1, '8, 12-15', 20), (2, '5-3 3', 9), (3, '1，2、4', 4)",
    "state(id, value)": "(1, 'a'), (2, 'b'), (3, 'c')",
    "changes(id, value)": "(2, 'B'), (4, 'D')",
    "meta_expected(key, value)": "('model', 'm2'), ('glossary', 'g'), ('schema', '2'), ('hint', NULL)",
    "meta_stored(key, value)": "('model', 'm1'), ('schema', '2'), ('other', 'x')",
    "blocks(block_id, unit_id, text)": "('b1', 'u1', 'one'), ('b2', 'u1', 'two'), ('b3', 'u2', 'three'), ('b4', 'u2', '  '), ('b5', 'u3', 'five')",
    "done_blocks(block_id, text)": "('b1', 'one'), ('b2', 'changed'), ('b5', '*')",
    "issues(page_num, kind, message, detail)": "(2, 'failed', '翻译失败', 'timeout'), (3, 'glossary_miss', '术语可能未按表翻译', 'a'), (0, 'missing', '没有译文', ''), (5, 'odd', '?', '')",
    "review(page_num, category, title)": "(3, '时间线', 'b'), (CAST(NULL AS INT), '术语疑点', 'z'), (1, '规则符号', 'c'), (3, '时间线', 'a'), (CAST(NULL AS INT), '术语疑点', 'y'), (1, '问题页索引', 'd')",
    "usage(model, input_tokens, output_tokens, cached_tokens, api_calls)": "('small', 1000, 400, 250, 3), ('small', 3000, 100, 750, 2), ('large', 100, 10, 0, 1), ('none', 0, 0, 0, 0)",
    "prices(model, input_per_m, output_per_m, cached_per_m)": "('small', 1.0, 4.0, 0.25), ('large', 8.0, 32.0, 2.0)",
    "texts(id, page, seq, text, x0, y0, x1, y1)": "(1, 0, 1, 'same text', 0.0, 0.0, 100.0, 20.0), (2, 0, 3, 'same  text', 0.0, 50.0, 100.0, 70.0), (3, 0, 1, 'other', 200.0, 0.0, 300.0, 20.0), (4, 1, 1, 'alone here', 0.0, 0.0, 50.0, 10.0)",
    "images(page, seq, x0, y0, x1, y1)": "(0, 2, -10.0, -10.0, 95.0, 40.0), (0, 0, 0.0, 0.0, 500.0, 500.0), (1, 2, 25.0, 0.0, 80.0, 10.0)",
    "boxes(id, page, x0, y0, x1, y1)": "(1, 0, 10.0, 10.0, 590.0, 30.0), (2, 0, 320.0, 40.0, 580.0, 60.0), (3, 0, 10.0, 40.0, 280.0, 60.0), (4, 0, 10.0, 70.0, 280.0, 90.0), (5, 0, 10.0, 200.0, 590.0, 220.0), (6, 0, 330.0, 230.0, 580.0, 240.0), (7, 0, 10.0, 235.0, 280.0, 250.0)",
    "spans(line, span_no, text, font, font_size)": "(1, 1, 'Hi', 'Serif', 10.0), (1, 2, 'LongText', 'Sans', 20.0), (2, 1, 'aa', 'Mono', 8.0), (2, 2, 'bb', 'Sans', 9.0), (3, 1, '', 'Sans', 9.0)",
    "covered(id, begin, stop)": "(1, 2, 5), (1, 4, 9), (1, 12, 14), (2, 0, 10), (3, 3, 3)",
    "sizes(id, n)": "(1, 20), (2, 10), (3, 6), (4, 7)",
    "base_layout(page_index, layout)": "(0, 'toc'), (1, 'single'), (2, 'columns'), (3, 'art'), (4, 'single')",
    "semantic_layout(page_index, layout)": "(0, 'single'), (1, 'columns'), (2, 'cover'), (5, 'single')",
    "labels_seen(id, label)": "(1, 'IV'), (2, 'xii'), (3, 'MCMXCIV'), (4, 'iii')",
    "sheets(page, width, height, image_coverage)": "(0, 600.0, 800.0, 0.6), (1, 600.0, 800.0, 0.0), (2, 600.0, 800.0, 0.0), (3, 600.0, 800.0, 0.0), (4, 600.0, 800.0, 0.0), (5, 600.0, 800.0, 0.1)",
    "regions(page, x0, y0, x1, y1)": """(0, 0.0, 0.0, 50.0, 10.0), (1, 200.0, 100.0, 400.0, 150.0), (1, 210.0, 300.0, 390.0, 320.0), (2, 20.0, 100.0, 280.0, 500.0), (2, 320.0, 100.0, 580.0, 500.0),
        (3, 20.0, 20.0, 580.0, 60.0), (3, 20.0, 100.0, 280.0, 200.0), (3, 20.0, 220.0, 280.0, 300.0), (3, 320.0, 100.0, 580.0, 300.0), (4, 20.0, 20.0, 580.0, 100.0), (4, 20.0, 120.0, 580.0, 200.0),
        (4, 20.0, 220.0, 580.0, 300.0), (4, 20.0, 320.0, 580.0, 400.0)""",
    "roles(id, y0, y1, size, bold, accent, text)": """(1, 50.0, 100.0, 10.0, false, false, 'Running'), (2, 950.0, 960.0, 8.0, false, false, '12'), (3, 300.0, 320.0, 14.0, false, true, 'Red heading'), (4, 300.0, 340.0, 26.0, false, false, 'Big'),
        (5, 850.0, 860.0, 8.0, false, false, 'a note.'), (6, 300.0, 400.0, 10.0, false, false, '- one
- two'), (7, 300.0, 320.0, 12.0, true, false, 'Bold line'), (8, 300.0, 400.0, 10.0, false, false, 'A body line.')""",
    "flowing(page, pos, size, pitch, x0, y0, x1, y1)": """(0, 1, 9.0, 15.0, 45.8, 401.9, 515.8, 413.6), (0, 2, 9.0, 15.0, 54.3, 416.9, 524.3, 428.6), (0, 3, 9.0, 15.0, 60.0, 431.9, 530.0, 443.6), (0, 4, 9.0, 15.0, 45.8, 500.0, 200.0, 510.0),
        (0, 5, 14.0, 15.0, 45.8, 511.0, 200.0, 540.0)""",
    "decisions(term, target, action)": "('Agent', '干员', 'update'), ('Raven', '渡鸦', 'add'), ('agent', '?', 'ignore')",
    "terms_now(term, target)": "('Agent', '特工'), ('agent', '探员'), ('Green', '绿色')",
    "owners_expected(block_id, page)": "('a', 0), ('b', 0), ('c', 1), ('d', 1)",
    "owners(block_id, page)": "('a', 0), ('b', 0), ('b', 0), ('c', 0)",
    "page_labels(doc, page, label)": "(1, 0, 'iii'), (1, 1, 'iv'), (1, 2, 'v'), (1, 3, '1'), (1, 4, '2'), (1, 5, '4'), (2, 0, 'A1'), (2, 2, 'A2'), (2, 3, 'x')",
    "overprinted(id, pos, text, luminance)": "(1, 0, 'a', 10.0), (1, 1, 'a', 90.0), (1, 2, 'a', 90.0), (1, 3, 'b', 1.0), (1, 4, 'a', 0.0)",
    "diary(id, pos, text)": "(1, 0, 'before'), (1, 1, '1 May 1925'), (1, 2, 'they'), (1, 3, 'came'), (1, 4, '2 May 1925')",
    "runs(run, input_tokens, cached_tokens, cost_usd, translated_pages)": "('r', 1000, 250, 0.6, 3), ('z', 0, 0, 0.0, 0)",
    "styled(id, pos, text, bold, italic)": "(1, 0, 'a', NULL, NULL), (1, 1, 'b', true, NULL), (1, 2, 'c', true, true), (2, 0, 'x', true, NULL), (2, 1, 'y', true, NULL)",
    "tagged(id, text)": "(1, 'a <strong>b <em>c</em></strong>'), (2, '<strong>x'), (3, '</em>'), (4, '<u>x</u>')",
    "leaks(id, source, translation)": """(1, 'WARNING: stay', 'WARNING: 留下'), (2, 'a', '翻译规则如下：好'), (3, 'a', 'かな'), (4, 'a', '他说【……】走了'), (5, 'a', '[ Damaged ]'), (6, 'STR: 1', 'STR: 1'),
        (7, 'a', '严格遵循术语表，保持上下文'), (8, 'a', '严格遵循术语表'), (9, 'a', '好的'), (10, 'a', '')""",
    "exact_labels(id, text)": "(1, ' | Armor: '), (2, 'armor'), (3, 'Weapon'), (4, 'Green：')",
    "label_book(term, target)": "('Armor', '护甲'), ('green', '绿')",
}


def _split(head: str) -> tuple[str, str]:
    name, cols = head[:-1].split("(")
    return name, cols


def relation(name: str) -> str:
    """The relation as a common table expression."""
    for head, rows in FIXTURES.items():
        if _split(head)[0] == name:
            return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t({_split(head)[1]}))"
    raise KeyError(name)


def given(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"WITH {relation(name)} SELECT * FROM {name}")


def with_(*names: str) -> str:
    return "WITH " + ", ".join(relation(n) for n in names)
