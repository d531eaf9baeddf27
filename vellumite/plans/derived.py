"""Relations that stand for pages, translations, boxes and reports, each derived from a driver's table by SQL that Spark and DuckDB both read.

Every row of a table gives a row: texts are the table's own with marks, gaps and translations put in by the row's key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vellumite.tables import dealt, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
_HAN = "特工们慢慢地穿过废弃的车站，远处的雷声滚过山谷，没有人回答。"
_ROMAN = {1: "i", 4: "iv", 5: "v", 9: "ix", 10: "x", 40: "xl", 50: "l"}


def pick(index: str, *options: str) -> str:
    """One of the SQL expressions by a number from 0."""
    return f"CASE CAST({index} AS INT) " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def _words(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


def _text(c: str) -> str:
    return f"CAST({c} AS STRING)"


_ROWS = "(SELECT l_partkey AS page, l_orderkey AS k, l_suppkey AS s, l_linenumber AS n, l_quantity AS q, l_returnflag AS f, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem) r"
_TURN = "substr(text, 1, 30)"

RELATIONS = {
    "sheet_texts": f"""SELECT doc_id AS page_index, {pick("doc_id % 9", "''", f"'Roll 1d6 and lose 1/1d6 SAN. The Armor ' || {_text('doc_id % 7')} || ' vest stops 40% of STR damage at ' || {_text('doc_id % 30')} || ' m. ' || substr(text, 1, 200)",
        f"'Firearms 40% and Dodge 30%, DEX 12. HP ' || {_text('doc_id % 5')}", *["text"] * 6)} AS source, {pick("doc_id % 5", *_words("toc", "art", "handout", "", ""))} AS layout FROM documents WHERE doc_id % 11 <> 3""",
    "sheet_translations": f"""SELECT doc_id AS page_index, {pick("doc_id % 7", "text", "'[Translation failed: ' || source || ']'", f"repeat('{_HAN}', CAST(3 + doc_id % 20 AS INT))", "''",
        f"'掷 1d6，失去 1/1d6 SAN。护甲 ' || {_text('doc_id % 4')} || ' 背心挡住 40% 的力量伤害。'", f"repeat('{_HAN}', 4) || substr(text, 1, 400)", "'Firearms 40%，闪避 30%，敏捷 12'")} AS translation FROM documents WHERE doc_id % 13 <> 5""",
    "sheet_failures": "SELECT doc_id AS page_index, CASE WHEN doc_id % 34 = 0 THEN '' ELSE 'API timeout' END AS failed_reason FROM documents WHERE doc_id % 17 = 0",
    "leaks": f"""SELECT conv_id * 100 + turn AS id, {pick("(conv_id + turn) % 3", "'WARNING: ' || text", "'STR: ' || text", "text")} AS source, {pick("(conv_id * 3 + turn) % 11", "'WARNING: 留下'", f"'翻译规则如下：' || {_TURN}", f"{_TURN} || 'かな'", "'他说【……】走了'",
        "'[ Damaged ]'", "'STR: 1'", "'严格遵循术语表，保持上下文'", "'严格遵循术语表'", _TURN, "''", "'（省略三行）' || text")} AS translation FROM conversations""",
    "glossary": f"SELECT o_orderkey AS ord, {pick('o_orderkey % 5', *_words('特工', '探员', '绿色', '实体', '手表'))} AS target, 'term ' || {_text('o_custkey % 700')} || o_orderstatus AS term FROM orders",
    "bench_terms": f"""SELECT item_id AS ord, {pick("item_id % 5", "split_part(text, ' ', 2)", "split_part(text, ' ', 2) || '  ' || split_part(text, ' ', 3)", "upper(split_part(text, ' ', 4)) || ' ' || split_part(text, ' ', 5) || ' ' || split_part(text, ' ', 6)", "'(' || split_part(text, ' ', 5) || ')'",
        "split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4)")} AS term, 't' || {_text("item_id")} AS target FROM benchmark""",
    "exact_labels": f"SELECT l_orderkey * 10 + l_linenumber AS id, {pick('l_suppkey % 5', *_words(' | ', '', ': ', '：', ' '))} || {pick('l_quantity % 2', 'upper(l_returnflag)', 'lower(l_returnflag)')} || {_text('l_partkey % 300')} || {pick('l_linenumber % 4', *_words(' ', ':', '|', ''))} AS text FROM lineitem",
    "label_book": f"SELECT 'r' || {_text('p_partkey')} AS term, p_name AS target FROM part UNION ALL SELECT 'A' || {_text('p_partkey')}, p_name FROM part WHERE p_partkey % 3 = 0",
    "misread": f"""SELECT doc_id AS id, substr(text, 1, 12) AS target, {pick("doc_id % 4", "replace(substr(text, 1, 12), 'o', '0')", "replace(replace(substr(text, 1, 12), 'e', '3'), 'l', '1')", "replace(substr(text, 1, 12), 'S', '5')", "substr(text, 2, 12)")} AS candidate, CAST(doc_id % 3 AS INT) AS max_edits FROM documents""",
    "sentences": f"""SELECT doc_id AS page_index, {pick("doc_id % 3", "'D-1: the agents arrive. Nothing happens. The next dawn they leave. ' || substr(text, 1, 100)", f"'Monday at 10:30 AM the call comes. Night ' || {_text('doc_id % 4')} || ' is quiet? Day 4 is not. Monday at 10:30 AM the call comes.'", "substr(text, 1, 200)")} AS source,
        {pick("doc_id % 4", "''", "'第二天，他们来到车站。 午夜时分有人敲门！ 没有。'", "''", "'dusk falls. ' || substr(text, 1, 60)")} AS translation FROM documents""",
    "lines": f"""SELECT conv_id AS page_index, CAST(turn AS INT) AS line_no, {pick("turn % 4", _TURN, "'中文' || substr(text, 1, 5)", "substr(text, 1, 12) || '行'", "'- ' || substr(text, 1, 9)")} AS line, turn % 4 = 3 AS structural FROM conversations""",
    "heads": "SELECT conv_id AS doc, turn AS page_index, CASE WHEN (conv_id + turn) % 3 = 0 THEN substr(text, 1, 10) WHEN (conv_id + turn) % 3 = 1 THEN '' END AS heading, CASE WHEN turn % 5 = 3 THEN 'toc' ELSE '' END AS layout FROM conversations",
    "answers": f"""SELECT doc_id AS id, 'intro [BLOCK 0]
first
[/BLOCK 0] [BLOCK ' || {_text('1 + doc_id % 4')} || '] ' || substr(text, 1, 40) || ' [/BLOCK ' || {_text('1 + doc_id % 4')} || '][BLOCK 3]
 three [/BLOCK 3] [BLOCK 4] open' AS response FROM documents""",
    "cards": f"""SELECT doc_id AS id, {pick("doc_id % 3", "'[CARD] ' || source || chr(10) || '[/CARD] b' || chr(10) || '[CARD]' || substr(text, 1, 9) || chr(10) || '[/CARD]'", "'none [CARD]x[/CARD]' || chr(10) || '## ' || lang || chr(10) || 'Roll 1d6. Lose SAN! Roll 1d6. Nothing'",
        f"'[STAT_BLOCK]' || chr(10) || 'STR ' || {_text('doc_id % 18')} || chr(10) || '[/STAT_BLOCK]' || chr(10) || 'Lose ' || {_text('doc_id % 9')} || ' HP! plain'")} AS text FROM documents""",
    "marks": f"SELECT doc_id AS id, {pick('doc_id % 4', *_words('# ', ' ##   ', '#', '##### '))} || source || '  x' || chr(10) || lang || chr(10) || '#### ' || {_text('doc_id')} AS text FROM documents",
    "line_kinds": f"""SELECT conv_id * 100 + turn AS id, {pick("(conv_id * 7 + turn) % 17", "'# **' || substr(text, 1, 6) || '** ## title'", "'[CARD]'", f"'- ' || {_TURN}", "substr(text, 1, 10)", "'这里有' || substr(text, 1, 4) || '吗？'", "'| a | ' || substr(text, 1, 5) || ' |'", "'> | --- | :---: |'",
        f"'STR 10 CON ' || {_text('turn')} || ' HP 12'", "text", "''", "'CONTENTS // CONTENTS'", "'| --- |'", f"'技能：隐匿 STR ' || {_text('turn')}", "'12 STR 标题'", _text("conv_id"), "'1. ' || substr(text, 1, 8)", "'| |'")} AS line FROM conversations""",
    "line_forms": f"""SELECT conv_id * 100 + turn AS id, {pick("(conv_id * 5 + turn) % 16", _text("turn"), "'d10'", "'iv – ix.'", "' [卡片] '", "'[/图片]'", "'WROTH HEADNG；' || substr(text, 1, 9)", "'BADLY READ  [原文损坏] x'", "'**甲乙。**化名：丙 年龄：3 职业：' || role", "'甲乙：化名：丙 年龄'", "text",
        "substr(text, 1, 20)", "role || '_timeline.md'", "role || '.pdf'", "''", "'1234'", "'x - 2'")} AS line, {pick("turn % 5", *_words("header", "footer", "title", "body", "footer"))} AS role, {pick("conv_id % 4", *_words("body", "running_header", "section", "body"))} AS font_role, conv_id % 3 = 0 AS accent FROM conversations""",
    "chunked": f"""SELECT doc_id AS id, 'intro' || chr(10) || ' ' || chr(10) || substr(text, 1, 40) || chr(10) || {pick("doc_id % 9", "''", "'[/CARD]'", "'[CARD]' || chr(10) || 'a'", "' [STAT_BLOCK] ' || chr(10) || 'STR ' || source || chr(10) || chr(10) || 'x' || chr(10) || '[/STAT_BLOCK]'",
        "'[CARD]' || chr(10) || '[IMAGE]' || chr(10) || '[/CARD]'", "'[CARD]' || chr(10) || '[/CARD]' || chr(10) || '[IMAGE]' || chr(10) || lang || chr(10) || '[/IMAGE]'", "lang", "'p' || chr(10) || chr(10) || chr(10) || 'q'", "'[CARD]' || chr(10) || 'z' || chr(10) || '[/IMAGE]'")} || chr(10) || 'end' AS text FROM documents""",
    "headed": f"""SELECT doc_id AS id, '# One' || chr(10) || chr(10) || {pick("doc_id % 5", "'# ' || lang", "'## ' || lang", "substr(text, 1, 20)", "'# Ends.'", "''")} || chr(10) || ' ' || chr(10) || '# ' || source || chr(10) || chr(10) || 'body' || chr(10) || chr(10) || '### a' || chr(10) || chr(10) || '### b' AS text FROM documents""",
    "specs": f"SELECT o_orderkey AS id, {pick('o_orderkey % 4', *(f'{_text(a)} || {b}' for a, b in (('1 + o_custkey % 9', _words(', 12-15')[0]), ('5 + o_custkey % 3', _words('-3 3')[0]), ('1 + o_custkey % 4', _words('，2、4')[0]), ('9', _words('')[0]))))} AS spec, 20 AS total FROM orders",
    "state_rows": "SELECT o_orderkey AS id, o_orderstatus AS value FROM orders WHERE o_orderkey % 3 > 0",
    "state_changes": f"SELECT o_orderkey AS id, o_orderstatus || {_text('o_custkey')} AS value FROM orders WHERE o_orderkey % 3 < 2",
    "meta_expected": f"SELECT 'k' || {_text('o_orderkey')} AS key, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS value FROM orders",
    "meta_stored": f"SELECT 'k' || {_text('o_orderkey')} AS key, CASE WHEN o_orderkey % 7 > 0 THEN 'F' END AS value FROM orders WHERE o_orderkey % 4 > 0",
    "blocks": "SELECT CAST(conv_id * 100 + turn AS STRING) AS block_id, conv_id AS unit_id, CASE WHEN (conv_id + turn) % 9 = 4 THEN ' ' ELSE text END AS text FROM conversations",
    "done_blocks": "SELECT CAST(conv_id * 100 + turn AS STRING) AS block_id, CASE WHEN turn % 5 = 1 THEN '*' WHEN turn % 5 = 2 THEN 'changed' ELSE text END AS text FROM conversations WHERE conv_id % 3 > 0 OR turn % 2 = 0",
    "usage": f"SELECT {pick('user_id % 4', *_words('small', 'large', 'none', 'other'))} AS model, event_id % 900 AS input_tokens, event_id % 70 AS output_tokens, event_id % 300 AS cached_tokens, event_id % 4 AS api_calls FROM events",
    "prices": "SELECT CASE n_nationkey WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE n_name END AS model, CAST(1 + n_nationkey * 7 AS DOUBLE) AS input_per_m, CAST(4 + n_nationkey * 28 AS DOUBLE) AS output_per_m, 0.25 + n_nationkey AS cached_per_m FROM nation",
    "issues": f"SELECT o_orderkey AS id, CAST(o_orderkey % 50 AS INT) AS page_num, {pick('o_custkey % 4', *_words('failed', 'missing', 'glossary_miss', 'odd'))} AS kind, {_text('o_custkey')} AS message, o_orderstatus AS detail FROM orders",
    "review": f"SELECT o_custkey % 97 AS report, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_custkey % 40 AS INT) END AS page_num, {pick('o_orderkey % 4', *_words('时间线', '术语疑点', '规则符号', '问题页索引'))} AS category, {_text('o_orderkey')} AS title FROM orders",
    "texts": f"SELECT page * 1000 + pos AS id, page, CAST(s % 4 AS INT) AS seq, {pick('s % 3', *_words('same text', 'same  text', 'tiny'))} || CASE WHEN s % 5 = 4 THEN f ELSE '' END AS text, CAST(k * 37 % 500 AS DOUBLE) AS x0, CAST(k * 53 % 700 AS DOUBLE) AS y0, k * 37 % 500 + 20 + q AS x1, k * 53 % 700 + 10 + q AS y1 FROM {_ROWS} WHERE pos <= 12",
    "images": f"SELECT page, CAST(n % 5 AS INT) AS seq, CAST(k * 37 % 400 AS DOUBLE) - 20 AS x0, CAST(k * 53 % 600 AS DOUBLE) - 20 AS y0, k * 37 % 400 + q * 9 AS x1, k * 53 % 600 + q * 9 AS y1 FROM {_ROWS} WHERE pos > 12",
    "boxes": f"SELECT page * 1000 + pos AS id, page, CAST(s % 3 * 150 AS DOUBLE) AS x0, CAST(k * 53 % 700 AS DOUBLE) AS y0, s % 3 * 150 + 60 + q * 8 AS x1, k * 53 % 700 + 10.0 AS y1 FROM {_ROWS}",
    "spans": f"SELECT page AS line, pos AS span_no, {pick('s % 5', *_words('Hi', 'LongText', '', ' x ', 'aa'))} AS text, {pick('k % 3', *_words('Serif', 'Sans', 'Mono'))} AS font, CAST(8 + n AS DOUBLE) AS font_size FROM {_ROWS}",
    "covered": f"SELECT page AS id, CAST(k % 300 AS INT) AS begin, CAST(k % 300 + q AS INT) AS stop FROM {_ROWS}",
    "sizes": "SELECT p_partkey AS id, CAST(200 + p_partkey % 200 AS INT) AS n FROM part",
    "base_layout": f"SELECT o_orderkey AS page_index, {pick('o_custkey % 5', *_words('toc', 'single', 'columns', 'art', 'mixed'))} AS layout FROM orders WHERE o_orderkey % 4 > 0",
    "semantic_layout": f"SELECT o_orderkey AS page_index, {pick('o_custkey % 4', *_words('single', 'columns', 'cover', 'three_columns'))} AS layout FROM orders WHERE o_orderkey % 3 > 0",
    "labels_seen": f"SELECT c_custkey AS id, {pick('c_custkey % 2', 'upper(x)', 'x')} AS label FROM (SELECT c_custkey, repeat('m', CAST(c_custkey % 3 AS INT)) || {pick('c_custkey % 4', *_words('', 'cd', 'd', 'cm'))} || {pick('c_custkey % 5', *_words('', 'xl', 'l', 'xx', 'xc'))} || {pick('c_custkey % 6', *_words('i', 'iv', 'v', 'ix', 'iii', 'vii'))} AS x FROM customer) t",
    "sheets": "SELECT p_partkey AS page, CAST(600 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height, CAST(p_partkey % 7 AS DOUBLE) / 10 AS image_coverage FROM part",
    "regions": f"SELECT page, CAST(20 + s % 2 * 290 AS DOUBLE) AS x0, CAST(k * 53 % 600 AS DOUBLE) AS y0, CASE WHEN s % 5 = 0 THEN 580 ELSE 20 + s % 2 * 290 + 100 + q * 3 END AS x1, k * 53 % 600 + 10 + q * 5 AS y1 FROM {_ROWS} WHERE pos <= 1 + page % 7",
    "roles": f"""SELECT page * 1000 + pos AS id, CAST(k * 53 % 1000 AS DOUBLE) AS y0, k * 53 % 1000 + q AS y1, 7.0 + s % 22 AS size, n % 2 = 0 AS bold, n % 3 = 0 AS accent, {pick("k % 9", "'Running'", _text("s"), "'Red heading'", "'Big'", "'a note.'", "'- one' || chr(10) || '- two'", "'BOLD LINE'", "'A body line.'",
        "'a   b' || chr(10) || 'c   d' || chr(10) || 'e   f'")} AS text FROM {_ROWS}""",
    "flowing": f"SELECT CAST(page AS INT) AS page, CAST(pos AS INT) AS pos, CAST(9 + s % 3 AS DOUBLE) AS size, CAST(15 AS DOUBLE) AS pitch, CAST(40 + s % 7 * 2 AS DOUBLE) AS x0, CAST(pos * 14 + CASE WHEN k % 5 = 0 THEN 12 ELSE 0 END AS DOUBLE) AS y0, 300 + q AS x1, CAST(pos * 14 + 11 AS DOUBLE) AS y1 FROM {_ROWS}",
    "decisions": f"SELECT 'k' || {_text('o_orderkey')} AS term, o_orderstatus AS target, CASE WHEN o_custkey % 3 = 0 THEN 'ignore' WHEN o_orderkey % 2 = 0 THEN 'update' ELSE 'add' END AS action FROM orders WHERE o_orderkey % 3 = 0",
    "terms_now": f"SELECT 'k' || {_text('o_orderkey')} AS term, {_text('o_custkey')} AS target FROM orders WHERE o_orderkey % 2 = 0",
    "owners_expected": f"SELECT {_text('o_orderkey')} AS block_id, o_custkey % 9 AS page FROM orders",
    "owners": f"SELECT {_text('o_orderkey')} AS block_id, CASE WHEN o_orderkey % 8 = 0 THEN 99 ELSE o_custkey % 9 END AS page FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT {_text('o_orderkey')}, o_custkey % 9 FROM orders WHERE o_orderkey % 6 = 1",
    "page_labels": f"SELECT conv_id AS doc, turn AS page, CASE WHEN conv_id % 3 = 0 THEN {pick('turn % 6', *_words('iii', 'iv', 'v', 'vi', 'vii', 'x'))} WHEN turn % 4 = 3 THEN 'cover' ELSE {pick('conv_id % 2', *_words('', 'A'))} || {_text('turn + turn % 5')} END AS label FROM conversations",
    "overprinted": f"SELECT page AS id, pos, {pick('s % 2', *_words('a', 'b'))} AS text, CAST(n AS DOUBLE) AS luminance FROM {_ROWS}",
    "diary": f"SELECT conv_id AS id, turn AS pos, CASE WHEN turn % 3 = 1 THEN {_text('1 + turn')} || ' May 1925' ELSE substr(text, 1, 20) END AS text FROM conversations",
    "runs": f"SELECT {_text('o_orderkey')} AS run, o_custkey % 1000 * (o_orderkey % 4) AS input_tokens, o_custkey % 250 AS cached_tokens, CAST(o_custkey % 97 AS DOUBLE) / 8 AS cost_usd, o_orderkey % 5 AS translated_pages FROM orders",
    "styled": f"SELECT page AS id, pos, f AS text, CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bold, CASE WHEN page % 4 = 0 THEN NULL WHEN s % 2 = 0 THEN true END AS italic FROM {_ROWS} WHERE page % 5 > 0 OR n % 3 = 0",
    "tagged": f"SELECT doc_id AS id, {pick('doc_id % 7', *_words('a <strong>b <em>c</em></strong>', '<strong>x', '</em>', '<u>x</u>', '<em>a <strong>b</em></strong>', 'x <em class=y>y</em>', 'plain'))} || source AS text FROM documents",
}


def given(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    sql = RELATIONS[name]
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    tables = {t: table(spark, sf_dir, t) for t in used}
    if _ROWS in RELATIONS[name]:
        tables["lineitem"] = dealt(tables["lineitem"], "l_partkey")
    return spark.sql(sql, **tables)


def with_(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n]})" for n in names)
