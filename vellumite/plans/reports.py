"""Queries over texts, progress, dictionaries and report rows derived from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumite.functions import blocks as B
from vellumite.functions import lines as L
from vellumite.operators import columns, documents, hints, images, orders, pages, review, segments, state, terms
from vellumite.plans.catalogue import _FOUND, _found, query
from vellumite.plans.derived import given, with_
from vellumite.plans.layouts import _BLOCKS, _ROWS, _TITLE, _blocks, _merging, _rows
from vellumite.sources import readers, sinks, word
from vellumite.tables import table


@query(_FOUND + """,
t AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN '有目0' WHEN 1 THEN '有目1目2' ELSE 'none' END AS translation FROM documents),
x AS (SELECT id, term, ' 目' || length(target) % 3 || ' ' AS target FROM found)
SELECT DISTINCT x.id, term, target FROM x JOIN t ON t.id = x.id WHERE NOT contains(translation, trim(target))""")
def targets_missing(spark, sf_dir):
    k = F.col("doc_id") % 3
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(k == 0, "有目0").when(k == 1, "有目1目2").otherwise("none").alias("translation"))
    found = _found(spark, sf_dir).withColumn("target", F.concat(F.lit(" 目"), (F.length("target") % 3).cast("string"), F.lit(" ")))
    return terms.missing_targets(found, pairs)


@query(f"WITH {_BLOCKS} SELECT page, id, ({_TITLE}) AS title FROM b")
def title_cards(spark, sf_dir):
    c = F.col
    title = pages.is_title_card(c("text"), c("font_size"), c("median_size"), c("x0"), c("y0"), c("x1"), c("page_width"), c("page_height"))
    return _blocks(spark, sf_dir).select("page", "id", title.alias("title"))


@query("""
WITH b AS (SELECT conv_id AS id, turn AS block, CASE WHEN turn % 3 = 0 THEN text ELSE '译' || upper(substr(role, 1, 2)) || turn END AS t FROM conversations)
SELECT id, string_agg(t, chr(10) ORDER BY block) AS text FROM b GROUP BY id""")
def preserved_texts(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("block"), F.col("text").alias("content"), (F.col("turn") % 3 > 0).alias("translatable"), "role")
    made = df.where("translatable").select("id", "block", F.concat(F.lit("译"), F.upper(F.substring("role", 1, 2)), F.col("block").cast("string")).alias("text"))
    return sinks.preserved_markdown(df.drop("role"), made)


@query("""
WITH b AS (SELECT conv_id * 100 + turn - CASE WHEN turn % 6 = 5 THEN 1 ELSE 0 END AS block_id, conv_id * 10 + turn % 4 AS region_id, text AS source, CASE WHEN turn % 5 = 2 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM conversations),
r AS (SELECT DISTINCT conv_id * 10 + turn AS region_id FROM conversations WHERE turn % 4 > 0 OR conv_id % 2 = 0)
SELECT 'twice' AS problem, block_id FROM b GROUP BY block_id HAVING count(*) > 1 UNION ALL SELECT 'no region', block_id FROM b WHERE region_id NOT IN (SELECT region_id FROM r) UNION ALL SELECT 'stale', block_id FROM b WHERE sha256(source) <> h""")
def broken_references(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    df = table(spark, sf_dir, "conversations")
    stored = F.when(t % 5 == 2, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    blocks = df.select((c * 100 + t - F.when(t % 6 == 5, 1).otherwise(0)).alias("block_id"), (c * 10 + t % 4).alias("region_id"), F.col("text").alias("source"), stored.alias("source_hash"))
    return review.broken_references(blocks, df.where((t % 4 > 0) | (c % 2 == 0)).select((c * 10 + t).alias("region_id")).distinct())


@query(f"""
WITH {_BLOCKS}, f AS (SELECT page, n_lines, unnest(CASE id % 3 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['C'] ELSE []::VARCHAR[] END) AS font FROM b WHERE x1 - x0 <= 330 AND n_lines >= 3), n AS (SELECT page, font, sum(n_lines) AS n FROM f GROUP BY ALL)
SELECT page, font FROM n QUALIFY n >= max(n) OVER (PARTITION BY page) * 0.3""")
def body_fonts(spark, sf_dir):
    fonts = F.when(F.col("id") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).when(F.col("id") % 3 == 1, F.array(F.lit("C"))).otherwise(F.array().cast("array<string>"))
    return pages.body_fonts(_blocks(spark, sf_dir).select("page", (F.col("x1") - F.col("x0")).alias("width"), "page_width", "n_lines", fonts.alias("fonts")))


@query(f"""
WITH {_ROWS}, a AS (SELECT l_partkey AS page, degrees(atan2((l_suppkey % 3) * l_quantity, 100.0 * l_linenumber)) AS a, CASE WHEN l_suppkey % 4 = 0 THEN ' ' ELSE 'x' END AS text FROM r)
SELECT page, coalesce(round_even((avg(a) FILTER (abs(a) >= 0.5 AND trim(text) <> ''))::DECIMAL(18, 9), 2)::DOUBLE, 0) AS angle FROM a GROUP BY page""")
def page_angles(spark, sf_dir):
    lines = _rows(spark, sf_dir).select("page", (F.col("l_suppkey") % 3 * F.col("l_quantity")).alias("dy"), (F.lit(100.0) * F.col("l_linenumber")).alias("dx"), F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise("x").alias("text"))
    return pages.dominant_angle(lines, "page")


@query(f"""
WITH {_ROWS}, d AS (SELECT l_partkey AS page, line_no AS seq, CASE l_linenumber % 3 WHEN 0 THEN '#ffffff' WHEN 1 THEN '#00000' || l_suppkey % 9 END AS colour, (300.0 + l_quantity * 6) * (500.0 + l_quantity * 6) AS area FROM r)
SELECT p.page, arg_min(colour, seq) FILTER (colour <> '#ffffff' AND area >= 432000) AS colour FROM (SELECT DISTINCT l_partkey AS page FROM lineitem) p LEFT JOIN d ON d.page = p.page GROUP BY p.page""")
def page_backgrounds(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    colour = F.when(n % 3 == 0, "#ffffff").when(n % 3 == 1, F.concat(F.lit("#00000"), (F.col("l_suppkey") % 9).cast("string")))
    rows = _rows(spark, sf_dir)
    drawings = rows.select("page", F.col("line_no").alias("seq"), colour.alias("colour"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (q * 6 + 300).alias("x1"), (q * 6 + 500).alias("y1"))
    return pages.background(drawings, rows.select("page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).distinct())


@query(with_("sheet_texts", "sheet_translations", "sheet_failures") + """
SELECT count(*) AS n, count(d.page_index) AS n_done, count(f.page_index) AS n_failed, count(*) FILTER (trim(source) <> '') AS n_text
FROM sheet_texts s LEFT JOIN (SELECT page_index FROM sheet_translations WHERE translation <> '') d ON d.page_index = s.page_index LEFT JOIN sheet_failures f ON f.page_index = s.page_index""")
def progress_counts(spark, sf_dir):
    return state.progress_summary(given(spark, "sheet_texts", sf_dir).withColumnRenamed("source", "text"), given(spark, "sheet_translations", sf_dir).where("translation <> ''"), given(spark, "sheet_failures", sf_dir))


@query(f"""
WITH RECURSIVE {_ROWS}, i AS (SELECT l_partkey AS doc, line_no AS ord, [l_suppkey::VARCHAR, 'n' || l_orderkey % 9] AS b FROM r WHERE line_no <= 12),
f AS (SELECT doc, ord, b, true AS ok, b AS owned FROM i WHERE ord = 1
  UNION ALL SELECT i.doc, i.ord, i.b, NOT list_has_any(owned, i.b), CASE WHEN list_has_any(owned, i.b) THEN owned ELSE owned || i.b END FROM f JOIN i ON i.doc = f.doc AND i.ord = f.ord + 1)
SELECT doc, ord::INT AS ord, array_to_string(b, ',') AS blocks FROM f WHERE ok""")
def repair_groups(spark, sf_dir):
    blocks = F.array(F.col("l_suppkey").cast("string"), F.concat(F.lit("n"), (F.col("l_orderkey") % 9).cast("string")))
    df = _rows(spark, sf_dir).where("line_no <= 12").select(F.col("page").alias("doc"), F.col("line_no").cast("int").alias("ord"), blocks.alias("blocks"))
    return review.first_owner_groups(df).withColumn("blocks", F.array_join("blocks", ","))


@query(with_("cards") + """,
s AS (SELECT id, unnest(t) AS e, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT id, string_split(regexp_replace(regexp_replace(text, '([。.!?！？])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS t FROM cards)),
q AS (SELECT id, pos, trim(regexp_replace(e, '\\s+', ' ', 'g')) AS e FROM s WHERE regexp_matches(e, '(?i)\\b\\d+d\\d+\\b|\\bSAN\\b|\\bHP\\b|\\bWP\\b|检定|技能|损失|roll|test')),
r AS (SELECT id, min(pos) AS pos, arg_min(e, pos) AS excerpt FROM q GROUP BY id, lower(e))
SELECT id, pos::INT AS pos, excerpt FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 12""")
def rule_references(spark, sf_dir):
    return segments.rule_references(given(spark, "cards", sf_dir))


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY try_cast(v AS INT) IS NULL, try_cast(v AS INT), v, event_id)::INT AS ord FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE (event_id % 150)::VARCHAR END AS v FROM events)""")
def results_in_order(spark, sf_dir):
    v = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise((F.col("event_id") % 150).cast("string"))
    df = table(spark, sf_dir, "events").select("event_id", "user_id", v.alias("v"))
    return orders.numbered(df, ["user_id"], [*orders.numeric_first("v"), F.col("event_id")]).select("event_id", "ord")


@query(with_("answers") + """,
f AS (SELECT id, list_distinct(list_transform(regexp_extract_all(response, '(?s)\\[BLOCK (\\d+)\\]', 1), lambda x: x::INT)) AS f FROM answers)
SELECT id, array_to_string(list_sort(list_filter([0, 1, 3, 7], lambda x: NOT list_contains(f, x))), ',') AS missing, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains([0, 1, 3, 7], x))), ',') AS extra FROM f""")
def marker_differences(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all("response", F.lit("\\[BLOCK (\\d+)\\]"), F.lit(1)).cast("array<int>"))
    ids = segments.marker_ids(F.array(*(F.lit(x) for x in (0, 1, 3, 7))), found)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return given(spark, "answers", sf_dir).select("id", ids.alias("d")).select("id", text("d.missing").alias("missing"), text("d.extra").alias("extra"))


@query("SELECT conv_id, turn, regexp_replace(t, '(?s)\\[IMAGE\\].*?\\[/IMAGE\\]', '', 'g') AS text FROM (SELECT conv_id, turn, role || CASE turn % 3 WHEN 0 THEN '[IMAGE]' || text || '[/IMAGE] x [IMAGE][/IMAGE]' ELSE text END || 'end' AS t FROM conversations)")
def without_images(spark, sf_dir):
    t = F.concat("role", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[IMAGE]"), "text", F.lit("[/IMAGE] x [IMAGE][/IMAGE]"))).otherwise(F.col("text")), F.lit("end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", segments.without_images(t).alias("text"))


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace(trim(t), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x)), '/') AS cells FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' | ' || p_name || ' | b |' WHEN 1 THEN '||' || p_name WHEN 2 THEN p_name ELSE '| --- |:-: |' END AS t FROM part)""")
def table_line_cells(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    t = F.when(k % 4 == 0, F.concat(F.lit(" | "), n, F.lit(" | b |"))).when(k % 4 == 1, F.concat(F.lit("||"), n)).when(k % 4 == 2, n).otherwise("| --- |:-: |")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(segments.table_cells(t), "/").alias("cells"))


_RAW = "CASE doc_id % 3 WHEN 0 THEN replace(text, 'th', 'th-' || chr(10) || '  ') WHEN 1 THEN chr(10) || doc_id || chr(10) || replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)) ELSE replace(text, ' a', '   a') END"


def _raw():
    k, t, nl = F.col("doc_id"), F.col("text"), "\n"
    return F.when(k % 3 == 0, F.replace(t, F.lit("th"), F.lit("th-\n  "))).when(k % 3 == 1, F.concat(F.lit(nl), k.cast("string"), F.lit(nl), F.replace(t, F.lit(". "), F.lit("." + nl * 4)))).otherwise(F.replace(t, F.lit(" a"), F.lit("   a")))


@query(f"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace({_RAW}, '([\\p{{L}}\\p{{M}}\\p{{N}}_])-\\s*\\n\\s*([\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1\\2', 'g'), '  +', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^\\s*\\d{{1,3}}\\s*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM a)
SELECT doc_id, sha256(trim(t, ' ' || chr(10) || chr(9) || chr(13))) AS text FROM b""")
def cleaned_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(B.cleaned(_raw()).cast("binary"), 256).alias("text"))


@query("""
WITH t AS (SELECT doc_id, source || '_' || lang || CASE doc_id % 4 WHEN 0 THEN ' upload full proof 12' WHEN 1 THEN ' - the ' || substr(text, 1, 30) WHEN 2 THEN ' 0123abcdef99 · more.pdf' ELSE '  z-library.org CN' END AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(t, '_+', ' ', 'g')), '(?i)\\b(?:upload|z-library(?:\\.[a-z]+)?|1lib(?:\\.[a-z]+)?|z-lib(?:\\.[a-z]+)?|full proof \\d+)\\b', '', 'g'), '(?i)\\bcn\\b$', '', 'g'), '(?i)\\b[a-f0-9]{8,}\\b', '', 'g') AS t FROM t),
b AS (SELECT doc_id, CASE WHEN contains(t, ' - ') THEN trim(regexp_extract(t, '(?s)^.*? - (.*)$', 1)) ELSE t END AS t FROM a),
c AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '[.·]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM b)
SELECT doc_id, left(trim(trim(regexp_replace(CASE WHEN len(p) > 0 AND NOT regexp_matches(t, '[一-鿿]') THEN p[1] ELSE t END, '\\s+', ' ', 'g')), ' ._-'), 32) AS title FROM c""")
def header_titles(spark, sf_dir):
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, " upload full proof 12").when(k == 1, F.concat(F.lit(" - the "), F.substring("text", 1, 30))).when(k == 2, " 0123abcdef99 · more.pdf").otherwise("  z-library.org CN")
    return table(spark, sf_dir, "documents").select("doc_id", B.header_title(F.concat("source", F.lit("_"), "lang", tail)).alias("title"))


@query("""
SELECT doc_id, regexp_replace(substr(text, 1, 40) || '/é x', '[^A-Za-z0-9._-]+', '_', 'g') AS stem, left(coalesce(list_filter(list_transform(string_split(chr(10) || '  ' || chr(10) || text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')[1], ''), 80) AS first_line,
  replace(replace(substr(text, 1, 300) || '|', '|', '\\|'), chr(10), ' ') AS cell, '"' || replace(replace(substr(text, 1, 200) || '"\\', '\\', '\\\\'), '"', '\\"')[:-1].replace(chr(10), '\\n') || '"' AS json FROM documents""")
def text_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", B.safe_stem(F.concat(F.substring(t, 1, 40), F.lit("/é x"))).alias("stem"), B.first_content_line(F.concat(F.lit("\n  \n"), t)).alias("first_line"), sinks.cell(F.concat(F.substring(t, 1, 300), F.lit("|"))).alias("cell"),
        B.json_string(F.concat(F.substring(t, 1, 200), F.lit('"\\'))).alias("json"),
    )


@query("""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'toc' ELSE '' END AS layout, '[CARD]' || chr(10) || '> ' || substr(text, 1, 400) || chr(10) || '| a | b |' || chr(10) || lang || chr(10) || '[/CARD]' AS t FROM documents),
l AS (SELECT doc_id, layout, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x NOT IN ('[CARD]', '[/CARD]') AND NOT regexp_matches(x, '^\\|.*\\|')) AS l FROM t),
j AS (SELECT doc_id, layout, array_to_string(list_transform(l, lambda x: CASE WHEN x LIKE '>%' THEN trim(regexp_replace(x, '^>+', '')) ELSE x END), chr(10)) AS t FROM l),
c AS (SELECT doc_id, layout, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([\\p{L}\\p{M}\\p{N}_])-\\s*\\n\\s*([\\p{L}\\p{M}\\p{N}_])', '\\1\\2', 'g'), '  +', ' ', 'g'), '(?m)^\\s*\\d{1,3}\\s*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM j)
SELECT doc_id, CASE WHEN layout = 'toc' THEN '' ELSE right(trim(t, ' ' || chr(10) || chr(9)), 1200) END AS context FROM c""")
def page_contexts(spark, sf_dir):
    t = F.concat(F.lit("[CARD]\n> "), F.substring("text", 1, 400), F.lit("\n| a | b |\n"), "lang", F.lit("\n[/CARD]"))
    return table(spark, sf_dir, "documents").select("doc_id", B.context_text(t, F.when(F.col("doc_id") % 6 == 0, "toc").otherwise("")).alias("context"))


@query(f"""
WITH {_ROWS}, u AS (SELECT l_partkey AS block_id, line_no AS pos, CASE WHEN l_suppkey % 5 = 0 THEN ' ' ELSE l_returnflag END AS text, l_linenumber % 2 = 0 AS bold, l_suppkey % 3 = 0 AS italic FROM r WHERE line_no <= 1 + l_partkey % 4),
s AS (SELECT block_id, count(*) FILTER (trim(text) <> '') AS n, bool_or(italic) FILTER (trim(text) <> '') AND NOT bool_and(italic) FILTER (trim(text) <> '') AS i, bool_or(bold) FILTER (trim(text) <> '') AND NOT bool_and(bold) FILTER (trim(text) <> '') AS b FROM u GROUP BY block_id),
t AS (SELECT *, CASE block_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<em>x</em>' WHEN 2 THEN '<strong>x</strong>' ELSE 'x' END AS t FROM s WHERE n >= 2 AND block_id % 7 > 0),
a AS (SELECT block_id % 50 AS page, block_id, concat_ws('、', CASE WHEN i AND NOT contains(t, '<em>') THEN '斜体' END, CASE WHEN b AND NOT contains(t, '<strong>') THEN '粗体' END) AS absent FROM t WHERE t <> '')
SELECT * FROM a WHERE absent <> ''""")
def emphasis_missing(spark, sf_dir):
    k = F.col("block_id")
    runs = _rows(spark, sf_dir).where("line_no <= 1 + page % 4").select(
        F.col("page").alias("block_id"), F.col("line_no").alias("pos"), F.when(F.col("l_suppkey") % 5 == 0, " ").otherwise(F.col("l_returnflag")).alias("text"), (F.col("l_linenumber") % 2 == 0).alias("bold"), (F.col("l_suppkey") % 3 == 0).alias("italic")
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    text = F.when(k % 4 == 0, "").when(k % 4 == 1, "<em>x</em>").when(k % 4 == 2, "<strong>x</strong>").otherwise("x")
    blocks = runs.groupBy("block_id").agg(whole.alias("source")).select("block_id", (k % 50).alias("page"), F.when(k % 7 > 0, F.col("source")).otherwise("other").alias("source"), text.alias("translation"))
    return documents.missing_emphasis(runs, blocks)


@query(with_("bench_terms") + """
SELECT d.doc_id AS id, string_agg('- ' || term || ' -> ' || target, chr(10) ORDER BY ord) AS section FROM documents d JOIN bench_terms b ON b.ord % 7 = d.doc_id % 7 WHERE term NOT IN (SELECT term FROM bench_terms WHERE ord % 5 = 0) GROUP BY d.doc_id""")
def prompt_sections(spark, sf_dir):
    t = given(spark, "bench_terms", sf_dir)
    relevant = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("k")).join(t.withColumn("k", F.col("ord") % 7), "k").select("id", F.col("ord").alias("match_rank"), "term", "target")
    return review.prompt_terms(relevant, t.where("ord % 5 = 0"))


@query("""
WITH c AS (SELECT conv_id * 100 + turn AS key, CASE turn % 4 WHEN 0 THEN ' ' WHEN 1 THEN text || 'かな' WHEN 2 THEN '翻译规则如下' || text ELSE text END AS value, turn FROM conversations)
SELECT o_orderkey AS id, value FROM orders JOIN c ON c.key = o_orderkey % 5000 WHERE turn % 4 = 3""")
def cached_answers(spark, sf_dir):
    t = F.col("turn") % 4
    cache = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.when(t == 0, " ").when(t == 1, F.concat("text", F.lit("かな"))).when(t == 2, F.concat(F.lit("翻译规则如下"), "text")).otherwise(F.col("text")).alias("value"))
    return state.cached_answers(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5000).alias("key")), cache)


@query("""
WITH s AS (SELECT doc_id AS page_index, text FROM documents), g AS (SELECT text FROM s WHERE page_index IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT 'state' AS part, page_index AS id FROM s WHERE page_index NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'cache', page_index FROM s WHERE text NOT IN (SELECT text FROM g)""")
def cleared_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_index"), "text")
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_index"))
    left, cache = state.cleared(d, d.select(F.col("page_index").alias("key"), F.col("text").alias("value")), gone)
    return left.select(F.lit("state").alias("part"), F.col("page_index").alias("id")).union(cache.select(F.lit("cache"), "key"))


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id % 3 = 1 AND turn % 2 = 0")
def loaded_progress(spark, sf_dir):
    meta = F.map_from_arrays(F.array(F.lit("model"), F.lit("glossary")), F.array((F.col("conv_id") % 3).cast("string"), (F.col("turn") % 2).cast("string")))
    wanted = spark.sql("SELECT * FROM VALUES ('model', '1'), ('glossary', '0') AS t(key, value)")
    return state.loaded(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", meta.alias("meta")), wanted)


@query("SELECT conv_id AS id, string_agg('[BLOCK ' || turn || ']' || chr(10) || text || chr(10) || '[/BLOCK ' || turn || ']', chr(10) || chr(10) ORDER BY turn) AS request FROM conversations GROUP BY conv_id")
def block_requests(spark, sf_dir):
    return segments.built_blocks(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("block"), "text"))


@query(with_("issues") + """SELECT '{"id":' || id || ',"page_num":' || page_num || ',"kind":"' || kind || '","message":"' || message || '","detail":null}' AS value FROM issues""")
def issue_lines(spark, sf_dir):
    return sinks.json_lines(given(spark, "issues", sf_dir).withColumn("detail", F.lit(None).cast("string")))


@query("SELECT p_partkey AS ord, trim(p_name) AS target, 'term ' || p_partkey AS term FROM part WHERE p_partkey % 5 > 1")
def dictionary_lines(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    term = F.concat(F.lit("term "), k.cast("string"))
    text = F.when(k % 5 == 0, F.concat(F.lit("# "), n)).when(k % 5 == 1, n).when(k % 5 == 2, F.concat(n, F.lit("\t"), term, F.lit("\tnote"))).otherwise(F.concat(F.lit(" "), n, F.lit("   "), term))
    return readers.glossary(table(spark, sf_dir, "part").select(k.alias("line"), text.alias("text")))


@query("SELECT turn AS page_index, role || conv_id AS text FROM conversations WHERE turn % 4 > 0")
def stored_translations(spark, sf_dir):
    t = F.when(F.col("turn") % 4 == 0, " ").otherwise(F.concat("role", F.col("conv_id").cast("string")))
    doc = F.concat(F.lit('{"schema_version": 2, "translations": {"'), F.col("turn").cast("string"), F.lit('": "'), t, F.lit('"}}'))
    return readers.translations(readers.parsed_json(table(spark, sf_dir, "conversations").select(doc.alias("j")), "j", readers.PROGRESS, 2))


_REGIONS = f"{_ROWS}, g AS (SELECT l_partkey AS page, line_no AS id, 600.0::DOUBLE AS pw, 20.0::DOUBLE + l_suppkey % 2 * 290 + l_orderkey % 40 AS x0, (l_orderkey * 53 % 700)::DOUBLE AS y0, 20.0::DOUBLE + l_suppkey % 2 * 290 + l_orderkey % 40 + CASE WHEN l_linenumber = 7 THEN 450 ELSE 190 + l_quantity END AS x1, (l_orderkey * 53 % 700)::DOUBLE + 20 AS y1, CASE l_linenumber WHEN 1 THEN 'subsection' WHEN 2 THEN 'display' ELSE 'body' END AS font_role, CASE WHEN l_suppkey % 9 = 0 THEN 'header' ELSE 'body_column' END AS role FROM r)"
_GUTTER = """
s AS (SELECT page, CASE WHEN x1 - x0 <= 390 AND (x0 + x1) / 2 < 252 THEN 0 WHEN x1 - x0 <= 390 AND (x0 + x1) / 2 > 348 THEN 1 END AS side, x0, x1 FROM g),
m AS (SELECT page, count(*) AS n, list_sort(list(x1) FILTER (side = 0)) AS l, list_sort(list(x0) FILTER (side = 1)) AS r FROM s GROUP BY page),
u AS (SELECT page, CASE WHEN n >= 3 AND r[len(r) // 2 + 1] > l[len(l) // 2 + 1] THEN (l[len(l) // 2 + 1] + r[len(r) // 2 + 1]) / 2 END AS gutter FROM m)"""


def _column_regions(spark, sf_dir):
    k, s, n = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x0, y0 = s % 2 * 290 + k % 40 + 20.0, (k * 53 % 700).cast("double")
    return _rows(spark, sf_dir).select(
        "page", F.col("line_no").alias("id"), F.lit(600.0).alias("page_width"), x0.alias("x0"), y0.alias("y0"), (x0 + F.when(n == 7, 450.0).otherwise(F.col("l_quantity") + 190)).alias("x1"), (y0 + 20).alias("y1"),
        F.when(n == 1, "subsection").when(n == 2, "display").otherwise("body").alias("font_role"), F.when(s % 9 == 0, "header").otherwise("body_column").alias("role"), F.when(F.col("page") % 4 == 0, "single").otherwise("columns").alias("page_type"),
    )


@query(f"WITH {_REGIONS}, {_GUTTER} SELECT page, gutter FROM u")
def page_gutters(spark, sf_dir):
    return columns.gutters(_column_regions(spark, sf_dir), "page")


@query(f"""
WITH {_REGIONS}, {_GUTTER},
c AS (SELECT g.*, CASE WHEN font_role = 'display' OR font_role = 'subsection' AND abs((x0 + x1) / 2 - 300) <= 48 OR gutter IS NULL OR x1 - x0 >= 390 THEN NULL WHEN (x0 + x1) / 2 < gutter THEN 'left' ELSE 'right' END AS side FROM g JOIN u ON u.page = g.page WHERE g.page % 4 > 0 AND role <> 'header')
SELECT page, side, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c WHERE side IS NOT NULL GROUP BY page, side""")
def column_boxes(spark, sf_dir):
    r = _column_regions(spark, sf_dir)
    return columns.column_boxes(r, columns.gutters(r, "page"), "page")


@query(f"""
WITH {_REGIONS}, i AS (SELECT page, y0, y1 + 200 AS y1 FROM (SELECT page, x0 + 100 AS x0, y0, x1 + 100 AS x1, y1 FROM g WHERE id <= 3) WHERE x1 - x0 >= 108 AND y1 + 200 - y0 >= 144 AND NOT (x1 - x0 >= 540 AND y1 + 200 - y0 >= 720) AND x0 < 300 AND x1 > 300 AND y0 > 32 AND y1 + 200 < 768)
SELECT DISTINCT g.page, g.id FROM g JOIN i ON i.page = g.page WHERE role = 'body_column' AND g.id % 5 > 0 AND greatest(least(g.y1, i.y1) - greatest(g.y0, i.y0), 0) / least(g.y1 - g.y0, i.y1 - i.y0) >= 0.12""")
def blocks_beside_images(spark, sf_dir):
    r = _column_regions(spark, sf_dir).withColumn("layout_mode", F.when(F.col("id") % 5 > 0, "paragraph").otherwise("positioned"))
    images = r.where("id <= 3").select("page", "page_width", F.lit(800.0).alias("page_height"), (F.col("x0") + 100).alias("x0"), "y0", (F.col("x1") + 100).alias("x1"), (F.col("y1") + 200).alias("y1"))
    return columns.beside_images(r, images, "page")


@query(f"""
WITH {_ROWS}, b AS (SELECT l_partkey AS page, line_no AS pos, 'b' || line_no AS id, CASE WHEN l_suppkey % 3 = 0 THEN 'display' ELSE 'body' END AS font_role, CASE WHEN l_suppkey % 7 = 1 THEN 'quote' ELSE 'body_column' END AS role, CASE l_linenumber % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'he end' WHEN 2 THEN ' é ' ELSE 'and so ' END AS text,
    40.0::DOUBLE + l_orderkey % 3 AS x0, line_no * 12.0::DOUBLE + l_quantity % 6 AS y0, 200.0::DOUBLE + l_quantity AS x1, line_no * 12.0::DOUBLE + 10 AS y1 FROM r),
l AS (SELECT *, coalesce(font_role = 'display' AND regexp_full_match(trim(text), '\\p{{L}}') AND lead(font_role) OVER w = 'body' AND regexp_matches(lead(text) OVER w, '^\\p{{Ll}}') AND x0 <= lead(x0) OVER w AND y0 <= lead(y0) OVER w + 2, false) AS leads FROM b WINDOW w AS (PARTITION BY page ORDER BY pos)),
f AS (SELECT *, coalesce(lag(leads) OVER w, false) OR NOT leads AND coalesce(font_role = 'body' AND role = 'body_column' AND y0 - lag(y1) OVER w <= 4, false) AS goes FROM l WINDOW w AS (PARTITION BY page ORDER BY pos)),
g AS (SELECT *, sum((NOT goes)::INT) OVER (PARTITION BY page ORDER BY pos) AS grp FROM f), c AS (SELECT *, first_value(leads) OVER (PARTITION BY page, grp ORDER BY pos) AS cap FROM g)
SELECT page, min(pos) AS pos, arg_min(id, pos) AS id, cap AS drop_cap, count(*) AS n, CASE WHEN cap THEN max(trim(text)) FILTER (leads) || string_agg(trim(text), ' ' ORDER BY pos) FILTER (NOT leads) ELSE first(text) END AS text,
  min(x0) FILTER (NOT (cap AND leads)) AS x0, min(y0) FILTER (NOT (cap AND leads)) AS y0, max(x1) FILTER (NOT (cap AND leads)) AS x1, max(y1) FILTER (NOT (cap AND leads)) AS y1 FROM c GROUP BY page, CASE WHEN cap THEN grp ELSE -pos END, cap""")
def drop_caps(spark, sf_dir):
    n, s, i = F.col("l_linenumber"), F.col("l_suppkey"), F.col("line_no")
    text = F.when(n % 4 == 0, "T").when(n % 4 == 1, "he end").when(n % 4 == 2, " é ").otherwise("and so ")
    blocks = _rows(spark, sf_dir).select(
        "page", i.alias("pos"), F.concat(F.lit("b"), i.cast("string")).alias("id"), F.when(s % 3 == 0, "display").otherwise("body").alias("font_role"), F.when(s % 7 == 1, "quote").otherwise("body_column").alias("role"), text.alias("text"),
        (F.col("l_orderkey") % 3 + 40.0).alias("x0"), (i * 12.0 + F.col("l_quantity") % 6).alias("y0"), (F.col("l_quantity") + 200.0).alias("x1"), (i * 12.0 + 10).alias("y1"),
    )
    return columns.with_drop_caps(blocks, "page")


@query(with_("line_forms") + """,
s AS (SELECT *, trim(line) AS s, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS q FROM line_forms), d AS (SELECT *, trim(regexp_replace(q, '^[A-Z�][A-Za-z�\\-\\]\\s]{3,}[一-鿿]{0,4}[；;]\\s*', '')) AS d1, regexp_replace(regexp_replace(s, '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '\\s+', '', 'g') AS e FROM s)
SELECT id, regexp_full_match(line, '\\s*(?:\\d{1,3}|[dD]\\d+|[ivxlcdmIVXLCDM]+)(?:\\s*[-–—]\\s*(?:\\d{1,3}|[ivxlcdmIVXLCDM]+))?[.)、:]?\\s*') AS roll, role = 'header' OR font_role = 'running_header' AS header, role = 'footer' AND regexp_full_match(s, '\\p{Nd}+') AS number,
  role IN ('title', 'subtitle') OR font_role IN ('display', 'section', 'subsection', 'callout') OR q <> '' AND length(q) <= 48 AND accent AS heading, coalesce(map {'[卡片]': '[CARD]', '[/图片]': '[/IMAGE]', '[属性块]': '[STAT_BLOCK]'}[s], s) AS marker,
  trim(regexp_replace(d1, '^[A-Z�][A-Za-z�\\-\\]\\s]{3,}?(\\s*\\[原文损坏\\])', '\\1')) AS mended, regexp_matches(e, '^[一-鿿A-Za-z·.'' -]{2,32}[。.:：]化名[：:]') AND contains(e, '年龄') AND (contains(e, '职业') OR contains(e, '外貌特征')) AS dossier,
  regexp_matches(line, '\\.(pdf|html|docx|zip|md)$') AND NOT regexp_matches(line, '_(extraction_report|glossary_report|glossary_candidates|quality_report|risk_workbench|rule_symbols|timeline|word_review|prep_checklist|module_structure|run_report)\\.md$') AS result FROM d""")
def line_forms(spark, sf_dir):
    c = F.col("line")
    return given(spark, "line_forms", sf_dir).select(
        "id", L.is_roll_marker(c).alias("roll"), L.is_running_header(F.col("role"), F.col("font_role")).alias("header"), L.is_page_number(F.col("role"), c).alias("number"), L.is_short_heading(F.col("role"), F.col("font_role"), c, F.col("accent")).alias("heading"),
        L.canonical_marker(c).alias("marker"), L.without_damage(c).alias("mended"), L.is_dossier_entry(c).alias("dossier"), L.is_result_file(c).alias("result"),
    )


@query(with_("page_labels") + """,
k AS (SELECT doc, page, label, CASE WHEN regexp_matches(label, '\\d+$') THEN 'n' WHEN regexp_full_match(label, '[ivxlcdm]+') THEN 'r' END AS kind, regexp_extract(label, '^(.*?)(\\d+)$', 1) AS p, coalesce(try_cast(regexp_extract(label, '(\\d+)$', 1) AS INT), map {'iii': 3, 'iv': 4, 'v': 5, 'vi': 6, 'vii': 7, 'x': 10}[label]) AS v FROM page_labels)
SELECT a.doc, a.page, coalesce(a.kind = b.kind AND a.p = b.p AND b.v = a.v + 1, false) AS follows FROM k a JOIN k b ON b.doc = a.doc AND b.page = a.page + 1""")
def labels_follow(spark, sf_dir):
    df = given(spark, "page_labels", sf_dir)
    after = df.select("doc", (F.col("page") - 1).alias("page"), F.col("label").alias("after"))
    return df.join(after, ["doc", "page"]).select("doc", "page", review.labels_follow(F.col("label"), F.col("after")).alias("follows"))


_DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>outside</w:t></w:r></w:p>{}</w:body></w:document>'


def _word_files(parts):
    """Word files (path, content) out of their paragraphs' XML (path, xml)."""
    import io
    import zipfile

    for pdf in parts:
        made = []
        for xml in pdf["xml"]:
            with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
                z.writestr("word/document.xml", _DOCX.format(xml))
            made.append(buffer.getvalue())
        yield pdf[["path"]].assign(content=made)


@query("""
WITH b AS (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS box FROM conversations),
p AS (SELECT conv_id, box, 0 AS para, 'role ' || turn AS text, turn % 2 = 0 AS bold FROM b UNION ALL SELECT conv_id, box, 2, 'end' || turn, NULL FROM b WHERE turn % 3 > 0)
SELECT 'c' || conv_id || '.docx' AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY box, para) - 1)::INT AS block, box::INT AS textbox, para::INT AS para, text, bold FROM p""")
def word_boxes(spark, sf_dir):
    t = F.col("turn").cast("string")
    run = lambda x, style="": F.concat(F.lit(f"<w:r>{style}<w:t xml:space='preserve'>"), x, F.lit("</w:t></w:r>"))
    bold = F.when(F.col("turn") % 2 == 0, "<w:rPr><w:b/></w:rPr>").otherwise("<w:rPr><w:sz w:val='21'/></w:rPr>")
    first = F.concat(F.lit("<w:p><w:r>"), bold, F.lit("<w:t xml:space='preserve'> role </w:t></w:r>"), run(t), F.lit("</w:p><w:p/>"))
    last = F.when(F.col("turn") % 3 > 0, F.concat(F.lit("<w:p>"), run(F.concat(F.lit("end"), t)), F.lit("</w:p>"))).otherwise("<w:p> </w:p>")
    box = F.concat(F.lit("<w:p><w:r><w:pict><w:txbxContent>"), first, last, F.lit("</w:txbxContent></w:pict></w:r></w:p>"))
    xml = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", box.alias("x")))), lambda x: x["x"]), "")
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(xml.alias("xml")).select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".docx")).alias("path"), "xml").mapInPandas(_word_files, "path string, content binary")
    return word.text_boxes(files).withColumn("bold", F.get("runs", F.lit(0))["bold"]).drop("runs")


@query(f"""
WITH {_ROWS}, l AS (SELECT l_partkey AS page, line_no, CASE l_orderkey % 7 WHEN 0 THEN ' 12 ' WHEN 1 THEN 'MAY 12 (night)' WHEN 2 THEN 'june 3' WHEN 3 THEN repeat('long ', 12) ELSE 'Line' END AS t, 6.0::DOUBLE + l_suppkey % 20 AS size, l_linenumber % 2 = 0 AS bold, l_suppkey % 8 = 0 AS accent, CASE WHEN l_linenumber = 3 THEN 5.0 END AS angle,
  (l_orderkey * 53 % 790)::DOUBLE AS y0, (l_orderkey * 53 % 790)::DOUBLE + 10 AS y1, (l_orderkey * 37 % 400)::DOUBLE AS x0, (l_orderkey * 37 % 400)::DOUBLE + 100 AS x1 FROM r),
k AS (SELECT *, CASE WHEN y1 <= 68 AND abs(coalesce(angle, 0)) < 1 THEN 'running_header/header' WHEN y0 >= 720 AND regexp_full_match(trim(t), '\\d+') THEN 'footer/footer' WHEN size >= 25 * 0.85 AND size >= 15.5 THEN 'display/title' WHEN accent AND (size >= 11.5 OR length(trim(t)) <= 48 AND bold) THEN 'section/subtitle'
  WHEN bold AND regexp_full_match(trim(t), '(?i)(?:JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)\\s+\\d{{1,2}}(?:\\s+\\([^)]+\\))?') THEN 'subsection/subtitle' WHEN size >= 17.5 THEN 'section/subtitle'
  WHEN size >= 11.5 AND length(trim(t)) <= 72 AND bold THEN CASE WHEN y0 >= 600 AND abs((x0 + x1) / 2 - 300) <= 60 THEN 'callout/subtitle' ELSE 'subsection/subtitle' END ELSE 'body/body_column' END AS k FROM l)
SELECT page, line_no, k AS kind FROM k""")
def line_classes(spark, sf_dir):
    k, s = F.col("l_orderkey"), F.col("l_suppkey")
    text = F.when(k % 7 == 0, " 12 ").when(k % 7 == 1, "MAY 12 (night)").when(k % 7 == 2, "june 3").when(k % 7 == 3, "long " * 12).otherwise("Line")
    x0, y0 = (k * 37 % 400).cast("double"), (k * 53 % 790).cast("double")
    df = _rows(spark, sf_dir).withColumns({"x0": x0, "y0": y0, "x1": x0 + 100, "y1": y0 + 10, "page_width": F.lit(600.0), "page_height": F.lit(800.0), "median_size": F.lit(10.0), "max_size": F.lit(25.0)})
    kind = hints.line_class(text, s % 20 + 6.0, F.col("l_linenumber") % 2 == 0, s % 8 == 0, F.when(F.col("l_linenumber") == 3, 5.0), usual_accents=False)
    return df.select("page", "line_no", kind.alias("k")).select("page", "line_no", F.concat_ws("/", "k.font_role", "k.role").alias("kind"))


@query(f"""
WITH {_ROWS}, l AS (SELECT l_partkey AS block, line_no, CASE l_suppkey % 8 WHEN 0 THEN ' • Title ' || l_linenumber WHEN 1 THEN l_orderkey % 900 || '' WHEN 2 THEN 'Chapter ' || l_returnflag || ' ....... ' || l_orderkey % 90 WHEN 3 THEN 'Joined' || l_orderkey % 90 WHEN 4 THEN 'CONTENTS' WHEN 5 THEN ' ' WHEN 6 THEN '- Some  title' ELSE 'dashes---- 7' END AS line FROM r),
c AS (SELECT block, line_no, trim(regexp_replace(regexp_replace(line, '^[\\s•*\\-]+', ''), '\\s+', ' ', 'g')) AS t FROM l),
d AS (SELECT *, CASE WHEN regexp_full_match(t, '\\d{{1,4}}') THEN 'number' WHEN regexp_full_match(t, '(.+?)(?:\\.{{3,}}|-{{3,}}|\\s{{2,}}|\\s+)(\\d{{1,4}})') THEN 'inline' WHEN regexp_full_match(t, '(.*[A-Za-z][^\\d]*?)(\\d{{1,4}})') THEN 'compact' ELSE 'plain' END AS kind FROM c WHERE t NOT IN ('', 'CONTENTS')),
e AS (SELECT *, lag(kind) OVER w AS bk, lag(t) OVER w AS bt, lead(kind) OVER w AS ak FROM d WINDOW w AS (PARTITION BY block ORDER BY line_no)),
f AS (SELECT block, line_no, CASE kind WHEN 'number' THEN CASE WHEN bk = 'plain' THEN bt || ' ........ ' || t ELSE t END WHEN 'plain' THEN CASE WHEN coalesce(ak, '') <> 'number' THEN t END
  WHEN 'inline' THEN trim(regexp_replace(regexp_extract(t, '^(.+?)(?:\\.{{3,}}|-{{3,}}|\\s{{2,}}|\\s+)(\\d{{1,4}})$', 1), '[.\\-]{{3,}}\\s*$', ''), ' -') || ' ........ ' || regexp_extract(t, '(\\d{{1,4}})$', 1) ELSE trim(regexp_extract(t, '^(.*[A-Za-z][^\\d]*?)(\\d{{1,4}})$', 1), ' -') || ' ........ ' || regexp_extract(t, '^(.*[A-Za-z][^\\d]*?)(\\d{{1,4}})$', 2) END AS e FROM e)
SELECT block, coalesce(string_agg(e, chr(10) ORDER BY line_no), '') AS entries FROM f GROUP BY block""")
def contents_blocks(spark, sf_dir):
    k, s, n = F.col("l_orderkey"), F.col("l_suppkey") % 8, F.col("l_linenumber").cast("string")
    text = lambda c: c.cast("string")
    line = F.when(s == 0, F.concat(F.lit(" • Title "), n)).when(s == 1, text(k % 900)).when(s == 2, F.concat(F.lit("Chapter "), "l_returnflag", F.lit(" ....... "), text(k % 90))).when(s == 3, F.concat(F.lit("Joined"), text(k % 90)))
    line = line.when(s == 4, "CONTENTS").when(s == 5, " ").when(s == 6, "- Some  title").otherwise("dashes---- 7")
    return hints.contents_entries(_rows(spark, sf_dir).select(F.col("page").alias("block"), "line_no", line.alias("line")), "block")


@query(f"""
WITH {_ROWS}, c AS (SELECT DISTINCT l_partkey AS page, c.col, CASE WHEN c.col = 'left' THEN 20.0 ELSE 310.0 END::DOUBLE AS x0, 50.0::DOUBLE AS y0, CASE WHEN c.col = 'left' THEN 290.0 ELSE 580.0 END::DOUBLE AS x1, 760.0::DOUBLE AS y1 FROM lineitem, (VALUES ('left'), ('right')) AS c(col)),
b AS (SELECT l_partkey AS page, CASE WHEN l_suppkey % 2 = 0 THEN 'left' ELSE 'right' END AS col, line_no, (l_orderkey * 53 % 700 + 40)::DOUBLE AS y0, (l_orderkey * 53 % 700 + 40)::DOUBLE + l_quantity AS y1 FROM r WHERE l_linenumber < 6),
p AS (SELECT l_partkey AS page, (l_orderkey * 37 % 500)::DOUBLE AS x0, (l_orderkey * 53 % 700 + 40)::DOUBLE AS y0, (l_orderkey * 37 % 500)::DOUBLE + l_quantity * 3 AS x1, (l_orderkey * 53 % 700 + 40)::DOUBLE + 30 AS y1 FROM r WHERE l_linenumber >= 6),
o AS (SELECT c.page, c.col, p.y0, p.y1, row_number() OVER (PARTITION BY c.page, c.col ORDER BY p.y0, p.y1) - 1 AS section FROM c JOIN p ON p.page = c.page AND p.y1 > c.y0 AND p.y0 < c.y1 AND least(c.x1, p.x1) - greatest(c.x0, p.x0) >= least(c.x1 - c.x0, p.x1 - p.x0) * 0.2),
s AS (SELECT b.*, (SELECT count(*) FROM o WHERE o.page = b.page AND o.col = b.col AND (b.y0 + b.y1) / 2 >= o.y1) AS section FROM b),
g AS (SELECT page, col, section, count(*) AS n, min(y0) AS top, max(y1) AS low FROM s GROUP BY ALL),
e AS (SELECT g.page, g.col, g.section::INT AS section, n, c.x0, greatest(c.y0, top) AS y0, c.x1, least(c.y1, greatest(low, coalesce(o.y0, c.y1) - 3)) AS y1 FROM g JOIN c ON c.page = g.page AND c.col = g.col LEFT JOIN o ON o.page = g.page AND o.col = g.col AND o.section = g.section)
SELECT *, CASE WHEN y1 <= y0 THEN 'no height' END AS error FROM e""")
def column_sections(spark, sf_dir):
    k, q, n = F.col("l_orderkey"), F.col("l_quantity"), F.col("l_linenumber")
    rows = _rows(spark, sf_dir)
    left = F.col("col") == "left"
    cols = rows.select("page").distinct().select("page", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("col")).select("page", "col", F.when(left, 20.0).otherwise(310.0).alias("x0"), F.lit(50.0).alias("y0"), F.when(left, 290.0).otherwise(580.0).alias("x1"), F.lit(760.0).alias("y1"))
    x0, y0 = (k * 37 % 500).cast("double"), (k * 53 % 700 + 40).cast("double")
    blocks = rows.where("l_linenumber < 6").select("page", F.when(F.col("l_suppkey") % 2 == 0, "left").otherwise("right").alias("col"), x0.alias("x0"), y0.alias("y0"), (x0 + 10).alias("x1"), (y0 + q).alias("y1"))
    return hints.column_sections(cols, blocks, rows.where(n >= 6).select("page", x0.alias("x0"), y0.alias("y0"), (x0 + q * 3).alias("x1"), (y0 + 30).alias("y1")), "page")


@query("""
WITH b AS (SELECT conv_id AS page, CASE WHEN conv_id % 2 = 0 THEN 'columns' ELSE 'single' END AS page_type, turn AS id, text <> '' AS translatable FROM conversations)
SELECT page, CASE WHEN page % 3 = 0 AND page % 6 > 0 THEN 'art' ELSE page_type END AS page_type, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN page % 4 = 1 AND id % 2 = 0 THEN 100 - id END NULLS LAST, id) - 1 AS place, translatable AND NOT (page % 5 = 2 AND id % 3 = 1) AS translatable FROM b""")
def hinted_pages(spark, sf_dir):
    c, t = F.col("page"), F.col("id")
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.when(F.col("conv_id") % 2 == 0, "columns").otherwise("single").alias("page_type"), F.col("turn").alias("id"), F.col("turn").alias("pos"), (F.col("text") != "").alias("translatable"))
    page_hints = b.where(c % 3 == 0).select("page", F.when(c % 6 > 0, "art").alias("page_type")).distinct()
    return hints.hinted_pages(b, page_hints, b.where((c % 5 == 2) & (t % 3 == 1)), b.where((c % 4 == 1) & (t % 2 == 0)).select("page", "id", (100 - t).alias("pos")), "page").withColumn("place", F.col("place").cast("bigint"))


@query(f"""
WITH {_ROWS}, m AS (SELECT l_partkey AS page, 'c' || l_suppkey % 3 AS col, line_no AS id, l_linenumber AS region FROM r),
g AS (SELECT l_partkey AS page, l_linenumber AS region, min(l_quantity) AS x0, min(l_orderkey % 700)::DOUBLE AS y0, max(l_quantity) + 100 AS x1, max(l_orderkey % 700)::DOUBLE + 20 AS y1 FROM r WHERE l_linenumber < 7 GROUP BY ALL)
SELECT m.page, col, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, 'no box of block ' || min(CASE WHEN x0 IS NULL THEN id::VARCHAR END) AS error FROM m LEFT JOIN g ON g.page = m.page AND g.region = m.region GROUP BY m.page, col""")
def hinted_columns(spark, sf_dir):
    rows, k = _rows(spark, sf_dir), F.col("l_orderkey") % 700
    blocks = rows.select("page", F.col("line_no").alias("id"), F.col("l_linenumber").alias("region_id"))
    members = rows.select("page", F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("col"), F.col("line_no").alias("id"))
    regions = rows.where("l_linenumber < 7").groupBy("page", F.col("l_linenumber").alias("region_id")).agg(F.min("l_quantity").alias("x0"), F.min(k.cast("double")).alias("y0"), (F.max("l_quantity") + 100).alias("x1"), (F.max(k.cast("double")) + 20).alias("y1"))
    return hints.hinted_columns(members, blocks, regions, "page")


_IMAGES = f"""{_ROWS}, t AS (SELECT l_partkey AS page, line_no AS id, (l_orderkey * 37 % 560)::DOUBLE AS x0, (l_orderkey * 53 % 760)::DOUBLE AS y0, (l_orderkey * 37 % 560)::DOUBLE + l_quantity AS x1, (l_orderkey * 53 % 760)::DOUBLE + 12 AS y1, repeat('w', l_linenumber::INT * l_linenumber::INT - 1) AS text, l_suppkey % 5 AS s FROM r WHERE line_no > 6),
i AS (SELECT l_partkey AS page, (l_orderkey * 37 % 400)::DOUBLE AS x0, (l_orderkey * 53 % 600)::DOUBLE AS y0, (l_orderkey * 37 % 400)::DOUBLE + l_quantity * 5 + 100 AS x1, (l_orderkey * 53 % 600)::DOUBLE + l_quantity * 4 + 60 AS y1, line_no FROM r WHERE line_no <= 6)"""
_AREA, _OVER = "greatest({0}.x1 - {0}.x0, 0) * greatest({0}.y1 - {0}.y0, 0)", "greatest(least({0}.x1, {1}.x1) - greatest({0}.x0, {1}.x0), 0) * greatest(least({0}.y1, {1}.y1) - greatest({0}.y0, {1}.y0), 0)"


def _images(spark, sf_dir):
    k, q, n = F.col("l_orderkey"), F.col("l_quantity"), F.col("l_linenumber")
    rows, sheet = _rows(spark, sf_dir), [F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height")]
    x, y = (k * 37 % 560).cast("double"), (k * 53 % 760).cast("double")
    texts = rows.where("line_no > 6").select("page", F.col("line_no").alias("id"), x.alias("x0"), y.alias("y0"), (x + q).alias("x1"), (y + 12).alias("y1"), F.repeat(F.lit("w"), (n * n - 1).cast("int")).alias("text"), F.col("l_suppkey").alias("s"))
    u, v = (k * 37 % 400).cast("double"), (k * 53 % 600).cast("double")
    return texts, rows.where("line_no <= 6").select("page", *sheet, u.alias("x0"), v.alias("y0"), (u + q * 5 + 100).alias("x1"), (v + q * 4 + 60).alias("y1"), "line_no")


@query(f"""
WITH {_IMAGES} SELECT DISTINCT t.page, id FROM t JOIN i ON i.page = t.page WHERE s <> 1 AND length(text) BETWEEN 1 AND 3 AND {_AREA.format('i')} > 9600 AND {_AREA.format('i')} < 432000 AND {_OVER.format('t', 'i')} / ({_AREA.format('t')}) >= 0.35
UNION SELECT page, id FROM t WHERE s = 2""")
def overlay_texts(spark, sf_dir):
    texts, pictures = _images(spark, sf_dir)
    texts = texts.withColumn("text", F.when(F.length("text") == 3, F.lit("xy")).otherwise(F.col("text"))).withColumn("role", F.when(F.col("s") % 5 == 1, "title").otherwise("body_column"))
    return images.overlay_texts(texts.withColumn("layout_mode", F.when(F.col("s") % 5 == 2, "image_overlay_text")), pictures, "page")


@query(f"""
WITH RECURSIVE {_IMAGES}, f AS (SELECT DISTINCT page, x0, y0, x1, y1 FROM i WHERE line_no > 1 AND {_AREA.format('i')} BETWEEN 12000 AND 264000 AND x1 - x0 >= 120 AND y1 - y0 >= 64 AND NOT ((x0 <= 2 OR y0 <= 2 OR x1 >= 598 OR y1 >= 798) AND {_AREA.format('i')} > 28800)),
k AS (SELECT page, x0, y0, x1 - 60 AS x1, y1 FROM i WHERE line_no = 1 AND page % 3 = 0),
o AS (SELECT f.page, f.x0, f.y0, f.x1, f.y1, count(*) FILTER (h) AS n, coalesce(sum(length(text)) FILTER (h), 0) AS chars, sum(c) AS over, coalesce(sum(length(text)) FILTER (c > 0 AND c / greatest(ta, 1) >= 0.15), 0) AS lying
  FROM (SELECT f.page, f.x0, f.y0, f.x1, f.y1, text, (t.x0 + t.x1) / 2 >= f.x0 AND (t.x0 + t.x1) / 2 < f.x1 AND (t.y0 + t.y1) / 2 >= f.y0 AND (t.y0 + t.y1) / 2 < f.y1 AS h, {_OVER.format('t', 'f')} AS c, {_AREA.format('t')} AS ta FROM f JOIN t ON t.page = f.page WHERE text <> '') f GROUP BY ALL),
b AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.page = f.page AND {_OVER.format('f', 'k')} / greatest(least({_AREA.format('f')}, {_AREA.format('k')}), 1) > 0.2)
  AND NOT EXISTS (SELECT 1 FROM o WHERE o.page = f.page AND o.x0 = f.x0 AND o.y0 = f.y0 AND o.x1 = f.x1 AND o.y1 = f.y1 AND (n >= 3 AND chars >= 240 OR over / greatest({_AREA.format('o')}, 1) >= 0.25 AND lying >= 120))), {_merging("b", 8)}
SELECT m.page, m.x0, m.y0, m.x1, m.y1, count(*) AS n FROM m JOIN b ON b.page = m.page AND b.x0 >= m.x0 AND b.y0 >= m.y0 AND b.x1 <= m.x1 AND b.y1 <= m.y1 GROUP BY ALL""")
def picture_regions(spark, sf_dir):
    texts, pictures = _images(spark, sf_dir)
    cards = pictures.where("line_no = 1 AND page % 3 = 0").withColumn("x1", F.col("x1") - 60)
    return images.picture_regions(pictures.where("line_no > 1"), cards, texts, "page")


@query("""
WITH s AS (SELECT conv_id * 100 + turn AS id, repeat('[IMAGE]x[/IMAGE]', (turn % 4)::INT) || role AS source, CASE WHEN turn % 5 = 1 THEN '[IMAGE] ' ELSE '' END || text || ' ' || chr(10) AS t FROM conversations),
m AS (SELECT *, turn_marks - CASE WHEN t LIKE '[IMAGE]%' THEN 1 ELSE 0 END AS n FROM (SELECT *, (length(source) - length(replace(source, '[IMAGE]', ''))) // 7 AS turn_marks FROM s))
SELECT id, CASE WHEN n > 0 THEN rtrim(t, ' ' || chr(10)) || repeat(chr(10) || chr(10) || '[IMAGE]' || chr(10) || 'Illustration placeholder' || chr(10) || '[/IMAGE]', n::INT) ELSE t END AS text FROM m""")
def image_placeholders(spark, sf_dir):
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 100 + t)
    sources = c.select("id", F.concat(F.repeat(F.lit("[IMAGE]x[/IMAGE]"), (t % 4).cast("int")), "role").alias("source"))
    return images.with_placeholders(c.select("id", F.concat(F.when(t % 5 == 1, "[IMAGE] ").otherwise(""), "text", F.lit(" \n")).alias("text")), sources, "id")


@query("SELECT o_orderkey AS block_id, o_custkey % 60 AS page FROM orders WHERE o_orderkey % 5 > 0 AND o_custkey % 4 > 0 AND o_orderkey % 3 > 0 AND o_orderkey % 7 > 1")
def rendered_blocks(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    blocks = o.select(k.alias("block_id"), (c % 60).alias("page"), (k % 5 > 0).alias("translatable"), F.when(c % 4 > 0, "t").otherwise("").alias("translated"), F.when(k % 3 == 0, "hidden_source_text").when(k % 2 == 0, "paragraph").alias("layout_mode"))
    return images.rendered_blocks(blocks, o.where(k % 7 <= 1).select(k.alias("block_id")))


@query("""
WITH b AS (SELECT conv_id AS doc, turn // 4 AS reading_page, turn AS pos, CASE WHEN turn % 8 > 3 THEN 'single' END AS layout, turn + conv_id % 2 * (turn % 2) AS source_page, text FROM conversations),
d AS (SELECT DISTINCT doc, reading_page, source_page + 1 AS p FROM b), g AS (SELECT *, p - row_number() OVER (PARTITION BY doc, reading_page ORDER BY p) AS g FROM d), r AS (SELECT doc, reading_page, min(p) AS a, max(p) AS z FROM g GROUP BY doc, reading_page, g),
s AS (SELECT doc, reading_page, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '-' || z END, ', ' ORDER BY a) AS ranges FROM r GROUP BY ALL)
SELECT b.doc, b.reading_page, '<!-- Reading Page ' || (b.reading_page + 1) || '; Layout: ' || coalesce(arg_min_null(layout, pos), 'columns') || '; Source PDF Pages: ' || ranges || ' -->' || chr(10) || chr(10) || string_agg(text || chr(10) || chr(10), '' ORDER BY pos) || '---' || chr(10) || chr(10) AS text
FROM b JOIN s ON s.doc = b.doc AND s.reading_page = b.reading_page GROUP BY b.doc, b.reading_page, ranges""")
def reading_pages_markdown(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    blocks = table(spark, sf_dir, "conversations").select(c.alias("doc"), F.floor(t / 4).alias("reading_page"), t.alias("pos"), F.when(t % 8 > 3, "single").alias("layout"), (t + c % 2 * (t % 2)).alias("source_page"), "text")
    return images.reading_markdown(blocks, "doc")
