"""Queries over boxes and records that are derived from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumite.operators import boxes, records
from vellumite.plans.catalogue import query
from vellumite.tables import dealt, table

_BOXES = """b AS (SELECT l_orderkey AS page, l_linenumber AS id, 600.0::DOUBLE AS page_width, 800.0::DOUBLE AS page_height, (l_partkey * 37 % 400)::DOUBLE AS x0, (l_suppkey * 53 % 760)::DOUBLE AS y0,
  (l_partkey * 37 % 400)::DOUBLE + l_quantity::DOUBLE * 6 AS x1, (l_suppkey * 53 % 760)::DOUBLE + 10 + l_partkey % 40 AS y1 FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = (F.col("l_partkey") * 37 % 400).cast("double"), (F.col("l_suppkey") * 53 % 760).cast("double")
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), x0.alias("x0"), y0.alias("y0"),
        (x0 + F.col("l_quantity").cast("double") * 6).alias("x1"), (y0 + 10 + F.col("l_partkey") % 40).alias("y1"),
    )


@query(f"""
WITH {_BOXES}, t AS (SELECT *, CASE id WHEN 1 THEN 'Delta-Green:  notes' WHEN 2 THEN (y0 * 3)::BIGINT::VARCHAR WHEN 3 THEN 'left // right' WHEN 4 THEN ' ' ELSE 'a line of the body' END AS text FROM b)
SELECT page, id, trim(text) = '' OR regexp_full_match(text, '\\d{{1,4}}') OR ((y1 < 64 OR y0 > 736) AND id = 3) OR y0 > 736 AS marginal FROM t""")
def marginal_blocks(spark, sf_dir):
    text = F.when(F.col("id") == 1, "Delta-Green:  notes").when(F.col("id") == 2, (F.col("y0") * 3).cast("bigint").cast("string")).when(F.col("id") == 3, "left // right").when(F.col("id") == 4, " ").otherwise("a line of the body")
    return _boxes(spark, sf_dir).select("page", "id", boxes.marginal(text, F.col("y0"), F.col("y1"), F.col("page_height")).alias("marginal"))


@query("SELECT event_id, contains('VT323,Sans,DejaVu Mono,Courier New'[1 + event_id % 20:20 + event_id % 20], 'VT323') OR regexp_matches('VT323,Sans,DejaVu Mono,Courier New'[1 + event_id % 20:20 + event_id % 20], 'Mono|Courier') AS one_width FROM events")
def one_width_fonts(spark, sf_dir):
    fonts = F.split(F.substr(F.lit("VT323,Sans,DejaVu Mono,Courier New"), (F.col("event_id") % 20 + 1).cast("int"), F.lit(20)), ",")
    return table(spark, sf_dir, "events").select("event_id", boxes.one_width(fonts).alias("one_width"))


@query(f"""
WITH {_BOXES}, t AS (SELECT *, greatest(x1 - x0, 0) AS w, greatest(y1 + 200 - y0, 0) AS h FROM b)
SELECT page, id, w >= 108 AND h >= 144 AND NOT (w >= 540 AND h >= 720) AND x0 < 300 AND x1 > 300 AND y0 > 32 AND y1 + 200 < 768 AS central FROM t""")
def central_images(spark, sf_dir):
    return _boxes(spark, sf_dir).select("page", "id", boxes.central(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1") + 200, F.col("page_width"), F.col("page_height")).alias("central"))


@query(f"""
WITH {_BOXES} SELECT a.page, a.id, r.id AS region FROM b a JOIN b r ON r.page = a.page AND r.id <= 2 AND a.x0 >= r.x0 - 4 AND a.y0 >= r.y0 - 104 AND a.x1 <= r.x1 + 4 AND a.y1 <= r.y1 + 304""")
def boxes_in_regions(spark, sf_dir):
    df = _boxes(spark, sf_dir)
    return boxes.contained(df, df.where("id <= 2").withColumn("y0", F.col("y0") - 100).withColumn("y1", F.col("y1") + 300), "page")


@query(f"""
WITH {_BOXES}, p AS (SELECT a.page, a.id, o.id AS other, least(a.x1, o.x1) - greatest(a.x0, o.x0) AS common, greatest(least(a.x1 - a.x0, o.x1 - o.x0), 1) AS narrow, (a.x0 + a.x1) / 2 AS m, (o.x0 + o.x1) / 2 AS n
  FROM b a JOIN b o ON o.page = a.page AND a.id < o.id)
SELECT page, id, other FROM p WHERE common / narrow >= 0.2 OR ((m < 300) = (n < 300) AND abs(m - n) <= 600 * 0.22)""")
def column_pairs(spark, sf_dir):
    return boxes.sharing_column(_boxes(spark, sf_dir), "page")


@query(f"""
WITH {_BOXES}, d AS (SELECT page, id, unnest([1, 2, 3]) AS col, (x0 + x1) / 2 AS m FROM b)
SELECT page, id, arg_min(col, (abs([100.0, 300.0, 500.0][col] - m), col)) AS "column" FROM d GROUP BY page, id""")
def nearest_columns(spark, sf_dir):
    df = _boxes(spark, sf_dir)
    columns = df.select("page").distinct().select("page", F.posexplode(F.array(F.lit(100.0), F.lit(300.0), F.lit(500.0))).alias("p", "centre"))
    return boxes.nearest_column(df, columns.select("page", (F.col("p") + 1).alias("column"), "centre"), "page")


@query(f"""
WITH RECURSIVE {_BOXES}, n AS (SELECT page, id, (x0 + x1) / 2 AS c, count(*) OVER (PARTITION BY page) AS n, row_number() OVER (PARTITION BY page ORDER BY (x0 + x1) / 2, id) AS r FROM b WHERE x1 - x0 <= 600 * 0.46),
f AS (SELECT page, id, r, 0 AS cluster, c AS total, 1 AS k FROM n WHERE r = 1 AND n >= 3
  UNION ALL SELECT n.page, n.id, n.r, cluster + (abs(n.c - total / k) >= 600 * 0.13)::INT, CASE WHEN abs(n.c - total / k) >= 600 * 0.13 THEN n.c ELSE total + n.c END, CASE WHEN abs(n.c - total / k) >= 600 * 0.13 THEN 1 ELSE k + 1 END
  FROM f JOIN n ON n.page = f.page AND n.r = f.r + 1)
SELECT page, id, cluster FROM f""")
def column_clusters(spark, sf_dir):
    return boxes.column_clusters(_boxes(spark, sf_dir), "page")


@query("""
WITH s AS (SELECT l_orderkey AS line, (l_partkey % 5) * 2.5::DOUBLE AS font_size, CASE WHEN l_suppkey % 7 = 0 THEN ' ' ELSE 'x' END AS text, CASE WHEN l_partkey % 6 < 5 THEN (l_partkey % 6)::VARCHAR END AS color FROM lineitem),
n AS (SELECT line, color, count(*) AS n FROM s WHERE text <> ' ' AND color IS NOT NULL GROUP BY ALL)
SELECT line, round(coalesce(avg(font_size) FILTER (font_size > 0), 0), 6) AS mean_size, (SELECT color FROM n WHERE n.line = s.line ORDER BY n DESC, color LIMIT 1) AS colour FROM s GROUP BY line""")
def line_styles(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("line"), (F.col("l_partkey") % 5 * 2.5).cast("double").alias("font_size"), F.when(F.col("l_suppkey") % 7 == 0, " ").otherwise("x").alias("text"),
        F.when(F.col("l_partkey") % 6 < 5, (F.col("l_partkey") % 6).cast("string")).alias("color"),
    )
    return boxes.line_style(spans, "line").withColumn("mean_size", F.round("mean_size", 6))


@query(f"""
WITH {_BOXES}, t AS (SELECT page, greatest(x1 - x0 - 20, 0) AS w, greatest(y1 - y0, 0) AS h FROM b)
SELECT page, round(least(sum(w * h) / 480000.0::DOUBLE, 1)::DOUBLE, 9) AS coverage, count(*) FILTER (least(w, h) <= 2)::BIGINT AS n_lines, count(*) FILTER (least(w, h) <= 2) >= 2 AS grid FROM t GROUP BY page""")
def page_cover(spark, sf_dir):
    return boxes.page_cover(_boxes(spark, sf_dir).withColumn("x1", F.col("x1") - 20), "page", dense=2).withColumn("coverage", F.round("coverage", 9))


@query("""
SELECT o_custkey AS doc, min(w) AS width, min(h) AS height, CASE WHEN count(DISTINCT (w, h)) > 1 THEN 'pages of several sizes' END AS error
FROM (SELECT o_custkey, (600.0 + 10 * (o_orderkey % 2))::DOUBLE AS w, 800.0::DOUBLE AS h FROM orders) GROUP BY o_custkey""")
def document_sizes(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (600.0 + 10 * (F.col("o_orderkey") % 2)).alias("page_width"), F.lit(800.0).alias("page_height"))
    return boxes.one_size(df, "doc")


@query("""
WITH t AS (SELECT o_orderkey, o_custkey % 7 - 1 AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 9 END AS b, o_orderkey % 6 AS n FROM orders),
c AS (SELECT *, least(coalesce(b, n), n) AS z FROM t),
e AS (SELECT *, CASE WHEN n < 1 THEN 'no pages' WHEN a < 0 THEN 'start below 0' WHEN a >= n THEN 'start beyond the last page' WHEN z <= a THEN 'stop not after start' END AS error FROM c)
SELECT o_orderkey, CASE WHEN error IS NULL THEN a || '-' || z ELSE error END AS pages FROM e""")
def page_windows(spark, sf_dir):
    k = F.col("o_custkey")
    w = records.page_window(k % 7 - 1, F.when(F.col("o_orderkey") % 5 != 0, k % 9), F.col("o_orderkey") % 6)
    df = table(spark, sf_dir, "orders").select("o_orderkey", w.alias("w"))
    return df.select("o_orderkey", F.coalesce("w.error", F.concat_ws("-", F.col("w.start").cast("string"), F.col("w.stop").cast("string"))).alias("pages"))


@query("""
WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://h.example/' || page_id || '//' WHEN 1 THEN 'http://h.example/a' WHEN 2 THEN '  HTTP://LocalHost:8000/V1/' WHEN 3 THEN 'ftp://x' ELSE ' ' END AS u FROM pages)
SELECT page_id, lower(rtrim(trim(u), '/')) AS address, CASE page_id % 5 WHEN 1 THEN 'plain http to a remote host' WHEN 3 THEN 'neither http nor https' WHEN 4 THEN 'empty' END AS error FROM t""")
def endpoints(spark, sf_dir):
    k = F.col("page_id") % 5
    u = F.when(k == 0, F.concat(F.lit("https://h.example/"), F.col("page_id").cast("string"), F.lit("//"))).when(k == 1, "http://h.example/a").when(k == 2, "  HTTP://LocalHost:8000/V1/").when(k == 3, "ftp://x").otherwise(" ")
    return table(spark, sf_dir, "pages").select("page_id", records.endpoint(u).alias("e")).select("page_id", "e.*")


@query("""
WITH t AS (SELECT doc_id, text, instr(lower(text), 'tion') AS p FROM documents),
c AS (SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(p - 81, 0) + 1, least(p + 83, length(text)) - greatest(p - 81, 0)) ELSE text END AS x FROM t),
s AS (SELECT doc_id, trim(regexp_replace(x, '[ \\t\\r\\n\\x0b\\f]+', ' ', 'g')) AS t FROM c)
SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(left(t, 160)) || '...' END AS excerpt FROM s""")
def excerpts_around(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.excerpt_around(F.col("text"), F.lit("TION")).alias("excerpt"))


@query("""
WITH t AS (SELECT p_partkey, p_name, p_partkey % 1000 AS n FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS title, CASE WHEN p_partkey % 4 < 3 THEN n::VARCHAR END AS page FROM t""")
def contents_entries(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, (F.col("p_partkey") % 1000).cast("string")
    line = F.when(k == 0, F.concat("p_name", F.lit(" ..... "), n)).when(k == 1, F.concat(F.lit("  "), "p_name", F.lit("   "), n, F.lit(" "))).when(k == 2, F.concat("p_name", F.lit("----"), n)).otherwise(F.concat("p_name", F.lit(" "), n))
    return table(spark, sf_dir, "part").select("p_partkey", records.contents_entry(line).alias("e")).select("p_partkey", "e.title", "e.page")


@query("""
WITH t AS (SELECT doc_id, text, instr(text, 'reast') - 1 AS s FROM documents)
SELECT doc_id, s >= 2 AND regexp_matches(substr(text, greatest(s - 4, 0) + 1, least(s, 4)), '(?i)\\b(the|a|an)\\s+$') AS article FROM t WHERE s >= 0""")
def after_articles(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text", (F.instr("text", "reast") - 1).alias("s")).where("s >= 0")
    return df.select("doc_id", records.after_article(F.col("text"), F.col("s")).alias("article"))


@query("SELECT min(page_id) AS page_id, '/data/' || page_id // 2 AS path FROM pages GROUP BY page_id // 2")
def paths_once(spark, sf_dir):
    half = F.floor(F.col("page_id") / 2).cast("string")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/data/./x/../"), half)).otherwise(F.concat(F.lit("data//"), half))
    df = table(spark, sf_dir, "pages").select("page_id", records.resolved(path).alias("path"))
    return records.first_of_each(df, F.col("path"), [F.col("page_id")])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def pages_not_ignored(spark, sf_dir):
    return records.not_ignored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id", "source")


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN 10 - l_linenumber END NULLS LAST, l_linenumber) AS place
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def hinted_blocks(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return records.hinted_order(df, df.where("l_linenumber % 2 = 0").withColumn("at", 10 - F.col("l_linenumber")), ["l_orderkey"], "l_linenumber", "l_linenumber")


@query("""
WITH t AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN (event_id % 20)::VARCHAR ELSE 'p' || event_id % 4 END AS page FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY try_cast(page AS BIGINT) NULLS LAST, coalesce(page, ''), event_id) AS place FROM t""")
def issue_places(spark, sf_dir):
    k = F.col("event_id")
    page = F.when(k % 3 == 1, (k % 20).cast("string")).when(k % 3 == 2, F.concat(F.lit("p"), (k % 4).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", records.issue_place("user_id", page, [k]).alias("place"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events")
def file_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", records.file_time(F.col("ts")).alias("at"))


@query("""SELECT o_orderkey, sha256('{"block_id":"' || o_orderkey || '","source_hash":"' || sha256(o_orderstatus) || '","target_signature":"' || sha256('{"height":' || o_custkey || ',"width":600}') || '"}') AS key FROM orders""")
def target_signatures(spark, sf_dir):
    target = records.signature(F.col("o_custkey").alias("height"), F.lit(600).alias("width"))
    key = records.signature(F.col("o_orderkey").cast("string").alias("block_id"), F.sha2("o_orderstatus", 256).alias("source_hash"), target.alias("target_signature"))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))


@query("""
SELECT conv_id, sha256('{"block_ids":["' || string_agg(turn::VARCHAR, '","' ORDER BY turn) || '"],"source_hashes":["' || string_agg(sha256(coalesce(text, '')), '","' ORDER BY turn) || '"],"target_signature":"t' || conv_id % 7 || '"}') AS cache_key
FROM conversations GROUP BY conv_id""")
def group_signatures(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("target", F.concat(F.lit("t"), (F.col("conv_id") % 7).cast("string")))
    return records.group_signatures(df, ["conv_id"], "turn", "turn", "text", "target")


@query("""
SELECT conv_id, turn AS block, role AS translation FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 3 = 0 AND turn = 1 OR conv_id % 4 = 1 AND turn = 0) AND conv_id % 11 <> 0""")
def cached_group_hits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    wanted = c.select("conv_id", F.col("turn").alias("block"), F.col("conv_id").alias("cache_key"), F.lit(True).alias("wanted"), ((F.col("conv_id") % 4 == 1) & (F.col("turn") == 0)).alias("unusable"))
    found = c.where("NOT (conv_id % 3 = 0 AND turn = 1)").select(F.col("conv_id").alias("cache_key"), F.col("turn").alias("block"), F.col("role").alias("translation"))
    extra = c.where("conv_id % 11 = 0").select(F.col("conv_id").alias("cache_key"), F.lit(-1).cast(c.schema["turn"].dataType).alias("block"), F.lit("?").alias("translation")).distinct()
    return records.cached_groups(wanted, found.union(extra), ["conv_id"])


@query("""
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'truncated' WHEN conv_id % 5 = 1 THEN 'empty' WHEN conv_id % 5 = 2 THEN 'kana' END AS fault FROM conversations""")
def completion_faults(spark, sf_dir):
    k = F.col("conv_id") % 5
    text = F.when(k == 1, " \n").when(k == 2, F.concat("text", F.lit("かな"))).otherwise(F.concat(F.lit("x "), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", records.completion_fault(text, F.when(F.col("turn") % 4 == 0, "length")).alias("fault"))
