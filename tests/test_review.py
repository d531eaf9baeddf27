"""Review, reference and progress operators on small relations."""

import pytest
from pyspark.sql import functions as F

from vellumite.functions import text as T
from vellumite.operators import review, state


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reviewed_dictionary(spark):
    g = spark.createDataFrame([("a", "1"), ("b", "2")], "term string, target string")
    d = spark.createDataFrame([("b", "two", "update"), ("c", "3", "add"), ("a", "x", "ignore")], "term string, target string, action string")
    assert rows(review.reviewed(g, d)) == [("a", "1"), ("b", "two"), ("c", "3")]
    with pytest.raises(Exception, match="term exists: a"):
        review.reviewed(g, d.select("term", "target", F.lit("add").alias("action")).where("term = 'a'")).collect()
    with pytest.raises(Exception, match="no such term: c"):
        review.reviewed(g, d.select("term", "target", F.lit("update").alias("action")).where("term = 'c'")).collect()
    assert rows(review.overlaid(g, spark.createDataFrame([("b", "!")], "term string, target string"))) == [("a", "1"), ("b", "!")]


def test_prompt_section(spark):
    found = spark.createDataFrame([(1, 1, "b", "2"), (1, 0, "long a", "1"), (1, 2, "c", "3")], "id int, match_rank int, term string, target string")
    core = spark.createDataFrame([("c",)], "term string")
    assert rows(review.prompt_terms(found, core)) == [(1, "- long a -> 1\n- b -> 2")]


def test_references(spark):
    blocks = spark.createDataFrame([("b1", "r1", "x"), ("b1", "r1", "x"), ("b2", "r9", "y"), ("b3", "r1", "z")], "block_id string, region_id string, source string")
    blocks = blocks.withColumn("source_hash", F.when(F.col("block_id") == "b3", "old").otherwise(T.source_hash(F.col("source"))))
    assert rows(review.broken_references(blocks, spark.createDataFrame([("r1",)], "region_id string"))) == [("no region", "b2"), ("stale", "b3"), ("twice", "b1")]
    want = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "block_id string, page int")
    have = spark.createDataFrame([("a", 0), ("b", 0), ("b", 0), ("c", 0)], "block_id string, page int")
    assert rows(review.ownership(want, have)) == [("missing", "d"), ("multiple", "b"), ("wrong page", "c")]


def test_labelled_ranges(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["iii", "iv", "v", "1", "2", "4", "A-9", "A-10", "x y"])], "doc int, page int, label string")
    assert rows(review.labelled_ranges(df, ["doc"])) == [(1, "iii-v, 1-2, 4, A-9-A-10, x y")]


def test_emphasis(spark):
    texts = ["a <strong>b <em>c</em></strong>", "<strong>x", "</em>", "<u>x</u>", "<em><strong></em></strong>", None]
    got = review.checked_emphasis(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    assert [r.error for r in got] == ["", "open strong", "unpaired em", "tag u", "unpaired em", ""]


def test_runs(spark):
    df = spark.createDataFrame([(1, 0, "a", None, None), (1, 1, "b", True, None), (1, 2, "c", True, True), (2, 0, "x", True, None), (2, 1, "y", True, None), (3, 0, "p", None, None), (3, 1, "q", False, None)], "id int, pos int, text string, bold boolean, italic boolean")
    assert rows(review.marked_runs(df)) == [(1, "a<b>b</b><bi>c</bi>"), (2, "xy"), (3, "pq")]


def test_overprints(spark):
    df = spark.createDataFrame([(1, 0, "a", 10.0), (1, 1, "a", 90.0), (1, 2, "a", 90.0), (1, 3, "b", 1.0), (1, 4, "a", 0.0)], "id int, pos int, text string, luminance double")
    assert rows(review.kept_overprints(df)) == [(1, 2), (1, 3), (1, 4)]


def test_date_groups(spark):
    df = spark.createDataFrame([(1, 0, "before"), (1, 1, "1 May 1925"), (1, 2, "they"), (1, 3, "came"), (1, 4, "2 May 1925")], "id int, pos int, text string")
    got = review.date_groups(df, F.col("text").rlike("^\\d{1,2} [A-Z][a-z]+ \\d{4}$"))
    assert rows(got) == [(1, 1, "1 May 1925", "they came"), (1, 2, "2 May 1925", "")]


def test_first_owner(spark):
    df = spark.createDataFrame([("d", 1, ["a", "b"]), ("d", 2, ["b", "c"]), ("d", 3, ["c"]), ("d", 4, ["d", "a"])], "doc string, ord int, blocks array<string>")
    assert [r.ord for r in review.first_owner_groups(df).orderBy("ord").collect()] == [1, 3]


def test_effect(spark):
    df = spark.createDataFrame([("r", 1000, 250, 0.6, 3), ("z", 0, 0, None, 0)], "run string, input_tokens int, cached_tokens int, cost_usd double, translated_pages int")
    got = {r.run: r for r in review.run_effect(df).collect()}
    assert got["r"].cache_hit_rate == 0.25 and abs(got["r"].cost_per_page - 0.2) < 1e-12
    assert got["z"].cache_hit_rate == 0 and got["z"].cost_per_page is None
    assert spark.range(1).select(review.cost_text(F.lit(1.5)), review.age_days(F.lit(86_400.0), F.lit(0.0))).first()[:] == ("$1.500", 0.0)


def test_stored_progress(spark):
    stored = spark.createDataFrame([({"model": "m", "v": "2"}, 1, "x")], "meta map<string,string>, id int, text string")
    keys = lambda *kv: spark.createDataFrame(list(kv), "key string, value string")
    assert rows(state.loaded(stored, keys(("model", "m")))) == [(1, "x")]
    assert rows(state.loaded(stored, keys(("model", "m"), ("v", "3")))) == []
    pages = spark.createDataFrame([(0, "a"), (1, "b")], "page_index int, text string")
    cache = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "かな"), ("k4", "")], "key string, value string")
    left, entries = state.cleared(pages, cache, spark.createDataFrame([(1,)], "page_index int"))
    assert rows(left) == [(0, "a")] and {r.key for r in entries.collect()} == {"k1", "k3", "k4"}
    asked = spark.createDataFrame([(i, f"k{i}") for i in range(6)], "id int, key string")
    assert rows(state.cached_answers(asked, cache)) == [(1, "a"), (2, "b")]
    summary = state.progress_summary(pages, pages.where("page_index = 0"), pages.where("page_index = 1"))
    assert rows(summary) == [(2, 1, 1, 2)]
