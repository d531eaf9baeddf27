import corpus_pipeline
from tests.llm.test_operators import groups_brute, fingerprint_brute, passages_brute
from vellumite.llm.common import written


def test_stages_on_rough_rows(spark, rough, sf_dir):
    docs, seen = rough, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == rough.columns
    near = seen["simhash"].collect()
    assert len(set(groups_brute([fingerprint_brute(r.text) for r in near]))) == len(near)
    exact = seen["exact_dedup"].collect()
    assert len(near) == len(set(groups_brute([fingerprint_brute(r.text) for r in exact])))
    want = {r.doc_id: n - gone for r, (n, gone, _, _) in zip(near, passages_brute([r.text.encode() for r in near], corpus_pipeline.PASSAGE))}
    got = {r.doc_id: len(r.text.encode()) for r in seen["suffix_dedup"].collect()}
    assert got == {k: n for k, n in want.items() if n}
    assert {r.doc_id for r in seen["packing"].collect()} == set(got)


def test_stages_on_nothing(spark, nothing, sf_dir):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []


def test_clean_rows_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.known_language(spark, docs, sf_dir).count() == docs.count()
