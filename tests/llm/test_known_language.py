import random

import corpus_pipeline
from pyspark.sql import functions as F
from vellumite.llm import language_id
from vellumite.tables import table

SCRIPTS = [(0x430, 0x44F), (0x3B1, 0x3C9), (0xAC00, 0xD7A0), (0x4E00, 0x9FA5), (0x61, 0x7A)]


def test_unlearned_texts_go_and_clean_ones_stay(spark):
    rng = random.Random(5)
    word = lambda lo, hi: "".join(chr(rng.randint(lo, hi)) for _ in range(rng.randint(2, 8)))
    odd = [(10_000_000 + i, " ".join(word(*SCRIPTS[i % 5]) for _ in range(200))) for i in range(300)]
    clean = table(spark, "/root/testdata/sf0.01", "documents")
    strange = spark.createDataFrame(odd, "doc_id long, text string")
    both = clean.unionByName(strange, allowMissingColumns=True)
    kept = corpus_pipeline.known_language(spark, both, "").select("doc_id").cache()
    assert kept.where("doc_id >= 10000000").count() == 0
    assert kept.count() == clean.where(F.col("text").rlike("\\p{L}")).count()


def test_the_cosine_of_operator_4_decides(spark):
    """Half of the letters are unlearned, so that less than half of the trigrams are known; the cosine is far above that of unlearned texts."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rng = random.Random(6)
    text = docs.where("lang = 'en' AND n_chars BETWEEN 2000 AND 3000").first().text
    strange = " ".join("".join(chr(rng.randint(*SCRIPTS[0])) for _ in range(6)) for _ in range(len(text) // 5))
    mixed = spark.createDataFrame([(10_000_000, f"{text} {strange}")], "doc_id long, text string")
    both = docs.unionByName(mixed, allowMissingColumns=True)
    score = language_id.predict(mixed, language_id.learn(docs)).first()
    assert score.lang_pred == "en" and score.score >= language_id.SURE
    assert language_id.in_known_language(both, sure=2.0).where("doc_id = 10000000").count() == 0
    assert corpus_pipeline.known_language(spark, both, "").where("doc_id = 10000000").count() == 1
