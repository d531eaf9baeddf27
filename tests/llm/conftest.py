import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id string, spans string, _left string, shard string"


@pytest.fixture(scope="session")
def rough_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(3)
    vocab = {
        "en": "the of and thing onder reast athing be that with for is was".split(),
        "fr": "le la éau queré mentès dans pour une est çons de les".split(),
    }
    make = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    passage = make("en", 120)
    rows = [(i, make("en", 60 + i) if i % 2 else make("fr", 60 + i), "en" if i % 2 else "fr") for i in range(24)]
    rows += [
        (24, None, "en"), (25, "", "en"), (26, "   \n\t ", None), (27, "...!!! 123", "en"), (28, rows[0][1], "fr"), (29, rows[0][1].replace(" ", "  \n"), "fr"),
        (30, "One", "en"), (31, "one", "en"), (32, "Two words", None), (33, make("en", 30_000), "en"), (34, "a" * 3000, "en"), (34, "a" * 3000, "en"),
        (None, rows[3][1], "en"), (None, None, None), (35, make("en", 20) + " " + passage, "en"), (36, passage + " " + make("fr", 20), "fr"),
        (37, "日本語 текст \x1c     İstanbul ǅ <|endoftext|> 's 'LL", "en"), (38, "x\x00y \U0001f600 é", None), (39, "word " * 300, "en"), (40, "line one\nline one\n\nline two", "en"),
    ]
    return [(i, t, lang, None if n % 5 == 0 else f"s{n % 3}", None if t is None else len(t), 0.5, "clash", "clash", "clash", None) for n, (i, t, lang) in enumerate(rows)]


@pytest.fixture(scope="session")
def rough(spark, rough_rows):
    return spark.createDataFrame(rough_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
