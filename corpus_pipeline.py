"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it works on every row that the stage before it kept,
and all but the last give the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumite.llm import exact_dedup, language_id, packing, simhash, suffix_dedup
from vellumite.llm.common import written
from vellumite.tables import table

#: Bytes of a repeated passage that goes: 50 words of four letters and a blank.
PASSAGE = 250


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay that operator 4 finds in a learned language by their cosine; where it is too low to tell, those of whose trigrams a language knows half."""
    return language_id.in_known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal normalised texts, the one with the smallest doc_id stays."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints or by similar five-word shingles, the row with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes and more that also start elsewhere are cut out of the texts."""
    return suffix_dedup.without_repeats(docs, PASSAGE, gram=32)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("simhash", near_copies),
    ("suffix_dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: SQL can express neither the learned language profiles nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
