"""From raw documents to a mixed, tokenised corpus, in five stages, each one operator of quillframe.llm.

Each stage reads all rows that its predecessor kept, as written to Parquet. The first four return the
columns of documents; the last returns a row per document of the mix with its token digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import bpe, exact_dedup, language_id, mixing, simhash
from quillframe.llm.common import discard, documents, materialise


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in none of the languages that the documents' own labels teach."""
    return language_id.stage(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts."""
    return exact_dedup.stage(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of texts with five-word similarity 0.8 or more."""
    return simhash.stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come near their target weights."""
    return mixing.stage(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document of the mix."""
    return bpe.stage(docs)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: SQL has neither automata nor byte-pair merges; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
