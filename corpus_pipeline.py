"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

Every stage but the last returns the columns of its documents, whatever they are named. Each stage says
what it does with null and empty texts, null ids, repeated rows and ties; a table without rows
passes all of them. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.llm import language, mixing, packing, simhash, substrings
from statuta.llm.common import table, written


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose language can't be told go: null texts, texts without a letter, and texts that no
    language has at least half of the likelihood of. Null ids and repeated rows stay; of equal languages the first
    by code point counts."""
    return language.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8 on five-word shingles, fingerprints within 2 bits or sets of shingles that share four fifths: of each
    group of near copies the document of the smallest doc_id stays. Texts without words are one group; a null id
    is larger than all others; of rows that repeat the smallest id one of the smallest hash of all columns stays."""
    return simhash.keep_first_similar(docs, reach=2)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: words in windows of 13 that a document of a smaller doc_id has, too, are cut out; a document that
    has no words left goes. Null texts stay; a null id is larger than all others; rows of one id don't cut each other."""
    return substrings.cleaned(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents, whole or in part, as often (up to three times) as their source's target asks. Null sources
    are one source; documents without words are in no mix; repeated rows count each."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the pieces of all documents in sequences of at most 1,024 tokens and 64 documents. Null texts are
    empty ones (one end id); repeated rows are packed each."""
    return packing.packed_documents(docs, max_docs=64)


STAGES = [
    ("language", told_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packed),
]
#: SQL has no way to express the learned and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
