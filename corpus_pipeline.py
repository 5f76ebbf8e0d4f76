"""A training corpus from raw documents, stage by stage.

Every stage takes the documents that its predecessor kept and, but for the
last, returns documents with the same columns.  Packing returns its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annolith.llm.common import Work
from annolith.llm.exact_dedup import deduplicate
from annolith.llm.language_id import with_known_language
from annolith.llm.mixing import mixed_documents
from annolith.llm.ngram_join import keep_one
from annolith.llm.packing import pack
from annolith.sources.work import owned


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose predicted language has the larger share; null texts, texts without a letter and texts like no learned language go."""
    return with_known_language(spark, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text (A-Z as a-z), the one of the largest doc_id.

    Null text equals the empty text.  A row without doc_id goes if another row has its text; of rows equal in text and doc_id one stays.  No rows give none.
    """
    return deduplicate(spark, docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a Jaccard similarity of 0.8 of five-word shingles, the one of the smallest doc_id.

    Null, empty and blank texts link with nothing and stay, as do rows without doc_id; rows that share a doc_id stay or go together; texts of fewer words than five are one shingle.  No rows give none.
    """
    return keep_one(spark, docs, width=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source gives its target of words.

    Null source and null language are values of their own.  Texts without words (null, empty, blank) change no total; rows that share a doc_id share their number of copies.  No rows give none.
    """
    return mixed_documents(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens.

    Null and empty texts are packed as their end id; a null source is a queue of its own; repeated rows are each packed.  No rows give none.
    """
    return pack(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Tokenisation cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of all that the stages before kept.  What a stage kept in the work folder goes once its documents are written."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with owned():  # what the stage has put into work folders
            docs = work.table(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
