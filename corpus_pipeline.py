"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage works on all that the one before kept; its rows are written to the shared folder and
read again, so a lost executor costs no more than its part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stmtlens.llm import line_dedup, packing, pii, quality, simhash
from stmtlens.llm.common import table, written


#: Jaccard similarity of five-word shingles from which documents are near copies, whatever their fingerprints.
SIMILAR = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that the rules reject go."""
    return quality.clean_documents(docs)


def spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from all documents but their first; documents left empty go."""
    return line_dedup.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash and common shingles propose, whole sets of shingles decide."""
    return simhash.keep_one(docs, similarity=SIMILAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", spread_lines),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: The fingerprints, the trained span classifier and the search for bins have no SQL form;
#: tests/llm compares the stages with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, the result of the last one.

    Null texts have no words and go in the first stage; null keys, ties, repeated rows and empty
    tables are as the stages' operators define; other columns pass until the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
