"""Cleaning of a document table in four stages: quality, near copies, secrets, packing.

Every stage takes any table with doc_id and text; further columns, whatever their names, stay as they are but for
the last stage. Null and empty texts, null and repeated ids, repeated rows and empty tables are handled as said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborist.llm import packing, secret_scan, simhash, zquality
from arborist.llm.common import stored, table
from arborist.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns from the labelled documents among them.

    Null and empty texts have the score of an empty text; rows with a null id are scored and teach nothing; a repeated
    id teaches once; without labels of both classes the score is the share of good ones, one half without any.
    """
    return zquality.keep_good(docs, zquality.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Links are SimHash fingerprints at two or fewer differing bits, as in operator 8; an exact search follows, for texts
    whose five-word shingles have a similarity of 0.8 or more and whose fingerprints are farther apart. Texts without words are one group; rows without an id stay; a repeated id counts by its smallest text and its
    rows stay or go together. Texts of any length are compared whole.
    """
    return simhash.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark.

    A null text stays null; n_chars, where there is such a column, becomes the new text's length.
    """
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024; a null text is one piece with the end id, rows with a null id and repeated rows are packed each."""
    return packing.pack(docs, tokenizer())


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("packing", pack)]

#: Compression, fingerprints, automata and BPE have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
