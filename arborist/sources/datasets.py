"""Question sets out of raw items: flat trees, questions and which nodes are relevant, as three tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tree import chunk_words
from . import readers

#: (nodes, questions, qrels): nodes as in operators.tree, questions (question_id, doc_id, question, expected, difficulty, category), qrels (question_id, node_id).
Dataset = tuple[DataFrame, DataFrame, DataFrame]

# Fixed value: what is asked of every report.
REPORT_QUESTION = "What are the main findings, conclusions, and recommendations of this report?"
SECTION_WORDS = 400


def _text(c: Column) -> Column:
    return c.cast("string")


def _root(doc: Column, title: Column, summary: Column, n: Column) -> list[Column]:
    return [
        doc.alias("doc_id"), F.lit("ROOT").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ord"), F.lit(0).alias("depth"), F.array(F.lit(0)).alias("path_ord"),
        title.alias("title"), summary.alias("summary"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("1-"), _text(F.greatest(n, F.lit(1)))).alias("page_ref"),
    ]


def _leaf(doc: Column, node: Column, at: Column, title: Column, text: Column) -> list[Column]:
    return [
        doc.alias("doc_id"), node.alias("node_id"), F.lit("ROOT").alias("parent_id"), at.alias("ord"), F.lit(1).alias("depth"), F.array(F.lit(0), at).alias("path_ord"),
        title.alias("title"), text.alias("summary"), text.alias("text"), _text(at + 1).alias("page_ref"),
    ]


def report_benchmark(reports: DataFrame, n: int | None = 40, seed: int = 42) -> Dataset:
    """Long reports (doc_id, report, summary) in sections of 400 words under one fixed question, whose answer is the summary; n of them by a hash of id and seed (None: all).

    All sections are relevant. A report without words has one empty section.
    """
    own = reports if n is None else reports.orderBy(F.xxhash64(_text(F.col("doc_id")), F.lit(seed)), "doc_id").limit(n)
    words = F.size(F.filter(F.split(F.coalesce("report", F.lit("")), r"\s+"), lambda x: x != ""))
    own = own.select("doc_id", F.coalesce("report", F.lit("")).alias("text"), "summary", words.alias("n_words")).withColumn("n", F.greatest(F.ceil(F.col("n_words") / SECTION_WORDS), F.lit(1)))
    cut = chunk_words(own, SECTION_WORDS).select("doc_id", "ord", "text").unionByName(own.where("n_words = 0").select("doc_id", F.lit(0).alias("ord"), F.lit("").alias("text")))
    leaf = cut.select(*_leaf(F.col("doc_id"), F.concat(F.lit("PAGE"), _text(F.col("ord") + 1)), F.col("ord"), F.concat(F.lit("Section "), _text(F.col("ord") + 1)), F.col("text")))
    about = F.concat(F.lit("Government report ("), _text(F.col("n_words")), F.lit(" words, "), _text(F.col("n")), F.lit(" sections)"))
    root = own.select(*_root(F.col("doc_id"), _text(F.col("doc_id")), about, F.col("n")))
    key = F.concat(F.lit("gr_"), _text(F.col("doc_id")))
    questions = own.select(key.alias("question_id"), "doc_id", F.lit(REPORT_QUESTION).alias("question"), F.col("summary").alias("expected"), F.lit("hard").alias("difficulty"), F.lit("long_document").alias("category"))
    return root.unionByName(leaf), questions, leaf.select(key.alias("question_id"), "node_id")


def item_benchmark(items: DataFrame) -> Dataset:
    """Multi-hop items (question_id, question, answer, kind, sections of title, text, relevant) as one flat tree each, whose id is the question's."""
    doc = F.col("question_id").alias("doc_id")
    each = items.select("question_id", F.posexplode("sections").alias("at", "s"))
    name = F.concat(F.lit("SEC"), _text(F.col("at")))
    leaf = each.select(*_leaf(F.col("question_id"), name, F.col("at"), F.col("s.title"), F.trim(F.col("s.text"))))
    root = items.select(*_root(F.col("question_id"), F.substring("question", 1, 60), F.concat(F.lit("Multi-hop context for: "), "question"), F.size("sections")))
    hard = F.when(F.col("kind") == "bridge", "hard").otherwise("medium")
    questions = items.select("question_id", doc, "question", F.col("answer").alias("expected"), hard.alias("difficulty"), F.lit("multi_hop").alias("category"))
    return root.unionByName(leaf), questions, each.where("s.relevant").select("question_id", name.alias("node_id"))


QUESTIONS = "question_id string, document_id string, question string, expected_answer_hint string, expected_sections array<string>, difficulty string, category string"


def load_dataset(spark: SparkSession, name: str, known: dict[str, Callable[[SparkSession], DataFrame]] | None = None) -> DataFrame:
    """The questions of a data set: by a keyword of `known`, else out of a JSON file with a list "questions" (columns QUESTIONS)."""
    builder = (known or {}).get(name.strip().lower())
    if builder:
        return builder(spark)
    raw = spark.read.text(name, wholetext=True).select(F.from_json("value", f"questions array<struct<{QUESTIONS.replace(' ', ': ').replace(',: ', ', ')}>>").alias("d"))
    return raw.select(F.inline("d.questions"))


def multi_hop_benchmark(spark: SparkSession, path: str, n: int | None = 100, seed: int = 42) -> Dataset:
    """item_benchmark of a file of multi-hop items."""
    return item_benchmark(readers.multi_hop_items(spark, path, n, seed))
