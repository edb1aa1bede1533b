"""The corpus pipeline: five stages, each one operator of quillon.llm, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns the documents it leaves, with the columns of ``docs``. All texts are read
whole, whatever their length, and each stage sees every row that the one before it kept.

Cases: a null, empty or short text fails the quality rules and goes; a null doc_id is the least id, and rows that share a doc_id are one document to the rules and the line
dedup; of rows given twice the join keeps one; a null source is a host and a source of its own, the last; a null lang is kept as it is; of equal keepers the join takes
the one with the least hash of its text, and the mix takes rows with one hash together; without a benchmark nothing goes; empty documents leave an empty
table; columns of any other name are passed through. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, line_dedup, mixing, ngram_join, oracles, quality_rules
from quillon.session import materialise, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are depleted by lines that too many documents of their host hold, go; the others lose these lines."""
    return quality_rules.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the largest doc_id only; no document goes."""
    return line_dedup.drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a 5-word shingle similarity of 0.8 or more the least doc_id stays."""
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage like an item of the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", rules),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing", weights),
]

#: All five stages by brute force; tests/llm/test_pipeline.py holds the rows against plain Python too.
ORACLE_SQL = oracles.PIPELINE


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
