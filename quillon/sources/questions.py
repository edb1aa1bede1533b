"""Question sources: directories of JSON question files, abstracts with labels, and multiple-choice exports.

Each reader gives the engine's fixed schema and keeps the rules of its source as plain columns, so that filters
and column pruning reach the scan.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.order_statistics import with_rank
from quillon.schemas import QUESTION, QUESTION_FILE
from quillon.session import exists
from quillon.sources.json_ranges import RANGE, elements

INCLUDED_TYPES = ["factoid", "yesno"]
LETTERS = ["A", "B", "C", "D"]


def question_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all *.json files under ``path``, each a document {"questions": [...]}; raises where there is none."""
    raw = spark.read.schema(QUESTION_FILE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return raw.select(F.explode("questions").alias("q"))


def split_question_files(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The rows of ``question_files`` where files are large: each is read by many tasks, in ranges of ``size`` bytes."""
    return elements(spark, path, size).select(F.from_json("element", QUESTION).alias("q"))


def exact_answer(kind: Column, value: Column) -> Column:
    """yesno: a string in lower case, else null; factoid: a string, or the first of a list or of a list of lists."""
    shape = F.schema_of_variant(value)
    text = F.when(shape == "STRING", F.try_variant_get(value, "$", "string"))
    nested = F.try_variant_get(value, "$[0]", "variant")
    first = F.when(F.schema_of_variant(nested) == "STRING", F.try_variant_get(value, "$[0]", "string")).otherwise(F.try_variant_get(value, "$[0][0]", "string"))
    return F.when(kind == "yesno", F.lower(text)).when(kind == "factoid", F.coalesce(text, F.when(shape.startswith("ARRAY"), first)))


def ideal_answer(value: Column) -> Column:
    """A string, or the first of a list."""
    return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")), F.try_variant_get(value, "$[0]", "string"))


def questions(raw: DataFrame, source: str = "bioasq") -> DataFrame:
    """Examples from ``question_files``: known types, with id, body, an answer and at least one snippet with text.

    Snippet ids count all snippets of the file, also the empty ones that are dropped."""
    q = raw.select("q.*").withColumn("question_type", F.lower("type"))
    q = q.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("body", F.lit("")) != "") & F.col("question_type").isin(INCLUDED_TYPES))
    every = F.transform("snippets", lambda s, i: F.struct(F.concat(F.lit(source + "_"), F.col("id"), F.lit("_snip"), i.cast("string")).alias("id"), s["text"].alias("text"), s["document"].alias("document")))
    q = q.withColumn("kept", F.filter(every, lambda s: F.coalesce(s["text"], F.lit("")) != "")).where(F.size("kept") > 0)
    q = q.withColumn("answer", exact_answer(F.col("question_type"), F.col("exact_answer"))).where(F.coalesce("answer", F.lit("")) != "")
    null = F.lit(None).cast("string")
    return q.select("id", F.lit(source).alias("source"), F.col("body").alias("question"), "question_type", "answer", null.alias("context"), null.alias("long_answer"), F.coalesce(ideal_answer(F.col("ideal_answer")), F.lit("")).alias("ideal_answer"), F.col("kept").alias("snippets"), F.transform("kept", lambda s: s["id"]).alias("gold_passage_ids"))


def labelled_abstracts(raw: DataFrame, source: str = "pubmedqa") -> DataFrame:
    """Examples from rows (pubid, question, context struct with contexts, long_answer, final_decision): yes/no questions on one passage."""
    key = F.col("pubid").cast("string")
    null = F.lit(None).cast("string")
    empty = F.lit(None).cast("array<struct<id:string,text:string,document:string>>")
    return raw.select(key.alias("id"), F.lit(source).alias("source"), "question", F.lit("yesno").alias("question_type"), F.lower("final_decision").alias("answer"), F.array_join("context.contexts", " ").alias("context"), "long_answer", null.alias("ideal_answer"), empty.alias("snippets"), F.array(F.concat(F.lit(source + "_"), key)).alias("gold_passage_ids"))


def _letter(index: Column) -> Column:
    return F.get(F.array(*map(F.lit, LETTERS)), index)


def lettered(texts: list[Column]) -> Column:
    return F.array(*(F.struct(F.lit(x).alias("label"), F.coalesce(t, F.lit("")).alias("text")) for x, t in zip(LETTERS, texts)))


def choice_lists(raw: DataFrame, subject: str, ordinal: str, source: str = "mmlu_med") -> DataFrame:
    """From (question, choices, answer index): short lists are filled with empty options; an index out of range counts as A."""
    return raw.select(F.concat(F.lit(f"mmlu_{subject}_"), F.col(ordinal).cast("string")).alias("id"), F.lit(source).alias("source_dataset"), "question", lettered([F.get("choices", i) for i in range(4)]).alias("options"), F.coalesce(_letter(F.col("answer")), F.lit("A")).alias("answer"), F.lit(subject).alias("subject"))


def with_ordinal(raw: DataFrame, *order: str) -> DataFrame:
    """``raw`` with ``ordinal``, the place of each row, from 0, in the order of the columns; without one, in the order of the files, by path, and of the rows in each."""
    return with_rank(raw, "ordinal", *order) if order else file_ordinals(raw)


def file_ordinals(raw: DataFrame) -> DataFrame:
    """``raw``, as read from Parquet files, with ``ordinal``, the place of each row, from 0, as the files have them: a row's index in its file, which the reader knows, whatever the splits, and
    the number of rows in the files before it. No row is sorted or shuffled; only the files' sizes are, a row a file."""
    placed = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = raw.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # files, not rows
    sizes = sizes.select("__file", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    return placed.join(sizes, "__file").withColumn("ordinal", F.col("__ahead") + F.col("__row")).drop("__file", "__row", "__ahead")


def subjects(loaders: dict[str, Callable[[], DataFrame]], *order: str) -> DataFrame:
    """``choice_lists`` of all subjects, with ordinals by subject, in the order of the columns or else of the files; a subject that can't be loaded is left out with a warning."""
    parts = []
    for subject, load in loaders.items():
        try:
            raw = load()
            raw.schema  # a missing path shows here
        except Exception as e:
            warnings.warn(f"subject {subject} was not loaded: {e}", stacklevel=2)
            continue
        parts.append(choice_lists(with_ordinal(raw, *order), subject, "ordinal"))
    if not parts:
        raise ValueError("no subject could be loaded")
    return reduce(DataFrame.unionByName, parts)


def source_path(variable: str = "BIOASQ_DATA_PATH") -> str:
    """The folder that the environment names; raises where it is not set."""
    path = os.environ.get(variable)
    if not path:
        raise ValueError(f"{variable} is not set: set it to the folder of the question files")
    return path


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``question_files`` of a folder that must be there."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return question_files(spark, path)


def choice_maps(raw: DataFrame, ordinal: str, source: str = "medqa_us") -> DataFrame:
    """From (question, options map of letters, answer_idx)."""
    return raw.select(F.concat(F.lit("medqa_"), F.col(ordinal).cast("string")).alias("id"), F.lit(source).alias("source_dataset"), "question", lettered([F.try_element_at("options", F.lit(x)) for x in LETTERS]).alias("options"), F.coalesce("answer_idx", F.lit("A")).alias("answer"), F.lit("usmle").alias("subject"))


def choice_columns(raw: DataFrame, source: str = "medmcqa") -> DataFrame:
    """From (id, question, opa..opd, cop, subject_name): rows without a valid answer go."""
    rows = raw.where(F.col("cop").between(0, 3))
    return rows.select(F.concat(F.lit("medmcqa_"), F.col("id")).alias("id"), F.lit(source).alias("source_dataset"), "question", lettered([F.col(c) for c in ("opa", "opb", "opc", "opd")]).alias("options"), _letter(F.col("cop")).alias("answer"), F.coalesce("subject_name", F.lit("")).alias("subject"))


def source_of_id(key: Column) -> Column:
    out = F.lit("unknown")
    for prefix, name in (("medmcqa_", "medmcqa"), ("medqa_", "medqa_us"), ("mmlu_", "mmlu_med")):
        out = F.when(key.startswith(prefix), name).otherwise(out)
    return out
