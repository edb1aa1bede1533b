"""File sources and sinks: JSON lines strict and tolerant, manifests, vector tables, configuration, annotations."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.order_statistics import with_rank
from quillon.schemas import ANNOTATION
from quillon.session import CLEANUP, exists

#: Configuration keys whose mappings are merged one level deep.
MERGED = ("model", "lora", "training", "data", "quantization", "logging")


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped, and a missing path is an empty table, as when a run resumes."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet export, or an empty table where it is missing."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_vectors(passages: DataFrame, path: str) -> None:
    """The vector index: one row (id, embedding) a passage."""
    passages.select("id", "embedding").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, embedding array<float>").parquet(path)


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON files of a folder, with the file's stem as ``cell``."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return df.withColumn("cell", F.regexp_extract(F.input_file_name(), "([^/]+)\\.json$", 1))


def write_manifest(spark: SparkSession, content: dict, path: str) -> None:
    """A small manifest, such as split ids, hashes or subset ids, as one text file in any store that Spark writes."""
    spark.createDataFrame([(json.dumps(content, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_config(path: str, base: str | None = None) -> dict:
    """A YAML file over an optional base: known groups are merged one level deep, all else is replaced."""
    import yaml

    def load(p: str) -> dict:
        with open(p, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}

    out = load(base) if base else {}
    for key, value in load(path).items():
        both = key in MERGED and isinstance(out.get(key), dict) and isinstance(value, dict)
        out[key] = out[key] | value if both else value
    return out


def write_partitioned(df: DataFrame, path: str, by: str, order: str) -> None:
    """One ordered folder for each value of ``by``; a value's rows stay in one file only where they are few."""
    df.repartitionByRange(by, order).sortWithinPartitions(by, order).write.mode("overwrite").partitionBy(by).json(path)


def write_aligned(records: DataFrame, path: str, by: str, order: str, per_file: int = 1000) -> None:
    """Records of several kinds (``by``) of the same examples (``order``), so that the files of all kinds have the same examples in the same order.

    One ordinal numbers the examples for all kinds; file k of a kind, in folder ``by``=../file=.., has those from k * ``per_file`` on, in their order. Each file is written by one task, which
    holds that file's rows only."""
    ids = with_rank(records.select(order).distinct(), "__at", order)
    rows = records.join(ids, order).withColumn("file", F.lpad(F.expr(f"string(__at div {per_file})"), 9, "0"))
    rows.repartition(by, "file").sortWithinPartitions(by, "file", "__at").drop("__at").write.mode("overwrite").partitionBy(by, "file").json(path)


def numbered(rows: DataFrame, order: str, per_file: int, name: str = "file") -> DataFrame:
    """``rows`` with the number of the file that has them where each has ``per_file`` of them, in the order of ``order``; only the ids are sorted."""
    ids = with_rank(rows.select(order).distinct(), "__at", order)
    return rows.join(ids.select(order, F.expr(f"__at div {per_file}").alias(name)), order)


#: Files of one task that are open at a time; beyond it Spark sorts a task's records.
WRITERS = 64
_OPEN = "spark.sql.maxConcurrentOutputFileWriters"


def write_expanded(examples: DataFrame, expand: Callable[[DataFrame], DataFrame], path: str, *by: str) -> None:
    """The records that ``expand``, a step without a shuffle, makes of examples that lie in the order in which they are to be written: compressed JSON lines in folders ``by``, in that order.

    Records hold an example's texts many times over, so they are neither shuffled nor sorted; a task has all files of its examples open. The shuffles of the examples go with the end of the write."""
    spark = examples.sparkSession
    before = {c: spark.conf.get(c, None) for c in (_OPEN, CLEANUP)}
    spark.conf.set(_OPEN, str(WRITERS))
    spark.conf.set(CLEANUP, "true")
    try:
        expand(examples).write.mode("overwrite").option("compression", "gzip").partitionBy(*by).json(path)
    finally:
        for c, old in before.items():
            spark.conf.unset(c) if old is None else spark.conf.set(c, old)


def aligned_manifest(spark: SparkSession, path: str, by: str, order: str) -> DataFrame:
    """(by, file, n, ids_sha256, sha256) of each file of ``write_aligned``, read from the files themselves, plain or compressed: how many records, the ids in their order, comma-joined, and all bytes, as they are before compression."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,json.gz}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    lines = F.filter(F.split("content", "\n"), lambda x: x != "")
    ids = F.transform(lines, lambda x: F.get_json_object(x, f"$.{order}"))
    kind, file = (F.regexp_extract("path", f"/{c}=([^/]*)/", 1) for c in (by, "file"))
    return raw.select(kind.alias(by), file.cast("long").alias("file"), F.size(ids).cast("long").alias("n"), F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"), F.sha2("content", 256).alias("sha256"))


def annotation_json(df: DataFrame) -> DataFrame:
    """(value): each annotation as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def annotations_of(values: DataFrame) -> DataFrame:
    """The annotations in (value), with the engine's schema."""
    return values.select(F.from_json("value", ANNOTATION).alias("a")).select("a.*")


def annotation_progress(df: DataFrame) -> DataFrame:
    """(cell_name, n, n_correct): how many annotations each cell has."""
    return df.groupBy("cell_name").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"))


def export_annotations(df: DataFrame, path: str) -> None:
    flat = df.withColumn("error_categories", F.array_join("error_categories", ";"))
    flat.write.mode("overwrite").option("header", True).csv(path)
