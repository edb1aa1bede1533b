"""The passage corpus: union of sources, first-wins dedup by normalised text, keyed lookups, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.order_statistics import exact_ranks
from quillon.functions.text import dedup_key, word_count
from quillon.session import materialise


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``; partial minima are taken before the shuffle, so hot keys cost nothing."""
    cols = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min_by(F.struct(order, *cols), order).alias("__first")).select(key, "__first.*").select(*rows.columns)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    cols = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(order, *cols), order).alias("__last")).select(key, "__last.*").select(*rows.columns)


def build_corpus(*sources: DataFrame) -> DataFrame:
    """(id, text, source, ord): the sources in the order given, of equal normalised texts the first."""
    parts = [s.select("id", "text", "source", F.struct(F.lit(i), F.col("ord")).alias("ord")) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts).withColumn("key", F.sha2(dedup_key(F.col("text")), 256))
    return first_wins(rows, "key", "ord").drop("key")


def snippet_passages(examples: DataFrame) -> DataFrame:
    """(id, text, source, metadata, ord) of all gold snippets, the first of each id."""
    rows = examples.select("source", F.col("id").alias("question_id"), F.posexplode("snippets").alias("pos", "s"))
    rows = rows.select("s.id", "s.text", "source", F.create_map(F.lit("question_id"), F.col("question_id"), F.lit("document"), F.col("s.document")).alias("metadata"), F.struct("question_id", "pos").alias("ord"))
    return first_wins(rows, "id", "ord")


def abstract_passages(examples: DataFrame) -> DataFrame:
    """One passage for each example with a context; of equal ids that of the least question id."""
    rows = examples.where(F.coalesce("context", F.lit("")) != "")
    rows = rows.select(F.get("gold_passage_ids", 0).alias("id"), F.col("context").alias("text"), "source", F.create_map(F.lit("pmid"), F.col("id"), F.lit("question"), F.col("question")).alias("metadata"), F.struct(F.col("id").alias("question_id"), F.lit(0).alias("pos")).alias("ord"))
    return first_wins(rows, "id", "ord")


def corpus_stats(passages: DataFrame) -> DataFrame:
    """One row: number, least, lower quarter, median, upper quarter and largest number of words, and the mean. The texts are read once; their numbers of words are written."""
    counted = materialise(passages.select(word_count(F.col("text")).alias("n")), "word-counts")
    out = counted.agg(F.count("*").alias("n_passages"), F.coalesce(F.min("n"), F.lit(0)).cast("long").alias("min_words"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_words"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("mean_words"))
    names = ("p25_words", "median_words", "p75_words")
    return out.withColumns({name: F.lit(value or 0).cast("long") for name, value in zip(names, exact_ranks(counted, "n", [(1, 4), (1, 2), (3, 4)]))})


def per_source_stats(rows: DataFrame, group: str, distinct: str, text: str) -> DataFrame:
    """Count, distinct values and mean words, for all rows and for each group, in one pass of grouping sets."""
    counted = rows.select(group, F.coalesce(distinct, F.lit("")).alias("d"), word_count(F.col(text)).alias("n"))
    out = counted.groupingSets([[], [group]], group).agg(F.grouping_id().alias("level"), F.count("*").alias("n_rows"), F.countDistinct("d").alias("n_distinct"), F.round(F.avg("n"), 6).alias("mean_words"))
    return out.select(F.when(F.col("level") == 1, "all").otherwise("group").alias("level"), F.when(F.col("level") == 0, F.col(group)).alias("grp"), "n_rows", "n_distinct", "mean_words")
