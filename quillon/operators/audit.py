"""Data audits: distributions and length statistics as tables, and the report made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.order_statistics import exact_ranks
from quillon.functions.text import word_count
from quillon.session import materialise


def distribution(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def split_types(rows: DataFrame) -> DataFrame:
    """(split, factoid, yesno) counts in one pass."""
    return rows.groupBy("split").agg(*(F.count_if(F.col("question_type") == t).alias(t) for t in ("factoid", "yesno")))


def length_table(rows: DataFrame, text: str, by: str) -> DataFrame:
    """Least, mean and largest number of words by group; 0 without rows."""
    n = word_count(F.col(text))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.min(n), F.lit(0)).cast("long").alias("min_words"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_words"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias("mean_words"))


def dataset_audit(rows: DataFrame, label: str, *texts: str) -> DataFrame:
    """(total, train, dev, test, labels: how often each value of ``label`` occurs, and of each text the mean, upper median and largest number of words) of rows with a ``split``."""
    counts = rows.groupBy(F.coalesce(label, F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    labels = counts.agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("labels"))  # a handful of labels
    out = rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "dev", "test"))).join(F.broadcast(labels))
    for t in texts:
        n = materialise(rows.select(word_count(F.col(t)).cast("long").alias("n")), "word-counts")
        out = out.join(F.broadcast(n.agg(F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias(f"{t}_mean"), F.coalesce(F.max("n"), F.lit(0)).alias(f"{t}_max"))))  # single rows
        out = out.withColumn(f"{t}_median", F.lit(exact_ranks(n, "n", [(1, 2)])[0] or 0).cast("long"))
    return out


def utc_now() -> Column:
    """The time of the query as ISO-8601 text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


#: Words of a run by which an item is looked up.
RUN = 5


def _runs(tokens: Column, k: Column | int) -> Column:
    """The hashes of all runs of ``k`` tokens. The tokens are bound first: inside a lambda an outer expression is computed for each element."""
    k = k if isinstance(k, Column) else F.lit(k)
    every = F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.xxhash64(F.slice(t, i, k)))).otherwise(F.array().cast("array<long>")))
    return F.array_distinct(F.get(every, 0))


def containing(docs: DataFrame, items: DataFrame, block: int = 1024) -> DataFrame:
    """(doc_id, item_id): the items (item_id, text) that a document (doc_id, text) holds character for character, for each row of both.

    What lies between an item's first and last white space are whole words of any text that holds it, so runs of up to ``RUN`` of them are joined with the runs of the documents; of an item's
    runs the one in the fewest documents is taken, and only documents with that run are compared with the item. An item without such a word (up to two words) has no run: these are
    compared with all documents, about ``block`` of them in a pass. Null texts hold nothing and are in nothing; an empty item is in every text; rows with one id, or none, are rows of their own."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    items = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"), F.sha2("text", 256).alias("key"))
    tokens = F.split("item", "\\s+")
    inner = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
    texts = materialise(items.select("key", "item").distinct().withColumn("k", F.least(F.size(inner), F.lit(RUN))), "item-texts")
    lengths = sorted(r["k"] for r in texts.select("k").distinct().collect())  # at most RUN + 1 numbers
    parts = [docs.sparkSession.createDataFrame([], "doc_id long, item_id long")]
    if any(lengths):
        runs = materialise(texts.where("k > 0").select("key", F.explode(_runs(inner, F.col("k"))).alias("run")), "item-runs")
        own = F.concat(*(_runs(F.split("text", "\\s+"), k) for k in lengths if k))
        held = materialise(docs.select("doc_id", F.explode(F.array_distinct(own)).alias("run")).join(runs.select("run").distinct(), "run", "left_semi"), "held-runs")
        counts = runs.join(held.groupBy("run").agg(F.count("*").alias("n")), "run", "left")  # a run that no document has rules its item out
        rarest = counts.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("best")).where("best.n > 0").select("key", "best.run")
        pairs = held.join(rarest, "run").select("doc_id", "key").distinct().join(items, "key")
        parts.append(pairs.alias("p").join(docs.alias("d"), F.col("p.doc_id").eqNullSafe(F.col("d.doc_id"))).where(F.contains("d.text", "p.item")).select("p.doc_id", "p.item_id"))
    if 0 in lengths:
        short = texts.where("k = 0").select("key", "item")
        passes = -(-short.count() // block)
        for n in range(passes):
            some = short.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == n).agg(F.collect_list(F.struct("item", "key")).alias("some"))
            found = docs.join(F.broadcast(some)).select("doc_id", F.explode(F.filter("some", lambda x: F.contains(F.col("text"), x["item"]))).alias("x"))
            parts.append(found.select("doc_id", "x.key").join(items, "key").select("doc_id", "item_id"))
    return reduce(DataFrame.unionByName, parts)


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report of small tables; each shows ``most`` rows."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(map(str, r)) + " |" for r in df.orderBy(*df.columns).limit(most).collect()]
    return "\n".join(out) + "\n"


# The error taxonomy of answer annotations, as annotation files have it (category, name, description, examples).
ERRORS = [
    ("factual_recall", "Factual recall error", "Answer contradicts a clearly stated fact in the evidence", ["Evidence says drug A is effective, model says it's ineffective", "Evidence states specific dosage, model gives wrong number"]),
    ("statistical_misinterpretation", "Statistical misinterpretation", "Misreads effect size, confidence interval, p-value, or direction", ["Confuses relative risk with absolute risk", "Misinterprets non-significant p-value as evidence of no effect", "Gets direction of effect wrong (increase vs decrease)"]),
    ("population_overgeneralization", "Population overgeneralization", "Applies a finding beyond the studied population", ["Study on adults, model applies to children", "Study on specific disease subtype, model generalizes to all cases"]),
    ("stale_evidence", "Stale evidence anchoring", "Relies on outdated info despite newer evidence in context", ["Ignores more recent study that contradicts older one", "Uses superseded clinical guidelines"]),
    ("reasoning_error", "Reasoning error", "Internally inconsistent chain of reasoning", ["Premises support one conclusion, model reaches opposite", "Logical contradiction within the response"]),
    ("refusal", "Refusal / non-answer", "Model refuses to answer or gives non-committal response", ["'I cannot determine from the evidence'", "Excessive hedging without taking a position"]),
    ("other", "Other", "Error that doesn't fit other categories", ["Formatting issues", "Unrelated tangent"]),
]
#: End of fixed values.


def error_categories(spark) -> DataFrame:
    return spark.createDataFrame(ERRORS, "category string, name string, description string, examples array<string>")


def error_breakdown(annotations: DataFrame) -> DataFrame:
    """(cell_name, category, n) of (cell_name, error_categories); a row counts under each of its categories."""
    return annotations.select("cell_name", F.explode("error_categories").alias("category")).groupBy("cell_name", "category").agg(F.count("*").alias("n"))


def taxonomy_use(annotations: DataFrame) -> DataFrame:
    """The error categories, each with the number of annotations (error_categories) that name it; 0 where none does. Names that are no category are left out."""
    named = annotations.select(F.explode(F.array_distinct("error_categories")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return error_categories(annotations.sparkSession).join(named, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
