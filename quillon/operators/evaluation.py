"""Retrieval metrics for all queries in one plan, and their strata in one pass of grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.order_statistics import with_rank
from quillon.session import materialise

METRICS = ("hit", "recall", "mrr", "ndcg")
BUCKETS = ["low (1-5)", "medium (6-10)", "high (11+)"]


def query_metrics(retrieved: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(qid, n_gold, hit, recall, mrr, ndcg) of every query that has gold; queries without gold are not counted.

    Hit, recall and ndcg look at the first k ranks, mrr at all that were retrieved."""
    n = gold.groupBy("qid").agg(F.countDistinct("pid").alias("n_set"), F.count("*").alias("n_gold"))
    found = retrieved.select("qid", "pid", "rank").join(gold.select("qid", "pid").distinct(), ["qid", "pid"], "left_semi")
    near = F.col("rank") <= k
    per = found.groupBy("qid").agg(F.count_if(near).alias("n_hit"), F.min("rank").alias("first"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = n.join(per, "qid", "left")
    zero = F.lit(0.0)
    return rows.select(
        "qid",
        "n_gold",
        F.when(F.col("n_hit") > 0, 1.0).otherwise(0.0).alias("hit"),
        (F.coalesce("n_hit", F.lit(0)) / F.col("n_set")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        (F.coalesce("dcg", zero) / ideal).alias("ndcg"),
    )


def length_terciles(rows: DataFrame, value: str, key: str) -> DataFrame:
    """``rows`` with ``tercile``: n div 3 rows are short, as many medium, and the rest long; ties go by key."""
    return terciles(rows, value, key, ("short", "medium", "long"))


def terciles(rows: DataFrame, value: str, key: str, names: tuple[str, str, str]) -> DataFrame:
    """``rows`` with ``tercile``: the first n div 3 rows by value and key have the first name, as many the second, and the rest the third."""
    third = rows.count() // 3
    name = F.when(F.col("__rank") < third, names[0]).when(F.col("__rank") < 2 * third, names[1]).otherwise(names[2])
    return with_rank(rows, "__rank", value, key).withColumn("tercile", name).drop("__rank")


def retrieval_strata(metrics: DataFrame, value: str = "ndcg") -> DataFrame:
    """(example_id, kind, stratum): how well retrieval worked for each query of ``query_metrics``: whether a gold passage was among the best, and the tercile of ``value``."""
    rows = materialise(metrics.select(F.col("qid").alias("example_id"), "hit", value), "retrieval-quality")
    hit = rows.select("example_id", F.lit("gold retrieved").alias("kind"), F.when(F.col("hit") > 0, "yes").otherwise("no").alias("stratum"))
    third = terciles(rows.select("example_id", value), value, "example_id", ("low", "medium", "high"))
    return hit.unionByName(third.select("example_id", F.lit(f"{value} tercile").alias("kind"), F.col("tercile").alias("stratum")))


def hit_band(figures: DataFrame, low: float = 0.70, high: float = 0.95, k: int = 5) -> DataFrame:
    """``figures`` with ``in_band``: retrieval is neither useless nor saturated if low < hit < high."""
    return figures.withColumn("in_band", (F.col(f"hit_{k}") > low) & (F.col(f"hit_{k}") < high))


def gold_bucket(n):
    return F.when(n <= 5, BUCKETS[0]).when(n <= 10, BUCKETS[1]).otherwise(BUCKETS[2])


def _figures(k: int) -> list:
    names = {"hit": f"hit_{k}", "recall": f"recall_{k}", "mrr": "mrr", "ndcg": f"ndcg_{k}"}
    return [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(names[m]) for m in METRICS] + [F.count("qid").alias("n")]


def overall(metrics: DataFrame, k: int = 5) -> DataFrame:
    """One row of means and the number of queries; zeros without any."""
    return metrics.agg(*_figures(k))


def by(metrics: DataFrame, column: str, k: int = 5, value: str | None = None) -> DataFrame:
    """Means by stratum; with ``value`` its least and largest in the stratum too."""
    spread = [F.min(value).cast("double").alias("range_low"), F.max(value).cast("double").alias("range_high")] if value else []
    return metrics.groupBy(F.col(column).alias("stratum")).agg(*_figures(k), *spread)


def by_n_gold(metrics: DataFrame, k: int = 5) -> DataFrame:
    """The three strata by number of golds; an empty one has zeros and the range (0, 0)."""
    rows = by(metrics.withColumn("bucket", gold_bucket(F.col("n_gold"))), "bucket", k, "n_gold")
    every = metrics.sparkSession.createDataFrame([(b,) for b in BUCKETS], "stratum string")
    return every.join(F.broadcast(rows), "stratum", "left").na.fill(0)


def all_strata(metrics: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(kind, stratum, figures) for all queries and each of the columns, in one grouping-sets pass; kinds are told by the grouping id."""
    rows = metrics.groupingSets([[], *([c] for c in columns)], *columns).agg(F.grouping_id().alias("__g"), *_figures(k))
    full = (1 << len(columns)) - 1
    kind, stratum = F.lit("overall"), F.lit("all")
    for i, c in enumerate(columns):
        own = F.col("__g") == full - (1 << (len(columns) - 1 - i))
        kind, stratum = F.when(own, c).otherwise(kind), F.when(own, F.col(c)).otherwise(stratum)
    return rows.select(kind.alias("kind"), stratum.alias("stratum"), *rows.columns[len(columns) + 1 :])


def report(rows: list, k: int = 5) -> str:
    """A text table of ``all_strata`` rows, in a fixed order."""
    head = ["kind", "stratum", "n", f"hit_{k}", f"recall_{k}", "mrr", f"ndcg_{k}"]
    lines = ["  ".join(head)]
    for r in sorted(rows, key=lambda r: (r["kind"] != "overall", r["kind"], str(r["stratum"]))):
        lines.append("  ".join(f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in head))
    return "\n".join(lines)
