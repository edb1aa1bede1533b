"""Retrieval for all queries at once: exact top-k, rerank, oracle and closed-book conditions, distractors."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.order_statistics import with_rank
from quillon.functions.text import words
from quillon.session import materialise

#: Queries and passages whose products are held at once, bytes of the queries of a pass, digits of a score.
QUERY_BLOCK, PASSAGE_BLOCK, PASS_BYTES, DIGITS = 1024, 1024, 8 << 20, 9
#: Fixed value: what the encoder expects before a query; passages are encoded as they are.
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, by score and then id."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    first = np.searchsorted(r, r, side="left")
    return order[np.arange(len(r)) - first < k]


def nearest(queries: DataFrame, passages: DataFrame, k: int = 20, exclude_same: bool = False) -> DataFrame:
    """(qid, pid, rank, score): the exact k largest inner products of each query; ties go to the lesser id.

    ``queries`` (qid, embedding) go to the passages as broadcasts of at most ``PASS_BYTES``, each with one pass over the passages; within it the products are
    made for ``QUERY_BLOCK`` queries and ``PASSAGE_BLOCK`` passages at a time, and only those that reach a query's k-th best so far are kept, so a worker's memory is bounded, whatever the tables' sizes. A partition of ``passages`` (pid, embedding) keeps its k best of
    each query, so k rows a query and partition are shuffled, not one a pair. Scores are rounded to ``DIGITS`` decimals, so that
    the order does not depend on the order of a sum. Rows without a vector take no part."""
    spark = passages.sparkSession
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, pid {passages.schema['pid'].dataType.simpleString()}, score double"
    parts = [spark.createDataFrame([], schema)]

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, matrix = shared.value
            own = np.array(qids)
            held: dict[int, tuple] = {}
            floors = np.full(len(qids), -np.inf)
            for b in (batch.slice(i, PASSAGE_BLOCK) for batch in batches for i in range(0, batch.num_rows, PASSAGE_BLOCK)):
                vectors = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                ids = np.array(b.column(0).to_pylist())
                for a in range(0, len(qids), QUERY_BLOCK):
                    scores = matrix[a : a + QUERY_BLOCK] @ vectors.T
                    np.round(scores, DIGITS, out=scores)
                    if exclude_same:
                        scores[own[a : a + QUERY_BLOCK, None] == ids[None, :]] = -np.inf
                    floor = floors[a : a + QUERY_BLOCK]
                    if not np.isfinite(floor).all():
                        n = min(k, b.num_rows)
                        floor = np.maximum(floor, np.partition(scores, -n, axis=1)[:, -n])
                    r, c = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
                    if not len(r):
                        continue
                    new = (r, scores[r, c], ids[c])
                    both = tuple(np.concatenate(x) for x in zip(held[a], new)) if a in held else new
                    keep = _best(*both, k)
                    held[a] = tuple(x[keep] for x in both)
                    counts = np.bincount(held[a][0], minlength=len(floor))
                    full = counts >= k
                    floors[a : a + QUERY_BLOCK][full] = held[a][1][np.cumsum(counts)[full] - 1]
            for a, (r, s, found) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([qids[a + i] for i in r]), pa.array(found.tolist()), pa.array(s)], names=["qid", "pid", "score"])

        return passages.where(F.col("embedding").isNotNull()).select("pid", "embedding").mapInArrow(run, schema)

    def passes() -> Iterator[list]:
        block, size = [], 0
        for row in queries.where(F.col("embedding").isNotNull()).select("qid", "embedding").toLocalIterator():
            if block and size > PASS_BYTES:
                yield block
                block, size = [], 0
            block.append(row)
            size += 8 * len(row["embedding"])
        if block:
            yield block

    last = None
    for block in passes():
        if last is not None:  # more than one pass: its rows are written, and the driver holds one block
            parts.append(materialise(search(last), "nearest"))
            last.unpersist()
        last = spark.sparkContext.broadcast(([r["qid"] for r in block], np.array([r["embedding"] for r in block], np.float64)))
    if last is not None:
        parts.append(search(last))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "pid")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def with_text(retrieved: DataFrame, corpus: DataFrame) -> DataFrame:
    """Left join with the corpus (id, text, source); a missing passage has empty texts."""
    c = corpus.select(F.col("id").alias("pid"), "text", "source")
    return retrieved.join(c, "pid", "left").withColumns({x: F.coalesce(x, F.lit("")) for x in ("text", "source")})


def distinct_words(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def word_share(query: Column, passage: Column) -> Column:
    """The share of the query's distinct words that the passage has; both are arrays of distinct words."""
    return F.round(F.size(F.array_intersect(query, passage)) / F.greatest(F.size(query), F.lit(1)), DIGITS)


def lexical_score(query: Column, text: Column) -> Column:
    """The scorer of two texts where no model is given."""
    return word_share(distinct_words(query), distinct_words(text))


def rerank(retrieved: DataFrame, queries: DataFrame, k: int = 5, score=lexical_score) -> DataFrame:
    """Scores (qid, pid, rank, score, text) against ``queries`` (qid, question), best k; ties keep the dense order."""
    rows = retrieved.join(queries.select("qid", "question"), "qid").withColumn("rerank_score", score(F.col("question"), F.col("text")))
    return _by_rerank_score(rows.drop("question"), k)


def _by_rerank_score(rows: DataFrame, k: int) -> DataFrame:
    rows = rows.withColumnsRenamed({"score": "dense_score", "rank": "dense_rank"})
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "dense_rank")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def lexical_rerank(retrieved: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """``rerank`` by ``lexical_score``, with the words of each text taken once and not once a pair."""
    q = queries.select("qid", distinct_words(F.col("question")).alias("__q"))
    p = corpus.select(F.col("id").alias("pid"), distinct_words(F.col("text")).alias("__p"))
    rows = retrieved.join(p, "pid", "left").join(q, "qid").withColumn("rerank_score", word_share(F.col("__q"), F.coalesce("__p", F.array().cast("array<string>"))))
    return _by_rerank_score(rows.drop("__q", "__p"), k)


def oracle(gold: DataFrame, corpus_ids: DataFrame, retrieved: DataFrame, k: int = 5, compat: bool = False) -> DataFrame:
    """(qid, pid, rank, score, is_gold): gold passages first with score 1, then retrieved ones that are not gold.

    ``gold`` is (qid, pid, pos from 0). Ranks are contiguous; with ``compat`` a gold rank counts golds that the corpus lacks."""
    found = gold.join(corpus_ids.select(F.col("id").alias("pid")).distinct(), "pid", "left_semi")
    by_pos = Window.partitionBy("qid").orderBy("pos")
    found = found.withColumn("nth", F.row_number().over(by_pos).cast("long")).where(F.col("nth") <= k)
    top = found.select("qid", "pid", (F.col("pos") + 1 if compat else F.col("nth")).cast("long").alias("rank"), F.lit(1.0).alias("score"), F.lit(True).alias("is_gold"))
    have = found.groupBy("qid").agg(F.max("nth").alias("n"))
    pad = retrieved.select("qid", "pid", "rank", "score").join(gold, ["qid", "pid"], "left_anti").join(have, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pad = pad.withColumn("nth", F.col("n") + F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("nth") <= k)
    return top.unionByName(pad.select("qid", "pid", F.col("nth").cast("long").alias("rank"), "score", F.lit(False).alias("is_gold")))


def closed_book(queries: DataFrame) -> DataFrame:
    """The condition without retrieval: each query, and no passage."""
    return queries.select("qid", F.lit(None).cast("long").alias("pid"), F.lit(0).cast("long").alias("n_passages"))


def distractors(retrieved: DataFrame, gold: DataFrame, mode: str) -> DataFrame:
    """(qid, pid, position): the best 4 (easy) or 5 (hard) retrieved passages that are not gold; queries with fewer get no rows but
    a status row with position 0."""
    if mode not in ("easy", "hard"):
        raise ValueError(f"mode must be 'easy' or 'hard', got {mode!r}")
    need = 4 if mode == "easy" else 5
    rest = retrieved.join(gold.select("qid", "pid"), ["qid", "pid"], "left_anti")
    w = Window.partitionBy("qid").orderBy("rank")
    top = rest.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= need)
    enough = F.count("*").over(Window.partitionBy("qid")) >= need
    return top.withColumn("ok", enough).select("qid", F.when(F.col("ok"), F.col("pid")).alias("pid"), F.when(F.col("ok"), F.col("position")).otherwise(0).alias("position")).distinct()


def seeded_distractors(gold: DataFrame, corpus: DataFrame, per_query: int, seed: int = 42, gold_share: float = 0.8) -> DataFrame:
    """(qid, pid, is_gold, position): a seeded coin keeps one gold passage with ``per_query`` - 1 others, or gives ``per_query`` others: each set of passages of the corpus that are no gold of the query is equally likely.

    A passage is drawn by its rank in the order of ids. For a query with g golds Floyd's sampling draws k + g ranks without repetition; of these g are gold at most, so k others are left, and
    no draw is made again. Only the drawn ranks, k + g a query, meet the corpus. Golds that the corpus lacks are no golds. A query with too few others in the whole corpus has one row, without pid, at position 0."""

    def drawn(salt: int, *parts: str | Column) -> Column:
        text = F.concat_ws("|", F.lit(seed + salt), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")  # 60 bits

    ranked = materialise(with_rank(corpus.select(F.col("id").alias("pid")).distinct(), "rank", "pid"), "passage-ranks")
    n = ranked.count()
    golds = gold.select("qid", "pid").distinct()
    known = golds.join(ranked, "pid", "left_semi")
    one = golds.select("qid").distinct().join(known.groupBy("qid").agg(F.count("*").alias("g"), F.min_by("pid", F.struct(drawn(0, "qid", "pid"), "pid")).alias("gold_pid")), "qid", "left")
    one = one.withColumn("g", F.coalesce("g", F.lit(0))).withColumn("with_gold", (drawn(1, "qid") % 1000 < int(1000 * gold_share)) & (F.col("g") > 0))
    one = one.withColumn("need", F.lit(per_query) - F.col("with_gold").cast("int"))
    size = F.least(F.lit(n), F.col("need") + F.col("g"))

    def next_rank(taken: Column, i: Column) -> Column:
        last = F.lit(n) - F.col("size") + i  # ranks up to here may be drawn now
        rank = drawn(2, F.col("qid"), i) % (last + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, rank), last).otherwise(rank)))

    none = F.array().cast("array<bigint>")
    ranks = F.when(F.col("size") > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), none, next_rank)).otherwise(none)
    draws = one.withColumn("size", size.cast("long")).select("qid", "need", F.explode(ranks).alias("rank"))
    others = draws.join(ranked, "rank").join(golds, ["qid", "pid"], "left_anti")
    w = Window.partitionBy("qid").orderBy(drawn(3, "qid", "pid"), "pid")
    others = others.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= F.col("need"))
    enough = others.groupBy("qid").agg(F.count("*").alias("found")).withColumnRenamed("qid", "__qid")
    one = one.join(enough, F.col("qid") == F.col("__qid"), "left").withColumn("ok", F.coalesce("found", F.lit(0)) == F.col("need")).drop("__qid")
    full = one.where("ok").select("qid")
    rows = others.join(full, "qid", "left_semi").select("qid", "pid", F.lit(False).alias("is_gold"))
    rows = rows.unionByName(one.where("ok and with_gold").select("qid", F.col("gold_pid").alias("pid"), F.lit(True).alias("is_gold")))
    w = Window.partitionBy("qid").orderBy(drawn(4, "qid", "pid"), "pid")
    short = one.where("not ok").select("qid", F.lit(None).cast(ranked.schema["pid"].dataType).alias("pid"), F.lit(False).alias("is_gold"), F.lit(0).cast("long").alias("position"))
    return rows.withColumn("position", F.row_number().over(w).cast("long")).unionByName(short)


def asked(question: Column, prefix: str = QUERY_INSTRUCTION) -> Column:
    """A question as an asymmetric encoder takes it."""
    return F.concat(F.lit(prefix), F.coalesce(question, F.lit("")))


def embed(rows: DataFrame, column: str, model, name: str = "embedding", prefix: str = "") -> DataFrame:
    """``rows`` with the unit vectors that ``model()`` gives: a factory called once a worker, whose result maps a list of texts to a matrix. ``prefix`` goes
    before each text: ``QUERY_INSTRUCTION`` for queries, nothing for passages."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for s in parts:
            m = np.asarray(encode(s.tolist()), np.float64)
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            yield pd.Series(list((m / np.where(norms == 0, 1, norms)).astype(np.float32)))

    return rows.withColumn(name, F.pandas_udf(run, "array<float>")(asked(F.col(column), prefix)))
