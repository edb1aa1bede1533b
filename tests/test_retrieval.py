"""Retrieval and its metrics on hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation, retrieval


def lists(spark, retrieved, gold):
    """(retrieved, gold) of id lists for each query."""
    r = [(q, p, i + 1) for q, ids in enumerate(retrieved) for i, p in enumerate(ids)]
    g = [(q, p, i) for q, ids in enumerate(gold) for i, p in enumerate(ids)]
    return spark.createDataFrame(r, "qid int, pid string, rank int"), spark.createDataFrame(g, "qid int, pid string, pos int")


def metrics(spark, retrieved, gold, k=5):
    rows = evaluation.query_metrics(*lists(spark, retrieved, gold), k).collect()
    return {r["qid"]: (r["hit"], r["recall"], r["mrr"], r["ndcg"]) for r in rows}


def test_hand_cases(spark):
    got = metrics(spark, [["a", "b"], ["x", "a"], ["x", "y", "z", "u", "v", "a"], ["a", "b", "c"], ["a"]], [["a"], ["a"], ["a"], ["c", "a", "q"], []])
    log = math.log2
    assert got[0] == (1, 1, 1, 1)
    assert got[1] == pytest.approx((1, 1, 0.5, 1 / log(3)))
    assert got[2] == pytest.approx((0, 0, 1 / 6, 0))
    assert got[3] == pytest.approx((1, 2 / 3, 1, (1 + 1 / log(4)) / (1 + 1 / log(3) + 1 / log(4))))
    assert 4 not in got


def test_duplicate_golds(spark):
    got = metrics(spark, [["a", "b"]], [["a", "a"]])
    assert got[0] == pytest.approx((1, 1, 1, 1 / (1 + 1 / math.log2(3))))


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(42)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[7] = v[3]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "pid long, embedding array<float>").repartition(5)
    got = retrieval.nearest(df.withColumnRenamed("pid", "qid"), df, 6, exclude_same=True).collect()
    scores = np.round(v.astype(np.float64) @ v.astype(np.float64).T, retrieval.DIGITS)
    np.fill_diagonal(scores, -9)
    want = {(q, int(p), r + 1) for q in range(60) for r, p in enumerate(sorted(range(60), key=lambda p: (-scores[q, p], p))[:6])}
    assert {(r["qid"], r["pid"], r["rank"]) for r in got} == want


def test_rerank_keeps_order_in_ties(spark):
    rows = spark.createDataFrame([(1, f"p{i}", i + 1, 1.0 - i / 10, t) for i, t in enumerate(["none", "alpha beta", "none", "alpha", "alpha beta x"])], "qid int, pid string, rank int, score double, text string")
    got = retrieval.rerank(rows, spark.createDataFrame([(1, "Alpha beta")], "qid int, question string"), 4).orderBy("rank").collect()
    assert [r["pid"] for r in got] == ["p1", "p4", "p3", "p0"]
    once = retrieval.lexical_rerank(rows.drop("text"), spark.createDataFrame([(1, "Alpha beta")], "qid int, question string"), rows.select(F.col("pid").alias("id"), "text"), 4).orderBy("rank").collect()
    assert [r["pid"] for r in once] == ["p1", "p4", "p3", "p0"]


def test_oracle(spark):
    gold = spark.createDataFrame([(1, "g1", 0), (1, "lost", 1), (1, "g2", 2), (2, "g1", 0)], "qid int, pid string, pos int")
    corpus = spark.createDataFrame([(x,) for x in ("g1", "g2", "a", "b", "c", "d")], "id string")
    found = spark.createDataFrame([(q, p, r + 1, 0.5) for q in (1, 2) for r, p in enumerate(["a", "g1", "b", "c", "d"])], "qid int, pid string, rank int, score double")
    got = {(r["qid"], r["rank"]): (r["pid"], r["is_gold"]) for r in retrieval.oracle(gold, corpus, found, 4).collect()}
    assert got == {(1, 1): ("g1", True), (1, 2): ("g2", True), (1, 3): ("a", False), (1, 4): ("b", False), (2, 1): ("g1", True), (2, 2): ("a", False), (2, 3): ("b", False), (2, 4): ("c", False)}
    assert {r["rank"] for r in retrieval.oracle(gold, corpus, found, 4, compat=True).where("qid = 1 and is_gold").collect()} == {1, 3}


@pytest.mark.parametrize("n", [4, 5, 7, 8, 10])
def test_terciles(spark, n):
    rows = spark.createDataFrame([(i, float(i // 3)) for i in range(n)], "qid int, v double")
    got = {r["qid"]: r["tercile"] for r in evaluation.length_terciles(rows, "v", "qid").collect()}
    assert [got[i] for i in range(n)] == ["short"] * (n // 3) + ["medium"] * (n // 3) + ["long"] * (n - 2 * (n // 3))


def test_strata(spark):
    rows = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1.0, n, "yes" if i % 2 else None) for i, n in enumerate([3, 8, 3])], "qid int, hit double, recall double, mrr double, ndcg double, n_gold int, answer string")
    got = {r["stratum"]: (r["n"], r["range_low"], r["range_high"]) for r in evaluation.by_n_gold(rows).collect()}
    assert got == {"low (1-5)": (2, 3, 3), "medium (6-10)": (1, 8, 8), "high (11+)": (0, 0, 0)}
    kinds = sorted((r["kind"], r["stratum"] or "", r["n"]) for r in evaluation.all_strata(rows, ["answer"]).collect())
    assert kinds == [("answer", "", 2), ("answer", "yes", 1), ("overall", "all", 3)]
    assert "overall" in evaluation.report(evaluation.all_strata(rows, ["answer"]).collect())


def test_distractors(spark):
    found = spark.createDataFrame([(1, f"p{i}", i) for i in range(1, 7)] + [(2, "p1", 1)], "qid int, pid string, rank int")
    gold = spark.createDataFrame([(1, "p2")], "qid int, pid string")
    got = {(r["qid"], r["pid"], r["position"]) for r in retrieval.distractors(found, gold, "easy").collect()}
    assert got == {(1, "p1", 1), (1, "p3", 2), (1, "p4", 3), (1, "p5", 4), (2, None, 0)}
    with pytest.raises(ValueError):
        retrieval.distractors(found, gold, "other")


def test_seeded_distractors(spark):
    corpus = spark.range(500).select(F.col("id").cast("string").alias("id"))
    gold = spark.createDataFrame([(q, str(q)) for q in range(200)], "qid int, pid string")
    rows = retrieval.seeded_distractors(gold, corpus, 5).collect()
    assert sorted(rows) == sorted(retrieval.seeded_distractors(gold, corpus, 5).collect())
    with_gold = {r["qid"] for r in rows if r["is_gold"]}
    assert 0.7 < len(with_gold) / 200 < 0.9
    assert not any(r["pid"] == str(r["qid"]) and not r["is_gold"] for r in rows)


def test_embed(spark):
    rows = spark.createDataFrame([("ab",), ("",)], "t string")
    got = retrieval.embed(rows, "t", lambda: lambda texts: [[len(t), 0.0] for t in texts]).collect()
    assert [list(r["embedding"]) for r in got] == [[1.0, 0.0], [0.0, 0.0]]


def test_pruned_search_is_exact(spark):
    """The rows of the search over all pairs, on clustered vectors with copies and ties, by far fewer blocks."""
    import numpy as np

    from quillon.operators import pruned

    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (30, 12))
    rows = [(i, (centres[i % 30] + rng.normal(0, 0.2, 12)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(400)] + [(3000, None)]
    passages = spark.createDataFrame(rows, "pid long, embedding array<float>")
    queries = passages.where("pid % 7 = 0 or pid = 3000").withColumnRenamed("pid", "qid")
    for exclude, k in ((True, 20), (False, 3), (False, 5000)):
        want = sorted(map(tuple, retrieval.nearest(queries.where("qid < 500" if k == 5000 else "true"), passages, k, exclude).collect()))
        got, counts = pruned.nearest_pruned(queries.where("qid < 500" if k == 5000 else "true"), pruned.Blocks(passages, centres=60, most=100), k, exclude)
        got = sorted((r["qid"], r["pid"], r["score"], r["rank"]) for r in got.collect())
        assert got == sorted((q, p, s, r) for q, p, s, r in [(r[0], r[1], r[2], r[3]) for r in want])
        if k < 100:
            seen = counts.collect()
            assert sum(r["n_scored"] for r in seen) < 0.25 * sum(r["n_blocks"] for r in seen)
    empty = pruned.nearest_pruned(queries, pruned.Blocks(passages.where("pid < 0")), 3)
    assert empty[0].count() == 0 and empty[0].columns == ["qid", "pid", "rank", "score"]


def test_blocks_are_bounded(spark):
    from quillon.operators import pruned

    rows = [(i, [1.0, 0.0]) for i in range(900)] + [(1000 + i, [0.0, float(i)]) for i in range(50)]
    blocks = pruned.Blocks(spark.createDataFrame(rows, "pid long, embedding array<float>"), centres=5, most=100)
    shapes = blocks.shapes.collect()
    assert sum(r["n"] for r in shapes) == 950 and max(r["n"] for r in shapes) < 200  # copies, too, are parted
