"""Steps whose memory, disk or time must not grow faster than their input."""

import gzip
import json
import random

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import analysis, pruned, retrieval, statistics, training
from quillon.plans.fixtures import examples, predictions, with_passages, with_passages_by
from quillon.session import table
from quillon.sources import files, json_ranges


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_predictions_are_not_broadcast(spark, sf):
    """A label gives thirty predictions, which Spark takes for as small as the labels."""
    strata = table(spark, sf, "documents").selectExpr("doc_id as example_id", "lang as stratum", "'lang' as kind")
    assert "BroadcastHashJoin" not in _plan(analysis.stratified(predictions(spark, sf), strata, "model"))
    assert "BroadcastHashJoin" not in _plan(statistics.paired(predictions(spark, sf), ("lora_b", "oracle", 42), ("base", "oracle", 42)))


def test_nearest_in_small_blocks(spark, monkeypatch):
    """Products of few queries and passages at a time, with a floor between them, give the same rows, ties too."""
    rng = random.Random(7)
    vectors = [[rng.choice((0.0, 0.5, 1.0)) for _ in range(3)] for _ in range(200)]  # many equal scores
    v = spark.createDataFrame(list(enumerate(vectors)), "pid long, embedding array<double>").coalesce(2)
    q = v.where("pid < 30").withColumnRenamed("pid", "qid")
    want = sorted((i, *t) for i in range(30) for t in [(p, r + 1, s) for r, (s, p) in enumerate(sorted(((sum(a * b for a, b in zip(vectors[i], x)), p) for p, x in enumerate(vectors) if p != i), key=lambda t: (-t[0], t[1]))[:5])])
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "PASSAGE_BLOCK", 3)  # fewer than k
    assert sorted(tuple(r) for r in retrieval.nearest(q, v, 5, True).select("qid", "pid", "rank", "score").collect()) == want


def test_pruned_in_small_batches(spark, monkeypatch):
    rng = random.Random(8)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(120)], "pid long, embedding array<double>").coalesce(2)
    q = v.where("pid < 25").withColumnRenamed("pid", "qid")
    monkeypatch.setattr(pruned, "STEP", 4)
    monkeypatch.setattr(pruned, "GIVEN", 3)
    got = pruned.nearest_pruned(q, pruned.Blocks(v, centres=9), 5, True)[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.nearest(q, v, 5, True).select(*got.columns).collect()))


def test_model_steps_hold_few_rows(spark, monkeypatch):
    """A worker holds no more rows than it is told to, whatever Spark's batches are, and gives the same answers."""
    monkeypatch.setattr(training, "HELD", 12)
    rows = spark.range(100).selectExpr("id as doc_id", "concat('p', id) as prompt", "'t' as target", "named_struct('a', id) as metadata")

    def model(texts):
        return [(f"{len(texts)} Answer: {t}", 1, 1) for t in texts]

    got = training.generate_batches(rows, lambda: model, 5, workers=1).select("doc_id", "metadata.a", "generated_answer", "response").collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(i, i, f"p{i}") for i in range(100)}
    assert sorted(r["response"][0] for r in got) == ["5"] * 100
    seen = spark.sparkContext.accumulator(0)

    def tokenizer():
        return lambda t: (seen.add(1), [ord(c) for c in t])[1]

    out = training.tokenised(rows.coalesce(1), tokenizer, 3)
    assert [f.dataType.simpleString() for f in out.schema.fields if f.name in ("input_ids", "labels", "metadata")] == ["struct<a:bigint>", "array<int>", "array<int>"]
    assert out.limit(1).collect()[0]["input_ids"] is not None and seen.value < 100  # the first few were enough


@pytest.mark.parametrize("n", [1, 4, 70])
def test_records_are_written_without_a_shuffle(spark, tmp_path, n):
    """The same passages as by blocks of ids; and what is written is compressed, whole and in the order of the examples."""
    d = str(tmp_path)
    spark.createDataFrame([(3 * i if n == 70 else i, f"text {i}", "en", "s", 8) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    rows = examples(spark, d)
    packed = with_passages_by(files.numbered(rows, "question_id", 8), spark, d, "file", 3)
    want = {r["question_id"]: r["passages"] for r in with_passages(rows, spark, d).collect()}
    assert {r["question_id"]: r["passages"] for r in packed.collect()} == want
    records = lambda x: training.recipes(x.where("generated_reasoning is not null"))
    files.write_expanded(packed, records, f"{d}/out", "recipe")
    ids = []
    for part in sorted((tmp_path / "out" / "recipe=b").glob("part-*.json.gz")):
        ids += [json.loads(line)["example_id"] for line in gzip.open(part, "rt")]
    assert ids == sorted(i for i in want if i % 50 != 49)


def test_tasks_of_ranges_do_not_grow(tmp_path, monkeypatch):
    """However many ranges a file has, tasks are bounded and get their own ranges only."""
    states = ";".join(f"0,{10 * 999},{10 * i},{10 * i + 10},0,0,0" for i in range(999))
    reader = json_ranges.JsonRangesReader({"path": str(tmp_path), "states": states, "files": "x"})
    parts = reader.partitions()
    assert len(parts) <= 256 and [r.begin for p in parts for r in p.ranges] == list(range(0, 9990, 10))
    assert len(cloudpickle.dumps(reader)) < 2000 + len(str(tmp_path))


def test_draws_are_looked_up_by_halving(spark):
    """A draw costs the logarithm of the distinct values, in plain columns without a lambda, and takes the value that a join with the ranked rows gives."""
    for k in (1, 2, 3, 8, 300):  # distinct values
        rows = spark.range(700).selectExpr("if(id < 500, 'a', null) as g", f"cast(id * id % {k} as double) / 8 as v")
        few, many = (statistics.resampled_means(rows, "v", ["g"], 20, 5, few) for few in (4096, 0))
        assert "lambda" not in _plan(few)
        assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and few.count() == 40


def test_draws_without_groups_are_looked_up_by_halving(spark, sf):
    pairs = statistics.paired(predictions(spark, sf), ("lora_b", "oracle", 42), ("base", "oracle", 42))
    few, many = (statistics.resampled_means(pairs, "diff", [], 30, 42, few) for few in (4096, 0))
    assert "lambda" not in _plan(few)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and few.count() == 30


def test_held_words_of_long_texts(spark):
    """The words asked for are sorted as plain strings, each text is split once, and repeats, odd characters and empty texts count as in plain Python."""
    rng = random.Random(9)
    bag = ["a", "A", "ab", "a\x01", "a\x00", "é", "é", "\U0001f600", "～", "[P1].", "zz"]
    texts = [(i, " ".join(rng.choices(bag, k=i % 40)) or None, " ".join(rng.choices(bag[: 1 + i % 11], k=i % 7))) for i in range(200)] + [(200, "", "a"), (201, "a a", None), (202, " \t", " ")]
    df = spark.createDataFrame(texts, "i int, some string, others string")
    out = df.select("i", T.held_words(T.words(F.col("some")), T.words(F.col("others"))).alias("n"), statistics.lexical_overlap(F.col("some"), F.col("others")).alias("share"))

    def held(a, b):
        return sum(w in b.split() for w in a.split())

    for r, (_, a, b) in zip(sorted(out.collect()), texts):
        a, b = a or "", b or ""
        assert r["n"] == held(a, b) and r["share"] == round(held(a.lower(), b.lower()) / max(len(a.split()), 1), 6)
    plan = _plan(df.select(statistics.lexical_overlap(F.col("some"), F.col("others")).alias("share")))
    assert "array_sort(" not in plan and plan.count("split(") == 2


@pytest.mark.parametrize("few", [0, 2, T.FEW_WORDS])
def test_held_words_without_a_sort(spark, few):
    """Texts that lack or hold only a few of the other's words are compared with these and not sorted, and count the same as sorted ones; empty words go without a step a word."""
    rng = random.Random(10)
    bag = [f"w{k}" for k in range(60)] + ["é", "\x00", "\U0001f600"]
    texts = []
    for i in range(120):
        others = rng.sample(bag, (0, 1, 5, 40, len(bag))[i % 5])
        own = rng.choices(bag, k=i) if i % 3 else rng.choices(others, k=i) if others else []
        texts.append((i, f" {' '.join(own)}\n\t{rng.choice(bag)} ", " ".join(others)))
    df = spark.createDataFrame(texts, "i int, some string, others string")
    held = df.select("i", T.held_words(T.words(F.col("some")), T.words(F.col("others")), few).alias("n"))
    assert {r["i"]: r["n"] for r in held.collect()} == {i: sum(w in set(b.split()) for w in a.split()) for i, a, b in texts}
    plan = _plan(held)
    assert "filter(split(" not in plan and plan.count("split(") == 2
