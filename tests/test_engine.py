"""Sources, splits, training sets, statistics, streaming, and the entry points."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon import schemas
from quillon.operators import audit, corpus, quality, splits, statistics, training
from quillon.plans import catalogue
from quillon.sources import files, questions
from quillon.streaming import progress


def test_question_files(spark, tmp_path):
    qs = [
        {"id": "1", "body": "q1", "type": "YesNo", "exact_answer": "Yes", "ideal_answer": ["i1"], "snippets": [{"text": "", "document": "d"}, {"text": "t", "document": "d"}]},
        {"id": "2", "body": "q2", "type": "factoid", "exact_answer": [["a", "b"]], "ideal_answer": "i2", "snippets": [{"text": "t2", "document": "d"}]},
        {"id": "3", "body": "q3", "type": "factoid", "exact_answer": ["x"], "snippets": [{"text": "t3", "document": "d"}]},
        {"id": "4", "body": "q4", "type": "factoid", "exact_answer": [], "snippets": [{"text": "t", "document": "d"}]},
        {"id": "5", "body": "q5", "type": "list", "exact_answer": "x", "snippets": [{"text": "t", "document": "d"}]},
        {"id": "6", "body": "", "type": "yesno", "exact_answer": "no", "snippets": [{"text": "t", "document": "d"}]},
        {"id": "7", "body": "q7", "type": "yesno", "exact_answer": "no", "snippets": [{"text": "", "document": "d"}]},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"questions": qs}))
    rows = {r["id"]: r for r in questions.questions(questions.question_files(spark, str(tmp_path))).collect()}
    assert {k: (r["answer"], r["ideal_answer"], r["gold_passage_ids"]) for k, r in rows.items()} == {"1": ("yes", "i1", ["bioasq_1_snip1"]), "2": ("a", "i2", ["bioasq_2_snip0"]), "3": ("x", "", ["bioasq_3_snip0"])}
    passages = corpus.snippet_passages(questions.questions(questions.question_files(spark, str(tmp_path))))
    assert passages.count() == 3


def test_abstracts_and_choices(spark):
    raw = spark.createDataFrame([(9, "q", (["a", "b"],), "long", "YES")], "pubid int, question string, context struct<contexts:array<string>>, long_answer string, final_decision string")
    row = questions.labelled_abstracts(raw).first()
    assert (row["id"], row["context"], row["answer"], row["gold_passage_ids"]) == ("9", "a b", "yes", ["pubmedqa_9"])
    raw = spark.createDataFrame([(0, "q", ["x", "y"], 1), (1, "q", ["x", "y", "z", "u"], 9)], "n int, question string, choices array<string>, answer int")
    got = questions.choice_lists(raw, "anatomy", "n").orderBy("id").collect()
    assert [(r["id"], r["answer"], [o["text"] for o in r["options"]]) for r in got] == [("mmlu_anatomy_0", "B", ["x", "y", "", ""]), ("mmlu_anatomy_1", "A", ["x", "y", "z", "u"])]
    raw = spark.createDataFrame([(0, "q", {"A": "a", "D": "d"}, None)], "n int, question string, options map<string,string>, answer_idx string")
    assert [o["text"] for o in questions.choice_maps(raw, "n").first()["options"]] == ["a", "", "", "d"]
    ids = spark.createDataFrame([("mmlu_a_1",), ("medqa_1",), ("medmcqa_1",), ("z",)], "id string")
    assert [r[0] for r in ids.select(questions.source_of_id(F.col("id"))).collect()] == ["mmlu_med", "medqa_us", "medmcqa", "unknown"]


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2, "b"\n{"a": 3, "b": "z"}\n')
    assert [r["a"] for r in files.tolerant_lines(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()] == [1, 3]
    assert files.tolerant_lines(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(Exception):
        files.strict_lines(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()


def test_config(tmp_path):
    (tmp_path / "b.yaml").write_text("model: {a: 1, b: 2}\nx: {p: 1}\n")
    (tmp_path / "r.yaml").write_text("model: {b: 3}\nx: {q: 1}\n")
    assert files.read_config(str(tmp_path / "r.yaml"), str(tmp_path / "b.yaml")) == {"model": {"a": 1, "b": 3}, "x": {"q": 1}}


def test_corpus_first_wins(spark):
    a = spark.createDataFrame([("1", " Text ", "a", 5), ("2", "text", "a", 1)], "id string, text string, source string, ord long")
    b = spark.createDataFrame([("3", "TEXT ", "b", 0), ("4", "other", "b", 1)], "id string, text string, source string, ord long")
    assert sorted(r["id"] for r in corpus.build_corpus(a, b).collect()) == ["2", "4"]
    s = corpus.corpus_stats(spark.createDataFrame([("a",), ("a b",), ("a b c",), ("",)], "text string")).first()
    assert (s["min_words"], s["p25_words"], s["median_words"], s["p75_words"], s["max_words"]) == (0, 1, 2, 3, 3)
    assert corpus.corpus_stats(spark.createDataFrame([], "text string")).first()["median_words"] == 0


def test_splits(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "factoid").otherwise("yesno").alias("t"))
    got = {(r["split"], r["t"]): r["count"] for r in splits.stratified_split(rows, "id", "t", "factoid", 42, 500, 100).groupBy("split", "t").count().collect()}
    assert got == {("test", "factoid"): 167, ("test", "yesno"): 333, ("dev", "factoid"): 33, ("dev", "yesno"): 67, ("train", "factoid"): 134, ("train", "yesno"): 266}
    p = splits.permutation_split(rows, "id", 1, {"dev": 50, "test": 500}, "train")
    assert {r["split"]: r["count"] for r in p.groupBy("split").count().collect()} == {"dev": 50, "test": 500, "train": 450}
    assert splits.overlap(p.where("split = 'dev'"), p.where("split = 'test'"), "id").isEmpty()
    assert splits.least(rows, "id", 3, 20).count() == 20
    q = splits.quota_subset(rows, "id", "t", 3, 165, 500, "yesno").groupBy("t").count().collect()
    assert {r["t"]: r["count"] for r in q} == {"factoid": 165, "yesno": 335}
    assert splits.conditions("mirage") == ["none", "strong"]
    with pytest.raises(ValueError):
        splits.conditions("other")
    assert sorted(splits.python_permutation(9, 42)) == list(range(9))


def test_hash_lock(spark):
    rows = [("b", 'say "x"\\'), ("a", "plain")]
    want = json.dumps([{"id": i, "question": q} for i, q in sorted(rows)])
    for order in (rows, rows[::-1]):
        got = splits.test_hash(spark.createDataFrame(order, "id string, question string"), "id", "id", "question").first()
        assert (got["hash"], got["size"]) == (hashlib.sha256(want.encode()).hexdigest(), 2)


CASES = [
    # reasoning, answer, gold, type, failing filter
    (None, "Yes", "yes", "yesno", "format"),
    ("no marker " * 20, "Yes", "yes", "yesno", "citations"),
    ("[P1] [P7] " + "w " * 30, "Yes", "yes", "yesno", "citation_validity"),
    ("[P1] short", "Yes", "yes", "yesno", "reasoning_length"),
    ("[P1] " + "w " * 201, "Yes", "yes", "yesno", "reasoning_length"),
    ("[P1] " + "w " * 30, " ", "yes", "yesno", "answer_format"),
    ("[P1] " + "w " * 30, "Sure", "yes", "yesno", "answer_format"),
    ("[P1] " + "w " * 30, "w " * 31, "x", "factoid", "answer_format"),
    ("[P1] " + "w " * 30, "No", "yes", "yesno", "gold_answer_agreement"),
    ("[P1] " + "w " * 30, "five", "3", "factoid", "gold_answer_agreement"),
    ("[P1] " + "w " * 30, "Maybe", "yes", "yesno", None),
    ("[P1] " + "w " * 30, "three mg", "3 g", "factoid", None),
    ("w " * 30, "Insufficient evidence", "yes", "yesno", None),
    ("[P1] " + "w " * 30, "Yes", "", "yesno", "gold_answer_agreement"),
    ("[P1] " + "w " * 30, "Yes", "yes", "list", "answer_format"),
]


def generated(spark):
    rows = [(str(i), r, a, g, t, "easy") for i, (r, a, g, t, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "question_id string, generated_reasoning string, generated_answer string, gold_answer string, question_type string, mode string")


@pytest.mark.parametrize("ascii_only", [True, False])
def test_cascade(spark, ascii_only):
    out = quality.apply_filters(quality.apply_filters(generated(spark), ascii_only), ascii_only)
    got = {int(r["question_id"]): r for r in out.collect()}
    assert [got[i]["filter_failed_at"] for i in range(len(CASES))] == [c[-1] for c in CASES]
    assert got[10]["gold_disagreement"] == "model_hedged_yes" and got[3]["filter_failure_reason"] == "Reasoning too short (2 words, need ≥20)"
    counts = {r["filter"]: r["n"] for r in quality.rejections(out).collect()}
    assert sum(counts.values()) == 12 and len(counts) == 6
    assert quality.pass_rates(out).where("kind = 'overall'").first()["passed"] == 3


def test_recipes(spark):
    rows = spark.createDataFrame([("1", "Q", "yesno", "yes", "easy", "see P2", "Yes", [(2, "b"), (1, "a")])], "question_id string, question string, question_type string, gold_answer string, mode string, generated_reasoning string, generated_answer string, passages array<struct<position:int,text:string>>")
    got = {r["recipe"]: r for r in training.recipes(rows).collect()}
    assert got["a_prime"]["prompt"] == got["b"]["prompt"] != got["a"]["prompt"]
    assert "Passage [P1]: a\n\nPassage [P2]: b" in got["b"]["prompt"]
    assert got["a"]["target"] == "Answer: yes<|eot_id|>" and got["b"]["target"] == "see [P2]\n\nAnswer: yes<|eot_id|>"
    assert training.misaligned(training.recipes(rows)).isEmpty()


def test_generate_and_budget(spark):
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(6)], "question_id string, prompt string")

    def factory():
        def call(prompt):
            if prompt == "p3":
                raise RuntimeError("no")
            return f"Reasoning: r [P1]\n\nAnswer: {prompt}", 1000, 100

        return call

    rows = {r["question_id"]: r for r in training.generate(prompts, factory, 2).collect()}
    assert rows["1"]["generated_answer"] == "p1" and rows["1"]["cost_estimate"] == pytest.approx(0.0015)
    assert (rows["3"]["status"], rows["3"]["error"]) == ("error", "no")
    priced = spark.createDataFrame([(i, 1.0) for i in range(50)], "i int, c double").repartition(7)
    assert sorted(r["i"] for r in training.within_budget(priced, "i", "c", 10.5).collect()) == list(range(11))
    assert training.within_budget(priced, "i", "c", 100.0, 7).count() == 7
    done = spark.createDataFrame([("1", "easy")], "question_id string, mode string")
    assert training.work_items(prompts, done).count() == 11


def test_masking(spark):
    rows = spark.createDataFrame([("ab", "cd"), ("abcdef", "gh")], "prompt string, target string")
    got = training.tokenised(rows, lambda: lambda t: [ord(c) for c in t], 5).orderBy("prompt").collect()
    assert [r["labels"] for r in got] == [[-100, -100, 99, 100], [-100] * 5]
    assert all(len(r["labels"]) == len(r["input_ids"]) == len(r["attention_mask"]) for r in got)


def test_statistics(spark):
    rows = [(i, "m", "r", 1, p, g, c) for i, (p, g, c) in enumerate([("yes", "yes", 1.0), ("no", "yes", 0.9), ("no", "no", 0.05), ("maybe", "no", 0.6)])]
    pred = spark.createDataFrame(rows, "example_id int, model string, retrieval string, seed int, predicted string, gold string, confidence double")
    got = statistics.all_metrics(pred, *statistics.CELL).first()
    assert got["accuracy"] == 0.5 and got["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3, abs=1e-6)
    assert got["ece"] == pytest.approx((0 + 0.9 + 0.95 + 0.6) / 4)
    h = spark.range(1).select(statistics.cohens_h(F.lit(0.5), F.lit(0.25)).alias("h")).select("h", statistics.effect_name(F.col("h")).alias("n")).first()
    assert h["h"] == pytest.approx(0.5235987) and h["n"] == "medium"
    boot = statistics.bootstrap(spark.createDataFrame([(i, 1) for i in range(20)], "k int, d int"), "k", "d", 20).first()
    assert (boot["mean_diff"], boot["ci_lower"], boot["ci_upper"], boot["p_value"]) == (1, 1, 1, 0)
    assert statistics.cells(spark).count() == 30
    assert statistics.mean_std(71.25, 1.04) == "$71.2 \\pm 1.0$" and statistics.p_text(0.0004) == "$p < 0.001$" and statistics.p_text(0.25) == "$p = 0.25$"


def test_power(spark):
    rows = {r["effect"]: r["power"] for r in statistics.power(spark, (0, 8), simulations=40).collect()}
    assert rows[8] > 0.9 > 0.3 > rows[0]


def test_audit(spark):
    df = spark.createDataFrame([("train", "yesno"), ("train", "factoid"), ("dev", "yesno")], "split string, question_type string")
    assert {tuple(r) for r in audit.split_types(df).collect()} == {("train", 1, 1), ("dev", 0, 1)}
    assert "| dev | 0 | 1 |" in audit.markdown("Audit", {"splits": audit.split_types(df)})
    notes = spark.createDataFrame([("c", ["refusal", "reasoning_error"]), ("c", ["refusal"])], "cell_name string, error_categories array<string>")
    assert {tuple(r) for r in audit.error_breakdown(notes).collect()} == {("c", "refusal", 2), ("c", "reasoning_error", 1)}
    assert audit.error_categories(spark).count() == 7


def test_streams(spark, tmp_path):
    rows = generated(spark)
    schema = "question_id string, generated_reasoning string, generated_answer string, gold_answer string, question_type string, mode string, cost_estimate double"
    priced = rows.withColumn("cost_estimate", F.lit(0.5))
    files.append_lines(priced, f"{tmp_path}/in")
    files.append_lines(priced.limit(4), f"{tmp_path}/in")
    stream = progress.progress_stream(spark, f"{tmp_path}/in", schema)
    progress.filtered_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    seen = []
    progress.spend_stream(progress.progress_stream(spark, f"{tmp_path}/in", schema), lambda n, d: seen.append((n, d)), f"{tmp_path}/cp2").awaitTermination(120)
    assert seen[-1] == (19, 9.5)


def test_entry(spark, sf):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_schemas(spark):
    for name in ("QA_EXAMPLE", "MCQ_EXAMPLE", "PASSAGE", "PASSAGE_VECTOR", "GENERATED", "TRAIN_RECORD", "PREDICTION", "ANNOTATION"):
        assert spark.createDataFrame([], getattr(schemas, name)).columns


def test_works_without_llm(tmp_path):
    """The engine imports where the llm folders and the pipeline are deleted."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(catalogue.QUERIES)
