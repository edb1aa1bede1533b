"""Locks, arguments, ranks, JSON and the other rules that the catalogue's queries do not reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.order_statistics import with_rank
from quillon.operators import analysis, audit, corpus, evaluation, quality, retrieval, splits, statistics, training
from quillon.sources import files, questions


def test_json_string(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice('ab "\\/\n\r\t\b\f\x00\x1f\x7fé߿€ 😀') for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["plain ASCII", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.json_string(F.col("t")).alias("j")).collect()
    assert {r["i"]: r["j"] for r in rows} == {i: json.dumps(t) for i, t in enumerate(texts)}


def test_hash_of_accents(spark):
    """The lock of a set with accents, as Python's own JSON gives it."""
    import hashlib

    rows = [("b", "é yes"), ("a", "no 😀"), ("c", None)]
    want = json.dumps([{"answer": t or "", "id": i} for i, t in sorted(rows)], sort_keys=True)
    got = splits.test_hash(spark.createDataFrame(rows, "id string, answer string"), "id", "id", "answer").first()
    assert (got["hash"], got["size"]) == (hashlib.sha256(want.encode()).hexdigest(), 3)


def test_label_of_several_lines(spark):
    df = spark.createDataFrame([("Yes at first glance.\nBut the trial says no.",), ("maybe\nyes\n",)], "t string")
    assert [r[0] for r in df.select(T.extract_label(F.col("t"))).collect()] == ["no", "yes"]


def test_arguments(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        splits.check_split("validation")
    assert splits.check_split("dev") == "dev"
    for bad in ("other", "bioasq"):
        with pytest.raises(ValueError):
            splits.splits_of(bad, {"mirage": lambda s: spark.range(3)})
    parts = splits.splits_of("pubmedqa", {"pubmedqa": lambda s: spark.range(len(s))})
    assert {k: v.count() for k, v in parts.items()} == {"train": 5, "dev": 3, "test": 4}
    monkeypatch.delenv("BIOASQ_DATA_PATH", raising=False)
    with pytest.raises(ValueError):
        questions.source_path()
    monkeypatch.setenv("BIOASQ_DATA_PATH", str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        questions.files_of(spark, questions.source_path())


def test_lock(spark, tmp_path):
    path = f"{tmp_path}/split"
    first = {tuple(r) for r in splits.locked(spark, path, lambda: spark.createDataFrame([("a", "test")], "id string, split string")).collect()}
    again = {tuple(r) for r in splits.locked(spark, path, lambda: 1 / 0).collect()}
    assert first == again == {("a", "test")}
    examples = spark.createDataFrame([("a", 0, "old"), ("a", 1, "new"), ("b", 2, "x")], "id string, ord int, text string")
    ids = spark.createDataFrame([("a",)], "id string")
    assert [r["text"] for r in splits.split_examples(ids, examples).collect()] == ["new"]
    with pytest.raises(KeyError):
        splits.split_examples(spark.createDataFrame([("z",)], "id string"), examples)


def test_subjects(spark):
    def load(k):
        if k == 1:
            raise OSError("gone")
        return spark.createDataFrame([(j, f"q{j}", ["x", "y"], j) for j in range(3)], "n int, question string, choices array<string>, answer int")

    with pytest.warns(UserWarning, match="b was not loaded"):
        rows = questions.subjects({"a": lambda: load(0), "b": lambda: load(1), "c": lambda: load(2)}, "n").collect()
    assert sorted((r["id"], r["answer"]) for r in rows) == [(f"mmlu_{s}_{j}", "ABC"[j]) for s in "ac" for j in range(3)]
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        questions.subjects({"b": lambda: load(1)}, "n")


def test_abstract_of_equal_ids(spark):
    """Of equal passage ids the first question's passage is taken, always."""
    df = spark.createDataFrame([("2", "second"), ("1", "first"), ("3", "third")], "id string, context string")
    df = df.select("id", "context", F.lit("s").alias("source"), F.lit("q").alias("question"), F.array(F.lit("p")).alias("gold_passage_ids"))
    for n in (1, 3):
        assert [r["text"] for r in corpus.abstract_passages(df.repartition(n, "id")).collect()] == ["first"]


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_ranks(spark, n):
    rng = random.Random(n)
    rows = [(rng.randint(0, 20), i) for i in range(n)]
    got = {(r["v"], r["i"]): r["r"] for r in with_rank(spark.createDataFrame(rows, "v int, i int"), "r", "v", "i").collect()}
    assert got == {x: k for k, x in enumerate(sorted(rows))}


@pytest.mark.parametrize("n,test,dev", [(0, 5, 5), (3, 60, 30), (900, 60, 30), (900, 10_000, 5)])
def test_stratified(spark, n, test, dev):
    import hashlib

    rows = [(i, "a" if i % 3 else "b") for i in range(n)]
    got = {r["i"]: r["split"] for r in splits.stratified_split(spark.createDataFrame(rows, "i int, s string"), "i", "s", "a", 9, test, dev).collect()}
    share = sum(s == "a" for _, s in rows) / max(1, n)
    want = {}
    for stratum in "ab":
        t = int(test * share) if stratum == "a" else test - int(test * share)
        d = int(dev * share) if stratum == "a" else dev - int(dev * share)
        for k, i in enumerate(sorted((i for i, s in rows if s == stratum), key=lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest())):
            want[i] = "test" if k < t else "dev" if k < t + d else "train"
    assert got == want


def test_containing(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, "")]
    items = [(k, "".join(rng.choice("ab ") for _ in range(rng.randint(1, 6)))) for k in range(40)] + [(99, None), (98, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k) for i, t in docs for k, x in items if t is not None and x is not None and x in t}
    for block in (4096, 7):
        got = [tuple(r) for r in audit.containing(d, b, block).collect()]
        assert set(got) == want and (block < 4096 or len(got) == len(want))


def test_nearest_in_passes(spark, monkeypatch):
    """More queries than a pass or a block holds give the same rows."""
    rng = random.Random(5)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(120)], "pid long, embedding array<double>")
    q = v.where("pid < 40").withColumnRenamed("pid", "qid")
    want = sorted(tuple(r) for r in retrieval.nearest(q, v, 5, True).collect())
    monkeypatch.setattr(retrieval, "PASS_BYTES", 10 * 32)
    assert sorted(tuple(r) for r in retrieval.nearest(q, v, 5, True).collect()) == want and len(want) == 200


def test_refilter_keeps_old_disagreement(spark):
    df = spark.createDataFrame([("yesno", "Yes", "yes", " ".join(["w"] * 30) + " [P1].", "model_hedged_no")], "question_type string, generated_answer string, gold_answer string, generated_reasoning string, gold_disagreement string")
    assert quality.apply_filters(df).first()["gold_disagreement"] is None
    assert quality.apply_filters(df, compat=True).first()["gold_disagreement"] == "model_hedged_no"


def test_unicode_answers_take_the_python_step(spark):
    """ASCII answers stay in the JVM and get the same verdict with and without the decomposition."""
    df = spark.createDataFrame([("Café doses",), ("cafe",), (None,), ("ﬁbre",)], "a string")
    got = [set(r[0] or []) for r in df.select(T.factoid_tokens(F.col("a"))).collect()]
    assert got == [{"cafe", "doses"}, {"cafe"}, set(), {"fibre"}]


def test_generate_retries_and_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        seen: dict = {}

        def call(p):
            calls.add(1)
            seen[p] = seen.get(p, 0) + 1
            if p == "slow" and seen[p] < 3:
                raise TimeoutError("late")
            if p == "lost":
                raise ConnectionError("gone")
            if p == "bad":
                raise KeyError("bad")
            return ("Answer: yes", 1, 1)

        return call

    df = spark.createDataFrame([("ok",), ("slow",), ("lost",), ("bad",)], "prompt string")
    got = {r["prompt"]: r["status"] for r in training.generate(df, factory, 1).collect()}
    assert got == {"ok": "success", "slow": "success", "lost": "error", "bad": "error"} and calls.value == 1 + 3 + 3 + 1

    def model(texts):
        if any(t == "17" for t in texts):
            raise RuntimeError("out of memory")
        return [(f"Answer: {len(texts)}", 1, 1) for _ in texts]

    df = spark.createDataFrame([(str(i),) for i in range(20)], "prompt string").coalesce(1)
    rows = training.generate_batches(df, lambda: model, 8, 1).collect()
    assert sum(r["status"] == "error" for r in rows) in (4, 8) and max(int(r["generated_answer"] or 0) for r in rows) == 8


def test_bands_and_texts(spark):
    df = spark.createDataFrame([(0.5,), (0.8,), (0.95,)], "hit_5 double")
    assert [r["in_band"] for r in evaluation.hit_band(df).collect()] == [False, True, False]
    assert statistics.interaction_text(0.1234, 0.01, 0.2, 0.004) == "$\\Delta = 0.123$ (95\\% CI $[0.010, 0.200]$, $p = 0.004$)"
    got = spark.range(1).select(statistics.mean_std_text(F.lit(12.34), F.lit(0.56))).first()[0]
    assert got == statistics.mean_std(12.34, 0.56)
    row = spark.createDataFrame([(0.04, 0.1, 0.4, 1.0), (0.04, 0.1, 0.2, 0.7), (0.04, -0.1, 0.4, 1.0), (0.2, 0.1, 0.4, 1.0)], "p double, d double, h double, s double")
    assert [r[0] for r in row.select(statistics.decision(F.col("p"), F.col("d"), F.col("h"), F.col("s"))).collect()] == ["strong", "moderate", "null", "null"]
    now = spark.range(1).select(audit.utc_now()).first()[0]
    from datetime import datetime, timezone

    assert abs((datetime.now(timezone.utc) - datetime.fromisoformat(now)).total_seconds()) < 60
    one = spark.createDataFrame([("a_b", 0.5)], "name string, value double")
    assert {k: "caption" in v for k, v in analysis.tables(one, one, one, one).items()} == {"main": True, "errors": True, "retrieval": True, "tests": True}


def test_erfc(spark):
    import math

    xs = [k / 50 for k in range(300)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(statistics.erfc(F.col("x"))).collect()]
    assert max(abs(a - math.erfc(x)) for a, x in zip(got, xs)) < 2e-7


def test_manifest(spark, tmp_path):
    content = {"ids": ["é", "b"], "size": 2}
    files.write_manifest(spark, content, f"file://{tmp_path}/m")
    assert files.read_manifest(spark, f"file://{tmp_path}/m") == content


def test_bootstrap_by_values_and_by_ranks(spark):
    """A draw looked up among few distinct values and one joined with the ranked rows give the same resamples, and those of plain Python."""
    import hashlib

    from quillon.operators import statistics

    rows = [(g, float(v)) for g, n in (("a", 41), ("b", 7), (None, 5)) for v in [(i * i) % 9 - 3 for i in range(n)]] + [("a", None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    few, many = (statistics.grouped_bootstrap(df, "v", "g", resamples=60, few=k) for k in (10, 1))
    few, many = ({r["g"]: tuple(r) for r in x.collect()} for x in (few, many))
    assert few == many and set(few) == {"a", "b", None}
    values = sorted(v for g, v in rows if g == "a" and v is not None)
    n = len(values)
    means = sorted(round(sum(values[int(hashlib.md5(f"42|a|{b}|{d}".encode()).hexdigest()[:8], 16) % n] for d in range(n)) / n, 9) for b in range(60))
    p = min(1, 2 * min(sum(m <= 0 for m in means), sum(m >= 0 for m in means)) / 60)
    assert few["a"][1:] == pytest.approx((n, sum(values) / n, means[1], means[58], p), abs=1e-6)


def test_interaction_by_strata_is_that_of_each_stratum(spark):
    from quillon.operators import statistics

    cells = [("base", "none"), ("base", "oracle"), ("lora_b", "none"), ("lora_b", "oracle"), ("lora_a_prime", "none"), ("lora_a_prime", "oracle")]
    pred = [(i, m, r, 42, "yes" if (i * 7 + 3 * len(m) + len(r) * i) % 5 else "no", "yes") for i in range(60) for m, r in cells]
    pred = spark.createDataFrame(pred, "example_id int, model string, retrieval string, seed int, predicted string, gold string")
    strata = spark.createDataFrame([(i, "third", str(i % 3)) for i in range(50)] + [(i, "all", "all") for i in range(60)], "example_id int, kind string, stratum string")
    out = {(r["kind"], r["stratum"]): r for r in statistics.interaction_effect(pred, resamples=30, strata=strata).collect()}
    assert len(out) == 4 and out["third", "0"]["n"] == 17 and out["all", "all"]["n"] == 60
    whole = statistics.interaction_effect(pred, resamples=30).first()
    for c in ("treated_interaction", "control_interaction", "effect_size", "difference"):
        assert out["all", "all"][c] == whole[c]
    part = statistics.interaction_effect(pred.where("example_id % 3 = 1 and example_id < 50"), resamples=30).first()
    assert (out["third", "1"]["difference"], out["third", "1"]["treated_interaction"]) == (part["difference"], part["treated_interaction"])


def test_exact_ranks(spark):
    """Order statistics by histograms are those of a sort, for whole numbers, decimals and floats of any spread, with ties, nulls and NaN."""
    import decimal
    import math
    import random

    from quillon.functions.order_statistics import exact_rank, exact_ranks

    rng = random.Random(4)
    shares = [(0, 1), (1, 4), (1, 2), (3, 4), (1, 1), (999, 1000)]
    columns = {
        "long": [rng.randint(-(10**rng.randint(1, 18)), 10**rng.randint(1, 18)) for _ in range(700)] + [7] * 300 + [2**63 - 1, -(2**63)],
        "int": list(range(1000)),
        "double": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)] + [0.5] * 90 + [float("inf"), -1.7e308, 1.7e308, 5e-324, 0.0],
        "float": [rng.random() for _ in range(200)],
        "decimal(20,4)": [decimal.Decimal(rng.randint(-(10**15), 10**15)).scaleb(-4) for _ in range(300)],
    }
    for kind, values in columns.items():
        if kind == "double":
            values = [v for v in values if not math.isinf(v)]
        df = spark.createDataFrame([(v,) for v in [*values, None]], f"x {kind}")
        order = sorted(r["x"] for r in df.where("x is not null").collect())
        want = [order[a * len(order) // b] if a * len(order) // b < len(order) else None for a, b in shares]
        assert exact_ranks(df, "x", shares) == want and exact_ranks(df, "x", shares, radix=3) == want, kind
    df = spark.createDataFrame([(v,) for v in (1.0, float("nan"), 2.0, float("nan"))], "x double")
    got = exact_ranks(df, "x", [(0, 1), (1, 2), (3, 4)])
    assert got[0] == 1.0 and math.isnan(got[1]) and math.isnan(got[2])
    empty = df.where("x > 5 and not isnan(x)")
    assert exact_ranks(empty, "x", [(1, 2)]) == [None] and exact_rank(empty, "x", 1, 2).count() == 0


def test_exact_ranks_of_many_distinct_values(spark):
    from quillon.functions.order_statistics import exact_ranks

    df = spark.range(300_000).select((F.xxhash64("id") % 10**12).alias("x"))
    order = sorted(r["x"] for r in df.collect())
    assert exact_ranks(df, "x", [(1, 4), (1, 2), (9, 10)]) == [order[300_000 // 4], order[150_000], order[270_000]]


def test_distractors_from_the_whole_corpus(spark):
    """Always as many as asked for, from every place of the corpus, also where it is small; each set is equally likely."""
    corpus = spark.range(60).select(F.col("id").alias("id"))
    gold = spark.createDataFrame([(q, p) for q in range(3000) for p in (q % 60, (q + 1) % 60, 1000 + q)], "qid int, pid long")
    rows = retrieval.seeded_distractors(gold, corpus, 5).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["qid"], []).append(r)
    assert len(by) == 3000 and all(len(x) == 5 and len({r["pid"] for r in x}) == 5 and sorted(r["position"] for r in x) == [1, 2, 3, 4, 5] for x in by.values())
    assert all(not r["is_gold"] or r["pid"] in (r["qid"] % 60, (r["qid"] + 1) % 60) for r in rows) and not any(not r["is_gold"] and r["pid"] in (r["qid"] % 60, (r["qid"] + 1) % 60) for r in rows)
    seen = [0] * 60
    for r in rows:
        seen[r["pid"]] += not r["is_gold"]
    mean = sum(seen) / 60
    assert 0.7 * mean < min(seen) and max(seen) < 1.3 * mean
    pairs = [0, 0]
    for x in by.values():  # neighbours in the corpus are no likelier together than others
        ids = sorted(r["pid"] for r in x if not r["is_gold"])
        pairs[0] += sum(b - a == 1 for a, b in zip(ids, ids[1:]))
        pairs[1] += len(ids) * (len(ids) - 1) // 2
    assert pairs[0] / pairs[1] == pytest.approx(2 / 60, rel=0.25)


def test_too_few_distractors_are_told(spark):
    corpus = spark.createDataFrame([(str(i),) for i in range(6)], "id string")
    gold = spark.createDataFrame([("a", "0"), ("b", "0"), ("b", "1"), ("b", "2"), ("c", "x")], "qid string, pid string")
    rows = retrieval.seeded_distractors(gold, corpus, 5, gold_share=1.0).collect()
    assert [tuple(r) for r in rows if r["qid"] == "b"] == [("b", None, False, 0)]
    assert {q: sum(r["qid"] == q for r in rows) for q in "ac"} == {"a": 5, "c": 5}
    assert {r["pid"] for r in rows if r["is_gold"]} == {"0"} and not any(r["is_gold"] for r in rows if r["qid"] == "c")


# -- streams that go on where they ended ---------------------------------------------------------------------------------
def send(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def test_budget_over_failures(spark, tmp_path, monkeypatch):
    """A batch that fails after its rows are written counts once; the query ends when the budget is spent."""
    from quillon.streaming import progress
    from quillon.streaming.sink import CommittedSink

    schema, rows = "id long, price double", [(i, 0.25 * (1 + i % 3)) for i in range(60)]
    sink = CommittedSink(f"{tmp_path}/sink", schema + ", spent_before double")
    write, failures = CommittedSink.write, []

    def fails_once(self, rows, batch, *more, **named):
        out = write(self, rows, batch, *more, **named)
        if batch == 1 and not failures:
            failures.append(batch)
            spark.createDataFrame([], "x int").write.mode("overwrite").parquet(f"{self.path}/commits/of={batch}")  # rows without commit
            raise RuntimeError("lost")
        return out

    monkeypatch.setattr(CommittedSink, "write", fails_once)
    told = []
    for k in range(4):
        send(spark, rows[15 * k : 15 * k + 15], schema, f"{tmp_path}/in")
        for _ in range(2):
            try:
                told.append(progress.spend_until(progress.progress_stream(spark, f"{tmp_path}/in", schema), sink, f"{tmp_path}/state", "id", "price", 12.0))
                break
            except Exception as e:
                assert "lost" in str(e)
    assert failures == [1]
    want, spent = [], 0.0
    for i, price in rows:
        if spent < 12.0:
            want.append((i, price, spent))
            spent += price
    assert sorted(tuple(r) for r in sink.rows(spark).drop("bucket").collect()) == want
    assert told[-1] == (len(want), spent) and [t[0] for t in told] == sorted(t[0] for t in told)


def test_first_of_each_without_state(spark, tmp_path):
    """Each key once, also when it comes again many batches later and with null keys; the query keeps no state."""
    from quillon.streaming import progress
    from quillon.streaming.sink import CommittedSink

    schema = "question_id string, mode string, v long"
    sink = CommittedSink(f"{tmp_path}/sink", schema)
    for k in range(4):
        send(spark, [(str(i), "easy", k) for i in range(10 * k, 10 * k + 15)] + [(None, "easy", k), ("0", None, k), ("0", "easy", k), ("0", "easy", k)], schema, f"{tmp_path}/in")
        progress.first_of_each_into(progress.progress_stream(spark, f"{tmp_path}/in", schema), sink, f"{tmp_path}/state")
    rows = sink.rows(spark).collect()
    keys = [(r["question_id"], r["mode"]) for r in rows]
    assert len(keys) == len(set(keys)) and set(keys) == {(str(i), "easy") for i in range(45)} | {(None, "easy"), ("0", None)}
    assert {r["v"] for r in rows if r["question_id"] == "0"} == {0}
    assert not (tmp_path / "state" / "state").exists()  # no state store


def test_paid_calls_survive_a_killed_worker(tmp_path):
    """A worker dies in the middle of a task; the task is run again and makes only the calls that the first one had not made."""
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "run.py"
    script.write_text(f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from quillon.operators import training
from quillon.session import local_session
import pathlib
calls, died = pathlib.Path({str(tmp_path)!r}) / "calls", pathlib.Path({str(tmp_path)!r}) / "died"

def client():
    def call(prompt):
        if prompt == "p 13" and not died.exists():
            died.touch()
            os._exit(1)
        with calls.open("a") as f:
            f.write(prompt + "\\n")
        if prompt == "p 5":
            raise RuntimeError("refused")
        return "Reasoning: r\\nAnswer: " + prompt, 10, 1
    return call

spark = local_session("2, 4", 2, "1g")
rows = spark.createDataFrame([(str(i), "easy", f"p {{i}}") for i in range(20)], "question_id string, mode string, prompt string")
out = training.generate(rows, client, workers=2, ledger="file://{tmp_path}/ledger").collect()
assert sorted(r["generated_answer"] or "" for r in out) == sorted("" if i == 5 else f"p {{i}}" for i in range(20)), out
again = training.generate(rows, client, workers=1, ledger="file://{tmp_path}/ledger").collect()
assert len(again) == 20
""")
    out = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr[-2000:]
    made = (tmp_path / "calls").read_text().splitlines()
    assert (tmp_path / "died").exists()
    assert sorted(x for x in made if x != "p 5") == sorted(f"p {i}" for i in range(20) if i != 5)  # each paid once, over a killed worker and a second run
    assert 2 <= made.count("p 5") <= 3  # an error is not kept


def test_answers_stop_at_the_budget(spark, tmp_path):
    from quillon.operators import training
    from quillon.streaming import progress
    from quillon.streaming.sink import CommittedSink

    schema = "question_id string, mode string, prompt string"
    sink = CommittedSink(f"{tmp_path}/sink", f"{schema}, {training.ANSWER}, generated_reasoning string, generated_answer string, cost_estimate double")
    told = []
    for k in range(3):
        send(spark, [(str(i), "easy", "p") for i in range(5 * k, 5 * k + 5)], schema, f"{tmp_path}/in")
        told.append(progress.generate_into(progress.progress_stream(spark, f"{tmp_path}/in", schema), sink, f"{tmp_path}/state", lambda: lambda p: ("Answer: yes", 1_000_000, 0), f"{tmp_path}/ledger", dollars=7.0, workers=2))
    assert told == [(5, 5.0), (10, 10.0), (10, 10.0)]  # the batch that goes beyond the cap is the last
    assert len(list((tmp_path / "ledger").glob("*/*.json"))) == 10


# -- locks, ordinals, aligned files --------------------------------------------------------------------------------------
def test_saved_hashes_are_verified(spark, tmp_path):
    import hashlib

    rows = [(f"q{i}", a) for i, a in enumerate(["yes", "no \"x\" \\ é\n\t\x01\x7f", "𝒳 ü", None, "maybe"] * 40)]
    df = spark.createDataFrame(rows, "id string, answer string").repartition(7)

    def fails():
        raise RuntimeError("no data")

    saved = splits.save_test_hash(spark, f"{tmp_path}/hashes", {"a": lambda: df, "b": lambda: df.limit(0), "c": fails})
    text = json.dumps([{"id": i, "answer": a or ""} for i, a in sorted(rows)], sort_keys=True)
    assert saved["a"] == {"hash": hashlib.sha256(text.encode()).hexdigest(), "size": 200}
    assert saved["b"] == {"hash": hashlib.sha256(b"[]").hexdigest(), "size": 0} and saved["c"] == {"error": "no data"}
    check = lambda name, rows: splits.verify_test_hash(spark, f"{tmp_path}/hashes", name, rows)
    assert check("a", df.orderBy(F.desc("id"))) and check("b", df.where("false"))
    assert not check("a", df.withColumn("answer", F.when(F.col("id") == "q7", "no").otherwise(F.col("answer")))) and not check("a", df.where("id <> 'q7'"))
    for name in ("c", "d"):
        with pytest.raises(ValueError):
            check(name, df)
    with pytest.raises(FileNotFoundError):
        splits.verify_test_hash(spark, f"{tmp_path}/none", "a", df)


def test_hash_of_a_large_set_is_a_chain(spark):
    """The same digest as that of one text, from ranges of the key; the plan collects no list."""
    import hashlib

    rows = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.md5(F.col("id").cast("string").cast("binary")).alias("answer"))
    out = splits.test_hash(rows, "id", "id", "answer")
    text = json.dumps([{"answer": r["answer"], "id": r["id"]} for r in sorted(rows.collect(), key=lambda r: r["id"])])
    assert tuple(out.first()) == (hashlib.sha256(text.encode()).hexdigest(), 20_000)
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Exchange rangepartitioning" in plan


def test_ordinals_of_files(spark, tmp_path):
    """Places over several files and row groups, whatever the splits of the read."""
    from quillon.sources import questions

    spark.range(5000).select("id", F.concat(F.lit("text "), F.md5(F.col("id").cast("string").cast("binary"))).alias("t")).repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 20_000).parquet(f"{tmp_path}/x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "16k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = questions.with_ordinal(spark.read.parquet(f"{tmp_path}/x"))
            assert rows.where("id <> ordinal").count() == 0 and rows.count() == 5000 and rows.columns == ["id", "t", "ordinal"]
        assert rows.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_aligned_files(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, f"{k} {i} é") for k in ("b", "a") for i in range(25) if (k, i) != ("a", 12)], "kind string, id int, text string").repartition(5)
    for path in ("x", "y"):
        files.write_aligned(rows, f"{tmp_path}/{path}", "kind", "id", 10)
    x, y = ({(r["kind"], r["file"]): r for r in files.aligned_manifest(spark, f"{tmp_path}/{p}", "kind", "id").collect()} for p in "xy")
    assert {k: r["n"] for k, r in x.items()} == {("a", 0): 10, ("a", 1): 9, ("a", 2): 5, ("b", 0): 10, ("b", 1): 10, ("b", 2): 5}
    assert {k: r["sha256"] for k, r in x.items()} == {k: r["sha256"] for k, r in y.items()}
    same = {k: x["a", k]["ids_sha256"] == x["b", k]["ids_sha256"] for k in range(3)}
    assert same == {0: True, 1: False, 2: True}  # the lost record shows in its file
    lines = next((tmp_path / "x").glob("kind=b/file=000000001/*.json")).read_text().splitlines()
    assert [json.loads(line)["id"] for line in lines] == list(range(10, 20))


# -- question files in ranges --------------------------------------------------------------------------------------------
def odd_json(rng, n):
    """Documents with quotes, brackets, runs of backslashes and other scripts in strings, nested lists, and elements longer than a range."""
    parts = ['"', "\\", "\\\\", "{", "}", "[", "]", "é", "𝒳", "a", " ", "\n", ",", ":", '\\"']
    text = lambda k: "".join(rng.choice(parts) for _ in range(rng.randint(0, k)))
    return [{"id": str(i), "body": text(30), "type": "factoid", "exact_answer": [[text(5), "x"], [text(9)]], "snippets": [{"text": text(400 if i % 9 == 0 else 12), "document": "d"} for _ in range(rng.randint(0, 3))], "more": {"a": [{"b": text(4)}, []]}} for i in range(n)]


def test_elements_by_ranges(spark, tmp_path):
    from quillon.sources import json_ranges

    rng = random.Random(8)
    want = {}
    for k, (n, indent) in enumerate([(40, None), (25, 2), (0, None), (1, 1)]):
        rows = odd_json(rng, n)
        name = f"{tmp_path}/f{k}.json"
        with open(name, "w") as f:
            json.dump({"title": "[{\\\"", "questions": rows, "end": {"x": "]"}}, f, indent=indent, ensure_ascii=k % 2 == 0)
        want[name] = rows
    for size in (7, 64, 1000, 1 << 20):
        if size == 7:  # many ranges of one file
            (tmp_path / "one").mkdir()
            (tmp_path / "one" / "f.json").write_bytes((tmp_path / "f3.json").read_bytes())
            got = json_ranges.elements(spark, f"{tmp_path}/one", size).collect()
            assert [json.loads(r["element"]) for r in got] == want[f"{tmp_path}/f3.json"]
            (tmp_path / "one" / "f.json").unlink()
            continue
        by = {}
        for r in json_ranges.elements(spark, str(tmp_path), size).collect():
            by.setdefault(r["file"], []).append((r["start"], json.loads(r["element"])))
        assert {k: [e for _, e in sorted(v, key=lambda x: x[0])] for k, v in by.items()} == {k: v for k, v in want.items() if v}


def test_split_files_have_the_rows_of_whole_ones(spark, tmp_path):
    from quillon.sources import json_ranges, questions

    rng = random.Random(9)
    (tmp_path / "q.json").write_text(json.dumps({"questions": odd_json(rng, 30)}))
    pick = lambda df: sorted(map(str, df.select("q.id", "q.body", F.to_json("q.exact_answer"), "q.snippets").collect()))
    whole = pick(questions.question_files(spark, str(tmp_path)))
    parted = questions.split_question_files(spark, str(tmp_path), 500)
    assert pick(parted) == whole and len(whole) == 30 and parted.rdd.getNumPartitions() > 10
    (tmp_path / "broken.json").write_text('{"questions": [{"id": "1"}, {"id": "2')
    with pytest.raises(ValueError):
        json_ranges.elements(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        json_ranges.elements(spark, f"{tmp_path}/none")


def test_items_in_documents(spark):
    """Items of any number of words against a search of every pair; nulls, empty items, repeated rows and ids, and more short items than one pass takes."""
    texts = ["the quick brown fox jumps over the lazy dog", "xthe quick brown fox jumps over the lazy dogs", "the quick brown fox", "a\n\nb  c d", "", None, "fox", "the the the the the the the the", "ünï cödé wörds hére and there", "w " * 3000 + "end"]
    docs = [(i % 8, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0]), (3, texts[3])]
    wanted = ["the quick brown fox jumps over the lazy dog", "quick brown fox jumps over", "brown fox", "ox jum", "a\n\nb  c", "b  c ", "", None, "the the the the the", "cödé wörds hére", "w w w w w w end", "no such words are here", "fox", "fox", " the lazy ", "  ", "lazy dogs"]
    items = list(enumerate(wanted)) + [(0, wanted[0])]
    expected = sorted(((d, i) for d, t in docs for i, w in items if t is not None and w is not None and w in t), key=str)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in audit.containing(a, b, 2).collect()), key=str) == expected
    assert audit.containing(a, b.limit(0)).count() == 0 and audit.containing(a.limit(0), b).count() == 0


def test_conditions_of_rows(spark):
    rows = spark.createDataFrame([(1, "bioasq"), (2, "mirage"), (2, "mirage")], "id long, dataset string")
    assert sorted(tuple(r) for r in splits.with_conditions(rows).select("id", "condition").collect()) == [(1, "none"), (1, "oracle"), (1, "strong"), (2, "none"), (2, "none"), (2, "strong"), (2, "strong")]
    for bad in ("other", None):
        with pytest.raises(Exception, match="unknown dataset"):
            splits.with_conditions(spark.createDataFrame([(1, bad)], "id long, dataset string")).collect()
    assert splits.with_conditions(rows.limit(0)).count() == 0


def test_taxonomy_and_grid_have_every_row(spark):
    """Categories and cells that do not occur have 0; a category named twice in one annotation counts once; the base model's seed does not matter."""
    notes = spark.createDataFrame([(["refusal", "refusal"],), (["refusal", "no such"],), (None,)], "error_categories array<string>")
    assert {r["category"]: r["n"] for r in audit.taxonomy_use(notes).collect()} == {e[0]: 2 * (e[0] == "refusal") for e in audit.ERRORS}
    pred = spark.createDataFrame([("base", "none", 42), ("base", "none", 7), ("lora_a", "oracle", 123), ("lora_a", "oracle", 9)], "model string, retrieval string, seed int")
    found = {r["cell"]: r["n"] for r in statistics.cells_found(pred).collect()}
    assert len(found) == 30 and {c: n for c, n in found.items() if n} == {"base_none": 2, "lora_a_oracle_seed123": 1}
