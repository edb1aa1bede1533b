"""The catalogue's queries do the whole job: whole passages and the full number of resamples."""

import hashlib
import re

import pytest

from quillon.operators import analysis, statistics
from quillon.plans import catalogue
from quillon.plans.fixtures import examples, predictions, with_passages
from quillon.session import table


def test_passages_are_whole(spark, sf):
    """Every prompt holds the five documents to their last character, by brute force over the table."""
    text = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert max(map(len, text.values())) > 10_000
    want = {i: "\n\n".join(f"Passage [P{k + 1}]: {text[(i + k) % len(text)]}" for k in range(5)) for i in text if i % 50 != 49}
    for name in ("materialize_a_prime", "materialize_b"):
        got = {r["example_id"]: r["prompt"] for r in catalogue.QUERIES[name](spark, sf).collect()}
        assert got.keys() == want.keys()
        assert [i for i in got if want[i] not in got[i]] == []
    stats = {r["recipe"]: r for r in catalogue.QUERIES["materialize_stats"](spark, sf).collect()}
    rest = sum(len(p) - len(want[i]) for i, p in got.items())
    assert stats["b"]["avg_prompt_chars"] == pytest.approx((sum(map(len, want.values())) + rest) / len(want), abs=1e-3)
    assert catalogue.QUERIES["ablation_check"](spark, sf).count() == 0


def test_registered_support_is_whole(spark, sf):
    """The registered query's counts against plain Python over whole documents."""
    text = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    want = {}
    for r in examples(spark, sf).where("generated_reasoning is not null").select("question_id", "generated_reasoning").collect():
        n = ok = 0
        for sentence in re.split(r"[.!?]\s+", r["generated_reasoning"]):
            for k in {int(x) for x, _ in re.findall(r"P([1-5])([^0-9]|$)", sentence)}:
                s = re.sub(r"\[?P[1-5](, P[1-5])*\]?", "", sentence).lower().split()
                p = set(text[(r["question_id"] + k - 1) % len(text)].lower().split())
                n += 1
                ok += bool(s) and sum(w in p for w in s) >= analysis.SUPPORT * len(s)
        if n:
            want[r["question_id"]] = (n, ok)
    got = {r["question_id"]: (r["n_citations"], r["n_supported"]) for r in catalogue.QUERIES["citation_support"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 3, 5, 70])
def test_passages_go_round_the_table(spark, tmp_path, n):
    rows = [(i, f"text {i}", "en", "s", 8) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["question_id"]: [(p["position"], p["id"], p["text"]) for p in r["passages"]] for r in with_passages(examples(spark, str(tmp_path)), spark, str(tmp_path)).collect()}
    assert got == {i: [(k + 1, (i + k) % n, f"text {(i + k) % n}") for k in range(5)] for i in range(n)}


def test_resamples(spark, sf):
    """The registered intervals against 1000 resamples in plain Python, and the registered power against 1000 simulations."""
    p = predictions(spark, sf)
    for name, pairs in (("bootstrap_ci", statistics.paired(p, ("lora_b", "oracle", 42), ("base", "oracle", 42))), ("interaction", statistics.interaction_pairs(p))):
        v = [float(r["diff"]) for r in pairs.orderBy("example_id").collect()]
        draw = lambda b, i: v[int(hashlib.md5(f"42|{b}|{i}".encode()).hexdigest()[:8], 16) % len(v)]
        means = sorted(round(sum(draw(b, i) for i in range(len(v))) / len(v), 9) for b in range(1000))
        least = min(sum(m <= 0 for m in means), sum(m >= 0 for m in means))
        got = catalogue.QUERIES[name](spark, sf).first()
        assert tuple(got) == pytest.approx((sum(v) / len(v), means[25], means[975], min(1, 2 * least / 1000)), abs=2e-6)
    found = catalogue.QUERIES["power_simulation"](spark, sf).collect()
    for b in statistics.accuracy(p.where("model = 'base'"), "retrieval").collect():  # each starts from what was measured
        assert sorted(tuple(r)[1:] for r in found if r["retrieval"] == b["retrieval"]) == sorted(map(tuple, statistics.power(spark, simulations=1000, base=b["accuracy"]).collect()))
