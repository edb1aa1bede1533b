"""Text expressions against plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T

TRICKY = ["", "   ", "a b", "a b", "x\x1fy", "\t a \n b ", "[P10]", "[P53, x]", "[P1, P2, P3]", "αP1", "P1é", "(P2)", "TP53 P3.", "[P7] [P2]", "P6", "[P99999999999999999999]", "[P0]", "P1", "x P5"]


def column(spark, texts, *cols):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *cols).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def test_words_and_keys(spark):
    got = column(spark, TRICKY, T.word_count(F.col("t")), T.dedup_key(F.col("t")))
    assert got == [(len(t.split()), t.strip().lower()) for t in TRICKY]


def test_citations(spark):
    got = column(spark, TRICKY, T.is_cited(F.col("t")), T.bracket_citations(F.col("t")), T.first_bad_citation(F.col("t")))
    for t, (cited, text, bad) in zip(TRICKY, got):
        assert cited == bool(re.search(r"\[P[1-5]", t) or re.search(r"\bP[1-5]\b", t)), t
        assert text == re.sub(r"(?<!\[)\bP([1-5])\b(?!\])", r"[P\1]", t), t
        assert bad == next((n for n in re.findall(r"\[P(\d+)\]", t) if not 1 <= int(n) <= 5), None), t


def test_parse_response(spark):
    texts = ["Reasoning: a b\n\nAnswer: yes", "x Answer: one Answer: two", "none", "Answer:", "Reasoning:Answer: z"]
    r, a = T.parse_response(F.col("t"))
    assert column(spark, texts, r, a) == [("a b", "yes"), ("x", "one Answer: two"), (None, None), ("", ""), ("", "z")]


def plain_tokens(text):
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    out = set()
    for t in re.sub(r"[^\w\s]", " ", text).split():
        if t in T.STOPWORDS:
            continue
        t = T.NUMBER_WORDS.get(t, t)
        if len(t) > 1 or t.isdigit():
            out.add(t)
    return out


def test_factoid_tokens(spark):
    texts = ["The Three doses (of) Café", "α-synuclein", "x 5 a", "", "naïve ﬁbres x²", "one, TWO; three!"]
    got = column(spark, texts, T.factoid_tokens(F.col("t")))
    assert [set(g[0]) for g in got] == [plain_tokens(t) for t in texts]
    assert column(spark, ["three doses"], T.factoid_overlap(F.col("t"), F.lit("3 mg"))) == [(True,)]


@pytest.mark.parametrize("text,want", [("Answer: Yes", "yes"), ("so the answer is no.", "no"), ("maybe yes maybe no", "no"), ("nothing", None)])
def test_extract_label(spark, text, want):
    assert column(spark, [text], T.extract_label(F.col("t"))) == [(want,)]


def test_preview_and_tokens(spark):
    assert column(spark, ["a" * 10, "a b c"], T.preview(F.col("t"), 5), T.token_estimate(F.col("t"))) == [("aaaaa...", 1), ("a b c", 3)]


def test_held_words(spark):
    """Repeats count, in linear memory; null and blank texts have no words."""
    rows = [(1, "a b a c", "a x c"), (2, "", "a"), (3, None, "a"), (4, "a a", None), (5, "z z z", "z"), (6, "A é", "é a"), (7, "b " * 60000, "a b " * 60000)]
    df = spark.createDataFrame(rows, "id int, some string, others string").select("id", T.held_words(T.words(F.col("some")), T.words(F.col("others"))).alias("n"))
    assert {r["id"]: r["n"] for r in df.collect()} == {1: 3, 2: 0, 3: 0, 4: 0, 5: 3, 6: 1, 7: 60000}


def test_long_texts_take_linear_time(spark):
    """Half a million characters without a label, or of white space, or of openings without an end: quadratic time would take hours."""
    rows = [("word " * 100000,), ("a" + " " * 500000 + "b",), ("Answer: " * 60000,), (" " * 500000,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(T.extract_label(F.col("t")).alias("label"), F.length(T.strip(F.col("t"))).alias("n"), T.answer_of_target(F.col("t")).alias("answer")).collect()
    assert [tuple(r) for r in got] == [(None, 499999, None), (None, 500002, None), (None, 479999, None), (None, 0, None)]


def test_answer_of_target(spark):
    rows = ["Answer: yes<|eot_id|>", "x\nAnswer: a\nb<|eot_id|>c<|eot_id|>", "Answer: <|eot_id|>", "Answer: <|eot_id|>d<|eot_id|>", "<|eot_id|>Answer: no", None, "", "Answer: 1 Answer: 2<|eot_id|>", "Answer:<|eot_id|>"]
    plain = [None if t is None or not (m := re.search(r"(?s)Answer: (.+?)<\|eot_id\|>", t)) else m.group(1) for t in rows]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(T.answer_of_target(F.col("t"))).collect()] == plain
