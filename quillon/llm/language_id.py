"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of distinct character n-grams, of the lengths 1 to 3, that both
hold, divided by the geometric mean of the two numbers of distinct n-grams. Nystroem landmarks, drawn evenly from the languages, turn
a text into its kernel values against the landmarks; one-versus-rest kernel ridge regression in the space they span gives a
score for each language. n-grams are hashed to ``BUCKETS`` presence bits, so the kernel values of a batch of texts
are one matrix product of its presence bits with those of the landmarks, and the scores are a second product.

The longer a text, the more n-grams it has, and the less their presence says; so texts are cut into segments of ``SEGMENT`` characters, each of which is a row of the kernel,
and a text has the mean of its segments' scores, weighted by their lengths.

Only the fit is bounded: at most ``ROWS`` segments of labelled texts, as many of each language, ``PER_LANG`` at most, those with the least hash
of doc_id and place. Every language is learnt, as long as there are ``ROWS`` segments to share; beyond that many languages, the most frequent. The prediction reads every whole text.

Cases: a null text or one without a letter (number signs such as ``½`` are none) is `und` with score 0; a null lang teaches nothing; without any labelled row every
prediction is `und`; a single language is predicted everywhere; of languages with equal scores the first in alphabetical order is predicted; a text of any length is read whole; rows given twice get the same answer twice; other columns than
doc_id, text and (for the fit) lang are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.spans import pieces
from quillon.session import table

#: n-gram lengths, hash buckets, characters of a segment, landmarks of all languages and of one, ridge, rows of one matrix product.
LENGTHS, BUCKETS, SEGMENT, MARKS, LANDMARKS, RIDGE, BLOCK = (1, 2, 3), 1 << 14, 4096, 512, 24, 1e-3, 256
#: Bounds of the fit: segments of all languages and of one.
ROWS, PER_LANG = 4096, 300
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: which n-gram buckets it holds. Letters are compared in lower case."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        gram = np.zeros(len(codes), np.uint32)
        for n in range(max(LENGTHS)):
            if len(codes) <= n:
                break
            gram = (gram[: len(codes) - n] * np.uint32(0x9E3779B1)) ^ (codes[n:] + np.uint32(n * 0x632BE5AB))
            if n + 1 in LENGTHS:
                row[((gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)] = 1
    return out


def kernel(rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The normalised presence kernel of every row with every landmark."""
    norms = np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(marks.sum(axis=1), 1))[None, :]
    return (rows @ marks.T) / norms


def segments(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(the segments of all texts, the text of each)."""
    parts = [(t[a : a + SEGMENT], i) for i, t in enumerate(texts) for a in range(0, max(len(t), 1), SEGMENT)]
    return [p for p, _ in parts], np.array([i for _, i in parts], np.int64)


@dataclass
class KernelRidge:
    """``marks``: presence bits of the landmarks; ``weights``: kernel values to scores, a column for each of ``langs``."""

    langs: list[str]
    marks: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]], per_lang: int = LANDMARKS, ridge: float = RIDGE) -> KernelRidge:
        """From (text, lang) pairs, in a fixed order; the first segments of the first texts of each language are its landmarks."""
        labelled = [(t, x) for t, x in labelled if has_letter(t)]
        langs = sorted({x for _, x in labelled})
        if not langs:
            return cls([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, 0), np.float32))
        per_lang = max(1, min(per_lang, MARKS // len(langs)))
        of: dict[str, list[str]] = {}
        for t, x in labelled:
            of.setdefault(x, []).append(t)
        some = langs if len(langs) <= MARKS else [langs[i * len(langs) // MARKS] for i in range(MARKS)]  # landmarks span a space; not each language needs its own
        marks = presence([t[:SEGMENT] for x in some for t in of[x][:per_lang]])
        parts, owner = segments([t for t, _ in labelled])
        k = np.concatenate([kernel(presence(parts[a : a + BLOCK]), marks) for a in range(0, len(parts), BLOCK)]).astype(np.float64)
        number = {x: i for i, x in enumerate(langs)}
        lang = np.array([number[x] for _, x in labelled])[owner]
        share = (1.0 / np.bincount(lang, minlength=len(langs)))[lang][:, None]  # languages weigh alike
        kmm = kernel(marks, marks).astype(np.float64)
        gram = k.T @ (share * k) + ridge * kmm + 1e-9 * np.eye(len(marks))
        own = np.zeros((len(langs), len(marks)))
        np.add.at(own, lang, share * k)  # the rows of a language count 1 in its own column and -1 in the others
        return cls(langs, marks, np.linalg.solve(gram, 2 * own.T - own.sum(axis=0)[:, None]).astype(np.float32))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language with the largest score and a softmax of the scores at it."""
        if not self.langs or not texts:
            return [(UNKNOWN, 0.0)] * len(texts)
        parts, owner = segments(texts)
        scores = np.concatenate([kernel(presence(parts[a : a + BLOCK]), self.marks) @ self.weights for a in range(0, len(parts), BLOCK)]).astype(np.float64)
        size = np.maximum(np.fromiter(map(len, parts), np.float64, len(parts)), 1)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        scores = np.add.reduceat(scores * size[:, None], first) / np.add.reduceat(size, first)[:, None]
        best = scores.argmax(axis=1)
        sure = 1 / np.exp(4 * (scores - scores.max(axis=1, keepdims=True))).sum(axis=1)
        return [(self.langs[b], round(float(s), 4)) if has_letter(t) else (UNKNOWN, 0.0) for b, s, t in zip(best, sure, texts)]


def sample(docs: DataFrame, per_lang: int = PER_LANG, rows: int = ROWS) -> list[tuple[str, str]]:
    """(segment, lang) of at most ``rows`` segments of labelled texts, as many of each language: those with the least hash of doc_id and place, from anywhere in a
    text.

    The counts by language give a share of the hashes that holds enough segments; what is read beyond it never leaves the executors."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    known = known.withColumn("place", F.explode(F.sequence(F.lit(0), F.expr(f"greatest(length(text) - 1, 0) div {SEGMENT}"))))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not counts:
        return []
    most = max(1, min(per_lang, rows // len(counts)))
    shares = [(r["lang"], int((1 << 30) * min(1.0, (1.5 * most + 20) / r["n"]))) for r in counts]
    bounds = docs.sparkSession.createDataFrame(shares, "lang string, bound long")
    some = known.join(F.broadcast(bounds), "lang").withColumn("h", F.pmod(F.xxhash64("doc_id", "place"), F.lit(1 << 30))).where(F.col("h") <= F.col("bound"))  # a row a language, at most ``rows``
    some = some.select("lang", "h", "doc_id", "place", F.substring("text", F.col("place") * SEGMENT + 1, F.lit(SEGMENT)).alias("part"))
    order = ("h", "doc_id", "place", F.xxhash64("part"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return [(r["part"], r["lang"]) for r in some.withColumn("nth", nth).where(F.col("nth") <= most).orderBy("h", "doc_id", "place", "lang", "nth").select("part", "lang").collect()]


def predict(docs: DataFrame, model: KernelRidge) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``; the model goes to the executors once, as a broadcast of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            found = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred and score for each document; rows with crc32(doc_id) mod 3 = 1 are held out of the fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = KernelRidge.fit(sample(docs.where(F.coalesce(fold, F.lit(0)) != 1)))
    return predict(docs, model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
