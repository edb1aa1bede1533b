"""Quality classifier by co-training.

Two classifiers see two views of a document: its words (hashed to ``BUCKETS`` presence features), and its page
metadata (source, language, and the layout of the page: its length, the number, mean, largest length and blank share of its lines, and its shares of capitals, digits and signs, which
no word feature has). Both are logistic regressions. In each round each of them scores every row of the table but those that the fit has the label of, on the executors; of the rows with calibrated odds of 19 to 1 at least, were both labels as frequent, the ``PSEUDO`` surest, in the proportion of
the known labels, come to the driver and join the other's training rows with its label. A view keeps what a round brought it only if its calibrated loss on labelled rows that no view learns from does not rise; else
it goes back to what it was, and when no view has gained, the rounds end. At the end each view is calibrated on labelled rows that it did not learn
from (Platt scaling), and the calibrated log odds are averaged, weighted by their quality there, into the score of every document.

Features are written once and read by every round and the last scoring. Bounded are the labelled rows of the fit, at most ``LABELLED``, those with the least hash of doc_id, and the
rows that a round brings back; the rounds look at the whole corpus, and the score reads every whole text.

Cases: a null or empty text has no words and zero lengths; a null source or lang is a value of its own; a label that
is null or has no document teaches nothing; of a document with two labels the better one counts; rows with a null doc_id have no label, and after a round has brought some, no later round brings others; with fewer than two labels known all scores are the known share (0.5
without any); rows of one doc_id with different texts and equally sure rows are ordered by their features, so runs agree; rows given twice get the same score
twice; a text of any length is read whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import SPACE, lines, tokens
from quillon.session import discard, materialise, table

BUCKETS, LABELLED, PSEUDO, ROUNDS, TAIL = 1 << 14, 2500, 250, 4, 256
#: Log odds from which on a view is sure, 19 to 1, and what a pseudo-label weighs against a known one.
CONFIDENT, TRUST = 2.944, 0.3
META = ["log_chars", "log_lines", "line_len", "longest_line", "blank_lines", "upper", "digit", "symbol"]
ROWS = "doc_id long, words array<int>, meta array<double>, tags array<int>"


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, words: the distinct hash buckets of the words, meta: numbers of the page, tags: buckets of source and lang)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", text.alias("t"), F.size(lines(text)).alias("n"))
    held = F.sort_array(F.array_distinct(F.transform(tokens(F.col("t")), lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))))
    sizes = F.transform(lines(F.col("t")), lambda x: F.length(F.btrim(x, F.lit(SPACE))))
    shares = [F.regexp_count("t", F.lit(p)) / F.greatest(F.length("t"), F.lit(1)) for p in ("\\p{Lu}", "[0-9]", "[#*$%&|<>!]")]
    meta = [F.log1p(F.length("t")), F.log1p("n"), F.log1p(F.length("t") / F.col("n")), F.log1p(F.array_max(sizes)), F.size(F.filter(sizes, lambda n: n == 0)) / F.col("n"), *shares]
    tags = F.array(*(F.pmod(F.xxhash64(F.lit(c), F.coalesce(F.col(c), F.lit("\0"))), F.lit(TAIL)).cast("int") for c in ("source", "lang")))
    return d.select("doc_id", held.alias("words"), F.array(*(m.cast("double") for m in meta)).alias("meta"), tags.alias("tags"))


def written_features(docs: DataFrame) -> DataFrame:
    """``features`` of every row, written once."""
    return materialise(features(docs), "features")


def _hashed() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))


def labelled_rows(rows: DataFrame, labels: DataFrame, most: int = LABELLED) -> list:
    """(doc_id, words, meta, tags, y) of at most ``most`` labelled documents, those with the least hash of doc_id. Only ids are sorted, and the features of
    the chosen ones fetched."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    chosen = known.join(rows.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").orderBy(_hashed(), "doc_id").limit(most).collect()
    ids = rows.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, y int")
    found = rows.join(F.broadcast(ids), "doc_id")  # at most ``most`` ids
    first = found.groupBy("doc_id").agg(F.min_by(F.struct("words", "meta", "tags", "y"), F.xxhash64("words", "meta", "tags")).alias("x"))
    return first.select("doc_id", "x.*").orderBy(_hashed(), "doc_id").collect()


def _sparse_rows(lists: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return (np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else np.zeros(0, np.int64)), sizes


def _sums(index: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each row's buckets, times the square root of their number."""
    running = np.concatenate([[0.0], np.cumsum(weights[index])])
    ends = np.cumsum(sizes)
    return (running[ends] - running[ends - sizes]) / np.sqrt(np.maximum(sizes, 1))


def _fit(gradient, size: int, steps: int = 100, rate: float = 0.15) -> np.ndarray:
    """Adam from zero; deterministic."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _balance(y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights under which both labels count alike, with the sum 1."""
    weight = np.ones(len(y)) if weight is None else weight
    p = max((weight * y).sum(), 1), max((weight * (1 - y)).sum(), 1)
    w = weight * np.where(y > 0, 0.5 / p[0], 0.5 / p[1])
    return w / w.sum()


@dataclass
class TextView:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1))

    def fit(self, index, sizes, y, weight=None) -> None:
        share, rows = _balance(y, weight), np.repeat(np.arange(len(sizes)), sizes)
        scale = 1 / np.sqrt(np.maximum(sizes, 1))

        def gradient(w):
            e = share * (_sigmoid(_sums(index, sizes, w[:-1]) + w[-1]) - y)
            return np.concatenate([np.bincount(index, (e * scale)[rows], BUCKETS), [e.sum()]]) + 1e-4 * w

        self.weights = _fit(gradient, BUCKETS + 1)

    def odds(self, index, sizes) -> np.ndarray:
        return _sums(index, sizes, self.weights[:-1]) + self.weights[-1]


@dataclass
class MetaView:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(META) + TAIL + 1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(META)))
    spread: np.ndarray = field(default_factory=lambda: np.ones(len(META)))

    def matrix(self, meta: np.ndarray, tags: np.ndarray) -> np.ndarray:
        z = np.clip((meta - self.mean) / self.spread, -4, 4)
        one_hot = np.zeros((len(z), TAIL))
        for c in range(tags.shape[1]):
            one_hot[np.arange(len(z)), tags[:, c]] = 0.5
        return np.hstack([z, z * z / 4, one_hot, np.ones((len(z), 1))])

    def fit(self, meta, tags, y, weight=None) -> None:
        self.mean, self.spread = meta.mean(axis=0), meta.std(axis=0) + 1e-6
        x, share = self.matrix(meta, tags), _balance(y, weight)
        self.weights = _fit(lambda w: x.T @ (share * (_sigmoid(x @ w) - y)) + 1e-3 * w, x.shape[1])

    def odds(self, meta, tags) -> np.ndarray:
        return self.matrix(meta, tags) @ self.weights


def _platt(odds: np.ndarray, y: np.ndarray, share: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that turn odds into log odds; ``share``: the rows' weights, with the sum 1."""
    share = np.full(len(y), 1 / len(y)) if share is None else share

    def gradient(w):
        e = share * (_sigmoid(w[0] * odds + w[1]) - y)
        return np.array([(e * odds).sum() + 1e-3 * (w[0] - 1), e.sum()])

    return tuple(_fit(gradient, 2, 400, 0.05).tolist())


def _sure(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(most odds for a sure 0, least odds for a sure 1) of a view, by rows that it has not seen: odds of 19 to 1, were both labels as frequent, and beyond all of these
    rows that have the other label. A view that can't tell the labels apart is never sure."""
    slope, offset = _platt(odds, y, _balance(y))
    if slope <= 0:
        return -np.inf, np.inf
    return min((-CONFIDENT - offset) / slope, odds[y > 0].min()), max((CONFIDENT - offset) / slope, odds[y < 1].max())


@dataclass
class CoTrained:
    """Both views, their calibration (slope, offset) and their weights in the mean of the log odds."""

    text: TextView
    meta: MetaView
    platt: list[tuple[float, float]]
    weight: list[float]
    share: float | None = None

    def score(self, words_, meta, tags) -> np.ndarray:
        """(p_text, p_meta, score) as rows."""
        if self.share is not None:
            return np.full((3, len(words_)), self.share)
        odds = [a * o + b for o, (a, b) in zip((self.text.odds(*_sparse_rows(words_)), self.meta.odds(meta, tags)), self.platt)]
        return np.array([_sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(self.weight[0] * odds[0] + self.weight[1] * odds[1])])


def _arrays(rows: list) -> tuple[list, np.ndarray, np.ndarray]:
    return [r["words"] for r in rows], np.array([r["meta"] for r in rows], float).reshape(len(rows), len(META)), np.array([r["tags"] for r in rows], np.int64).reshape(len(rows), 2)


def _batch_arrays(b: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray]:
    lists, n = b.column(1), b.num_rows
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    parts = np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1]) if n else []
    return parts, b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, len(META)), b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, 2)


def surest(rows: DataFrame, text: TextView, page: MetaView, low: int, high: int, taken: tuple[set, set], limits: list[tuple[float, float]]) -> list[list]:
    """For each view the ``low`` rows with the least and the ``high`` rows with the largest odds, as (label, row); not those of the ids in ``taken``, and
    only odds of at most the first and at least the second of the view's ``limits``.

    A task puts out that many rows of each kind at most, and the driver gets that many of all."""
    shared = rows.sparkSession.sparkContext.broadcast((text, page, taken))  # the views' weights, and some hundred ids a round

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, pa.Table] = {}
        words_, pages, done = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            parts, meta, tags = _batch_arrays(b)
            ids = b.column(0).to_pylist()
            for view, odds in enumerate((words_.odds(*_sparse_rows(parts)), pages.odds(meta, tags))):
                odds = odds.round(9)
                free = np.array([i not in done[view] for i in ids])
                for label, sign, most in ((0, 1, low), (1, -1, high)):
                    some = np.flatnonzero(free & (sign * odds <= sign * limits[view][label]))
                    if len(some) > most:
                        cut = np.partition(sign * odds[some], most - 1)[most - 1]
                        some = some[sign * odds[some] <= cut]
                    t = pa.Table.from_batches([b.take(pa.array(some))]).append_column("odds", pa.array(sign * odds[some]))
                    old = held.get((view, label))
                    t = t if old is None else pa.concat_tables([old, t])
                    if t.num_rows > 4 * most:
                        cut = np.partition(t["odds"].to_numpy(), most - 1)[most - 1]
                        t = t.filter(pc.less_equal(t["odds"], cut))
                    held[view, label] = t
        for (view, label), t in held.items():
            for b in t.combine_chunks().to_batches():
                fixed = [pa.array(np.full(b.num_rows, x), pa.int32()) for x in (view, label)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), b.column(4), *fixed], names=[*(x.split()[0] for x in ROWS.split(", ")), "odds", "view", "label"])

    written = materialise(rows.mapInArrow(run, ROWS + ", odds double, view int, label int"), "surest")
    found = written.withColumn("tie", F.xxhash64("words", "meta", "tags"))
    out: list[list] = [[], []]
    for view in range(2):
        for label, most in ((0, low), (1, high)):
            some = found.where((F.col("view") == view) & (F.col("label") == label))
            chosen = some.select("odds", "doc_id", "tie").orderBy("odds", _hashed(), "doc_id", "tie").limit(most).collect()
            if chosen:
                keys = rows.sparkSession.createDataFrame(sorted({(r["doc_id"], r["tie"]) for r in chosen}, key=str), "id long, t long")
                got = some.join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t"))).dropDuplicates(["doc_id", "tie"])
                out[view] += [(label, r) for r in got.orderBy("odds", _hashed(), "doc_id", "tie").collect()]
    discard(written)
    shared.unpersist()
    return out


def co_train(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, pseudo: int = PSEUDO) -> CoTrained:
    """The model learnt from ``written_features`` and labels (doc_id, quality); each third labelled row is kept for the calibration. All documents but the
    labelled ones of the fit are the pool of every round."""
    known = labelled_rows(rows, labels, labelled)
    y = np.array([r["y"] for r in known], float)
    text, page = TextView(), MetaView()
    if len(set(y)) < 2:
        return CoTrained(text, page, [(1, 0), (1, 0)], [0, 0], float(y.mean()) if len(y) else 0.5)
    held, learn = [list(range(len(known)))[2::3], [k for k in range(len(known)) if k % 3 != 2]]
    if len(set(y[held])) < 2 or len(set(y[learn])) < 2:
        held = learn = list(range(len(known)))
    low = min(pseudo - 1, max(1, round(pseudo * (1 - y[learn].mean()))))
    mine = [[(y[k], known[k]) for k in learn] for _ in range(2)]  # what each view learns from
    taken: tuple[set, set] = tuple({r["doc_id"] for r in known} for _ in range(2))
    calibration = _arrays([known[k] for k in held])

    def fitted(k: int) -> TextView | MetaView:
        view, own = (TextView(), MetaView())[k], mine[k]
        words_, meta, tags = _arrays([x for _, x in own])
        y_, weight = np.array([x for x, _ in own], float), np.where(np.arange(len(own)) < len(learn), 1.0, TRUST)
        view.fit(*_sparse_rows(words_), y_, weight) if k == 0 else view.fit(meta, tags, y_, weight)
        return view

    def judged(k: int, view) -> tuple[tuple[float, float], float]:
        """The calibration of a view, and its mean log loss on the held rows."""
        odds = view.odds(*_sparse_rows(calibration[0])) if k == 0 else view.odds(*calibration[1:])
        slope, offset = _platt(odds, y[held])
        p = _sigmoid(slope * odds + offset)
        return (slope, offset), float(-np.mean(np.log(np.where(y[held] > 0, p, 1 - p).clip(1e-6))))

    views = [fitted(k) for k in range(2)]
    state = [judged(k, v) for k, v in enumerate(views)]
    for _ in range(rounds):
        text, page = views
        limits = [_sure(o, y[held]) for o in (text.odds(*_sparse_rows(calibration[0])), page.odds(*calibration[1:]))]
        before, gained = [len(x) for x in mine], False
        for k, found in enumerate(surest(rows, text, page, low, pseudo - low, taken, limits)):
            mine[1 - k] += [(float(label), x) for label, x in found]
            taken[k].update(x["doc_id"] for _, x in found)
        for k in range(2):
            if len(mine[k]) > before[k]:
                view = fitted(k)
                new = judged(k, view)
                if new[1] <= state[k][1]:
                    views[k], state[k], gained = view, new, True
                else:
                    del mine[k][before[k] :]
        if not gained:
            break
    text, page = views
    platt, loss = [x for x, _ in state], [x for _, x in state]
    weight = [1 / (x + 1e-3) for x in loss]
    return CoTrained(text, page, platt, [x / sum(weight) for x in weight])


def classify(rows: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, p_text, p_meta, score) for each row of ``features``; the model is a broadcast of fixed size."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = shared.value.score(*_batch_arrays(b)).round(6)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, scores)], names=["doc_id", "p_text", "p_meta", "score"])

    return rows.select("doc_id", "words", "meta", "tags").mapInArrow(run, "doc_id long, p_text double, p_meta double, score double")


def op9_quality_classifier(spark, sf_dir):
    """doc_id, p_text, p_meta, score (of good quality, 0 to 1) and kept (score at least 0.5) for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rows = written_features(docs)
    return classify(rows, co_train(rows, table(spark, sf_dir, "labels"))).withColumn("kept", F.col("score") >= 0.5)
