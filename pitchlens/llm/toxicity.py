"""Toxicity categories by a chain of linear classifiers.

The categories have an order. The model of a category sees the words of a text and the probabilities of
all earlier categories. In training those probabilities are out-of-fold predictions, so that a later
model meets them as unsure as they will be on new texts; a text's fold is by its hash, so copies share one. Models are fitted on a bounded sample of
labelled rows (``max_rows``); all folds of a category are fitted side by side as tasks. Scoring covers
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitchlens.llm._common import cut
from pitchlens.llm._text import NOT_WORD, chunks

MAX_ROWS = 10_000    # labelled rows a chain is fitted on
FOLDS = 3
CANDIDATES = 1 << 16 # words of the sample that a model may choose from (places fit 16 bits)
MAX_FEATURES = 256   # words of one model
STEMS = (4, 5, 6)    # bytes of the word beginnings that are features beside whole words
MIN_ROWS = 5         # rows a word must be in
RIDGE = 0.03


@dataclass
class Linear:
    """One category: weights of words (by hash), of earlier categories' log-odds, and the intercept."""

    word: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _likely_words(words: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The words whose presence tells most about y (likelihood-ratio statistic), at most MAX_FEATURES."""
    kind, at = np.unique(words, return_inverse=True)
    n, pos = len(y), y.sum()
    df = np.bincount(at, minlength=len(kind)).astype(float)
    hit = np.bincount(at, weights=y[row], minlength=len(kind))

    def part(a, rows, of):  # a rows of y = 1 among `rows`, expected at the rate of / n
        e = rows * of / n
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / np.maximum(e, 1e-12)), 0)

    g = 2 * (part(hit, df, pos) + part(df - hit, df, n - pos) + part(pos - hit, n - df, pos) + part(n - df - pos + hit, n - df, n - pos))
    g[df < MIN_ROWS] = 0
    top = np.argsort(-g, kind="stable")[:MAX_FEATURES]
    return np.sort(kind[top[g[top] > 10]])


def _design(words: np.ndarray, row: np.ndarray, n: int, feature: np.ndarray, odds: np.ndarray) -> np.ndarray:
    x = np.zeros((n, len(feature) + odds.shape[1] + 1))
    if len(feature):
        at = np.minimum(np.searchsorted(feature, words), len(feature) - 1)
        hit = feature[at] == words
        x[row[hit], at[hit]] = 1.0
    x[:, len(feature):-1] = odds
    x[:, -1] = 1.0
    return x


def fit_one(words: np.ndarray, row: np.ndarray, y: np.ndarray, odds: np.ndarray) -> Linear:
    """Ridge logistic regression by Newton steps on the most telling words and the earlier log-odds."""
    feature = _likely_words(words, row, y)
    x = _design(words, row, len(y), feature, odds)
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    w = np.zeros(x.shape[1])
    w[-1] = _log_odds(np.array(rate))
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    k = len(feature)
    return Linear(feature, w[:k], w[k:-1], float(w[-1]))


def apply_one(m: Linear, words: np.ndarray, row: np.ndarray, n: int, odds: np.ndarray) -> np.ndarray:
    z = np.full(n, m.bias) + (odds @ m.earlier if odds.shape[1] else 0.0)
    if len(m.word):
        at = np.minimum(np.searchsorted(m.word, words), len(m.word) - 1)
        hit = m.word[at] == words
        z += np.bincount(row[hit], weights=m.weight[at[hit]], minlength=n)
    return _sigmoid(z)


def _features(w) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash, document) of every word and word beginning of a chunk."""
    h, doc = w.stems(STEMS)
    return (h >> np.uint64(32)).astype(np.uint32), doc


def _once(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) pairs sorted by document, each once."""
    pair = np.unique(doc.astype(np.uint64) << np.uint64(32) | h)
    return pair.astype(np.uint32), (pair >> np.uint64(32)).astype(np.int64)


def _word_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = []
        for w in chunks(b.column(0), lower=True, gap=NOT_WORD):
            h, doc = _once(*_features(w))
            sets += [x.tobytes() for x in np.split(h, np.searchsorted(doc, np.arange(1, w.n_docs)))]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sets, pa.binary())], ["h", "i", "y", "words"])


def _row_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f, c = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in b.column(0)] or [np.zeros(0, np.uint32)]),
                         return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(c)], ["f", "c"])


def _known_words(known: np.ndarray):
    """Each row's words as places in the sorted candidates (16 bits each)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(3):
                w = np.frombuffer(x.as_py(), np.uint32)
                at = np.minimum(np.searchsorted(known, w), max(len(known) - 1, 0))
                out.append(at[known[at] == w].astype(np.uint16).tobytes() if len(known) else b"")
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["h", "i", "y", "words"])

    return run


def _fit_task(sample, category: int, folds: int, odds: np.ndarray):
    """Task ``folds`` fits on the whole sample, task k leaves fold k out and predicts it."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, y_all, words = sample.value
        fold = y_all[:, -1]
        for task in (int(t) for pdf in frames for t in pdf["id"]):
            y = y_all[:, category].astype(float)

            def part(which):
                k = np.flatnonzero(which)
                flat = np.concatenate([words[i] for i in k] or [np.zeros(0, np.uint16)])
                return known[flat], np.repeat(np.arange(len(k)), [len(words[i]) for i in k]), odds[k]

            use = (y >= 0) & (fold != task)
            flat, row, o = part(use)
            m = fit_one(flat, row, y[use], o)
            out = {"task": task, "word": m.word.tobytes(), "weight": m.weight.tobytes(), "earlier": m.earlier.tobytes(),
                   "bias": m.bias, "p": b""}
            if task < folds:
                flat, row, o = part(fold == task)
                out["p"] = apply_one(m, flat, row, len(o), o).tobytes()
            yield pd.DataFrame([out])

    return run


def fit(labelled: DataFrame, categories: dict[str, Column], max_rows: int = MAX_ROWS, folds: int = FOLDS,
        id_col: str = "doc_id", text_col: str = "text") -> list[Linear]:
    """Models of the chain in the order of ``categories`` (name -> 0/1 column; NULL: not labelled).

    At most ``max_rows`` rows are used, chosen by a hash of the id, and of their words the ``CANDIDATES`` that are in
    most rows; this bounded sample is what is broadcast. The fits of a category run side by side as tasks.
    """
    spark = labelled.sparkSession
    fold = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(folds)).cast("int")
    y = F.array(*[F.coalesce(c.cast("int"), F.lit(-1)) for c in categories.values()], fold)
    pick = labelled.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).cast("long").alias("i"), y.alias("y"))
    # The largest hash that still belongs to the sample, found over the ids alone.
    last = pick.select("h").orderBy("h").limit(max_rows).agg(F.max("h"), F.count("h")).first()
    if not last[1]:
        return [Linear(earlier=np.zeros(k)) for k in range(len(categories))]
    sets = pick.where(F.col("h") <= last[0]).mapInArrow(_word_sets, "h long, i long, y array<int>, words binary")
    rows = cut(sets.orderBy("h", "i").limit(max_rows))
    top = (rows.select("words").mapInArrow(_row_counts, "f long, c long").groupBy("f").agg(F.sum("c").alias("c"))
           .where(F.col("c") >= MIN_ROWS).orderBy(F.desc("c"), "f").limit(CANDIDATES).toArrow())
    known = np.sort(top["f"].to_numpy().astype(np.uint32))
    got = sorted(rows.mapInArrow(_known_words(known), "h long, i long, y array<int>, words binary").collect(),
                 key=lambda r: (r["h"], r["i"] is None, r["i"]))
    sample = spark.sparkContext.broadcast((known, np.array([r["y"] for r in got], np.int8),
                                           [np.frombuffer(r["words"], np.uint16) for r in got]))
    fold_of = np.array([r["y"][-1] for r in got])
    odds, models = np.zeros((len(got), 0)), []
    for k in range(len(categories)):
        tasks = spark.range(0, folds + 1, 1, folds + 1)
        p = np.full(len(got), 0.5)
        for r in tasks.mapInPandas(_fit_task(sample, k, folds, odds),
                                   "task int, word binary, weight binary, earlier binary, bias double, p binary").collect():
            if r["task"] == folds:
                models.append(Linear(np.frombuffer(r["word"], np.uint32), np.frombuffer(r["weight"]),
                                     np.frombuffer(r["earlier"]), r["bias"]))
            else:
                p[fold_of == r["task"]] = np.frombuffer(r["p"])
        odds = np.hstack([odds, _log_odds(p)[:, None]])
    return models


def _scored(models: list[Linear]):
    every = np.unique(np.concatenate([m.word for m in models] or [np.zeros(0, np.uint32)]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.zeros((b.num_rows, len(models)))
            for w in chunks(b.column(1), lower=True, gap=NOT_WORD):
                h, doc = _features(w)
                hit = every[np.minimum(np.searchsorted(every, h), len(every) - 1)] == h if len(every) else np.zeros(len(h), bool)
                h, doc = _once(h[hit], doc[hit])
                odds = np.zeros((w.n_docs, 0))
                for k, m in enumerate(models):
                    q = apply_one(m, h, doc, w.n_docs, odds)
                    p[w.first:w.first + w.n_docs, k] = q
                    odds = np.hstack([odds, _log_odds(q)[:, None]])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, k]) for k in range(len(models))]],
                                             ["doc_id", *[f"p{k}" for k in range(len(models))]])

    return run


def predict(docs: DataFrame, models: list[Linear], names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and p_<category> per input row; NULL and wordless texts get what the intercepts say."""
    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _scored(models), ", ".join([f"doc_id {kind}", *[f"p{k} double" for k in range(len(models))]]))
    return got.select("doc_id", *[F.col(f"p{k}").alias(f"p_{n}") for k, n in enumerate(names)])


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, p_toxic_low_quality, toxic (p_toxic >= 0.5), learned from ``labels``.

    The categories are what the labels tell: poor text, toxic text, toxic and poor text, in this order; poor text is no
    kind of toxicity, but the chain's later models profit from it. Labels whose document is missing are not used; a
    document labelled twice, with equal labels or not, is used twice. NULL ids match no label and are scored like any row.
    """
    labelled = docs.select("doc_id", "text").join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    low, toxic = 1 - F.col("quality"), F.col("toxic")
    chain = {"low_quality": low, "toxic": toxic, "toxic_low_quality": low * toxic}
    models = fit(labelled, chain, max_rows)
    return predict(docs, models, list(chain)).withColumn("toxic", F.col("p_toxic") >= 0.5)
