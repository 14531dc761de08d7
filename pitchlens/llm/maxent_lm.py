"""Hashed maximum-entropy language model with a class-factored softmax.

log p(word | history) = log p(class of word | history) + log p(word | class). The class softmax has
hashed features of the history: the last word, the last two words (n-grams), the word two and the
word three back (skips). Frequent words are classes of their own; the other words of a bounded
vocabulary are clustered by the frequent word that comes before them; all words outside it share
one class. Word probabilities inside a class are the softmax of its words' own weights, whose maximum-likelihood
values are the log counts. All counts cover all training texts, whatever their number of words.

Training runs in rounds over slices of the texts. In a round every task takes gradient steps over its
texts from the shared weights; the weight changes are averaged block by block in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pitchlens.llm._common import cut, id_mod, mix64, tree_merge
from pitchlens.llm._text import Words, chunks

VOCAB = 1 << 18      # words with weights of their own (a bound on what is broadcast: 16 bytes each)
SINGLE = 14          # frequent words that are classes of their own
CLUSTERS = 16        # classes of the other vocabulary words
CLASSES = SINGLE + 1 + CLUSTERS + 1   # single words, the end of a text, clusters, all other words
END_CLASS, RARE_CLASS = SINGLE, CLASSES - 1
FEATURES = 4
BUCKETS = 1 << 14    # rows of the weight table of each feature
BLOCK = 1 << 10      # rows of a weight table that travel together
BATCH = 4096         # tokens of a gradient step
RATE = 0.15
END = np.uint64(0x5F3759DF5F3759DF)   # hash of the end token
START = np.uint64(0x2545F4914F6CDD1D)  # history before the first word
_KEYS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, first token of every document and the total); each document ends with END."""
    h = w.hashes()
    h[h == END] = START
    bounds = w.bounds + np.arange(w.n_docs + 1)
    out = np.full(len(h) + w.n_docs, END, np.uint64)
    out[np.arange(len(h)) + w.doc] = h
    return out, bounds


def history(tok: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(tokens, FEATURES): weight row of each feature of each token's history."""
    n = len(tok)
    back = np.full((4, n), START, np.uint64)
    nth = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in (1, 2, 3):
        ok = np.flatnonzero(nth >= k)
        back[k, ok] = tok[ok - k]
    out = np.empty((n, FEATURES), np.int32)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for f, value in enumerate((back[1], back[1] ^ mix64(back[2]), back[2], back[3])):
        out[:, f] = (mix64(value + np.uint64(_KEYS[f])) >> shift).astype(np.int32) + f * BUCKETS
    return out


@dataclass
class Vocabulary:
    """Sorted word hashes with training counts and classes; totals of all training tokens."""

    hash: np.ndarray
    count: np.ndarray
    cls: np.ndarray
    total: int       # N
    kinds: int       # V
    ends: int

    def find(self, tok: np.ndarray) -> np.ndarray:
        """Place of each token in the vocabulary, -1 outside it."""
        if not len(self.hash):
            return np.full(len(tok), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, tok), len(self.hash) - 1)
        return np.where(self.hash[at] == tok, at, -1)

    def classes(self, place: np.ndarray, tok: np.ndarray) -> np.ndarray:
        out = np.full(len(tok), RARE_CLASS, np.int64)
        out[place >= 0] = self.cls[place[place >= 0]]
        out[tok == END] = END_CLASS
        return out


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of a partition (words only), handed on whenever many different ones are held."""
    held, n = [], 0

    def rows():
        h = np.concatenate([x for x, _ in held]) if held else np.zeros(0, np.uint64)
        c = np.concatenate([y for _, y in held]) if held else np.zeros(0, np.int64)
        kind, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, weights=c, minlength=len(kind)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kind.view(np.int64)), pa.array(total)], ["h", "c"])

    for b in batches:
        for w in chunks(b.column(0), lower=True):
            h = w.hashes()
            h[h == END] = START
            kind, count = np.unique(h, return_counts=True)
            held.append((kind, count))
            n += len(kind)
            if n > 3_000_000:
                yield rows()
                held, n = [], 0
    yield rows()


def _before(single: np.ndarray, vocab: np.ndarray):
    """Counts of (vocabulary word, frequent word last seen before it in the text), by word place."""
    order = np.argsort(single)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(vocab), SINGLE), np.float32)
        for b in batches:
            for w in chunks(b.column(0), lower=True):
                if not len(w.start) or not len(vocab):
                    continue
                h = w.hashes()
                at = np.minimum(np.searchsorted(single[order], h), len(single) - 1)
                hit = single[order][at] == h
                spot = np.where(hit, np.arange(len(h)), -1)
                last = np.maximum.accumulate(np.append(-1, spot[:-1]))
                place = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                ok = (vocab[place] == h) & (last >= w.bounds[:-1][w.doc])
                key = place[ok] * SINGLE + order[at[last[ok]]]
                kind, count = np.unique(key, return_counts=True)
                total.reshape(-1)[kind] += count
        for a in range(0, len(vocab), 1 << 14):
            part = total[a:a + (1 << 14)].reshape(-1)
            at = np.flatnonzero(part).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([at.tobytes()], pa.binary()),
                                              pa.array([part[at].tobytes()], pa.binary())], ["block", "at", "n"])

    return run


def _before_sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << 14) * SINGLE, np.float32)
    for at, n in zip(pdf["at"], pdf["n"]):
        total[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.float32)
    at = np.flatnonzero(total).astype(np.int32)
    return pdf.iloc[:1].assign(at=[at.tobytes()], n=[total[at].tobytes()])


def cluster(x: np.ndarray, weight: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    """Weighted k-means of the rows of x (a bounded table), started from the heaviest distinct corners."""
    p = np.sqrt((x + 0.2) / (x + 0.2).sum(axis=1, keepdims=True))
    start = [int(weight.argmax())]
    near = ((p - p[start[0]]) ** 2).sum(axis=1)
    for _ in range(1, min(k, len(p))):
        start.append(int((near * weight).argmax()))
        near = np.minimum(near, ((p - p[start[-1]]) ** 2).sum(axis=1))
    mid = p[start].copy()
    at = np.zeros(len(p), np.int64)
    for _ in range(steps):
        at = (p @ mid.T - 0.5 * (mid ** 2).sum(axis=1)).argmax(axis=1)
        for c in range(len(mid)):
            own = at == c
            if own.any():
                mid[c] = np.average(p[own], axis=0, weights=weight[own])
    return at


def vocabulary(train: DataFrame, counts: DataFrame) -> Vocabulary:
    """The VOCAB most frequent words (ties by hash) with classes; train: column text, counts: columns h, c."""
    n, kinds = counts.agg(F.sum("c"), F.count("h")).first()
    ends = train.count()
    top = counts.orderBy(F.desc("c"), "h").limit(VOCAB).toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    c = top["c"].to_numpy()
    frequent = np.lexsort((h, -c))[:SINGLE]
    order = np.argsort(h)
    h, c, single = h[order], c[order], h[frequent]
    cls = np.full(len(h), SINGLE + 1, np.int64)
    if len(single) == SINGLE:
        parts = train.select("text").mapInArrow(_before(single, h), "block int, at binary, n binary")
        x = np.zeros((len(h) + (1 << 14), SINGLE), np.float32)
        flat = x.reshape(-1)
        for r in tree_merge(parts, ["block"], _before_sum, "block int, at binary, n binary").toLocalIterator():
            flat[r["block"] * SINGLE + np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.float32)
        cls = SINGLE + 1 + cluster(x[:len(h)], c.astype(float), CLUSTERS)
    for k, s in enumerate(single):
        cls[np.searchsorted(h, s)] = k
    return Vocabulary(h, c, cls, int(n or 0) + ends, int(kinds) + (ends > 0), ends)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = bias + weights[rows[:, 0]]
    for f in range(1, FEATURES):
        z += weights[rows[:, f]]
    return log_softmax(z)


def gradient_step(weights: np.ndarray, bias: np.ndarray, squares: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> float:
    """One adaptive step on a batch, in place. Returns the batch's log-likelihood (natural)."""
    lp = scores(weights, bias, rows)
    err = -np.exp(lp)
    err[np.arange(len(cls)), cls] += 1.0
    for f in range(FEATURES):
        order = np.argsort(rows[:, f], kind="stable")
        r = rows[order, f]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        g = np.add.reduceat(err[order], first, axis=0)
        row = r[first]
        squares[row] += g * g
        weights[row] += RATE * g / np.sqrt(squares[row])
    return float(lp[np.arange(len(cls)), cls].sum())


def _trained(vocab, weights, bias: np.ndarray):
    """Steps over a partition's texts; the weight changes by block, scaled by the tokens seen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        w = weights.value.copy()
        squares = np.ones_like(w)
        seen = 0
        for b in batches:
            for chunk in chunks(b.column(0), lower=True):
                tok, bounds = tokens(chunk)
                rows, cls = history(tok, bounds), v.classes(v.find(tok), tok)
                for k in range(0, len(tok), BATCH):
                    gradient_step(w, bias, squares, rows[k:k + BATCH], cls[k:k + BATCH])
                seen += len(tok)
        if seen:
            w -= weights.value
            at = np.arange(0, len(w), BLOCK)
            yield pa.RecordBatch.from_arrays([
                pa.array(at.astype(np.int32)), pa.array(np.full(len(at), float(seen))),
                pa.array([w[a:a + BLOCK].astype(np.float16).tobytes() for a in at], pa.binary())], ["block", "seen", "change"])

    return run


def _averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(s * np.frombuffer(x, np.float16).astype(np.float64) for s, x in zip(pdf["seen"], pdf["change"]))
    seen = pdf["seen"].sum()
    return pdf.iloc[:1].assign(seen=[seen], change=[(total / seen).astype(np.float16).tobytes()])


@dataclass
class Model:
    vocab: Vocabulary
    weights: np.ndarray
    bias: np.ndarray
    word_log: np.ndarray   # log10 p(word | class) per vocabulary word
    rare_total: float      # N_rare + 0.5 (V_rare + 1): what a word outside the vocabulary is divided by


def fit(train: DataFrame, counts: DataFrame, rounds: int = 2) -> Model:
    """train: column text; counts: h, c over the same rows. A slice of the texts is one round's work."""
    spark = train.sparkSession
    v = vocabulary(train, counts)
    mass = np.bincount(v.cls, weights=v.count, minlength=CLASSES).astype(float)
    inside = float(v.count.sum())
    mass[END_CLASS] += v.ends
    mass[RARE_CLASS] += v.total - v.ends - inside
    bias = np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32)
    word_log = np.log10(v.count / np.maximum(np.bincount(v.cls, weights=v.count, minlength=CLASSES)[v.cls], 1.0))
    rare_kinds = v.kinds - (v.ends > 0) - len(v.hash)
    model = Model(v, np.zeros((FEATURES * BUCKETS, CLASSES), np.float32), bias, word_log,
                  (v.total - v.ends - inside) + 0.5 * (rare_kinds + 1))
    vocab = spark.sparkContext.broadcast(v)
    for k in range(rounds if v.total else 0):
        weights = spark.sparkContext.broadcast(model.weights)
        part = train.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k).select("text")
        changes = tree_merge(part.mapInArrow(_trained(vocab, weights, bias), "block int, seen double, change binary"),
                             ["block"], _averaged, "block int, seen double, change binary")
        new = model.weights.copy()
        for r in changes.toLocalIterator():
            new[r["block"]:r["block"] + BLOCK] += np.frombuffer(r["change"], np.float16).reshape(-1, CLASSES)
        model.weights = new
        weights.unpersist()
    return model


def _scored(shared):
    """Per text: token counts, base and model score over vocabulary tokens, and the other words with counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        v = m.vocab
        low = np.log10(v.total + 0.5 * (v.kinds + 1))
        base_log = np.log10(v.count + 0.5) - low
        end_log = np.log10(v.ends + 0.5) - low
        for b in batches:
            for w in chunks(b.column(b.num_columns - 1), lower=True):
                tok, bounds = tokens(w)
                place = v.find(tok)
                cls = v.classes(place, tok)
                doc = np.repeat(np.arange(w.n_docs), np.diff(bounds))
                lp = np.empty(len(tok))
                for k in range(0, len(tok), BATCH):
                    s = scores(m.weights, m.bias, history_part(tok, bounds, k))
                    lp[k:k + BATCH] = s[np.arange(len(s)), cls[k:k + BATCH]]
                lp *= np.log10(np.e)
                base = np.zeros(len(tok))
                inside = place >= 0
                base[inside] = base_log[place[inside]]
                lp[inside] += m.word_log[place[inside]]
                end = tok == END
                base[end] = end_log
                other = ~inside & ~end
                known = inside | (end & (v.ends > 0))
                # Different words outside the vocabulary, with their counts in the text.
                order = np.lexsort((tok[other], doc[other]))
                h, d = tok[other][order], doc[other][order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(first, len(h)))
                off = np.append(0, np.cumsum(np.bincount(d[first], minlength=w.n_docs))).astype(np.int32)
                part = b.slice(w.first, w.n_docs)
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:-1], pa.array(np.diff(bounds)),
                    pa.array(np.bincount(doc, weights=known, minlength=w.n_docs).astype(np.int64)),
                    pa.array(np.bincount(doc, weights=base, minlength=w.n_docs)),
                    pa.array(np.bincount(doc, weights=lp, minlength=w.n_docs)),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(h[first].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(tf.astype(np.int32)))],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "lp", "h", "tf"])

    return run


def history_part(tok: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """``history`` of the tokens k .. k + BATCH - 1."""
    lo, hi = max(0, k - 3), min(len(tok), k + BATCH)
    inner = bounds[(bounds > lo) & (bounds < hi)]
    rows = history(tok[lo:hi], np.concatenate([[0], inner - lo, [hi - lo]]))
    return rows[k - lo:]


def score(docs: DataFrame, learn: Column | None = None, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    NULL text counts as empty (one end token). ``learn`` picks the training rows; by default those whose
    crc32(id) mod 5 is not 1 (a NULL id is neither trained on nor held out). Words outside the
    bounded vocabulary get their exact training counts by a join.
    """
    spark = docs.sparkSession
    mod = id_mod(id_col, 5)
    learn = F.coalesce(mod != 1, F.lit(False)) if learn is None else learn
    text = F.coalesce(F.col(text_col), F.lit(""))
    train = docs.where(learn).select(text.alias("text"))
    counts = cut(train.mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    model = fit(train, counts, rounds)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(mod == 1, F.lit(False)).alias("held_out"),
                       F.monotonically_increasing_id().alias("row"), text.alias("text"))
    done = cut(rows.mapInArrow(_scored(shared), f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, "
                               "base double, lp double, h array<long>, tf array<int>"))
    # Words outside the vocabulary: exact counts, 0 for words that training never saw.
    v = model.vocab
    low = float(np.log10(v.total + 0.5 * (v.kinds + 1)))
    rare = done.select("row", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("row", "x.h", "x.tf")
    found = rare.join(counts, "h", "left").select("row", "tf", F.coalesce("c", F.lit(0)).alias("c"))
    log = F.log10(F.col("c") + 0.5)
    more = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * (log - low)).alias("more_base"),
        F.sum(F.col("tf") * (log - float(np.log10(model.rare_total)))).alias("more_lp"))
    return done.drop("h", "tf").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("lp") + F.coalesce("more_lp", F.lit(0.0))).alias("score"))
