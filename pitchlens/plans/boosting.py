"""Gradient boosting with second-order gains: logistic, softmax and squared loss.

Features are binned once and landed, thousands of rows to a record of packed arrays. A round fits one tree per class, all
classes side by side, one level per pass: tasks add up gradients and hessians by (class, node, feature bin), partial sums
merge in blocks of nodes, and where a block is complete its best splits are found, so the driver gets splits and no
histogram. A pass is one plain job over the landed records: no query is planned, nothing is unpacked row by row, and
sums of at most ``SMALL`` bytes in all are not exchanged but added up on the driver (half of a pass is the exchange). Scores
of the rounds since the last refresh are computed in the passes; every ``REFRESH`` rounds they are added
to the landed table. The loss of the training rows before each round comes with the round's first pass.
Rows that make up one task (fewer than two times ``ROWS_PER_TASK``) have nothing to exchange between levels: a
pass is then a whole round, and tasks share out the classes. With one score per row, the rows are persisted as they are
read by the passes, in as many partitions as there are slots, and get the scores of a round's tree in the first pass of the next
one; their lineage is cut every ``LINEAGE`` rounds. Nodes of few rows (``LOCAL_ROWS`` together with their sibling) are left out
of these passes: their rows are dealt out once, packed, to groups of about equal size, and each group grows its subtrees to
the end where it is, by the same sums and splits.
"""

from __future__ import annotations

import heapq
import math
import operator
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_path
from .trees import PRIME, draw

REFRESH = 4               # rounds between updates of the landed scores
ROWS_PER_TASK = 50_000
LOCAL_ROWS = 1 << 19      # rows of two siblings that are dealt out instead of taking
LOCAL_LEVELS = 3          # so many levels or more by passes
LINEAGE = 12              # rounds between checkpoints of the persisted rows
TASK_ROWS = 1 << 20       # of these, rows that a task reads at most (where a cluster has few slots)
FAN_IN = 64               # partial histograms that a task merges at a time
BLOCK_CELLS = 1 << 19     # (node, bin) cells of a histogram block
CLASS_CELLS = 1 << 23     # (class, node, bin) cells that a task holds; more classes take more passes
BATCH = 1 << 16           # rows of a landed record at most, and
RECORD_SCORES = 1 << 20   # their scores
SMALL = 1 << 25           # bytes of all partial sums of a pass that the driver adds up itself
TREES = "round int, class int, node int, feature int, threshold double, left int, right int, value double"

LOSSES = ("logistic", "softmax", "squared")


def gradients(scores: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, hessian, loss) of every row; scores, gradients and hessians are (rows, classes)."""
    if loss == "squared":
        d = scores - y[:, None]
        return d, np.ones_like(d), d[:, 0] ** 2
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-scores))
        z = np.where(y[:, None] > 0, scores, -scores)
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16), np.logaddexp(0.0, -z)[:, 0]
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    p = e / e.sum(axis=1, keepdims=True)
    at, c = np.arange(len(y)), y.astype(np.int64)
    value = np.log(e.sum(axis=1)) + top[:, 0] - scores[at, c]
    g = p.copy()
    g[at, c] -= 1.0
    return g, np.maximum(2.0 * p * (1 - p), 1e-16), value


class Tree:
    """A tree by places: feature -1 is a leaf. bins: thresholds are bins (rows go left up to it)."""

    __slots__ = ("feature", "bin", "left", "right", "value")

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value = ([-1], [0], [-1], [-1], [0.0])

    def split(self, at: int, feature: int, bin_: int) -> tuple[int, int]:
        k = len(self.feature)
        self.feature[at], self.bin[at], self.left[at], self.right[at] = feature, bin_, k, k + 1
        for name, v in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("value", 0.0)):
            getattr(self, name).extend([v, v])
        return k, k + 1

    def walk(self, x: np.ndarray) -> np.ndarray:
        """Place of every row; x holds bins, or values where ``bin`` holds thresholds."""
        feature, bins, left, right = (np.asarray(v) for v in (self.feature, self.bin, self.left, self.right))
        leaf, own = feature < 0, np.arange(len(feature))     # rows that are at a leaf stay there
        if not (x.flags.c_contiguous or x.flags.f_contiguous):
            x = np.ascontiguousarray(x)
        flat, (down, across) = x.ravel("K"), (v // x.itemsize for v in x.strides)
        column, cuts = np.where(leaf, 0, feature) * across, bins.astype(x.dtype)
        child = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], 1).ravel()
        at, first, level = np.zeros(len(x), np.int64), np.arange(len(x)) * down, np.zeros(1, np.int64)
        while len(level := level[~leaf[level]]):             # a step for each level that has splits
            level = np.append(left[level], right[level])
            where = column.take(at)
            where += first
            below_ = flat.take(where) <= cuts.take(at)
            at += at
            at += below_
            at = child.take(at)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.walk(x)]


def gain(g: np.ndarray, h: np.ndarray, reg_lambda: float, reg_alpha: float) -> np.ndarray:
    t = np.sign(g) * np.maximum(np.abs(g) - reg_alpha, 0.0)
    return t * t / (h + reg_lambda)


def leaf_value(g: float, h: float, p: dict) -> float:
    if h + p["reg_lambda"] <= 0:
        return 0.0
    return -p["learning_rate"] * math.copysign(max(abs(g) - p["reg_alpha"], 0.0), g) / (h + p["reg_lambda"])


def best_splits(g: np.ndarray, h: np.ndarray, first: np.ndarray, allowed: np.ndarray, p: dict) -> list[tuple]:
    """Per node (rows of g and h, columns are the bins of all features): the best split, or none.

    first: column of each feature's first bin, and the end. allowed: mask of features.
    -> (gain, feature, bin, g left, h left, g, h); ties go to the first feature and bin.
    """
    out = []
    total_g, total_h = g[:, first[0]:first[1]].sum(1), h[:, first[0]:first[1]].sum(1)
    cg, ch = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    feature = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before = first[:-1][feature]
    lg = cg - np.where(before > 0, cg[:, before - 1], 0.0)
    lh = ch - np.where(before > 0, ch[:, before - 1], 0.0)
    rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
    with np.errstate(divide="ignore", invalid="ignore"):
        won = (gain(lg, lh, p["reg_lambda"], p["reg_alpha"]) + gain(rg, rh, p["reg_lambda"], p["reg_alpha"])
               - gain(total_g, total_h, p["reg_lambda"], p["reg_alpha"])[:, None])
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False                 # the last bin of a feature splits nothing off
    ok = inner & allowed[feature] & (lh >= p["min_child_weight"]) & (rh >= p["min_child_weight"]) & (lh > 0) & (rh > 0)
    won = np.where(ok & np.isfinite(won), won, -np.inf)
    rounded = np.round(won, 7)                   # equal partitions by two features differ in the last bits
    for k in range(len(g)):
        c = int(rounded[k].argmax())
        if won[k, c] > max(p["gamma"], 1e-10):
            out.append((float(won[k, c]), int(feature[c]), int(c - before[c]), float(lg[k, c]), float(lh[k, c]), float(total_g[k]), float(total_h[k])))
        else:
            out.append((-1.0, -1, 0, 0.0, 0.0, float(total_g[k]), float(total_h[k])))
    return out


def cut_points(rows: DataFrame, n_features: int, max_bins: int) -> list[np.ndarray]:
    """Per feature the upper ends of its bins but the last: all its values where they fit ``max_bins``, else quantiles."""
    flat = rows.select(*[F.col("x")[k].alias(f"f{k}") for k in range(n_features)])
    most = int(0.9 * max_bins)

    def kinds(batches):
        held = [np.zeros(0)] * n_features                   # values of each feature, None: more than ``most``
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
            for k, v in enumerate(held):
                if v is not None:
                    v = np.unique(np.append(v, x[:, k]))
                    held[k] = v if len(v) <= most else None
        for k, v in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(1 if v is None else len(v), k, np.int32)),
                                              pa.nulls(1, pa.float64()) if v is None else pa.array(v)], ["k", "v"])

    seen = rows.select("x").mapInArrow(kinds, "k int, v double").distinct().groupBy("k").agg(
        F.max(F.col("v").isNull()).alias("over"), F.count("v").alias("n"), F.slice(F.sort_array(F.collect_set("v")), 1, most + 1).alias("v"))
    out = {r["k"]: np.array(r["v"])[:-1] for r in seen.where(f"NOT over AND n <= {most}").collect()}
    many = [k for k in range(n_features) if k not in out]
    if many:
        probs = [k / max_bins for k in range(max_bins + 1)]
        for k, q in zip(many, flat.approxQuantile([f"f{k}" for k in many], probs, 1.0 / (8 * max_bins))):
            out[k] = np.unique(q)[:-1]
    return [out[k] for k in range(n_features)]


def _chosen(n: int, share: float, seed: int, round_: int, class_: int) -> np.ndarray:
    """Mask of the features that a tree may use: the first ones by keyed hash."""
    keep = max(1, int(round(share * n)))
    mask = np.zeros(n, bool)
    mask[np.argsort(draw(seed, 2, round_, class_, np.arange(n)), kind="stable")[:keep]] = True
    return mask


def _sampled(uid: np.ndarray, share: float, seed: int, round_: int) -> np.ndarray:
    if share >= 1:
        return np.ones(len(uid), bool)
    return draw(seed, 3, round_, uid % PRIME, (uid // PRIME) % PRIME) < share * PRIME


class _Pass:
    """What a pass over the rows needs: trees since the refresh, the trees in growth, their open nodes."""

    def __init__(self, loss, n_classes, first, recent, growing, open_, round_, p, classes):
        self.loss, self.n_classes, self.first, self.recent, self.growing = loss, n_classes, first, recent, growing
        self.open, self.round, self.p, self.classes = open_, round_, p, classes

    def scores(self, bins: np.ndarray, base: np.ndarray) -> np.ndarray:
        out = base.copy()
        for trees in self.recent:
            for k, t in enumerate(trees):
                out[:, k] += t.score(bins)
        return out


def _packed(uid: np.ndarray, bins: np.ndarray, y: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """One record of the landed table: so many rows as packed arrays."""
    return pa.RecordBatch.from_arrays([pa.array([len(uid)], pa.int32()), pa.array([uid.astype(np.int64).tobytes()], pa.binary()),
                                       pa.array([bins.astype(np.int16).T.tobytes()], pa.binary()), pa.array([y.astype(float).tobytes()], pa.binary()),
                                       pa.array([scores.astype(float).tobytes()], pa.binary())], ["n", "uid", "bins", "label", "scores"])


def _rows(records: Iterable, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(uid, bins, label, scores) of blocks of rows, from records (n, uid, bins by feature, label, scores)."""
    for n, uid, bins, y, scores in records:
        if n:
            yield np.frombuffer(uid, np.int64), np.frombuffer(bins, np.int16).reshape(-1, n).T, np.frombuffer(y), np.frombuffer(scores).reshape(n, k)


class _Sums:
    """Gradient and hessian sums by (class, open node, bin) of the rows of a task."""

    def __init__(self, step: _Pass, classes, trees: list[Tree], open_: list[list[int]]):
        self.width, self.first, self.trees = int(step.first[-1]), step.first, trees
        self.hold = {k: np.zeros((2, len(open_[k]), self.width)) for k in classes if len(open_[k])}
        self.count = {k: np.zeros(len(open_[k])) for k in self.hold}
        self.place = {}
        for k in self.hold:
            self.place[k] = np.full(len(trees[k].feature), -1, np.int64)
            self.place[k][open_[k]] = np.arange(len(open_[k]))

    def add(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, take: np.ndarray) -> None:
        for k, sums in self.hold.items():
            at = self.place[k][self.trees[k].walk(bins)]
            rows = np.flatnonzero((at >= 0) & take)
            at, weights = at[rows], (g[rows, k], h[rows, k])
            self.count[k] += np.bincount(at, minlength=sums.shape[1])
            for f, (a, b) in enumerate(zip(self.first, self.first[1:])) if len(rows) else ():
                index = at * (b - a) + bins[:, f][rows]
                for j, w in enumerate(weights):
                    sums[j, :, a:b] += np.bincount(index, w, sums.shape[1] * (b - a)).reshape(-1, b - a)


def _histograms(step: _Pass):
    """Rows -> ((class, block of nodes, lane), partial sums); class -1 has the loss and the number of rows."""

    def run(records):
        p, sums, loss, n = step.p, _Sums(step, step.classes, step.growing, step.open), 0.0, 0
        lane = TaskContext.get().partitionId() // FAN_IN
        for uid, bins, y, base in _rows(records, step.n_classes):
            g, h, value = gradients(step.scores(bins, base), y, step.loss)
            loss, n = loss + float(value.sum()), n + len(y)
            sums.add(bins, g, h, _sampled(uid, p["subsample"], p["seed"], step.round))
        yield (-1, 0, lane), np.array([loss, n])
        per = max(1, BLOCK_CELLS // sums.width)
        for k, held in sums.hold.items():
            held = np.append(held, np.stack([sums.count[k], np.zeros(held.shape[1])])[:, :, None], axis=2)     # last column: rows
            for a in range(0, held.shape[1], per):
                yield (k, a // per, lane), held[:, a:a + per]

    return run


def _whole_round(step: _Pass, max_depth: int, lanes: int):
    """All rows -> the round's trees of the classes of this task (class = lane modulo the number of lanes)."""

    def run(records):
        p, lane = step.p, TaskContext.get().partitionId()
        mine = [k for k in range(step.n_classes) if k % lanes == lane]
        held, loss, n = [], 0.0, 0
        for uid, bins, y, base in _rows(records, step.n_classes):
            g, h, value = gradients(step.scores(bins, base), y, step.loss)
            loss, n = loss + float(value.sum()), n + len(y)
            held.append((bins, g, h, _sampled(uid, p["subsample"], p["seed"], step.round)))
        trees = [Tree() for _ in range(step.n_classes)]
        open_ = [[0] if k in mine else [] for k in range(step.n_classes)]
        for depth in range(max(1, max_depth)):
            if not any(open_):
                break
            sums = _Sums(step, mine, trees, open_)
            for block in held:
                sums.add(*block)
            found = {k: best_splits(g, h, step.first, _chosen(len(step.first) - 1, p["colsample"], p["seed"], step.round, k), p)
                     for k, (g, h) in sums.hold.items()}
            open_ = _grow(trees, open_, found, depth, max_depth, p)
        yield -1, (loss, n)
        yield from ((k, trees[k]) for k in mine)

    return run


def _grow(trees: list[Tree], open_: list[list[int]], found: dict, depth: int, max_depth: int, p: dict) -> list[list[int]]:
    """Split the open nodes by what was found for them; the new open nodes."""
    nxt = [[] for _ in trees]
    for k, t in enumerate(trees):
        for at, (won, f, b, lg, lh, g, h, *_) in zip(open_[k], found.get(k, ())):
            if depth == 0:
                t.value[0] = leaf_value(g, h, p)
            if won < 0 or depth == max_depth:
                continue
            left, right = t.split(at, int(f), int(b))
            t.value[left], t.value[right] = leaf_value(lg, lh, p), leaf_value(g - lg, h - lh, p)
            nxt[k] += [left, right]
    return nxt


def _found(step: _Pass):
    """Complete sums of a block of nodes -> their best splits."""

    def run(kv):
        (k, block, _), sums = kv
        if k < 0:
            return k, block, sums
        found = best_splits(*sums[:, :, :-1], step.first, _chosen(len(step.first) - 1, step.p["colsample"], step.p["seed"], step.round, k), step.p)
        return k, block, np.column_stack([found, sums[0, :, -1]])

    return run


class _Level:
    """A pass over the persisted rows: the tree in growth and its open nodes. Rows are (uid, bins by feature, label, score,
    mask of the rows drawn for the round or None)."""

    def __init__(self, loss: str, first: np.ndarray, tree: Tree, open_: list[int], round_: int, p: dict):
        self.loss, self.first, self.tree, self.open, self.round, self.p = loss, first, tree, open_, round_, p

    def gradients(self, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(gradient, hessian, loss) by row; hessians that are all 1: None."""
        if self.loss == "squared":
            d = score - y
            return d, None, d * d
        g, h, value = gradients(score[:, None], y, self.loss)
        return g[:, 0], h[:, 0], value


def _narrow(first: np.ndarray):
    """Landed record -> persisted rows, bins in as few bytes as hold them."""
    kind = np.uint8 if max(np.diff(first)) <= 256 else np.int16

    def run(record):
        return next((uid, bins.T.astype(kind), y, scores[:, 0], None) for uid, bins, y, scores in _rows([record], 1))

    return run


def _advanced(tree: Tree | None, round_: int, p: dict):
    """Persisted rows -> the same with the scores of the last round's tree, and this round's draws."""

    def run(rows):
        for uid, bins, y, score, _ in rows:
            yield (uid, bins, y, score if tree is None else score + tree.score(bins.T),
                   _sampled(uid, p["subsample"], p["seed"], round_) if p["subsample"] < 1 else None)

    return run


def _added(bins: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray | None, first: np.ndarray, n: int) -> np.ndarray:
    """(2, n, bins of all features): gradients and hessians added up by slot (n of them; slot n is left out) and bin."""
    widest = int(np.diff(first).max())
    out, start, key = np.empty((2, n, first[-1])), slot * widest, np.empty(len(slot), np.int64)
    for f, (a, b) in enumerate(zip(first, first[1:])):
        np.add(start, bins[f], out=key)
        for j, w in enumerate((g, h)):
            out[j, :, a:b] = np.bincount(key, w, (n + 1) * widest)[:n * widest].reshape(n, widest)[:, :b - a]
    return out


def _level_sums(step: _Level):
    """Persisted rows -> what ``_histograms`` gives for one class."""

    def run(rows):
        n, width, loss, seen = len(step.open), int(step.first[-1]), 0.0, 0
        held, count = np.zeros((2, n, width)), np.zeros(n)
        lane = TaskContext.get().partitionId() // FAN_IN
        place = np.full(len(step.tree.feature), n, np.int64)
        place[step.open] = np.arange(n)
        for _, bins, y, score, take in rows:
            g, h, value = step.gradients(y, score)
            loss, seen = loss + float(value.sum()), seen + len(y)
            slot = place.take(step.tree.walk(bins.T))
            if take is not None:
                slot = np.where(take, slot, n)
            some = np.flatnonzero(slot < n)
            if len(some) < 0.7 * len(slot):
                bins, slot, g, h = bins[:, some], slot[some], g[some], h if h is None else h[some]
            if len(some):
                held += _added(bins, slot, g, h, step.first, n)
                count += np.bincount(slot, minlength=n + 1)[:n]
        yield (-1, 0, lane), np.array([loss, seen])
        held = np.append(held, np.stack([count, np.zeros(n)])[:, :, None], axis=2)     # last column: rows
        per = max(1, BLOCK_CELLS // width)
        for a in range(0, n, per):
            yield (0, a // per, lane), held[:, a:a + per]

    return run


def _dealt(step: _Level, bucket: np.ndarray):
    """Rows of the nodes that have a bucket -> (bucket, packed rows)."""

    def run(rows):
        task = TaskContext.get().partitionId()
        for k, (_, bins, y, score, take) in enumerate(rows):
            g, h, _ = step.gradients(y, score)
            at = step.tree.walk(bins.T)
            b = bucket[at]
            if take is not None:
                b[~take] = -1
            order = np.argsort(b, kind="stable")
            order = order[np.searchsorted(b[order], 0):]
            kinds, first = np.unique(b[order], return_index=True)
            at = at.astype(np.int32)
            for one, some in zip(kinds.tolist(), np.split(order, first[1:])):
                yield one, ((task, k), at[some], bins[:, some], g[some], h if h is None else h[some])

    return run


def _subtrees(step: _Level, level: dict[int, int], max_depth: int):
    """Packed rows by bucket -> (nodes, one table of their subtrees), as ``below`` grows them."""

    def run(kv):
        held: dict[int, list] = {}
        for b, part in kv:
            held.setdefault(b, []).append(part)
        while held:
            parts = sorted(held.pop(next(iter(held))), key=lambda x: x[0])
            at, bins, g, h = (None if parts[0][k] is None else np.concatenate([x[k] for x in parts], axis=-1) for k in (1, 2, 3, 4))
            nodes, at = np.unique(at, return_inverse=True)
            yield nodes.tolist(), below(at, bins, g, h, [level[k] for k in nodes.tolist()], max_depth, step)

    return run


def below(at: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray | None, level: list[int], max_depth: int, step: _Level) -> Tree:
    """Subtrees of several nodes, grown to the end; places 0, 1, ... are their roots. bins: (features, rows)."""
    t, p, width = Tree(), step.p, int(step.first[-1])
    for name, v in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("value", 0.0)):
        setattr(t, name, [v] * len(level))
    allowed = _chosen(len(step.first) - 1, p["colsample"], p["seed"], step.round, 0)
    per, open_, level = max(1, BLOCK_CELLS // width), list(range(len(level))), list(level)
    while open_ := [k for k in open_ if level[k] < max_depth]:
        slot = np.full(len(level), -1)
        slot[open_] = np.arange(len(open_))
        s = slot[at]
        if len(open_) > per:                     # blocks of nodes follow each other
            order = np.argsort(s.astype(np.int32), kind="stable")
            order = order[np.searchsorted(s[order], 0):]
            at, s, bins, g, h = at[order], s[order], bins[:, order], g[order], h if h is None else h[order]
        elif (s < 0).any():
            some = np.flatnonzero(s >= 0)
            at, s, bins, g, h = at[some], s[some], bins[:, some], g[some], h if h is None else h[some]
        found = []
        for a in range(0, len(open_), per):
            n = min(per, len(open_) - a)
            lo, hi = np.searchsorted(s, (a, a + n)) if len(open_) > per else (0, len(s))
            found += best_splits(*_added(bins[:, lo:hi], s[lo:hi] - a, g[lo:hi], h if h is None else h[lo:hi], step.first, n), step.first, allowed, p)
        nxt = []
        for k, (won, f, b, lg, lh, all_g, all_h) in zip(open_, found):
            if won >= 0:
                left, right = t.split(k, f, b)
                t.value[left], t.value[right] = leaf_value(lg, lh, p), leaf_value(all_g - lg, all_h - lh, p)
                level += [level[k] + 1, level[k] + 1]
                nxt += [left, right]
        open_ = nxt
        feature, cut_, left = np.array(t.feature)[at], np.array(t.bin)[at], np.array(t.left)[at]
        over = bins[np.maximum(feature, 0), np.arange(len(at))] > cut_
        at = np.where(feature >= 0, left + over, at)
    return t


def _graft(tree: Tree, nodes: list[int], sub: Tree) -> None:
    """Put subtrees in the places of their roots."""
    first, m = len(tree.feature), len(nodes)
    place = lambda k: k if k < 0 else first + k - m
    for k, at in enumerate(nodes):
        tree.feature[at], tree.bin[at], tree.left[at], tree.right[at] = sub.feature[k], sub.bin[k], place(sub.left[k]), place(sub.right[k])
    for name in ("feature", "bin", "value"):
        getattr(tree, name).extend(getattr(sub, name)[m:])
    for name in ("left", "right"):
        getattr(tree, name).extend(map(place, getattr(sub, name)[m:]))


def _splits(records: RDD, step: _Pass, parts: int) -> tuple[dict[int, np.ndarray], float]:
    """({class: best splits of its open nodes}, mean loss) of one level, for all classes."""
    found: dict[int, np.ndarray] = {}
    loss = math.nan
    per_pass = max(1, CLASS_CELLS // max(1, int(step.first[-1]) * max(1, max(map(len, step.open)))))
    for a in range(0, step.n_classes, per_pass):
        step.classes = range(a, min(a + per_pass, step.n_classes))
        some, loss = _merged(records.mapPartitions(_histograms(step)), step, [len(step.open[k]) for k in step.classes], parts)
        found.update(some)
    return found, loss


def _merged(out: RDD, step, nodes: list[int], parts: int) -> tuple[dict[int, np.ndarray], float]:
    """({class: best splits}, mean loss) from the partial sums of ``parts`` tasks; nodes: how many each class has open."""
    width, slots = int(step.first[-1]), out.context.defaultParallelism
    per, left = max(1, BLOCK_CELLS // width), parts
    if 16 * parts * width * sum(nodes) <= SMALL:
        whole: dict[tuple, np.ndarray] = {}
        for (k, block, _), data in out.collect():
            whole[k, block] = whole[k, block] + data if (k, block) in whole else data
        done = [_found(step)(((*kb, 0), data)) for kb, data in whole.items()]
    else:
        blocks = 1 + sum(-(-n // per) for n in nodes)
        while True:
            left = -(-left // FAN_IN)
            out = out.reduceByKey(operator.add, max(1, min(blocks * left, slots)))
            if left == 1:
                break
            out = out.map(lambda kv: ((*kv[0][:2], kv[0][2] // FAN_IN), kv[1]))
        done = out.map(_found(step)).collect()
    found: dict[int, dict[int, np.ndarray]] = {}
    loss = math.nan
    for k, block, data in done:
        if k < 0:
            loss = float(data[0] / data[1])
        else:
            found.setdefault(k, {})[block] = data
    return {k: np.concatenate([v[b] for b in sorted(v)]) for k, v in found.items()}, loss


def _round(records: RDD, step: _Pass, max_depth: int, parts: int) -> tuple[list[Tree], float]:
    """(trees of a round, mean loss before it)."""
    trees, loss = [Tree() for _ in range(step.n_classes)], math.nan
    if parts == 1:
        lanes = max(1, min(step.n_classes, records.context.defaultParallelism))
        copies = records.context.union([records] * lanes) if lanes > 1 else records      # partition k is lane k
        for k, found in copies.mapPartitions(_whole_round(step, max_depth, lanes)).collect():
            if k < 0:
                loss = found[0] / found[1]
            else:
                trees[k] = found
        return trees, loss
    open_ = [[0] for _ in trees]
    for depth in range(max(1, max_depth)):
        if not any(open_):
            break
        step.growing, step.open = trees, open_
        found, value = _splits(records, step, parts)
        loss = value if depth == 0 else loss
        open_ = _grow(trees, open_, found, depth, max_depth, step.p)
    return trees, loss


def _one_tree(rows: RDD, step: _Level, max_depth: int, parts: int) -> tuple[Tree, float]:
    """(tree of a round over persisted rows, mean loss before it)."""
    tree, loss, open_, aside = step.tree, math.nan, [0], {}
    held, share = {0: math.inf}, {0: 1.0}              # rows of a node and its sibling; about the node's own
    for depth in range(max(1, max_depth)):
        if max_depth - depth >= LOCAL_LEVELS:
            aside.update({at: depth for at in open_ if held[at] <= LOCAL_ROWS})
            open_ = [at for at in open_ if at not in aside]
        if not open_:
            break
        step.open = open_
        found, value = _merged(rows.mapPartitions(_level_sums(step)), step, [len(open_)], parts)
        loss = value if depth == 0 else loss
        before, (open_,) = open_, _grow([tree], [open_], found, depth, max_depth, step.p)
        for at, (won, _, _, _, lh, _, h, n) in zip(before, found.get(0, ())):
            if tree.feature[at] >= 0:
                left, right = tree.left[at], tree.right[at]
                held[left] = held[right] = n
                share[left], share[right] = n * lh / h, n - n * lh / h
    if aside:
        groups = max(-(-int(sum(share[at] for at in aside)) // LOCAL_ROWS) if LOCAL_ROWS else 1, min(len(aside), 2 * rows.context.defaultParallelism))
        load, bucket = [(0.0, b) for b in range(groups)], np.full(len(tree.feature), -1, np.int32)
        for at in sorted(aside, key=lambda at: -share[at]):      # the next largest node to the group with the fewest rows
            n, b = heapq.heappop(load)
            bucket[at] = b
            heapq.heappush(load, (n + share[at], b))
        if groups < 1 << 15:
            bucket = bucket.astype(np.int16)
        for nodes, sub in sorted(rows.mapPartitions(_dealt(step, bucket)).partitionBy(groups).mapPartitions(_subtrees(step, aside, max_depth)).collect(),
                                 key=lambda x: x[0]):
            _graft(tree, nodes, sub)
    return tree, loss


def _boost_one(records: RDD, loss: str, first: np.ndarray, rounds: int, max_depth: int, p: dict, parts: int) -> tuple[list[list[Tree]], list[float]]:
    """(trees by round, losses) of one score per row, over landed records of several tasks."""
    tasks = min(parts, max(records.context.defaultParallelism, parts * ROWS_PER_TASK // TASK_ROWS))
    rows, tree, before = records.map(_narrow(first)).coalesce(tasks), None, None
    done, losses = [], []
    for r in range(rounds):
        rows = rows.mapPartitions(_advanced(tree, r, p)).persist(StorageLevel.MEMORY_AND_DISK)
        if r % LINEAGE == LINEAGE - 1:
            rows.checkpoint()
        tree, value = _one_tree(rows, _Level(loss, first, Tree(), [], r, p), max_depth, tasks)
        if before is not None:
            before.unpersist()
        before = rows
        done.append([tree])
        losses.append(value)
    if before is not None:
        before.unpersist()
    return done, losses


def _refreshed(recent: list[list[Tree]], k: int):
    def run(batches):
        step = _Pass(None, k, None, recent, None, None, 0, None, None)
        for b in batches:
            for uid, bins, y, base in _rows(zip(*(c.to_pylist() for c in b.columns)), k):
                yield _packed(uid, bins, y, step.scores(bins, base))

    return run


_STATE = "n int, uid binary, bins binary, label binary, scores binary"


def _landed(rows: DataFrame, points: list[np.ndarray], n_classes: int, base: float, parts: int) -> DataFrame:
    """Binned rows with a number of their own and their first scores, packed."""

    most = max(1, min(BATCH, RECORD_SCORES // n_classes))

    def record(held):
        uid, x, y = (np.concatenate(v) for v in zip(*held))
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(points)], 1)
        return _packed(uid, bins, y, np.full((len(uid), n_classes), base))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                b = batch.slice(a, most)
                if n + b.num_rows > most:
                    yield record(held)
                    held, n = [], 0
                held.append((b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(2).to_numpy()))
                n += b.num_rows
        if held:
            yield record(held)

    numbered = rows.repartition(parts).select(F.monotonically_increasing_id().alias("uid"), "x", "label")
    return cut(numbered.mapInArrow(run, _STATE))


def boost(rows: DataFrame, loss: str, n_classes: int = 1, rounds: int = 100, learning_rate: float = 0.3, max_depth: int = 6,
          reg_lambda: float = 1.0, reg_alpha: float = 0.0, gamma: float = 0.0, min_child_weight: float = 1.0, subsample: float = 1.0,
          colsample: float = 1.0, max_bins: int = 255, base_score: float = 0.5, seed: int = 42) -> tuple[list[list[Tree]], list[float]]:
    """(trees by round and class, with thresholds; mean training loss before each round) over (x array<double>, label double).

    ``n_classes`` is the number of scores: 1 for logistic and squared loss. ``base_score`` is the first
    prediction: a probability for logistic loss.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}")
    p = {"learning_rate": learning_rate, "reg_lambda": reg_lambda, "reg_alpha": reg_alpha, "gamma": gamma, "min_child_weight": min_child_weight,
         "subsample": subsample, "colsample": colsample, "seed": seed}
    rows = rows.select("x", F.col("label").cast("double").alias("label"))
    n = rows.count()
    if not n:
        raise ValueError("no training rows")
    n_features = rows.select(F.size("x")).first()[0]
    points = cut_points(rows, n_features, max_bins)
    first = np.append(0, np.cumsum([len(c) + 1 for c in points]))
    parts = max(1, n // ROWS_PER_TASK)
    base = math.log(base_score / (1 - base_score)) if loss == "logistic" else base_score
    state = _landed(rows, points, n_classes, base, parts)
    done: list[list[Tree]] = []
    fresh: list[list[Tree]] = []
    losses: list[float] = []
    records = state.rdd.map(tuple)
    if n_classes == 1 and parts > 1:
        done, losses = _boost_one(records, loss, first, rounds, max_depth, p, parts)
    for r in range(0 if done else rounds):
        trees, value = _round(records, _Pass(loss, n_classes, first, fresh, None, None, r, p, None), max_depth, parts)
        losses.append(value)
        fresh.append(trees)
        done.append(trees)
        if len(fresh) == REFRESH and r < rounds - 1:
            state, fresh = cut(state.mapInArrow(_refreshed(fresh, n_classes), _STATE)), []
            records = state.rdd.map(tuple)
    for trees in done:
        for t in trees:
            t.bin = [float(points[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin)]
    return done, losses


def tree_table(spark, trees: list[list[Tree]]) -> DataFrame:
    rows = [(r, k, i, t.feature[i], t.bin[i], t.left[i], t.right[i], t.value[i])
            for r, ts in enumerate(trees) for k, t in enumerate(ts) for i in range(len(t.feature))]
    pdf = pd.DataFrame(rows, columns=["round", "class", "node", "feature", "threshold", "left", "right", "value"])
    return spark.createDataFrame(pdf.astype({"round": "int32", "class": "int32", "node": "int32", "feature": "int32", "left": "int32", "right": "int32"}), TREES)


def trees_of(table: DataFrame) -> list[list[Tree]]:
    out: list[list[Tree]] = []
    for (r, k), g in table.toPandas().sort_values(["round", "class", "node"]).groupby(["round", "class"], sort=True):
        t = Tree()
        t.feature, t.bin, t.left, t.right, t.value = (g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value"))
        while len(out) <= r:
            out.append([])
        out[r].append(t)
    return out


def add_scores(rows: DataFrame, trees: list[list[Tree]], x_col: str, n_classes: int, base: float, out_col: str) -> DataFrame:
    """rows and their scores (array<double>) by all trees; one pass, the trees are broadcast (they are the model)."""
    names = rows.columns
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            n = b.num_rows
            x = b.column(b.schema.get_field_index(x_col)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
            s = np.full((n, n_classes), base)
            for ts in shared.value if n else ():
                for k, t in enumerate(ts):
                    s[:, k] += t.score(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n_classes, pa.int32()), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], lists], [*names, out_col])

    schema = rows.withColumn(out_col, F.lit(None).cast("array<double>")).schema
    return rows.mapInArrow(run, schema)


class GradientBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Spark ML estimator over :func:`boost`. Loss ``auto``: squared for ``regression``, else logistic for two classes
    and softmax for more."""

    task = Param(Params._dummy(), "task", "classification or regression", typeConverter=TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth of a tree", typeConverter=TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature at most", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage", typeConverter=TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "quadratic penalty of leaf values", typeConverter=TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "absolute penalty of leaf values", typeConverter=TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "least gain of a split", typeConverter=TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian mass of a child", typeConverter=TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of rows per round", typeConverter=TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "share of features per tree", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", task="classification", rounds=100, maxDepth=6,
                 maxBins=255, seed=42, learningRate=0.1, regLambda=1.0, regAlpha=0.0, gamma=0.0, minChildWeight=1.0, subsample=1.0, colsample=1.0):
        super().__init__()
        self._setDefault(task="classification", rounds=100, maxDepth=6, maxBins=255, seed=42, learningRate=0.1, regLambda=1.0, regAlpha=0.0,
                         gamma=0.0, minChildWeight=1.0, subsample=1.0, colsample=1.0)
        self._set(**self._input_kwargs)

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setPredictionCol(self, v):
        return self._set(predictionCol=v)

    def _fit(self, df: DataFrame) -> "GradientBoostingModel":
        get = self.getOrDefault
        rows = cut(df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("label")))
        top = rows.agg(F.max("label")).first()[0]
        if top is None:
            raise ValueError("no training rows")
        loss = "squared" if get(self.task) == "regression" else "logistic" if top < 2 else "softmax"
        k = int(top) + 1 if loss == "softmax" else 1
        trees, losses = boost(rows, loss, k, get(self.rounds), get(self.learningRate), get(self.maxDepth), get(self.regLambda), get(self.regAlpha),
                              get(self.gamma), get(self.minChildWeight), get(self.subsample), get(self.colsample), get(self.maxBins), 0.5,
                              get(self.seed))
        path = shared_path(df.sparkSession, f"boosters/{uuid.uuid4().hex}")
        tree_table(df.sparkSession, trees).write.parquet(path)
        model = GradientBoostingModel(path, loss, k)
        model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        model.losses = losses
        return model


class _BoostWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.table().write.parquet(f"{path}/trees")


class _BoostReader(DefaultParamsReader):
    def load(self, path: str):
        return super().load(path)._set(treesPath=f"{path}/trees")


class GradientBoostingModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The trees live in a table; ``treesPath`` is its folder. ``losses``: mean training loss before each round (after a fit)."""

    treesPath = Param(Params._dummy(), "treesPath", "folder of the tree table", typeConverter=TypeConverters.toString)
    loss = Param(Params._dummy(), "loss", "loss that was fitted", typeConverter=TypeConverters.toString)
    numScores = Param(Params._dummy(), "numScores", "scores of a row", typeConverter=TypeConverters.toInt)
    losses: list[float] = []

    def __init__(self, path: str | None = None, loss: str | None = None, k: int | None = None):
        super().__init__()
        if path is not None:
            self._set(treesPath=path, loss=loss, numScores=k)

    def write(self):
        return _BoostWriter(self)

    @classmethod
    def read(cls):
        return _BoostReader(cls)

    def table(self) -> DataFrame:
        from pyspark.sql import SparkSession

        return (SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()).read.parquet(self.getOrDefault(self.treesPath))

    def _transform(self, df: DataFrame) -> DataFrame:
        x = df.withColumn("_boost_x", vector_to_array(F.col(self.getFeaturesCol())))
        arrays = x.select(*[vector_to_array(F.col(c)).alias(c) if kind == "vector" else F.col(c) for c, kind in x.dtypes])
        loss = self.getOrDefault(self.loss)
        out = add_scores(arrays, trees_of(self.table()), "_boost_x", self.getOrDefault(self.numScores), 0.0 if loss == "logistic" else 0.5, "_boost_s")
        s = F.col("_boost_s")
        rounded = F.transform(s, lambda v: F.round(v, 9))
        pred = (s[0] if loss == "squared" else (s[0] > 0).cast("double") if loss == "logistic"
                else (F.array_position(rounded, F.array_max(rounded)) - 1).cast("double"))
        return out.withColumn(self.getPredictionCol(), pred).drop("_boost_x", "_boost_s")
