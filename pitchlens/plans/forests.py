"""Random forests of any depth: best splits over binned features, Poisson bootstrap, nodes in a table.

Nodes with more than ``LOCAL_ROWS`` rows are settled for a block of trees at once, a level per pass: tasks add up
class counts (or sums of the target) by (tree, node, feature bin), partial sums merge by node, and the driver gets
splits. The rows of smaller nodes are then dealt out once, packed, to groups of about that size, and each group
grows its nodes to the end where it is. A row's weight in a tree and the features that a node tries come from
keyed hashes, so both ways of growing give the same trees.

Predictions of a small forest send its nodes to all tasks. Of a larger one the driver and all tasks get the nodes of many rows
alone; below these, rows (as bins) and nodes are dealt to buckets of subtrees, and the votes of a row are added up.
"""

from __future__ import annotations

import functools
import math
import operator
import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_path
from .boosting import _landed, _rows, cut_points
from .trees import PRIME, draw

LOCAL_ROWS = 1 << 17
ROWS_PER_TASK = 50_000
CELLS = 1 << 22          # (node, feature bin) cells that a task of the upper levels holds; more nodes take more passes
TASK_ROWS = 1 << 20      # rows that a task of a pass reads at most (where a cluster has few slots)
TABLE = 1 << 20          # counts up to which logarithms come from a table
SORTED = 4               # cells per row beyond which a level of small nodes is counted by sorting
MODEL_NODES = 1 << 21    # nodes of trees that are sent to all tasks for predictions; of larger forests rows and nodes meet in buckets
BUCKET_NODES = 1 << 18   # nodes of a bucket, about
VOTE_CELLS = 1 << 22     # sums of votes that a task holds before it passes them on
NODES = "tree int, node long, feature int, threshold double, n long, gain double, value array<double>"


def weights(uid: np.ndarray, tree: int, p: dict) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with replacement, 0 or 1 without."""
    if not p["bootstrap"] and p["subsample"] >= 1:
        return np.ones(len(uid), np.int64)
    u = (draw(p["seed"], 7, tree, uid % PRIME, (uid // PRIME) % PRIME) + 0.5) / PRIME
    if not p["bootstrap"]:
        return (u < p["subsample"]).astype(np.int64)
    steps = np.cumsum([math.exp(-p["subsample"]) * p["subsample"] ** k / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, u)


def allowed(tree: np.ndarray, node: np.ndarray, n_features: int, p: dict) -> np.ndarray:
    """(nodes, features) mask of the features that each node tries."""
    if p["tried"] >= n_features:
        return np.ones((len(node), n_features), bool)
    order = draw(p["seed"], 8, tree[:, None], node[:, None], np.arange(n_features))
    mask = np.zeros((len(node), n_features), bool)
    np.put_along_axis(mask, np.argsort(order, axis=1, kind="stable")[:, :p["tried"]], True, axis=1)
    return mask


def stats(y: np.ndarray, w: np.ndarray, n_classes: int) -> np.ndarray:
    """(statistics, rows): weighted class counts, or weight and weighted sums of the target and its square."""
    if n_classes:
        return w * (y.astype(np.int64) == np.arange(n_classes)[:, None]).astype(float)
    return np.stack([w, w * y, w * y * y]).astype(float)


def counted(key: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, n_classes: int) -> np.ndarray:
    """(statistics, n): ``stats`` added up by key; of classes all at once."""
    if n_classes:
        return np.bincount(key * n_classes + y, w, n * n_classes).reshape(n, n_classes).T
    return np.stack([np.bincount(key, v, n) for v in stats(y, w, 0)])


def impurity(s: np.ndarray, p: dict) -> np.ndarray:
    """Rows times impurity from statistics (statistics first)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if not p["classes"]:
            return np.where(s[0] > 0, np.maximum(s[2] - s[1] * s[1] / s[0], 0.0), 0.0)
        n = s.sum(axis=0)
        if p["impurity"] == "gini":
            return np.where(n > 0, n - (s * s).sum(axis=0) / n, 0.0)
        return -np.where(s > 0, s * np.log2(s / n), 0.0).sum(axis=0)


def size(s: np.ndarray, p: dict) -> np.ndarray:
    return s.sum(axis=0) if p["classes"] else s[0]


@functools.lru_cache
def _logarithms(bits: int) -> np.ndarray:
    v = np.arange(1 << bits)
    return v * np.log2(np.maximum(v, 1))


def _xlogx(top: float):
    """v -> v log2 v of counts up to ``top``; by a table where it is short."""
    if top >= TABLE:
        return lambda v: np.where(v > 0, v * np.log2(np.maximum(v, 1.0)), 0.0)
    table = _logarithms(int(top).bit_length())
    return lambda v: table.take(v.astype(np.int64))


def gains(left: np.ndarray, total: np.ndarray, ok: np.ndarray, p: dict) -> np.ndarray:
    """Fall of rows times impurity; -inf where it is not ok or a side has too few rows. ``left``, ``total``: statistics first."""
    n_left, n_all = size(left, p), size(total, p)
    ok = ok & (n_left >= p["min_leaf"]) & (n_all - n_left >= p["min_leaf"])
    with np.errstate(divide="ignore", invalid="ignore"):
        if not p["classes"]:
            rest = total[1] - left[1]
            out = left[1] * left[1] / n_left + rest * rest / (n_all - n_left) - total[1] * total[1] / n_all
        elif p["impurity"] == "gini":
            out = impurity(total, p) - impurity(left, p) - impurity(total - left, p)
        else:
            x = _xlogx(n_all.max(initial=0))
            side = lambda s, n: x(n) - sum(x(c) for c in s)
            out = side(total, n_all) - side(left, n_left) - side(total - left, n_all - n_left)
    return np.where(ok, out, -np.inf)


def best(cells: Iterable[tuple], total: np.ndarray, ok: np.ndarray, p: dict) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin) of every node; -1 without a split. ``cells``: per feature statistics by (node, bin), or the node, bin
    and statistics of the cells that occur, by node and bin. Of equal gains the first feature and bin wins."""
    n = total.shape[1]
    won, feature, bin_ = np.full(n, 1e-9), np.full(n, -1), np.zeros(n, np.int64)
    for f, node, b, s in cells:
        if node is None:
            g = np.round(gains(np.cumsum(s, axis=2), total[:, :, None], ok[:, f][:, None], p), 7)
            b = g.argmax(axis=1)
            top = g[np.arange(n), b]
            better = np.flatnonzero(top > won)
            won[better], feature[better], bin_[better] = top[better], f, b[better]
            continue
        run = np.cumsum(s, axis=1)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])[:len(node)])
        before = np.where(first > 0, run[:, first - 1], 0.0)
        left = run - np.repeat(before, np.diff(np.append(first, len(node))), axis=1)
        g = np.round(gains(left, total[:, node], ok[node, f], p), 7)
        top = np.maximum.reduceat(g, first) if len(first) else np.zeros(0)
        at = np.flatnonzero(g == np.repeat(top, np.diff(np.append(first, len(node)))))
        at = at[np.append(True, node[at][1:] != node[at][:-1])[:len(at)]]         # the first bin of the best ones
        better = at[g[at] > won[node[at]]]
        won[node[better]], feature[node[better]], bin_[node[better]] = g[better], f, b[better]
    return np.where(feature >= 0, won, 0.0), feature, bin_


def _added(bins: np.ndarray, at: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, k: int, n_classes: int) -> Iterator[np.ndarray]:
    """Per feature the statistics by (node, bin) of rows (bins by feature); of the target's: weight and weighted sum."""
    key, each = np.empty(len(at), np.int64), n_classes or 1
    start = at * (k * each) + (y if n_classes else 0)
    sums = (w,) if n_classes else (w, w * y)
    for column in bins:
        np.multiply(column, each, out=key, casting="unsafe", dtype=np.int64)
        key += start
        s = [np.bincount(key, v, n * k * each).reshape(n, k, each) for v in sums]
        yield np.moveaxis(s[0], 2, 0) if n_classes else np.stack([v[:, :, 0] for v in s])


def _cells(bins: np.ndarray, at: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, width: np.ndarray, p: dict) -> Iterator[tuple]:
    """Cells of ``best`` from rows (bins by feature): counted densely, or by sorting where nodes are many and small."""
    k = int(width.max())
    if n * k <= SORTED * len(at):
        yield from ((f, None, None, s) for f, s in enumerate(_added(bins, at, y, w, n, k, p["classes"])))
        return
    s = stats(y, w, p["classes"])[:p["classes"] or 2]
    for f in range(len(width)):
        key = at * k + bins[f]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        yield f, *np.divmod(key[first], k), np.add.reduceat(s[:, order], first, axis=1)


def _open(tree, node, total, p) -> np.ndarray:
    level = np.floor(np.log2(node.astype(float))).astype(int)
    return (level < p["max_depth"]) & (size(total, p) >= 2 * p["min_leaf"]) & (impurity(total, p) > 1e-9)


def _value(total: np.ndarray, p: dict) -> np.ndarray:
    return total.T if p["classes"] else (total[1] / total[0])[:, None]


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, tree: np.ndarray, node: np.ndarray, width: np.ndarray, p: dict) -> Iterator[tuple]:
    """Levels of nodes (arrays: tree, node, feature, bin, n, gain, value) of all (tree, node) groups of rows (bins by feature), grown to the end."""
    _, at, group = np.unique(tree * (1 << 40) + node, return_index=True, return_inverse=True)
    t, v, y, w = tree[at], node[at], y.astype(np.int64) if p["classes"] else y, w.astype(float)
    while len(y):
        total = counted(group, y, w, len(t), p["classes"])
        go = _open(t, v, total, p)
        place = np.cumsum(go) - 1
        won, feature, bin_ = np.zeros(len(t)), np.full(len(t), -1), np.zeros(len(t), np.int64)
        if go.any():
            if not go.all():
                mine = np.flatnonzero(go[group])
                bins, y, w, group = bins[:, mine], y[mine], w[mine], group[mine]
            won[go], feature[go], bin_[go] = best(_cells(bins, place[group], y, w, int(go.sum()), width, p), total[:, go],
                                                  allowed(t[go], v[go], len(bins), p), p)
        yield t, v, feature, bin_, size(total, p).astype(np.int64), won, _value(total, p)
        on = np.flatnonzero(feature[group] >= 0)
        if len(on) < len(group):
            bins, y, w, group = bins[:, on], y[on], w[on], group[on]
        right = bins[feature[group], np.arange(len(group))] > bin_[group]
        split = np.flatnonzero(feature >= 0)
        t, v = np.repeat(t[split], 2), np.repeat(2 * v[split], 2) + np.tile([0, 1], len(split))
        group = 2 * (np.cumsum(feature >= 0) - 1)[group] + right


def _steps(x: np.ndarray, at: np.ndarray, feature: np.ndarray, cuts: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Places that rows (x by feature) end at, from their places; children follow each other, rows go left up to the cut."""
    leaf, own = feature < 0, np.arange(len(feature))
    column, flat = np.where(leaf, 0, feature) * x.shape[1], x.ravel()
    nxt, first = np.stack([np.where(leaf, own, child + 1), np.where(leaf, own, child)], 1).ravel(), np.arange(x.shape[1])
    while True:
        if leaf.take(at).all():
            return at
        here = column.take(at)
        here += first
        at = nxt.take(2 * at + (flat.take(here) <= cuts.take(at)))


class _Upper:
    """Splits of the nodes settled so far, by tree: places of children follow each other."""

    def __init__(self, trees: range):
        self.trees = list(trees)
        self.tree, self.node = np.array(self.trees), np.ones(len(self.trees), np.int64)
        self.feature, self.bin, self.child = np.full(len(self.trees), -1), np.zeros(len(self.trees), np.int64), np.zeros(len(self.trees), np.int64)

    def split(self, at: np.ndarray, feature: np.ndarray, bin_: np.ndarray) -> np.ndarray:
        first = len(self.tree) + 2 * np.arange(len(at))
        self.feature[at], self.bin[at], self.child[at] = feature, bin_, first
        self.tree = np.append(self.tree, np.repeat(self.tree[at], 2))
        self.node = np.append(self.node, np.repeat(2 * self.node[at], 2) + np.tile([0, 1], len(at)))
        for name, v in (("feature", -1), ("bin", 0), ("child", 0)):
            setattr(self, name, np.append(getattr(self, name), np.full(2 * len(at), v)))
        return np.arange(len(self.tree) - 2 * len(at), len(self.tree))

    def walk(self, bins: np.ndarray, root: int) -> np.ndarray:
        return _steps(bins, np.full(bins.shape[1], root), self.feature, self.bin.astype(bins.dtype), self.child)


def _narrow(width: np.ndarray):
    """Landed record -> (uid, bins by feature in as few bytes as hold them, label)."""
    kind = np.uint8 if width.max() <= 256 else np.int16

    def run(record):
        return next((uid, bins.T.astype(kind), y) for uid, bins, y, _ in _rows([record], 1))

    return run


def _sums(upper: _Upper, slot: np.ndarray, n: int, width: np.ndarray, p: dict):
    """Rows -> (node's slot, statistics by feature bin) of the wanted nodes (slot >= 0); squares of targets with the first feature alone."""

    def run(rows):
        first, k = np.append(0, np.cumsum(width)), int(width.max())
        held = np.zeros((3 if not p["classes"] else p["classes"], n, first[-1]))
        for uid, bins, y in rows:
            y = y.astype(np.int64) if p["classes"] else y
            for root, tree in enumerate(upper.trees):
                w = weights(uid, tree, p)
                at = slot[upper.walk(bins, root)]
                some = np.flatnonzero((at >= 0) & (w > 0))
                if not len(some):
                    continue
                here, label, times, at = bins[:, some], y[some], w[some].astype(float), at[some]
                for f, s in enumerate(_added(here, at, label, times, n, k, p["classes"])):
                    held[:len(s), :, first[f]:first[f + 1]] += s[:, :, :width[f]]
                if not p["classes"]:
                    held[2, :, :width[0]] += np.bincount(at * k + here[0], times * label * label, n * k).reshape(n, k)[:, :width[0]]
        for k in range(n):
            yield k, held[:, k]

    return run


def _settled(upper: _Upper, places: np.ndarray, width: np.ndarray, p: dict):
    """(slot, statistics) -> (place, rows, gain, feature, bin, rows left, rows right, value) of a node of the upper levels."""

    def run(kv):
        place, sums = places[kv[0]], kv[1]
        total = sums[:, :width[0]].sum(axis=1)[:, None]
        tree, node = upper.tree[[place]], upper.node[[place]]
        won, feature, bin_ = np.zeros(1), np.full(1, -1), np.zeros(1, np.int64)
        first = np.append(0, np.cumsum(width))
        if _open(tree, node, total, p)[0]:
            cells = [(f, None, None, sums[:, None, first[f]:first[f + 1]]) for f in range(len(width))]
            won, feature, bin_ = best(cells, total, allowed(tree, node, len(width), p), p)
        n = int(size(total, p)[0])
        f = int(feature[0])
        left = int(size(sums[:, first[f]:first[f] + bin_[0] + 1].sum(axis=1)[:, None], p)[0]) if f >= 0 else 0
        return int(place), n, float(won[0]), f, int(bin_[0]), left, n - left, _value(total, p)[0].tolist() if n else []

    return run


def _dealt(upper: _Upper, bucket: np.ndarray, p: dict):
    """Rows of nodes that are grown locally: (bucket, packed rows)."""

    def run(rows):
        task = TaskContext.get().partitionId()
        for record, (uid, bins, y) in enumerate(rows):
            y = y.astype(np.int16 if p["classes"] < 1 << 15 else np.int32) if p["classes"] else y
            for root, tree in enumerate(upper.trees):
                w, at = weights(uid, tree, p), upper.walk(bins, root)
                b = np.where(w > 0, bucket[at], -1)
                b = b.astype(np.int16) if bucket.max() < 1 << 15 else b
                order = np.argsort(b, kind="stable")
                order = order[np.searchsorted(b[order], 0):]
                kinds, first = np.unique(b[order], return_index=True)
                for k, some in zip(kinds.tolist(), np.split(order, first[1:])):
                    yield k, ((tree, task, record), at[some].astype(np.int32), w[some].astype(np.int8), y[some], bins[:, some])

    return run


def _finished(upper: _Upper, width: np.ndarray, points: list[np.ndarray], p: dict):
    """(bucket, packed rows) -> packed levels of nodes."""

    def run(kv):
        held: dict[int, list] = {}
        for b, part in kv:
            held.setdefault(b, []).append(part)
        cuts, first = np.concatenate([*points, [0.0]]), np.append(0, np.cumsum(width - 1))
        for b in sorted(held):
            parts = sorted(held.pop(b), key=lambda x: x[0])
            place, w, y, bins = (np.concatenate([x[k] for x in parts], axis=-1) for k in (1, 2, 3, 4))
            for t, v, f, bin_, n, won, value in grow(bins, y, w, upper.tree[place], upper.node[place], width, p):
                threshold = np.where(f >= 0, cuts[np.where(f >= 0, first[f] + bin_, 0)], 0.0)
                yield (pickle.dumps((t.astype(np.int32), v, f.astype(np.int32), threshold, n, won, np.ascontiguousarray(value, float)), 5),)

    return run


def _unpacked(batches):
    """Packed levels of nodes -> rows of ``NODES``."""
    for batch in batches:
        for level in batch.column(0).to_pylist():
            *columns, value = pickle.loads(level)
            n, k = value.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(value.ravel()))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["tree", "node", "feature", "threshold", "n", "gain", "value"])


def _node(x: tuple, points: list[np.ndarray]) -> tuple:
    t, v, f, b, n, won, value = x
    return t, v, f, float(points[f][b]) if f >= 0 else 0.0, n, won, value


def forest(rows: DataFrame, n_classes: int, n_trees: int, max_depth: int, tried: int, impurity_: str = "gini", min_leaf: int = 1,
           bootstrap: bool = True, subsample: float = 1.0, seed: int = 42, max_bins: int = 32) -> DataFrame:
    """Table of all nodes (``NODES``; feature -1: a leaf) over (x array<double>, label double); ``n_classes`` 0: regression."""
    spark = rows.sparkSession
    rows = rows.select("x", F.col("label").cast("double").alias("label"))
    n_rows = rows.count()
    if not n_rows:
        raise ValueError("no training rows")
    points = cut_points(rows, rows.select(F.size("x")).first()[0], max_bins)
    width = np.array([len(c) + 1 for c in points])
    p = {"classes": n_classes, "max_depth": max_depth, "tried": tried, "impurity": impurity_, "min_leaf": max(1, min_leaf), "bootstrap": bootstrap,
         "subsample": subsample, "seed": seed}
    parts = max(1, n_rows // ROWS_PER_TASK)
    landed = _landed(rows, points, 1, 0.0, parts).rdd.map(tuple).map(_narrow(width))
    slots = spark.sparkContext.defaultParallelism
    records = landed.coalesce(min(parts, max(slots, n_rows // TASK_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
    most = max(1, CELLS // (int(width.sum()) * (n_classes or 3)))               # nodes of a pass
    step = max(1, most // max(1, 2 * n_rows // LOCAL_ROWS))
    blocks = [_block(spark, records, n_rows, range(a, min(a + step, n_trees)), width, points, p, most) for a in range(0, n_trees, step)]
    records.unpersist()
    out = blocks[0]
    for x in blocks[1:]:
        out = out.unionByName(x)
    return out


def _block(spark, records: RDD, n_rows: int, trees: range, width: np.ndarray, points: list[np.ndarray], p: dict, most: int) -> DataFrame:
    slots = records.context.defaultParallelism
    upper, n_of = _Upper(trees), {k: n_rows for k in range(len(trees))}
    todo, done = np.arange(len(trees)), []
    while len(todo := np.array([k for k in todo.tolist() if n_of[k] > LOCAL_ROWS], np.int64)):
        found = []
        for a in range(0, len(todo), most):
            places = todo[a:a + most]
            slot = np.full(len(upper.tree), -1)
            slot[places] = np.arange(len(places))
            found += (records.mapPartitions(_sums(upper, slot, len(places), width, p)).reduceByKey(operator.add, max(1, min(len(places), slots)))
                      .map(_settled(upper, places, width, p)).collect())
        found.sort()
        done += [_node((int(upper.tree[k]), int(upper.node[k]), f, b, n, won, value), points) for k, n, won, f, b, _, _, value in found if n]
        split = [x for x in found if x[3] >= 0]
        todo = upper.split(np.array([x[0] for x in split], np.int64), np.array([x[3] for x in split], np.int64), np.array([x[4] for x in split], np.int64))
        n_of.update(zip(todo.tolist(), [n for x in split for n in x[5:7]]))
    top = spark.createDataFrame(done, NODES)
    settled = {(t, v) for t, v, *_ in done}
    small = [k for k in range(len(upper.tree)) if upper.feature[k] < 0 and (int(upper.tree[k]), int(upper.node[k])) not in settled]
    if not small:
        return cut(top)
    bucket = np.full(len(upper.tree), -1)
    bucket[small] = np.cumsum([n_of[k] for k in small]) // LOCAL_ROWS
    lanes = max(1, min(int(bucket.max()) + 1, 8 * slots))
    grown = records.mapPartitions(_dealt(upper, bucket, p)).partitionBy(lanes).mapPartitions(_finished(upper, width, points, p))
    return cut(spark.createDataFrame(grown, "nodes binary", verifySchema=False)).mapInArrow(_unpacked, NODES).unionByName(top)


class Trees:
    """Nodes of some trees as arrays: children by place (the right one follows the left one)."""

    def __init__(self, nodes: pa.Table):
        tree, node = nodes["tree"].to_numpy().astype(np.int64), nodes["node"].to_numpy()
        order = np.lexsort((node, tree))
        tree, node = tree[order], node[order]
        self.feature, self.threshold = nodes["feature"].to_numpy()[order], nodes["threshold"].to_numpy()[order]
        values = nodes["value"].combine_chunks()
        self.value = values.flatten().to_numpy().reshape(len(tree), -1)[order]
        key, split = tree * (1 << 40) + node, self.feature >= 0
        self.left = np.arange(len(tree))
        self.left[split] = np.searchsorted(key, (tree * (1 << 40) + 2 * node)[split])
        self.roots = np.flatnonzero(node == 1)

    def leaf_values(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for root in self.roots.tolist():
            at, rows = np.full(len(x), root), np.arange(len(x))
            while len(rows):
                rows = rows[self.feature[at[rows]] >= 0]
                here = at[rows]
                at[rows] = self.left[here] + (x[rows, self.feature[here]] > self.threshold[here])
            yield self.value[at]


def votes(rows: DataFrame, nodes: DataFrame, x_col: str, n_classes: int, out_col: str) -> DataFrame:
    """rows and the sums over trees (array<double>) of class shares or means."""
    spark, names, width = rows.sparkSession, rows.columns, n_classes or 1
    if nodes.count() > MODEL_NODES:
        return _met(rows, nodes, x_col, n_classes, out_col)
    shared = spark.sparkContext.broadcast(Trees(nodes.select("tree", "node", "feature", "threshold", "value").toArrow()))

    def voted(batches):
        model = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            model = model or shared.value
            x = b.column(b.schema.get_field_index(x_col)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            s = np.zeros((n, width))
            for v in model.leaf_values(x):
                s += v / v.sum(axis=1, keepdims=True) if n_classes else v
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*names, out_col])

    return rows.mapInArrow(voted, rows.withColumn(out_col, F.lit(None).cast("array<double>")).schema)


class _Crown:
    """The nodes of many rows of all trees, and the roots of the subtrees below them (``bucket`` >= 0), by place."""

    def __init__(self, upper: pa.Table, limit: int, n_classes: int):
        tree, node = upper["tree"].to_numpy().astype(np.int64), upper["node"].to_numpy()
        order = np.lexsort((node, tree))
        tree, node, n = tree[order], node[order], upper["n"].to_numpy()[order]
        feature, threshold = upper["feature"].to_numpy()[order], upper["threshold"].to_numpy()[order]
        value = upper["value"].combine_chunks()
        value = value.flatten().to_numpy(zero_copy_only=False).reshape(len(tree), -1)[order]
        # Children come after all these nodes, two by two; those that are not among them are roots of subtrees.
        key, split = tree * (1 << 40) + node, np.flatnonzero(feature >= 0)
        child = np.repeat(tree[split], 2) * (1 << 40) + np.repeat(2 * node[split], 2) + np.tile([0, 1], len(split))
        at = np.searchsorted(key, child)
        known = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == child)
        roots = np.flatnonzero(node == 1)
        # Places: roots of trees, then pairs of children.
        self.n_trees, self.value = len(roots), np.zeros((len(roots) + len(child), value.shape[1]))
        self.feature, self.threshold = np.full(len(self.value), -1), np.zeros(len(self.value))
        self.child, self.bucket = np.zeros(len(self.value), np.int64), np.full(len(self.value), -1)
        place = np.full(len(key), -1)
        place[roots] = np.arange(len(roots))
        place[at[known]] = len(roots) + np.flatnonzero(known)
        self.feature[place], self.threshold[place], self.value[place] = feature, threshold, _shares(value, n_classes)
        self.child[place[split]] = len(roots) + 2 * np.arange(len(split))
        self.root = {int(t): k for k, t in enumerate(tree[roots])}
        below_ = len(roots) + np.flatnonzero(~known)
        rows = np.repeat(n[split], 2)[~known] / 2
        self.bucket[below_] = np.cumsum(rows) // limit

    def subtree(self, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Place of the subtree's root that each node is below of, -1 for nodes that are here."""
        roots = np.array(sorted(self.root))
        at = np.array([self.root[t] for t in roots.tolist()])[np.searchsorted(roots, tree)]
        for left in range(int(np.floor(np.log2(node.max()))) - 1 if len(node) else -1, -1, -1):
            on = (node >> left > 1) & (self.feature[at] >= 0)
            at = np.where(on, self.child[at] + (node >> left & 1), at)
        return np.where(self.bucket[at] >= 0, at, -1)


def _shares(value: np.ndarray, n_classes: int) -> np.ndarray:
    return value / value.sum(axis=1, keepdims=True) if n_classes else value


def _arrays(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Column of lists of one length as an array (rows, length)."""
    return batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _met(rows: DataFrame, nodes: DataFrame, x_col: str, n_classes: int, out_col: str) -> DataFrame:
    """``votes`` of a forest that is too large to be sent to all tasks."""
    spark, width, spare = rows.sparkSession, n_classes or 1, "_forest_row"
    sc = spark.sparkContext
    whole = max(2, int(nodes.where("node = 1").agg(F.max("n")).first()[0]))
    total = nodes.count()
    limit = max(1, min(whole // 2, whole * nodes.where("node = 1").count() * BUCKET_NODES // total))   # rows of subtrees of a bucket
    upper = nodes.where((F.col("n") > limit) | (F.col("node") == 1)).select("tree", "node", "feature", "threshold", "n", "value").toArrow()
    cuts: dict[int, list] = {}
    for f, t in nodes.where("feature >= 0").select("feature", "threshold").distinct().collect():
        cuts.setdefault(f, []).append(t)
    cuts = {f: np.sort(v) for f, v in cuts.items()}
    kind = np.uint8 if max(map(len, cuts.values()), default=0) < 256 else np.uint16 if max(map(len, cuts.values())) < 1 << 16 else np.int32
    crown = sc.broadcast(_Crown(upper, limit, n_classes))
    coded = lambda feature, threshold: _coded(cuts, feature, threshold, kind)
    tagged = cut(rows.withColumn(spare, F.monotonically_increasing_id()))
    n_buckets = int(crown.value.bucket.max(initial=-1)) + 1
    lanes = max(1, min(n_buckets, max(4 * sc.defaultParallelism, n_buckets // 8)))

    def routed(batches):
        top = crown.value
        threshold = coded(top.feature, top.threshold)
        for b in batches:
            if not b.num_rows:
                continue
            uid, x = b.column(0).to_numpy(), _arrays(b, 1)
            bins = np.stack([np.where(np.isnan(v), 0, np.searchsorted(cuts.get(f, np.zeros(0)), v, "left")) for f, v in enumerate(x.T)]).astype(kind)
            settled = np.zeros((len(x), width))
            for tree in range(top.n_trees):
                at = _steps(bins, np.full(len(x), tree), top.feature, threshold, top.child)
                where = top.bucket[at]
                settled += np.where((where < 0)[:, None], top.value[at], 0.0)
                order = np.argsort(where.astype(np.int32), kind="stable")
                order = order[np.searchsorted(where[order], 0):]
                kinds, first = np.unique(where[order], return_index=True)
                for k, some in zip(kinds.tolist(), np.split(order, first[1:]) if len(kinds) else ()):
                    yield k, pickle.dumps((int(uid[0]), len(uid), some.astype(np.int32), at[some].astype(np.int32), bins[:, some]), 5)
            yield n_buckets + int(uid[0]) % lanes, pickle.dumps((int(uid[0]), len(uid), settled), 5)

    def held(batches):
        top = crown.value
        for b in batches:
            tree, node, feature, threshold = (b.column(k).to_numpy() for k in range(4))
            at = top.subtree(tree.astype(np.int64), node)
            some = np.flatnonzero(at >= 0)
            values = _shares(_arrays(b, 4), n_classes)
            for k in np.unique(top.bucket[at[some]]).tolist():
                mine = some[top.bucket[at[some]] == k]
                yield k, pickle.dumps((at[mine], node[mine], feature[mine], coded(feature[mine], threshold[mine]), values[mine]), 5)

    def as_rows(make):
        def run(batches):
            for k, data in make(batches):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["bucket", "data"])

        return run

    def counted_(parts):
        """Buckets with their nodes and rows -> ((first row, rows), sums of votes)."""
        out, cells, buckets = {}, 0, {}
        for k, data in parts:
            buckets.setdefault(k, []).append(data)
        while buckets:
            _, packed = buckets.popitem()
            parts_nodes, parts_rows = [], []
            for data in map(pickle.loads, packed):
                (parts_rows if isinstance(data[0], int) else parts_nodes).append(data)
            trees = _Subtrees(parts_nodes) if parts_nodes else None
            for uid, n, *at in parts_rows:
                if (uid, n) not in out:
                    out[uid, n], cells = np.zeros((n, width)), cells + n * width
                if trees is None:                                     # settled among the upper nodes
                    out[uid, n] += at[0]
                else:
                    out[uid, n][at[0]] += trees.values(*at[1:])
                if cells > VOTE_CELLS:
                    yield from out.items()
                    out, cells = {}, 0
        yield from out.items()

    schema = "bucket int, data binary"
    from_rows = tagged.select(spare, x_col).mapInArrow(as_rows(routed), schema).rdd.map(tuple)
    from_nodes = nodes.select("tree", "node", "feature", "threshold", "value").mapInArrow(as_rows(held), schema).rdd.map(tuple)
    met = from_rows.union(from_nodes).partitionBy(lanes).mapPartitions(counted_)
    sums = met.reduceByKey(operator.add, lanes).map(lambda kv: (pickle.dumps((kv[0][0], kv[1]), 5),))

    def listed(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                uid, s = pickle.loads(data)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * width, pa.int32()), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(len(s))), lists], [spare, out_col])

    found = cut(spark.createDataFrame(sums, "data binary", verifySchema=False).mapInArrow(listed, f"{spare} long, {out_col} array<double>"))
    return tagged.join(found, spare).select(*[F.col(f"`{c}`") for c in rows.columns], out_col)


def _coded(cuts: dict[int, np.ndarray], feature: np.ndarray, threshold: np.ndarray, kind) -> np.ndarray:
    """Thresholds as places among those of their feature."""
    out = np.zeros(len(feature), kind)
    for f, c in cuts.items():
        mine = feature == f
        out[mine] = np.searchsorted(c, threshold[mine])
    return out


class _Subtrees:
    """Nodes of the subtrees of a bucket; rows start at the roots' places among the upper nodes."""

    def __init__(self, parts: list[tuple]):
        root, node, feature, self.cuts, self.value = (np.concatenate([x[k] for x in parts]) for k in range(5))
        order = np.lexsort((node, root))
        root, node, self.feature, self.cuts, self.value = root[order], node[order], feature[order].astype(np.int64), self.cuts[order], self.value[order]
        self.roots, self.first = np.unique(root, return_index=True)       # the root has the smallest number
        split, key = np.flatnonzero(self.feature >= 0), np.searchsorted(self.roots, root) * (1 << 40) + node
        self.child = np.zeros(len(node), np.int64)
        self.child[split] = np.searchsorted(key, key[split] + node[split])

    def values(self, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return self.value[_steps(bins, self.first[np.searchsorted(self.roots, at)], self.feature, self.cuts, self.child)]


class RandomForest(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Spark ML estimator over :func:`forest`, with the names of MLlib's forests. ``task``: classification or regression."""

    task = Param(Params._dummy(), "task", "classification or regression", typeConverter=TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth", typeConverter=TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature at most", typeConverter=TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features tried per node: auto, all, onethird, sqrt, log2, a share or a number",
                                  typeConverter=TypeConverters.toString)
    impurity = Param(Params._dummy(), "impurity", "gini or entropy; variance", typeConverter=TypeConverters.toString)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows of a node at least", typeConverter=TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "rows of a tree, as a share", typeConverter=TypeConverters.toFloat)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw rows with replacement", typeConverter=TypeConverters.toBoolean)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", task="classification", numTrees=20, maxDepth=5, maxBins=32,
                 featureSubsetStrategy="auto", impurity=None, minInstancesPerNode=1, subsamplingRate=1.0, bootstrap=True, seed=42):
        super().__init__()
        self._setDefault(task="classification", numTrees=20, maxDepth=5, maxBins=32, featureSubsetStrategy="auto", minInstancesPerNode=1,
                         subsamplingRate=1.0, bootstrap=True, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(impurity="variance" if self.getOrDefault(self.task) == "regression" else "gini")

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setPredictionCol(self, v):
        return self._set(predictionCol=v)

    def getNumTrees(self):
        return self.getOrDefault(self.numTrees)

    def getMaxDepth(self):
        return self.getOrDefault(self.maxDepth)

    def getFeatureSubsetStrategy(self):
        return self.getOrDefault(self.featureSubsetStrategy)

    def getImpurity(self):
        return self.getOrDefault(self.impurity)

    def getMinInstancesPerNode(self):
        return self.getOrDefault(self.minInstancesPerNode)

    def _fit(self, df: DataFrame) -> "RandomForestModel":
        get = self.getOrDefault
        rows = cut(df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("label")))
        first, top = rows.select(F.size("x").alias("n")).first(), rows.agg(F.max("label")).first()[0]
        if first is None:
            raise ValueError("no training rows")
        k = int(top) + 1 if get(self.task) == "classification" else 0
        nodes = forest(rows, k, get(self.numTrees), get(self.maxDepth), subset(get(self.featureSubsetStrategy), first["n"], k, get(self.numTrees)),
                       get(self.impurity), get(self.minInstancesPerNode), get(self.bootstrap), get(self.subsamplingRate), get(self.seed), get(self.maxBins))
        path = shared_path(df.sparkSession, f"forests/{uuid.uuid4().hex}")
        nodes.write.parquet(path)
        model = RandomForestModel(path, k, first["n"])
        model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return model


def subset(v: str, n: int, n_classes: int, n_trees: int) -> int:
    """Number of features tried per node, by MLlib's names."""
    if v == "auto":
        v = "all" if n_trees == 1 else "sqrt" if n_classes else "onethird"
    if v == "all":
        return n
    if v in ("sqrt", "log2", "onethird"):
        return max(1, math.ceil({"sqrt": n ** 0.5, "log2": math.log2(n), "onethird": n / 3}[v]))
    return min(n, max(1, math.ceil(float(v) * n) if "." in v else int(v)))


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.nodes().write.parquet(f"{path}/nodes")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str):
        return super().load(path)._set(nodesPath=f"{path}/nodes")


class RandomForestModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The nodes live in a table; ``nodesPath`` is its folder."""

    nodesPath = Param(Params._dummy(), "nodesPath", "folder of the node table", typeConverter=TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes, 0: regression", typeConverter=TypeConverters.toInt)
    numFeatures = Param(Params._dummy(), "numFeatures", "length of the input vectors", typeConverter=TypeConverters.toInt)

    def __init__(self, path: str | None = None, n_classes: int | None = None, n_features: int | None = None):
        super().__init__()
        if path is not None:
            self._set(nodesPath=path, numClasses=n_classes, numFeatures=n_features)

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader(cls)

    def nodes(self) -> DataFrame:
        from pyspark.sql import SparkSession

        return (SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()).read.parquet(self.getOrDefault(self.nodesPath))

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by feature, as shares of a tree's, averaged over the trees that have splits."""
        per = self.nodes().where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).toPandas()
        out = np.zeros(self.getOrDefault(self.numFeatures))
        if len(per):
            share = per["gain"] / per.groupby("tree")["gain"].transform("sum")
            for f, v in pd.Series(share).groupby(per["feature"]).sum().items():
                out[int(f)] = v
            out /= out.sum()
        return DenseVector(out)

    def _transform(self, df: DataFrame) -> DataFrame:
        k = self.getOrDefault(self.numClasses)
        x = df.withColumn("_forest_x", vector_to_array(F.col(self.getFeaturesCol())))
        arrays = x.select(*[vector_to_array(F.col(c)).alias(c) if kind == "vector" else F.col(c) for c, kind in x.dtypes])
        nodes = self.nodes()
        out = votes(arrays, nodes, "_forest_x", k, "_forest_votes")
        if k:
            rounded = F.transform("_forest_votes", lambda v: F.round(v, 9))
            pred = (F.array_position(rounded, F.array_max(rounded)) - 1).cast("double")
        else:
            pred = F.col("_forest_votes")[0] / float(nodes.select("tree").distinct().count())
        return out.withColumn(self.getPredictionCol(), pred).drop("_forest_x", "_forest_votes")
