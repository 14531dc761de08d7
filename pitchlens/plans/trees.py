"""Extremely randomised trees, grown level by level from DataFrame aggregates.

A node draws its features in the order of a keyed hash and one threshold per feature, uniform between the
feature's smallest and largest value in the node, from another; of the first ``max_features`` that are
not constant there the one with the best split wins. Thresholds depend on (seed, tree, node, feature) and the
node's rows alone, so any way of growing gives the same forest.

Nodes with many rows are settled for all trees of a block at once, a level at a time: one aggregate gives
their ranges and classes, a second one the class counts left of each drawn threshold. Nodes of at most
``local_rows`` rows are packed into groups of about that size, shuffled, and grown to the end where they are.
Large nodes of a block are at most ``FRONTIER``, which bounds what the driver gets and sends out per level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_path

PRIME = 2147483647
FRONTIER = 1 << 16
LOCAL_ROWS = 4096
ENTRIES = 1 << 16     # (row, tree) pairs that a task handles at a time
MODEL_NODES = 1 << 21  # nodes of trees that are sent to tasks together for predictions
MAX_LEVELS = 62       # node numbers (root 1, children 2n and 2n + 1) are longs

NODES = "tree int, node long, feature int, threshold double, n long, classes array<int>, counts array<long>"


def draw(seed, salt, tree, node, feature) -> np.ndarray:
    """Keyed hash in 0 .. PRIME - 1 of integers or arrays of them (the SQL of the tests has the same steps)."""
    h = (np.asarray(seed, np.int64) * 7919 + salt + 1) % PRIME
    for v in (tree, np.asarray(node, np.int64) % PRIME, feature):
        h = (h * 48271 + v) % PRIME
    h = (h * h + 1013904223) % PRIME
    return (h * h + 12345) % PRIME


def candidates(seed: int, tree: np.ndarray, node: np.ndarray, lo: np.ndarray, hi: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, threshold) of the first m features of every node that are not constant, -1 where there are fewer."""
    f = np.arange(lo.shape[1])
    order = np.where(lo < hi, draw(seed, 0, tree[:, None], node[:, None], f), PRIME)
    pick = np.argsort(order, axis=1, kind="stable")[:, :m]
    at = np.arange(len(tree))[:, None]
    low, high = lo[at, pick], hi[at, pick]
    thr = low + draw(seed, 1, tree[:, None], node[:, None], pick) / float(PRIME) * (high - low)
    return np.where(low < high, pick, -1), np.where(thr >= high, low, thr)


def scores(left: np.ndarray, total: np.ndarray, criterion: str) -> np.ndarray:
    """Split quality from class counts (..., classes) left of the threshold and in all; the largest is best."""
    right = total - left
    n_left, n_right = left.sum(-1), right.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if criterion == "gini":
            out = (left * left).sum(-1) / n_left.astype(float) + (right * right).sum(-1) / n_right.astype(float)
        else:
            out = sum(np.where(c > 0, c * np.log(c / n[..., None].astype(float)), 0.0).sum(-1) for c, n in ((left, n_left), (right, n_right)))
    return np.where((n_left > 0) & (n_right > 0), out, -np.inf)


def _starts(sorted_ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1])[:len(sorted_ids)])


def grow(x: np.ndarray, y: np.ndarray, row: np.ndarray, tree: np.ndarray, node: np.ndarray, n_classes: int, p: dict) -> dict[str, list]:
    """Grow all (tree, node) groups to the end: ``row[k]`` of x and y belongs to ``(tree[k], node[k])``."""
    out: dict[str, list] = {c: [] for c in ("tree", "node", "feature", "threshold", "n", "classes", "counts")}
    while len(row):
        order = np.lexsort((node, tree))
        row, tree, node = row[order], tree[order], node[order]
        new = np.append(True, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1]))
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        n = np.diff(np.append(at, len(row)))
        t, v = tree[at], node[at]
        keys, count = np.unique(group * n_classes + y[row], return_counts=True)
        owner, label = np.divmod(keys, n_classes)
        kinds = np.bincount(owner, minlength=len(at))
        level = np.floor(np.log2(v.astype(float))).astype(int)
        if (level >= MAX_LEVELS - 1).any():
            raise ValueError(f"a tree deeper than {MAX_LEVELS} levels")
        open_ = (kinds > 1) & (n >= p["min_split"]) & (level < p["max_depth"])
        feature, thr = np.full(len(at), -1), np.zeros(len(at))
        some = np.flatnonzero(open_)
        if len(some):
            slot = np.full(len(at), -1)
            slot[some] = np.arange(len(some))
            mine = np.flatnonzero(slot[group] >= 0)
            starts = _starts(group[mine])
            lo, hi = (np.concatenate([u.reduceat(x[row[mine], a:a + 8], starts, axis=0) for a in range(0, x.shape[1], 8)], axis=1)
                      for u in (np.minimum, np.maximum))
            cf, ct = candidates(p["seed"], t[some], v[some], lo, hi, p["max_features"])
            g = slot[group[mine]]
            best, where = np.full(len(some), -np.inf), np.full(len(some), -1)
            total = _counts(g, y[row[mine]], np.ones(len(mine), bool), len(some), n_classes)
            for k in np.argsort(-1 * (np.arange(cf.shape[1]) == -1), kind="stable"):
                valid = cf[:, k] >= 0
                left = x[row[mine], np.maximum(cf[g, k], 0)] <= ct[g, k]
                counts = _counts(g, y[row[mine]], left, len(some), n_classes)
                s = _sparse_scores(counts, total, len(some), n_classes, p["criterion"])
                n_left = np.bincount(g[left], minlength=len(some))
                s = np.where(valid & (n_left >= p["min_leaf"]) & (n[some] - n_left >= p["min_leaf"]), s, -np.inf)
                better = (s > best) | (s == best) & (s > -np.inf) & (cf[:, k] < cf[np.arange(len(some)), where])
                best, where = np.where(better, s, best), np.where(better, k, where)
            got = where >= 0
            feature[some[got]], thr[some[got]] = cf[got, where[got]], ct[got, where[got]]
        leaf = feature < 0
        held = np.split(np.arange(len(keys)), np.cumsum(kinds)[:-1])
        out["tree"] += t.tolist()
        out["node"] += v.tolist()
        out["feature"] += feature.tolist()
        out["threshold"] += thr.tolist()
        out["n"] += n.tolist()
        shown = leaf | p["inner"]
        out["classes"] += [label[h].tolist() if show else [] for h, show in zip(held, shown)]
        out["counts"] += [count[h].tolist() if show else [] for h, show in zip(held, shown)]
        go = ~leaf[group]
        right = x[row[go], feature[group[go]]] > thr[group[go]]
        row, tree, node = row[go], tree[go], node[go] * 2 + right
    return out


def _counts(g: np.ndarray, label: np.ndarray, take: np.ndarray, n: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(group * classes + class, rows) of the taken rows, ascending."""
    return np.unique(g[take] * n_classes + label[take], return_counts=True)


def _sparse_scores(left, total, n: int, n_classes: int, criterion: str) -> np.ndarray:
    """``scores`` from the classes that occur."""
    lk, lc = left
    tk, tc = total
    here = np.zeros(len(tk), np.int64)
    here[np.searchsorted(tk, lk)] = lc
    rest, g = tc - here, tk // n_classes
    add = lambda w: np.bincount(g, weights=w, minlength=n)
    n_left, n_right = add(here), add(rest)
    with np.errstate(divide="ignore", invalid="ignore"):
        if criterion == "gini":
            return add((here * here).astype(float)) / n_left + add((rest * rest).astype(float)) / n_right
        return sum(add(np.where(c > 0, c * np.log(c / m[g]), 0.0)) for c, m in ((here, n_left), (rest, n_right)))


class _Upper:
    """The part of a block of trees that is grown level by level: children and splits by place, one root per tree."""

    def __init__(self, trees: np.ndarray):
        self.tree, self.node = trees.copy(), np.ones(len(trees), np.int64)
        self.feature, self.threshold = np.full(len(trees), -1), np.zeros(len(trees))
        self.child = np.zeros(len(trees), np.int64)  # place of the left child; the right one follows
        self.rows = np.zeros(len(trees), np.int64)
        self.roots = len(trees)

    def split(self, at: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Split the nodes at these places; the places of their children."""
        first = len(self.tree) + 2 * np.arange(len(at))
        self.feature[at], self.threshold[at], self.child[at] = feature, threshold, first
        self.tree = np.append(self.tree, np.repeat(self.tree[at], 2))
        self.node = np.append(self.node, np.repeat(2 * self.node[at], 2) + np.tile([0, 1], len(at)))
        for name, v in (("feature", -1), ("threshold", 0.0), ("child", 0), ("rows", 0)):
            old = getattr(self, name)
            setattr(self, name, np.append(old, np.full(2 * len(at), v, old.dtype)))
        return np.arange(len(self.tree) - 2 * len(at), len(self.tree))

    def walk(self, x: np.ndarray) -> np.ndarray:
        """Place of every row in every tree."""
        at = np.tile(np.arange(self.roots), (len(x), 1))
        while True:
            f = self.feature[at]
            r, c = np.nonzero(f >= 0)
            if not len(r):
                return at
            here = at[r, c]
            at[r, c] = self.child[here] + (x[r, f[r, c]] > self.threshold[here])


def _arrays(batches: Iterable[pa.RecordBatch], step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, step):
            part = b.slice(k, step)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield x, part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _entries(upper: _Upper, wanted: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) pairs whose place is wanted (a mask by place), ascending by place."""
    at = upper.walk(x)
    r, c = np.nonzero(wanted[at])
    place = at[r, c]
    order = np.argsort(place, kind="stable")
    return r[order], place[order]


def _ranges(shared, wanted: np.ndarray):
    def run(batches):
        upper = shared.value
        for x, y in _arrays(batches, max(1, ENTRIES // upper.roots)):
            r, place = _entries(upper, wanted, x)
            if not len(r):
                continue
            at = _starts(place)
            lo, hi = np.minimum.reduceat(x[r], at, axis=0), np.maximum.reduceat(x[r], at, axis=0)
            n, k = lo.shape
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(place[at], k).astype(np.int64)), pa.array(np.tile(np.arange(k), n).astype(np.int32)),
                pa.array(lo.ravel()), pa.array(hi.ravel()), pa.nulls(n * k, pa.int64())], ["place", "feature", "lo", "hi", "n"])
            keys, count = np.unique(place * (1 << 31) + y[r], return_counts=True)
            place, label = np.divmod(keys, 1 << 31)
            yield pa.RecordBatch.from_arrays([
                pa.array(place), pa.array((-1 - label).astype(np.int32)), pa.nulls(len(keys), pa.float64()), pa.nulls(len(keys), pa.float64()),
                pa.array(count)], ["place", "feature", "lo", "hi", "n"])

    return run


def _lefts(shared, wanted: np.ndarray, feature: np.ndarray, threshold: np.ndarray, slot_of: np.ndarray):
    def run(batches):
        upper, m = shared.value, feature.shape[1]
        for x, y in _arrays(batches, max(1, ENTRIES // (upper.roots * m))):
            r, place = _entries(upper, wanted, x)
            s = slot_of[place]
            f = feature[s]
            left = x[r[:, None], np.maximum(f, 0)] <= threshold[s]
            e, k = np.nonzero(f >= 0)
            keys = ((place[e] * m + k) << 31) + y[r[e]]
            uniq, back, count = np.unique(keys, return_inverse=True, return_counts=True)
            on_left = np.bincount(back, weights=left[e, k], minlength=len(uniq)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array((uniq >> 31) // m), pa.array(((uniq >> 31) % m).astype(np.int32)), pa.array((uniq & (1 << 31) - 1).astype(np.int32)),
                pa.array(on_left), pa.array(count)], ["place", "slot", "label", "left", "n"])

    return run


def _packed(shared, bucket_of: np.ndarray):
    """Rows of nodes that are grown locally, with their bucket."""

    def run(batches):
        upper = shared.value
        for x, y in _arrays(batches, max(1, ENTRIES // upper.roots)):
            r, place = _entries(upper, bucket_of >= 0, x)
            n = len(r)
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket_of[place].astype(np.int32)), pa.array(upper.tree[place].astype(np.int32)), pa.array(upper.node[place]),
                pa.array(y[r].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x[r].ravel()))],
                ["bucket", "tree", "node", "label", "x"])

    return run


def _grown(n_classes: int, p: dict):
    def run(t):
        t = t.combine_chunks()
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        col = lambda c: t[c].to_numpy().astype(np.int64)
        out = grow(x, col("label"), np.arange(t.num_rows), col("tree"), col("node"), n_classes, p)
        return pa.table({"tree": pa.array(out["tree"], pa.int32()), "node": pa.array(out["node"], pa.int64()),
                         "feature": pa.array(out["feature"], pa.int32()), "threshold": pa.array(out["threshold"], pa.float64()),
                         "n": pa.array(out["n"], pa.int64()), "classes": pa.array(out["classes"], pa.list_(pa.int32())),
                         "counts": pa.array(out["counts"], pa.list_(pa.int64()))})

    return run


def grow_forest(rows: DataFrame, n_classes: int, n_trees: int = 100, max_depth: int | None = None, max_features: int = 1,
                criterion: str = "gini", min_samples_split: int = 2, min_samples_leaf: int = 1, seed: int = 42,
                local_rows: int | None = None, inner_counts: bool = False) -> DataFrame:
    """Table of all nodes (``NODES``; feature -1: a leaf with its class counts) of a forest over (x array<double>, label int).

    With ``inner_counts`` split nodes have their class counts too, so trees can be read up to any depth.
    """
    spark = rows.sparkSession
    rows = rows.select("x", "label")
    n_rows = rows.count()
    if not n_rows:
        raise ValueError("no training rows")
    p = {"max_depth": MAX_LEVELS if max_depth is None else int(max_depth), "max_features": max_features, "criterion": criterion,
         "min_split": max(2, min_samples_split, 2 * min_samples_leaf), "min_leaf": min_samples_leaf, "seed": seed, "inner": inner_counts}
    local = local_rows if local_rows is not None else max(LOCAL_ROWS, -(-n_rows // FRONTIER))
    step = max(1, FRONTIER // max(1, n_rows // max(1, local)))
    parts = [_block(spark, rows, n_rows, np.arange(a, min(a + step, n_trees)), n_classes, p, local) for a in range(0, n_trees, step)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _block(spark, rows: DataFrame, n_rows: int, trees: np.ndarray, n_classes: int, p: dict, local: int) -> DataFrame:
    upper = _Upper(trees)
    upper.rows[:] = n_rows
    todo, done = np.arange(len(trees)), []
    while len(todo := todo[upper.rows[todo] > local]):
        wanted = np.zeros(len(upper.tree), bool)
        wanted[todo] = True
        shared = spark.sparkContext.broadcast(upper)
        seen = (rows.mapInArrow(_ranges(shared, wanted), "place long, feature int, lo double, hi double, n long")
                .groupBy("place", "feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toPandas())
        kinds = seen[seen["feature"] < 0]
        seen = seen[seen["feature"] >= 0].sort_values(["place", "feature"])
        todo = np.sort(seen["place"].unique())
        lo, hi = (seen[c].to_numpy().reshape(len(todo), -1) for c in ("lo", "hi"))
        classes = kinds.groupby("place")["feature"].size().reindex(todo).to_numpy()
        level = np.floor(np.log2(upper.node[todo].astype(float))).astype(int)
        open_ = (classes > 1) & (upper.rows[todo] >= p["min_split"]) & (level < p["max_depth"])
        feature, thr = candidates(p["seed"], upper.tree[todo], upper.node[todo], lo, hi, p["max_features"])
        slot_of = np.zeros(len(upper.tree), np.int64)
        slot_of[todo] = np.arange(len(todo))
        wanted[:] = False
        wanted[todo[open_]] = True
        n, left = F.col("n"), F.col("left")
        right = n - left
        quality = (F.sum(left * left) / F.sum(left) + F.sum(right * right) / F.sum(right) if p["criterion"] == "gini" else
                   _information(left) + _information(right))
        best = {}
        if open_.any():
            scored = (rows.mapInArrow(_lefts(shared, wanted, feature, thr, slot_of), "place long, slot int, label int, left long, n long")
                      .groupBy("place", "slot", "label").agg(F.sum("left").alias("left"), F.sum("n").alias("n"))
                      .groupBy("place", "slot").agg(quality.alias("score"), F.sum("left").alias("n_left"), F.sum("n").alias("n")))
            for r in scored.toPandas().itertuples():
                f = int(feature[slot_of[r.place], r.slot])
                if min(r.n_left, r.n - r.n_left) >= p["min_leaf"] and (r.place not in best or (r.score, -f) > best[r.place][0]):
                    best[r.place] = ((r.score, -f), f, float(thr[slot_of[r.place], r.slot]), int(r.n_left))
        shared.unpersist()
        split = np.array(sorted(best), np.int64)
        held = {k: (g["feature"].to_numpy(), g["n"].to_numpy()) for k, g in kinds.groupby("place")}
        for place in todo.tolist():
            _, f, t, _ = best.get(place, (0, -1, 0.0, 0))
            label, count = (-1 - held[place][0], held[place][1]) if f < 0 or p["inner"] else (np.zeros(0, int),) * 2
            order = np.argsort(label)
            done.append((int(upper.tree[place]), int(upper.node[place]), f, t, int(upper.rows[place]), label[order].tolist(), count[order].tolist()))
        todo = upper.split(split, np.array([best[k][1] for k in split], int), np.array([best[k][2] for k in split], float))
        n_left = np.array([best[k][3] for k in split], np.int64)
        upper.rows[todo] = np.stack([n_left, upper.rows[split] - n_left], 1).ravel()
    top = spark.createDataFrame([(a, b, int(c), d, e, [int(v) for v in f], [int(v) for v in g]) for a, b, c, d, e, f, g in done], NODES)
    settled = {(a, b) for a, b, *_ in done}
    small = np.array([k for k in range(len(upper.tree)) if upper.feature[k] < 0 and (int(upper.tree[k]), int(upper.node[k])) not in settled], np.int64)
    if not len(small):
        return cut(top)
    bucket_of = np.full(len(upper.tree), -1, np.int64)
    bucket_of[small] = np.cumsum(upper.rows[small]) // max(1, local)
    shared = spark.sparkContext.broadcast(upper)
    grown = (rows.mapInArrow(_packed(shared, bucket_of), "bucket int, tree int, node long, label int, x array<double>")
             .groupBy("bucket").applyInArrow(_grown(n_classes, p), NODES))
    return cut(top.unionByName(grown))


def _information(c):
    """sum of c log(c / total) over the classes of a side."""
    return F.sum(F.when(c > 0, c * F.log(c.cast("double"))).otherwise(0.0)) - F.sum(c) * F.log(F.greatest(F.sum(c), F.lit(1)).cast("double"))


class Forest:
    """Nodes of some trees as arrays: children by place, the shares of classes of leaves."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        self.feature, self.threshold = nodes["feature"].to_numpy(), nodes["threshold"].to_numpy()
        key = list(zip(nodes["tree"], nodes["node"]))
        place = {k: i for i, k in enumerate(key)}
        self.left = np.array([place.get((t, 2 * n), -1) for t, n in key])
        self.right = np.array([place.get((t, 2 * n + 1), -1) for t, n in key])
        self.roots = np.array([i for i, (_, n) in enumerate(key) if n == 1])
        size = nodes["classes"].map(len).to_numpy()
        self.off = np.append(0, np.cumsum(size))
        self.label = np.concatenate([np.zeros(0, int), *nodes["classes"]]).astype(np.int64)
        self.share = np.concatenate([np.zeros(0), *nodes["counts"]]) / np.repeat(nodes["n"].to_numpy(), size)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Place of the leaf of every row in every tree."""
        at = np.tile(self.roots, (len(x), 1))
        while True:
            f = self.feature[at]
            r, c = np.nonzero(f >= 0)
            if not len(r):
                return at
            here = at[r, c]
            at[r, c] = np.where(x[r, f[r, c]] <= self.threshold[here], self.left[here], self.right[here])

    def votes(self, x: np.ndarray, n_classes: int) -> np.ndarray:
        """Sum over trees of the class shares of each row's leaf."""
        out = np.zeros((len(x), n_classes))
        at = self.leaves(x)
        for t in range(at.shape[1]):
            self.add(out, at[:, t])
        return out

    def add(self, out: np.ndarray, at: np.ndarray) -> None:
        """Add the class shares of each row's node to its votes."""
        a, size = self.off[at], self.off[at + 1] - self.off[at]
        ends = np.cumsum(size)
        k = np.repeat(a - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        np.add.at(out, (np.repeat(np.arange(len(at)), size), self.label[k]), self.share[k])


def tree_blocks(nodes: DataFrame) -> list[list[int]]:
    """Trees in blocks of at most MODEL_NODES nodes (one tree at least)."""
    sizes = {r["tree"]: r["count"] for r in nodes.groupBy("tree").count().collect()}
    out, held = [[]], 0
    for t in sorted(sizes):
        if out[-1] and held + sizes[t] > MODEL_NODES:
            out, held = out + [[]], 0
        out[-1].append(t)
        held += sizes[t]
    return out


def class_votes(rows: DataFrame, nodes: DataFrame, x_col: str, n_classes: int, out_col: str) -> DataFrame:
    """rows and the summed class shares (array<double>), one pass per block of trees; no row is shuffled."""
    spark = rows.sparkSession
    names = rows.columns
    rows = rows.withColumn(out_col, F.lit(None).cast("array<double>"))
    schema = rows.schema

    def voted(shared):
        def run(batches):
            forest = Forest(shared.value)
            for b in batches:
                n = b.num_rows
                x = b.column(b.schema.get_field_index(x_col)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
                v = forest.votes(x, n_classes) if n else np.zeros((0, n_classes))
                if n and b.column(len(names)).null_count == 0:
                    v += b.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n_classes, pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], b.schema.names)

        return run

    for block in tree_blocks(nodes):
        shared = spark.sparkContext.broadcast(nodes.where(F.col("tree").isin(block)).toPandas())
        rows = rows.mapInArrow(voted(shared), schema)
    return rows


def sweep(rows: DataFrame, nodes: DataFrame, n_classes: int, trees: list[int], depths: list[int]) -> DataFrame:
    """n_estimators, max_depth, hits, n, n_nodes: every size of a forest scored in one pass over (x, label).

    ``nodes`` has inner counts. As thresholds depend on the node alone, the first n trees read up to a depth are the
    forest that those settings grow. A task keeps the vote sums of one block of rows per depth.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(nodes.where(F.col("tree") < max(trees)).toPandas())
    asked, levels = set(trees), sorted(depths)

    def run(batches):
        forest, hits, n = Forest(shared.value), {}, 0
        for x, y in _arrays(batches, 1024):
            n += len(y)
            votes = np.zeros((len(levels), len(x), n_classes))
            for t, root in enumerate(forest.roots.tolist()):
                at, depth = np.full(len(x), root), 0
                for k, level in enumerate(levels):
                    while depth < level:
                        f = forest.feature[at]
                        go = np.flatnonzero(f >= 0)
                        if not len(go):
                            break
                        here = at[go]
                        at[go] = np.where(x[go, f[go]] <= forest.threshold[here], forest.left[here], forest.right[here])
                        depth += 1
                    forest.add(votes[k], at)
                if t + 1 in asked:
                    found = np.round(votes, 9).argmax(axis=2)
                    for k, level in enumerate(levels):
                        hits[t + 1, level] = hits.get((t + 1, level), 0) + int((found[k] == y).sum())
        for (t, level), h in hits.items():
            yield pa.RecordBatch.from_pydict({"n_estimators": pa.array([t], pa.int32()), "max_depth": pa.array([level], pa.int32()),
                                              "hits": pa.array([h], pa.int64()), "n": pa.array([n], pa.int64())})

    scored = rows.select("x", "label").mapInArrow(run, "n_estimators int, max_depth int, hits long, n long") \
        .groupBy("n_estimators", "max_depth").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    size = nodes.groupBy("tree", F.floor(F.log2("node")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("nodes")).toPandas()
    sizes = spark.createDataFrame([(t, d, int(size[(size["tree"] < t) & (size["level"] <= d)]["nodes"].sum())) for t in trees for d in depths],
                                  "n_estimators int, max_depth int, n_nodes long")
    return scored.join(sizes, ["n_estimators", "max_depth"])


class ExtraTreesClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Spark ML estimator over :func:`grow_forest`."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth; -1: none", typeConverter=TypeConverters.toInt)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "features tried per node: all, sqrt, log2, a share or a number",
                        typeConverter=TypeConverters.toString)
    impurity = Param(Params._dummy(), "impurity", "gini or entropy", typeConverter=TypeConverters.toString)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows of a leaf at least", typeConverter=TypeConverters.toInt)
    minInstancesPerSplit = Param(Params._dummy(), "minInstancesPerSplit", "rows of a split node at least", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=100, maxDepth=-1, maxFeatures="sqrt",
                 impurity="gini", minInstancesPerNode=1, minInstancesPerSplit=2, seed=42):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=-1, maxFeatures="sqrt", impurity="gini", minInstancesPerNode=1, minInstancesPerSplit=2, seed=42)
        self._set(**self._input_kwargs)

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setPredictionCol(self, v):
        return self._set(predictionCol=v)

    def _fit(self, df: DataFrame) -> "ExtraTreesModel":
        get = self.getOrDefault
        rows = df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("int").alias("label"))
        first, top = rows.select(F.size("x").alias("n")).first(), rows.agg(F.max("label")).first()[0]
        if first is None:
            raise ValueError("no training rows")
        nodes = grow_forest(rows, int(top) + 1, get(self.numTrees), None if get(self.maxDepth) < 0 else get(self.maxDepth),
                            tried(get(self.maxFeatures), first["n"]), get(self.impurity), get(self.minInstancesPerSplit),
                            get(self.minInstancesPerNode), get(self.seed))
        path = shared_path(df.sparkSession, f"forests/{uuid.uuid4().hex}")
        nodes.write.parquet(path)
        model = ExtraTreesModel(path, int(top) + 1)
        model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return model


def tried(v: str, n: int) -> int:
    """Number of features tried per node: 'all', 'sqrt', 'log2', a share with a point, or a number."""
    if v in ("all", "None"):
        return n
    if v in ("sqrt", "auto", "log2"):
        return max(1, int(np.sqrt(n) if v != "log2" else np.log2(n)))
    return max(1, int(float(v) * n)) if "." in v else min(n, max(1, int(v)))


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.nodes().write.parquet(f"{path}/nodes")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        return model._set(nodesPath=f"{path}/nodes")


class ExtraTreesModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The nodes live in a table; ``nodesPath`` is its folder."""

    nodesPath = Param(Params._dummy(), "nodesPath", "folder of the node table", typeConverter=TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", typeConverter=TypeConverters.toInt)

    def __init__(self, path: str | None = None, n_classes: int | None = None):
        super().__init__()
        if path is not None:
            self._set(nodesPath=path, numClasses=n_classes)

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader(cls)

    def nodes(self) -> DataFrame:
        from pyspark.sql import SparkSession

        return (SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()).read.parquet(self.getOrDefault(self.nodesPath))

    def _transform(self, df: DataFrame) -> DataFrame:
        x = df.withColumn("_forest_x", vector_to_array(F.col(self.getFeaturesCol())))
        plain = [c for c, kind in x.dtypes if kind == "vector"]
        arrays = x.select(*[F.col(c) if c not in plain else vector_to_array(F.col(c)).alias(c) for c in x.columns])
        voted = class_votes(arrays, self.nodes(), "_forest_x", self.getOrDefault(self.numClasses), "_forest_votes")
        rounded = F.transform("_forest_votes", lambda v: F.round(v, 9))
        # The smallest class of the most votes.
        out = voted.withColumn(self.getPredictionCol(), (F.array_position(rounded, F.array_max(rounded)) - 1).cast("double"))
        return out.drop("_forest_x", "_forest_votes")
