"""Extra-trees: against a plain recursive builder, whichever way nodes are grown."""
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pitchlens.plans import trees as T


def plain(x, y, tree, m, depth, criterion, min_leaf, seed, node=1):
    """(tree, node, feature, threshold, n, {class: rows}) of one tree, depth first, row by row."""
    counts = {int(c): int((y == c).sum()) for c in set(y.tolist())}
    if len(counts) > 1 and math.floor(math.log2(node)) < depth and len(y) >= max(2, 2 * min_leaf):
        tried, best = 0, None
        for f in sorted(range(x.shape[1]), key=lambda f: (int(T.draw(seed, 0, tree, node, f)), f)):
            lo, hi = x[:, f].min(), x[:, f].max()
            if lo == hi:
                continue
            tried += 1
            if tried > m:
                break
            t = lo + int(T.draw(seed, 1, tree, node, f)) / T.PRIME * (hi - lo)
            t = lo if t >= hi else t
            left = x[:, f] <= t
            score = 0.0
            for side in (y[left], y[~left]):
                n = [int((side == c).sum()) for c in counts]
                score += sum(v * v for v in n) / len(side) if criterion == "gini" else sum(v * math.log(v / len(side)) for v in n if v)
            if min(left.sum(), (~left).sum()) >= min_leaf and (best is None or (score, -f) > best[0]):
                best = (score, -f), f, t, left
        if best:
            _, f, t, left = best
            return [(tree, node, f, t, len(y), {}), *plain(x[left], y[left], tree, m, depth, criterion, min_leaf, seed, 2 * node),
                    *plain(x[~left], y[~left], tree, m, depth, criterion, min_leaf, seed, 2 * node + 1)]
    return [(tree, node, -1, 0.0, len(y), counts)]


def table(nodes):
    return sorted((r["tree"], r["node"], r["feature"], r["threshold"], r["n"], dict(zip(r["classes"], r["counts"]))) for r in nodes.collect())


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(600, 6)), 1)
    x[:, 4] = 1.0                                   # a constant feature
    y = ((x[:, 0] + x[:, 1] > 0) * 2 + (x[:, 2] > 0.5)).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, label int").repartition(5).cache()
    return x, y, df


@pytest.mark.parametrize("criterion,min_leaf,local", [("gini", 1, None), ("gini", 1, 50), ("gini", 1, 0), ("entropy", 7, 60)])
def test_every_way_of_growing_gives_the_plain_trees(points, criterion, min_leaf, local):
    x, y, df = points
    got = table(T.grow_forest(df, 4, 5, 6, 2, criterion, min_samples_leaf=min_leaf, seed=9, local_rows=local))
    want = sorted(n for t in range(5) for n in plain(x, y, t, 2, 6, criterion, min_leaf, 9))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=0)


def test_unlimited_depth_and_blocks_of_trees(points, monkeypatch):
    x, y, df = points
    monkeypatch.setattr(T, "FRONTIER", 10)          # 600 rows of at most 100 in a local node: blocks of 1 tree
    got = table(T.grow_forest(df, 4, 3, None, 6, seed=1, local_rows=100))
    assert got == sorted(n for t in range(3) for n in plain(x, y, t, 6, 99, "gini", 1, 1))
    assert all(len(g[5]) == 1 or len({tuple(v) for v in x}) < len(x) for g in got if g[2] < 0)


def test_votes_by_blocks_and_the_pipeline_round_trip(spark, points, monkeypatch, tmp_path):
    x, y, df = points
    flat = df.select("label", *[F.col("x")[k].alias(f"f{k}") for k in range(6)])
    est = T.ExtraTreesClassifier(numTrees=7, maxFeatures="0.5", seed=3)
    model = Pipeline(stages=[VectorAssembler(inputCols=[f"f{k}" for k in range(6)], outputCol="features"), est]).fit(flat)
    nodes = model.stages[-1].nodes()
    votes = np.zeros((len(x), 4))
    for t in range(7):
        tree = {n: (f, thr, c) for _, n, f, thr, _, c in plain(x, y, t, 3, 99, "gini", 1, 3)}
        for i, row in enumerate(x):
            n = 1
            while tree[n][0] >= 0:
                n = 2 * n + int(row[tree[n][0]] > tree[n][1])
            for c, k in tree[n][2].items():
                votes[i, c] += k / sum(tree[n][2].values())
    arrays = df.select("x", "label")
    one = [r["v"] for r in T.class_votes(arrays, nodes, "x", 4, "v").collect()]
    monkeypatch.setattr(T, "MODEL_NODES", 1)
    by_tree = [r["v"] for r in T.class_votes(arrays, nodes, "x", 4, "v").collect()]
    key = {tuple(a): v for a, v in zip(x.tolist(), votes)}
    order = [key[tuple(r["x"])] for r in arrays.collect()]
    assert np.allclose(one, order) and np.allclose(by_tree, order)
    pred = model.transform(flat)
    assert pred.where("prediction = label").count() > 0.99 * len(x) and set(flat.columns) < set(pred.columns)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert sorted(map(str, back.transform(flat).collect())) == sorted(map(str, pred.collect()))


def test_edges(spark):
    with pytest.raises(ValueError):
        T.grow_forest(spark.createDataFrame([], "x array<double>, label int"), 1)
    one = spark.createDataFrame([([1.0, 2.0], 0)] * 5, "x array<double>, label int")
    assert table(T.grow_forest(one, 1, 2)) == [(t, 1, -1, 0.0, 5, {0: 5}) for t in (0, 1)]
    same = spark.createDataFrame([([1.0], 0), ([1.0], 1), ([1.0], 1)], "x array<double>, label int")
    assert table(T.grow_forest(same, 2, 1)) == [(0, 1, -1, 0.0, 3, {0: 1, 1: 2})]
    assert [T.tried(v, 39) for v in ("all", "sqrt", "log2", "0.1", "10", "1.0")] == [39, 6, 5, 3, 10, 39]


@pytest.mark.parametrize("local", [None, 40])
def test_sweep_equals_forests_grown_alone(points, local):
    x, y, df = points
    train, test = df.where("label >= 0").limit(10_000), df
    nodes = T.grow_forest(train, 4, 6, 7, 2, seed=4, local_rows=local, inner_counts=True)
    got = {(r["n_estimators"], r["max_depth"]): (r["hits"], r["n"], r["n_nodes"]) for r in T.sweep(test, nodes, 4, [2, 5, 6], [1, 4, 7]).collect()}
    want = {}
    for n in (2, 5, 6):
        for d in (1, 4, 7):
            alone = T.grow_forest(train, 4, n, d, 2, seed=4)
            votes = T.class_votes(test, alone, "x", 4, "v").collect()
            hits = sum(int(np.round(r["v"], 9).argmax()) == r["label"] for r in votes)
            want[n, d] = hits, len(x), alone.count()
    assert got == want
