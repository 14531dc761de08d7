"""Random forests: against a plain recursive builder, whichever way nodes are grown."""
import numpy as np
import pytest

from pitchlens.plans import forests as R


def side(y, w, classes, how):
    if not classes:
        return ((w * y * y).sum() - (w * y).sum() ** 2 / w.sum()) if w.sum() else 0.0
    c = np.array([w[y == k].sum() for k in range(classes)], float)
    c = c[c > 0]
    return c.sum() - (c * c).sum() / c.sum() if how == "gini" else -(c * np.log2(c / c.sum())).sum()


def plain(x, y, w, classes, how, depth, leaf, node=1):
    """{node: (feature, threshold, rows)} over every distinct value; of equal gains the first feature and value."""
    best = None
    if depth and w.sum() >= 2 * leaf and side(y, w, classes, how) > 1e-9:
        for f in range(x.shape[1]):
            for v in np.unique(x[w > 0, f])[:-1]:
                left = x[:, f] <= v
                if min(w[left].sum(), w[~left].sum()) >= leaf:
                    won = side(y, w, classes, how) - side(y[left], w[left], classes, how) - side(y[~left], w[~left], classes, how)
                    if won > 1e-9 and (best is None or round(won, 7) > best[0]):
                        best = round(won, 7), f, v, left
    if best is None:
        return {node: (-1, 0.0, int(w.sum()))}
    _, f, v, left = best
    return {node: (f, v, int(w.sum())), **plain(x[left], y[left], w[left], classes, how, depth - 1, leaf, 2 * node),
            **plain(x[~left], y[~left], w[~left], classes, how, depth - 1, leaf, 2 * node + 1)}


@pytest.mark.parametrize("classes,how,leaf,local", [(0, "variance", 1, 1 << 16), (0, "variance", 3, 40), (3, "gini", 1, 60), (3, "entropy", 4, 1)])
def test_trees_equal_plain_ones_whichever_way_they_grow(spark, monkeypatch, classes, how, leaf, local):
    """trees of unlimited depth, grown by passes and locally, from rows of several tasks."""
    monkeypatch.setattr(R, "LOCAL_ROWS", local)
    monkeypatch.setattr(R, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(R, "SORTED", local % 3)
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(300, 3)), 1)
    x[:, 2] = 4.0
    y = (x[:, 0] > 0) * 1.0 + (x[:, 1] > 0.3) * 1.0 if classes else np.round(3 * x[:, 0] + x[:, 1] ** 2, 2)
    y[::7] = 0.0
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double").repartition(4).cache()
    nodes = R.forest(df, classes, 2, 30, 3, how, leaf, bootstrap=False, max_bins=200)
    want = plain(x, y, np.ones(300, int), classes, how, 30, leaf)
    for t in (0, 1):
        got = {n["node"]: (n["feature"], n["threshold"], n["n"]) for n in nodes.where(f"tree = {t}").collect()}
        assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
        leaves = {n["node"]: n["value"] for n in nodes.where(f"tree = {t} AND feature < 0").collect()}
    pred = R.votes(df, nodes, "x", classes, "v").collect()
    for row in pred[:60]:
        k = 1
        while want[k][0] >= 0:
            k = 2 * k + int(row["x"][want[k][0]] > want[k][1])
        v = np.array(leaves[k])
        assert np.allclose(row["v"], 2 * (v / v.sum() if classes else v))


def test_samples_and_features_differ_by_tree(spark):
    u = np.arange(20_000)
    p = {"bootstrap": True, "subsample": 1.0, "seed": 1, "tried": 2}
    w = [R.weights(u, t, p) for t in range(3)]
    assert all(abs(v.mean() - 1) < 0.05 and abs((v == 0).mean() - np.exp(-1)) < 0.02 for v in w) and (w[0] != w[1]).mean() > 0.3
    half = R.weights(u, 0, {**p, "bootstrap": False, "subsample": 0.5})
    assert abs(half.mean() - 0.5) < 0.02 and half.max() == 1
    mask = R.allowed(np.zeros(500, int), np.arange(1, 501), 6, p)
    assert (mask.sum(axis=1) == 2).all() and (mask.sum(axis=0) > 100).all()


def test_a_fit_computes_its_input_once(spark):
    """the stacked models before a forest (or booster) are applied once, not for every pass over its rows."""
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import functions as F

    from pitchlens.plans.boosting import GradientBoosting

    seen = spark.sparkContext.accumulator(0)

    def vector(a):
        seen.add(1)
        return Vectors.dense([a, a % 7])

    df = spark.range(200).select(F.udf(vector, VectorUDT())(F.col("id").cast("double")).alias("features"), (F.col("id") % 2).alias("label"))
    R.RandomForest(numTrees=2).fit(df)
    assert seen.value == 200
    GradientBoosting(rounds=2).fit(df)
    assert seen.value == 400


@pytest.mark.parametrize("classes", [0, 3])
def test_rows_meet_the_nodes_of_a_large_forest_in_buckets(spark, monkeypatch, classes):
    """predictions bring the nodes of many rows to the driver and no others; the votes are the same."""
    monkeypatch.setattr(R, "LOCAL_ROWS", 100)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(900, 3)), 1)
    y = (x[:, 0] > 0) * 1.0 + (x[:, 1] > 0.3) * 1.0 if classes else np.round(3 * x[:, 0] + x[:, 1] ** 2, 2)
    df = spark.createDataFrame([(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y))], "k int, x array<double>, label double").repartition(4).cache()
    nodes = R.forest(df, classes, 5, 30, 2, "gini" if classes else "variance", 1, max_bins=200).cache()
    want = {v["k"]: (v["x"], v["label"], v["v"]) for v in R.votes(df, nodes, "x", classes, "v").collect()}
    monkeypatch.setattr(R, "MODEL_NODES", 10)
    monkeypatch.setattr(R, "VOTE_CELLS", 500, raising=False)

    def refused(*_):
        raise AssertionError("the driver got a whole tree")

    monkeypatch.setattr(R, "Trees", refused)
    for each in (20, 1 << 18):
        monkeypatch.setattr(R, "BUCKET_NODES", each, raising=False)
        found = R.votes(df, nodes, "x", classes, "v")
        got = found.collect()
        assert found.columns == ["k", "x", "label", "v"] and len(got) == 900
        assert all(v["x"] == want[v["k"]][0] and np.allclose(v["v"], want[v["k"]][2]) for v in got)
    assert R.votes(df.limit(0), nodes, "x", classes, "v").count() == 0
