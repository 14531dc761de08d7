"""Gradient boosting: against a plain numpy version, whatever the partitions."""
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pitchlens.plans import boosting as B
from pitchlens.plans import models as M

P = {"learning_rate": 0.3, "reg_lambda": 1.5, "reg_alpha": 0.2, "gamma": 0.05, "min_child_weight": 2.0}


def plain_tree(x, g, h, depth, p):
    """(feature, threshold, left, right) or a leaf value, recursively over every distinct value."""
    t = lambda v: np.sign(v) * max(abs(v) - p["reg_alpha"], 0.0)
    quality = lambda a, b: t(a) ** 2 / (b + p["reg_lambda"])
    best = None
    if depth:
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= v
                a, b = (g[left].sum(), h[left].sum()), (g[~left].sum(), h[~left].sum())
                if min(a[1], b[1]) < p["min_child_weight"]:
                    continue
                won = quality(*a) + quality(*b) - quality(g.sum(), h.sum())
                if won > p["gamma"] and (best is None or won > best[0] + 1e-9):
                    best = won, f, v, left
    if best is None:
        return -p["learning_rate"] * t(g.sum()) / (h.sum() + p["reg_lambda"])
    _, f, v, left = best
    return f, v, plain_tree(x[left], g[left], h[left], depth - 1, p), plain_tree(x[~left], g[~left], h[~left], depth - 1, p)


def plain_score(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def data(kind, n=500, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)), 1)
    x[:, 3] = 7.0
    y = {"logistic": (x[:, 0] + x[:, 1] * x[:, 2] > 0), "softmax": (x[:, 0] > 0) * 1 + (x[:, 1] > 0.5) * 1, "squared": x[:, 0] * 3 + x[:, 1] ** 2}[kind]
    return x, y.astype(float)


def frame(spark, x, y):
    return spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double").repartition(5)


@pytest.mark.parametrize("loss,k", [("logistic", 1), ("softmax", 3), ("squared", 1)])
@pytest.mark.parametrize("tasks", [1, 5])
def test_rounds_equal_plain_numpy(spark, monkeypatch, loss, k, tasks):
    if tasks > 1:  # several tasks, merged in two levels, in blocks of one node, classes one by one; scores landed anew each round
        for name, v in (("ROWS_PER_TASK", 100), ("FAN_IN", 2), ("BLOCK_CELLS", 1), ("CLASS_CELLS", 1), ("REFRESH", 1)):
            monkeypatch.setattr(B, name, v)
    x, y = data(loss)
    trees, losses = B.boost(frame(spark, x, y), loss, k, rounds=3, max_depth=3, max_bins=200, **P)
    scores = np.full((len(x), k), 0.0 if loss == "logistic" else 0.5)
    for r in range(3):
        g, h, value = B.gradients(scores, y, loss)
        assert losses[r] == pytest.approx(value.mean(), abs=1e-9)
        add = np.array([[plain_score(plain_tree_, row) for row in x] for plain_tree_ in (plain_tree(x, g[:, c], h[:, c], 3, P) for c in range(k))]).T
        assert np.allclose(np.stack([t.score(x) for t in trees[r]], 1), add, atol=1e-9)
        scores += add


def test_gradients_are_derivatives():
    r = np.random.default_rng(1)
    for loss, k in (("logistic", 1), ("softmax", 4), ("squared", 1)):
        s, y = r.normal(size=(50, k)), r.integers(0, max(2, k), 50).astype(float)
        g = B.gradients(s, y, loss)[0] * (2 if loss == "squared" else 1)
        for c in range(k):
            d = np.zeros_like(s)
            d[:, c] = 1e-6
            slope = (B.gradients(s + d, y, loss)[2] - B.gradients(s - d, y, loss)[2]) / 2e-6
            assert np.allclose(slope, g[:, c], atol=1e-5)


def test_the_loss_falls_every_round_and_samples_differ(spark):
    x, y = data("softmax", 800)
    df = frame(spark, x, y)
    trees, losses = B.boost(df, "softmax", 3, rounds=20, learning_rate=0.2, max_depth=4)
    assert all(b < a for a, b in zip(losses, losses[1:])) and losses[-1] < 0.3 * losses[0]
    sampled, _ = B.boost(df, "softmax", 3, rounds=2, subsample=0.5, colsample=0.5, max_depth=3)
    used = [{f for f in t.feature if f >= 0} for ts in sampled for t in ts]
    assert all(len(u) <= 2 for u in used) and len(set(map(frozenset, used))) > 1


def test_few_bins_are_quantiles(spark):
    x = np.arange(10_000, dtype=float)[:, None]
    points = B.cut_points(frame(spark, x, x[:, 0]), 1, 16)[0]
    assert len(points) <= 16 and np.all(np.diff(np.append(0, points)) < 10_000 / 16 * 1.5)


def test_modeler_round_trip_and_classes(spark, tmp_path):
    x, y = data("softmax")
    df = frame(spark, x, y).select(*[F.col("x")[k].alias(f"f{k}") for k in range(4)], (F.col("label") * 10 + 100).cast("long").alias("who"))
    m = M.Modeler("xgb_classif", {"n_estimators": 5, "max_depth": 3, "reg_lambda": 2, "objective": "multi:softmax"}, "who", [f"f{k}" for k in range(4)]).fit(df)
    pred = m.predict(df)
    assert m.model.stages[-1].getOrDefault("loss") == "softmax" and pred.where("prediction = who").count() > 0.9 * len(x)
    m.save(str(tmp_path / "m"))
    back = M.Modeler("xgb_classif", {}, "who", [f"f{k}" for k in range(4)]).load(str(tmp_path / "m")).predict(df)
    assert sorted(map(str, back.collect())) == sorted(map(str, pred.collect()))
    reg = Pipeline(stages=[VectorAssembler(inputCols=["f0", "f1"], outputCol="features"),
                           B.GradientBoosting(task="regression", labelCol="f2", rounds=3)]).fit(df)
    reg.write().overwrite().save(str(tmp_path / "r"))
    assert PipelineModel.load(str(tmp_path / "r")).transform(df).where("prediction IS NULL").count() == 0


def test_edges(spark):
    with pytest.raises(ValueError):
        B.boost(spark.createDataFrame([], "x array<double>, label double"), "squared")
    one = spark.createDataFrame([([1.0], 2.0)] * 4, "x array<double>, label double")
    trees, _ = B.boost(one, "squared", 1, rounds=2, learning_rate=1.0, reg_lambda=0.0, base_score=0.0)
    assert trees[0][0].value == [2.0] and trees[1][0].value == [0.0]


def test_a_level_costs_one_stage_and_sums_merge_alike(spark, monkeypatch):
    """rounds over several tasks run one stage a level; with exchanged sums they give the same trees."""
    x, y = data("squared")
    df = frame(spark, x, y).cache()
    for name, v in (("ROWS_PER_TASK", 100), ("REFRESH", 100)):
        monkeypatch.setattr(B, name, v)
    shape = lambda trees: [[(t.feature, t.bin) for t in ts] for ts in trees]
    tracker, stages, got = spark.sparkContext.statusTracker(), [], []
    for rounds in (2, 6):
        group = f"boost-{rounds}"
        spark.sparkContext.setJobGroup(group, "rounds")
        got.append(shape(B.boost(df, "squared", 1, rounds=rounds, max_depth=3, max_bins=200, **P)[0]))
        stages.append(sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("other", "others")
    assert stages[1] - stages[0] <= 4 * 3
    for name, v in (("SMALL", 0), ("FAN_IN", 2), ("BLOCK_CELLS", 1), ("BATCH", 7)):
        monkeypatch.setattr(B, name, v)
    assert shape(B.boost(df, "squared", 1, rounds=6, max_depth=3, max_bins=200, **P)[0]) == got[1]


@pytest.mark.parametrize("loss", ["logistic", "squared"])
def test_small_nodes_are_grown_where_their_rows_are(spark, monkeypatch, loss):
    """subtrees of few rows take one job of two stages instead of a pass a level, and are the same trees."""
    x, y = data(loss)
    df = frame(spark, x, y).cache()
    for name, v in (("ROWS_PER_TASK", 100), ("REFRESH", 100), ("LOCAL_ROWS", 0)):
        monkeypatch.setattr(B, name, v, raising=False)
    fit = lambda rounds: B.boost(df, loss, 1, rounds=rounds, max_depth=6, max_bins=200, subsample=0.9, colsample=0.8, **P)
    by_passes, losses = fit(5)
    tracker, stages = spark.sparkContext.statusTracker(), []
    for local, cells in ((200, 1), (1 << 17, 1 << 17)):
        monkeypatch.setattr(B, "LOCAL_ROWS", local, raising=False)
        monkeypatch.setattr(B, "BLOCK_CELLS", cells)
        got, other = fit(5)
        assert other == pytest.approx(losses, abs=1e-9)
        for a, b in zip(by_passes, got):
            assert sorted(a[0].feature) == sorted(b[0].feature) and np.allclose(a[0].score(x), b[0].score(x), atol=1e-9)
    for rounds in (1, 5):
        group = f"dealt-{loss}-{rounds}"
        spark.sparkContext.setJobGroup(group, "rounds")
        fit(rounds)
        stages.append(sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("other", "others")
    assert stages[1] - stages[0] <= 4 * 3


def test_values_are_counted_in_one_pass_whatever_the_partitions(spark):
    """all values of a feature are bin ends where they fit, also when no partition has them all."""
    x = np.stack([np.arange(400.0) % 9, np.arange(400.0) % 200, np.zeros(400), np.where(np.arange(400) % 2, -0.0, 1.0)], 1)
    df = frame(spark, x, x[:, 0]).repartitionByRange(7, F.col("x")[1])
    points = B.cut_points(df, 4, 32)
    assert points[0].tolist() == list(range(8)) and len(points[1]) <= 32 and points[2].tolist() == [] and points[3].tolist() == [0.0]


def test_passes_take_as_many_tasks_as_there_are_slots(spark, monkeypatch):
    """rounds read persisted rows by few tasks, however many the rows were landed with; their lineage is cut."""
    x, y = data("squared")
    df = frame(spark, x, y).cache()
    monkeypatch.setattr(B, "ROWS_PER_TASK", 10)
    fit = lambda rounds: B.boost(df, "squared", 1, rounds=rounds, max_depth=3, max_bins=200, **P)
    tracker, tasks, slots = spark.sparkContext.statusTracker(), [], spark.sparkContext.defaultParallelism
    for rounds in (1, 5):
        group = f"slots-{rounds}"
        spark.sparkContext.setJobGroup(group, "rounds")
        whole = fit(rounds)
        infos = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds]
        tasks.append(sum(i.numTasks for i in infos if i))
    spark.sparkContext.setJobGroup("other", "others")
    assert tasks[1] - tasks[0] <= 4 * 3 * 2 * slots
    monkeypatch.setattr(B, "LINEAGE", 2, raising=False)
    trees, losses = fit(5)
    assert losses == pytest.approx(whole[1], abs=1e-9) and all(a[0].feature == b[0].feature for a, b in zip(trees, whole[0]))
