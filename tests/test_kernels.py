"""Kernel maps, feature agglomeration, AdaBoost.R2 against plain versions."""
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pitchlens.plans import adaboost as A
from pitchlens.plans import kernels as N


def vectors(spark, x, extra=None):
    cols = [f"c{k}" for k in range(x.shape[1])]
    rows = [tuple(map(float, r)) + ((float(extra[i]),) if extra is not None else ()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, *(["y"] if extra is not None else [])]))
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df.repartition(4))


def array(df, col):
    return np.array([r["a"] for r in df.select(vector_to_array(col).alias("a")).collect()])


def test_fourier_features_approach_the_kernel(spark):
    x = np.random.default_rng(0).normal(size=(60, 4))
    df = vectors(spark, x)
    out = N.RandomFourier(gamma=0.3, nComponents=3000, seed=7).transform(df)
    z, v = array(out, "fourier"), array(out, "features")
    assert z.shape == (60, 3000)
    assert np.abs(z @ z.T - N.kernel(v, v, "rbf", 0.3, 3, 1)).max() < 0.12       # five deviations of 1 / sqrt(3000)
    w, b = N.fourier_weights(4, 3000, 0.3, 7)
    assert np.allclose(z, np.sqrt(2 / 3000) * np.cos(v @ w.T + b)) and abs(w.std() - np.sqrt(0.6)) < 0.02


@pytest.mark.parametrize("name", N.KERNELS)
def test_nystroem_is_exact_on_its_landmarks_span(spark, name, tmp_path):
    centres = np.random.default_rng(1).normal(size=(6, 3)) * 3
    x = np.repeat(centres, 10, axis=0)                  # k-means finds the six points: every row is a landmark
    df = vectors(spark, x)
    model = Pipeline(stages=[N.Nystroem(kernel=name, gamma=0.2, nComponents=6, degree=2.0, seed=3)]).fit(df)
    out = model.transform(df)
    z, v = array(out, "nystroem"), array(out, "features")
    k = N.kernel(v, v, name, 0.2, 2.0, 1.0)
    if name != "sigmoid":                               # the sigmoid kernel may have negative directions, which map to 0
        assert np.allclose(z @ z.T, k, atol=1e-6)
    model.write().overwrite().save(str(tmp_path / name))
    assert np.allclose(array(PipelineModel.load(str(tmp_path / name)).transform(df), "nystroem"), z)


def plain_linkage(x, linkage):
    """Merges of the columns of x from the columns themselves."""
    clusters, out = {k: [k] for k in range(x.shape[1])}, []

    def height(a, b):
        p, q = x[:, a], x[:, b]
        if linkage == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((p.mean(1) - q.mean(1)) ** 2).sum())
        d = np.sqrt(((p[:, :, None] - q[:, None, :]) ** 2).sum(0))
        return d.max() if linkage == "complete" else d.mean()

    while len(clusters) > 1:
        h, i, j = min((round(height(clusters[i], clusters[j]), 9), i, j) for i in clusters for j in clusters if i < j)
        out.append((i, j, h))
        clusters[i] += clusters.pop(j)
    return out


@pytest.mark.parametrize("linkage", ["ward", "average", "complete"])
def test_agglomeration_equals_plain_linkage(spark, linkage):
    r = np.random.default_rng(2)
    base = r.normal(size=(80, 4))
    x = np.concatenate([base, base[:, :3] + 0.1 * r.normal(size=(80, 3)), 5 * r.normal(size=(80, 2))], axis=1)
    df = vectors(spark, x)
    model = N.FeatureAgglomeration(nClusters=4, linkage=linkage).fit(df)
    want = plain_linkage(x, linkage)
    assert [m[:2] for m in model.merges] == [m[:2] for m in want] and np.allclose([m[2] for m in model.merges], [m[2] for m in want])
    labels = model.getOrDefault("labels")
    assert labels[0] == labels[4] and labels[1] == labels[5] and max(labels) == 3
    out = model.transform(df)
    v = array(out, "features")
    assert np.allclose(array(out, "pooled"), np.stack([v[:, [k for k, c in enumerate(labels) if c == g]].mean(1) for g in range(4)], 1))


@pytest.mark.parametrize("loss", A.LOSSES)
def test_adaboost_weights_equal_a_plain_version(spark, loss, tmp_path):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(150, 2)), 1)
    y = np.round(np.sin(2 * x[:, 0]) + 0.3 * x[:, 1], 3)
    df = vectors(spark, x, y)
    model = A.AdaBoostR2(labelCol="y", rounds=3, maxDepth=2, learningRate=0.7, loss=loss).fit(df)
    rows = df.collect()
    w, weights = np.ones(len(rows)), []
    truth = np.array([q["y"] for q in rows])
    each = []
    for tree in model.trees:
        p = np.array([tree.predict(q["features"]) for q in rows])
        each.append(p)
        e = np.abs(truth - p)
        e = e / e.max()
        e = {"linear": e, "square": e ** 2, "exponential": 1 - np.exp(-e)}[loss]
        mean = (w * e).sum() / w.sum()
        beta = mean / (1 - mean)
        weights.append(0.7 * np.log(1 / beta))
        w = w * beta ** ((1 - e) * 0.7)
        w = w / w.sum() * len(rows)
    assert np.allclose(model.getOrDefault("weights"), weights)
    assert np.allclose(sorted(q["w"] for q in model.training.collect()), sorted(w))
    want = []
    for k in range(len(rows)):
        order = sorted(zip([p[k] for p in each], weights))
        total, run = sum(weights), 0.0
        for v, u in order:
            run += u
            if run >= total / 2:
                want.append(v)
                break
    got = [q["prediction"] for q in model.transform(df).collect()]
    assert np.allclose(got, want)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert np.allclose([q["prediction"] for q in A.AdaBoostR2Model.load(str(tmp_path / "m")).transform(df).collect()], got)


def test_adaboost_ends_on_perfect_and_hopeless_rounds(spark):
    x = np.arange(20.0)[:, None]
    one = A.AdaBoostR2(labelCol="y", rounds=5).fit(vectors(spark, x, (x[:, 0] > 9).astype(float)))
    assert len(one.trees) == 1
    flat = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0)], "a double, y double")
    none = A.AdaBoostR2(labelCol="y", rounds=5).fit(VectorAssembler(inputCols=["a"], outputCol="features").transform(flat))
    assert len(none.trees) == 1 and none.transform(VectorAssembler(inputCols=["a"], outputCol="features").transform(flat)).select(F.avg("prediction")).first()[0] == 0.5
