"""Kernel maps and feature agglomeration of the search space, as Spark ML stages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import PRIME, draw

KERNELS = ("rbf", "laplacian", "polynomial", "linear", "cosine", "sigmoid")


def fourier_weights(dim: int, n: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x dim frequencies, n phases) of random Fourier features of the RBF kernel, from a keyed hash."""
    c, f = np.arange(n)[:, None], np.arange(dim)
    u1, u2 = ((draw(seed, salt, c, f, 0) + 1) / (PRIME + 1) for salt in (4, 5))
    w = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2) * np.sqrt(2 * gamma)
    return w, 2 * np.pi * draw(seed, 6, np.arange(n), 0, 0) / PRIME


class RandomFourier(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features: inner products approach exp(-gamma |x - y|^2). One column expression, no Python."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", typeConverter=TypeConverters.toFloat)
    nComponents = Param(Params._dummy(), "nComponents", "number of features", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)
    dim = Param(Params._dummy(), "dim", "length of the input vectors", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="fourier", gamma=1.0, nComponents=100, seed=42, dim=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier", gamma=1.0, nComponents=100, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        n = self.getOrDefault(self.nComponents)
        if not self.isSet(self.dim):
            first = df.select(F.size(vector_to_array(self.getInputCol()))).first()
            self._set(dim=first[0] if first else 1)
        w, b = fourier_weights(self.getOrDefault(self.dim), n, self.getOrDefault(self.gamma), self.getOrDefault(self.seed))
        rows = F.array(*[F.struct(F.lit([float(v) for v in r]).alias("w"), F.lit(float(p)).alias("b")) for r, p in zip(w, b)])
        x = vector_to_array(F.col(self.getInputCol()))
        dot = lambda r: F.aggregate(F.zip_with(x, r["w"], lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        z = F.transform(rows, lambda r: F.cos(dot(r) + r["b"]) * float(np.sqrt(2.0 / n)))
        return df.withColumn(self.getOutputCol(), array_to_vector(z).alias(self.getOutputCol(), metadata={"ml_attr": {"num_attrs": n}}))


def kernel(x: np.ndarray, y: np.ndarray, name: str, gamma: float, degree: float, coef0: float) -> np.ndarray:
    if name == "laplacian":
        return np.exp(-gamma * np.abs(x[:, None, :] - y).sum(-1))
    dot = x @ y.T
    if name == "rbf":
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * dot, 0.0))
    if name == "cosine":
        return dot / np.maximum(np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1)), 1e-300)
    if name == "polynomial":
        return (gamma * dot + coef0) ** degree
    if name == "sigmoid":
        return np.tanh(gamma * dot + coef0)
    if name == "linear":
        return dot
    raise ValueError(f"unknown kernel {name!r}")


class _NystroemParams(HasInputCol, HasOutputCol):
    kernel = Param(Params._dummy(), "kernel", "one of " + ", ".join(KERNELS), typeConverter=TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel coefficient", typeConverter=TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "degree of the polynomial kernel", typeConverter=TypeConverters.toFloat)
    coef0 = Param(Params._dummy(), "coef0", "constant of the polynomial and sigmoid kernels", typeConverter=TypeConverters.toFloat)


class Nystroem(Estimator, _NystroemParams, DefaultParamsReadable, DefaultParamsWritable):
    """Kernel map from landmarks: the centres of a distributed k-means (k-means|| start), whose kernel matrix (as large as
    the landmarks, a parameter) is turned on the driver."""

    nComponents = Param(Params._dummy(), "nComponents", "number of landmarks", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="nystroem", kernel="rbf", gamma=1.0, degree=3.0, coef0=1.0, nComponents=10, seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="nystroem", kernel="rbf", gamma=1.0, degree=3.0, coef0=1.0, nComponents=10, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "NystroemModel":
        get = self.getOrDefault
        centres = KMeans(featuresCol=self.getInputCol(), k=max(2, get(self.nComponents)), seed=get(self.seed), maxIter=10).fit(
            df.select(self.getInputCol())).clusterCenters()
        marks = np.array(centres, float)[:get(self.nComponents)]
        k = kernel(marks, marks, get(self.kernel), get(self.gamma), get(self.degree), get(self.coef0))
        value, vector = np.linalg.eigh((k + k.T) / 2)
        value = np.where(value > 1e-12 * max(value.max(), 1e-300), value, np.inf)     # directions without mass map to 0
        model = NystroemModel(marks, vector / np.sqrt(value) @ vector.T)
        model._set(**{p: get(p) for p in ("inputCol", "outputCol", "kernel", "gamma", "degree", "coef0")})
        return model


class NystroemModel(Model, _NystroemParams, DefaultParamsReadable, DefaultParamsWritable):
    landmarks = Param(Params._dummy(), "landmarks", "landmarks, row-major", typeConverter=TypeConverters.toListFloat)
    turning = Param(Params._dummy(), "turning", "inverse root of the landmarks' kernel, row-major", typeConverter=TypeConverters.toListFloat)
    nComponents = Param(Params._dummy(), "nComponents", "number of landmarks", typeConverter=TypeConverters.toInt)

    def __init__(self, marks=None, turning=None):
        super().__init__()
        if marks is not None:
            self._set(landmarks=[float(v) for v in marks.ravel()], turning=[float(v) for v in turning.ravel()], nComponents=len(marks))

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        n = get(self.nComponents)
        marks, turn = np.reshape(get(self.landmarks), (n, -1)), np.reshape(get(self.turning), (n, n))
        how = get(self.kernel), get(self.gamma), get(self.degree), get(self.coef0)

        def project(v: pd.Series) -> pd.Series:
            return pd.Series(list(kernel(np.stack(v.to_numpy()).astype(float), marks, *how) @ turn)) if len(v) else v

        arr = F.pandas_udf(project, "array<double>")(vector_to_array(F.col(self.getInputCol())))
        return df.withColumn(self.getOutputCol(), array_to_vector(arr).alias(self.getOutputCol(), metadata={"ml_attr": {"num_attrs": n}}))


def merge_order(d2: np.ndarray, linkage: str = "ward") -> list[tuple[int, int, float]]:
    """Agglomeration of points from their squared distances: (cluster, cluster, height) merges, clusters named by their
    smallest point; of equal heights the smallest names go first."""
    n = len(d2)
    d = {(i, j): (d2[i, j] if linkage == "ward" else np.sqrt(d2[i, j])) for i in range(n) for j in range(i + 1, n)}
    size, out = dict.fromkeys(range(n), 1), []
    while len(size) > 1:
        (i, j), h = min(d.items(), key=lambda kv: (round(kv[1], 9), kv[0]))
        out.append((i, j, float(np.sqrt(h)) if linkage == "ward" else float(h)))
        for k in list(size):
            if k in (i, j):
                continue
            a, b = d.pop((min(i, k), max(i, k))), d.pop((min(j, k), max(j, k)))
            if linkage == "ward":
                t = size[i] + size[j] + size[k]
                new = ((size[i] + size[k]) * a + (size[j] + size[k]) * b - size[k] * h) / t
            elif linkage == "average":
                new = (size[i] * a + size[j] * b) / (size[i] + size[j])
            elif linkage == "complete":
                new = max(a, b)
            else:
                raise ValueError(f"unknown linkage {linkage!r}")
            d[min(i, k), max(i, k)] = new
        d.pop((i, j))
        size[i] += size.pop(j)
    return out


def cut_tree(merges: list[tuple[int, int, float]], n: int, n_clusters: int) -> list[int]:
    """Cluster of each point (numbered by smallest point) after the first n - n_clusters merges."""
    root = list(range(n))
    for i, j, _ in merges[:max(0, n - n_clusters)]:
        root = [i if r == j else r for r in root]
    names = sorted(set(root))
    return [names.index(r) for r in root]


class FeatureAgglomeration(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Columns that run together become their mean. One distributed aggregate gives the columns' inner products; their
    distances (columns x columns) are linked on the driver."""

    nClusters = Param(Params._dummy(), "nClusters", "number of pooled features", typeConverter=TypeConverters.toInt)
    linkage = Param(Params._dummy(), "linkage", "ward, average or complete", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="pooled", nClusters=2, linkage="ward"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="pooled", nClusters=2, linkage="ward")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "FeatureAgglomerationModel":
        from .models import _partial_sum

        x = df.select(vector_to_array(F.col(self.getInputCol())).alias("x"))
        n = x.select(F.size("x")).first()[0]
        dots = _partial_sum(x, lambda a: a.T @ a, (n, n))
        d2 = np.maximum(np.diag(dots)[:, None] + np.diag(dots) - 2 * dots, 0.0)
        merges = merge_order(d2, self.getOrDefault(self.linkage))
        model = FeatureAgglomerationModel(cut_tree(merges, n, self.getOrDefault(self.nClusters)))
        model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        model.merges = merges
        return model


class FeatureAgglomerationModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    labels = Param(Params._dummy(), "labels", "pooled feature of each column", typeConverter=TypeConverters.toListInt)
    merges: list = []

    def __init__(self, labels=None):
        super().__init__()
        if labels is not None:
            self._set(labels=[int(v) for v in labels])

    def _transform(self, df: DataFrame) -> DataFrame:
        labels = self.getOrDefault(self.labels)
        x = vector_to_array(F.col(self.getInputCol()))
        groups = [[k for k, c in enumerate(labels) if c == g] for g in range(max(labels) + 1)]
        pooled = F.array(*[sum((x[k] for k in g[1:]), x[g[0]]) / float(len(g)) for g in groups])
        return df.withColumn(self.getOutputCol(), array_to_vector(pooled).alias(self.getOutputCol(), metadata={"ml_attr": {"num_attrs": len(groups)}}))
