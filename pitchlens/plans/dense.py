"""Dense classifier with rectifiers and dropout, trained data-parallel.

The weights are broadcast; every task runs mini-batches of its own rows (Adam, with its own moments) for a few
epochs and returns its weights times its rows, cut into blocks; blocks are added by key, so what one task
merges is a block of all parts, and the driver gets the averaged weights (the model) alone.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_path

BLOCK = 1 << 16        # weights of a block
FAN_IN = 64            # parts that one task adds up
ROWS_PER_TASK = 20_000


class Network:
    """Weights of layers n0 -> n1 -> ... -> classes in one flat vector."""

    def __init__(self, sizes: list[int], flat: np.ndarray | None = None, seed: int = 0):
        self.sizes = list(sizes)
        if flat is None:
            rng = np.random.default_rng(seed)
            parts = []
            for a, b in zip(sizes, sizes[1:]):
                limit = np.sqrt(6.0 / (a + b))
                parts += [rng.uniform(-limit, limit, a * b), np.zeros(b)]
            flat = np.concatenate(parts)
        self.flat = flat

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, k = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((flat[k:k + a * b].reshape(a, b), flat[k + a * b:k + a * b + b]))
            k += a * b + b
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        layers = self.layers(self.flat)
        for k, (w, b) in enumerate(layers):
            x = x @ w + b
            if k < len(layers) - 1:
                x = np.maximum(x, 0.0)
        return x

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        s = self.scores(x)
        top = s.max(1)
        return float((np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(y)), y]).mean())

    def gradient(self, x: np.ndarray, y: np.ndarray, dropout: float = 0.0, rng=None) -> np.ndarray:
        """Of the mean cross-entropy; dropout leaves hidden units out and scales the others up."""
        layers = self.layers(self.flat)
        inputs, masks = [x], []
        for k, (w, b) in enumerate(layers):
            z = inputs[-1] @ w + b
            if k == len(layers) - 1:
                break
            mask = (z > 0) / 1.0
            if dropout:
                mask *= (rng.random(z.shape) >= dropout) / (1 - dropout)
            masks.append(mask)
            inputs.append(z * mask)
        e = np.exp(z - z.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1.0
        d /= len(y)
        out = np.zeros_like(self.flat)
        slots = self.layers(out)
        for k in range(len(layers) - 1, -1, -1):
            slots[k][0][...] = inputs[k].T @ d
            slots[k][1][...] = d.sum(0)
            if k:
                d = (d @ layers[k][0].T) * masks[k - 1]
        return out


class Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, flat: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        flat -= self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-7)


def _epochs(shared, sizes, epochs: int, batch: int, dropout: float, rate: float, seed: int, turn: int):
    """One task's rows -> its weights after some epochs, weighted by its rows, in blocks."""

    def run(frames):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        data = pd.concat(frames, ignore_index=True)
        x, y = np.stack(data["x"].to_numpy()).astype(float), data["label"].to_numpy().astype(int)
        net, part = Network(sizes, shared.value.copy()), TaskContext.get().partitionId()
        rng, adam = np.random.default_rng([seed, turn, part]), Adam(len(net.flat), rate)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                at = order[a:a + batch]
                adam.step(net.flat, net.gradient(x[at], y[at], dropout, rng))
        out = np.append(net.flat, 1.0) * len(y)
        for k in range(0, len(out), BLOCK):
            yield pd.DataFrame({"block": [k // BLOCK], "lane": [part // FAN_IN], "data": [out[k:k + BLOCK].tobytes()]})

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(d) for d in pdf["data"]], axis=0)
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "lane": pdf["lane"].iloc[:1] // FAN_IN, "data": [total.tobytes()]})


_PARTS = "block int, lane int, data binary"


def train(rows: DataFrame, sizes: list[int], epochs: int, batch: int = 1024, dropout: float = 0.5, rate: float = 1e-3, local_epochs: int = 10,
          seed: int = 42) -> Network:
    """Fit over (x array<double>, label int); the weights are averaged every ``local_epochs`` epochs."""
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        raise ValueError("no training rows")
    parts = max(1, n // ROWS_PER_TASK)
    table = cut(rows.select("x", F.col("label").cast("int").alias("label")).repartition(parts))
    net = Network(sizes, seed=seed)
    for turn, start in enumerate(range(0, epochs, local_epochs)):
        shared = spark.sparkContext.broadcast(net.flat)
        out = table.mapInPandas(_epochs(shared, sizes, min(local_epochs, epochs - start), batch, dropout, rate, seed, turn), _PARTS)
        left = parts
        while left > 1:
            left = -(-left // FAN_IN)
            out = out.groupBy("block", "lane").applyInPandas(_added, _PARTS)
        total = np.concatenate([np.frombuffer(r["data"]) for r in sorted(out.collect(), key=lambda r: r["block"])])
        net.flat = total[:-1] / total[-1]
        shared.unpersist()
    return net


class DenseClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Spark ML estimator over :func:`train`."""

    hidden = Param(Params._dummy(), "hidden", "units of the hidden layers", typeConverter=TypeConverters.toListInt)
    epochs = Param(Params._dummy(), "epochs", "passes over the rows", typeConverter=TypeConverters.toInt)
    batchSize = Param(Params._dummy(), "batchSize", "rows of a mini-batch", typeConverter=TypeConverters.toInt)
    dropout = Param(Params._dummy(), "dropout", "share of hidden units left out", typeConverter=TypeConverters.toFloat)
    learningRate = Param(Params._dummy(), "learningRate", "step size", typeConverter=TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", hidden=(256, 512), epochs=500, batchSize=1024, dropout=0.5,
                 learningRate=1e-3, seed=42):
        super().__init__()
        self._setDefault(hidden=[256, 512], epochs=500, batchSize=1024, dropout=0.5, learningRate=1e-3, seed=42)
        self._set(**{**self._input_kwargs, **({"hidden": list(self._input_kwargs["hidden"])} if "hidden" in self._input_kwargs else {})})

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setPredictionCol(self, v):
        return self._set(predictionCol=v)

    def _fit(self, df: DataFrame) -> "DenseModel":
        get = self.getOrDefault
        rows = df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("int").alias("label"))
        top = rows.agg(F.max(F.size("x")).alias("n"), F.max("label").alias("c")).first()
        if top["n"] is None:
            raise ValueError("no training rows")
        net = train(rows, [top["n"], *get(self.hidden), top["c"] + 1], get(self.epochs), get(self.batchSize), get(self.dropout), get(self.learningRate),
                    seed=get(self.seed))
        path = shared_path(df.sparkSession, f"networks/{uuid.uuid4().hex}")
        _weights(df.sparkSession, net).write.parquet(path)
        model = DenseModel(path, net.sizes)
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


def _weights(spark, net: Network) -> DataFrame:
    return spark.createDataFrame([(k // BLOCK, bytearray(net.flat[k:k + BLOCK].tobytes())) for k in range(0, len(net.flat), BLOCK)], "block int, data binary")


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.table().write.parquet(f"{path}/weights")


class _Reader(DefaultParamsReader):
    def load(self, path: str):
        return super().load(path)._set(weightsPath=f"{path}/weights")


class DenseModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    weightsPath = Param(Params._dummy(), "weightsPath", "folder of the weight table", typeConverter=TypeConverters.toString)
    sizes = Param(Params._dummy(), "sizes", "units of all layers", typeConverter=TypeConverters.toListInt)

    def __init__(self, path: str | None = None, sizes=None):
        super().__init__()
        if path is not None:
            self._set(weightsPath=path, sizes=[int(v) for v in sizes])

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)

    def table(self) -> DataFrame:
        from pyspark.sql import SparkSession

        return (SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()).read.parquet(self.getOrDefault(self.weightsPath))

    def network(self) -> Network:
        return Network(self.getOrDefault(self.sizes), np.concatenate([np.frombuffer(r["data"]) for r in self.table().orderBy("block").collect()]))

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.network())

        def best(v: pd.Series) -> pd.Series:
            return pd.Series(shared.value.scores(np.stack(v.to_numpy()).astype(float)).argmax(1).astype(float)) if len(v) else pd.Series([], dtype=float)

        return df.withColumn(self.getPredictionCol(), F.pandas_udf(best, "double")(vector_to_array(F.col(self.getFeaturesCol()))))
