"""AdaBoost.R2: reweighting rounds over a table, weighted median of the trees' predictions per row."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

LOSSES = ("linear", "square", "exponential")


def weighted_median(pairs: Column) -> Column:
    """The value at which the weights of the sorted (value, weight) structs reach half of their sum."""
    ordered = F.array_sort(pairs)
    half = F.aggregate(ordered, F.lit(0.0), lambda s, p: s + p["w"]) / 2
    run = F.aggregate(ordered, F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("v")), lambda s, p: F.struct(
        (s["w"] + p["w"]).alias("w"), F.when(s["v"].isNull() & (s["w"] + p["w"] >= half), p["v"]).otherwise(s["v"]).alias("v")))
    return run["v"]


class AdaBoostR2(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Trees of bounded depth, each fitted with the rows' weights (no resampling); a row's weight falls with how well
    the last tree predicts it. Rounds end early at an average loss of a half or of 0. The weights are a column
    of the training table, which is written anew each round."""

    rounds = Param(Params._dummy(), "rounds", "trees at most", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", typeConverter=TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "power of the reweighting", typeConverter=TypeConverters.toFloat)
    loss = Param(Params._dummy(), "loss", "linear, square or exponential", typeConverter=TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", rounds=50, maxDepth=3, learningRate=1.0, loss="linear", seed=42):
        super().__init__()
        self._setDefault(rounds=50, maxDepth=3, learningRate=1.0, loss="linear", seed=42)
        self._set(**self._input_kwargs)

    def setFeaturesCol(self, v):
        return self._set(featuresCol=v)

    def setLabelCol(self, v):
        return self._set(labelCol=v)

    def setPredictionCol(self, v):
        return self._set(predictionCol=v)

    def _fit(self, df: DataFrame) -> "AdaBoostR2Model":
        get = self.getOrDefault
        if get(self.loss) not in LOSSES:
            raise ValueError(f"unknown loss {get(self.loss)!r}")
        rows = cut(df.select(F.col(self.getFeaturesCol()).alias("f"), F.col(self.getLabelCol()).cast("double").alias("y"), F.lit(1.0).alias("w")))
        trees, weights = [], []
        for _ in range(get(self.rounds)):
            tree = DecisionTreeRegressor(featuresCol="f", labelCol="y", weightCol="w", predictionCol="p", maxDepth=get(self.maxDepth),
                                         seed=get(self.seed)).fit(rows)
            scored = tree.transform(rows).select("f", "y", "w", F.abs(F.col("y") - F.col("p")).alias("e"))
            top = scored.agg(F.max("e")).first()[0] or 0.0
            e = F.col("e") / top if top > 0 else F.lit(0.0)
            e = {"linear": e, "square": e * e, "exponential": 1 - F.exp(-e)}[get(self.loss)]
            scored = scored.withColumn("e", e)
            sums = scored.agg(F.sum(F.col("w") * F.col("e")).alias("loss"), F.sum("w").alias("w")).first()
            mean = (sums["loss"] or 0.0) / sums["w"]
            if mean <= 0:
                trees.append(tree)
                weights.append(1.0)
                break
            if mean >= 0.5:
                if not trees:
                    trees.append(tree)
                    weights.append(1.0)
                break
            beta = mean / (1 - mean)
            trees.append(tree)
            weights.append(get(self.learningRate) * math.log(1 / beta))
            new = F.col("w") * F.pow(F.lit(beta), (1 - F.col("e")) * get(self.learningRate))
            rows = scored.select("f", "y", new.alias("w"))
            total = rows.agg(F.sum("w")).first()[0]
            rows = cut(rows.withColumn("w", F.col("w") / total * sums["w"]))
        model = AdaBoostR2Model(trees, weights)
        model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        model.training = rows
        return model


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for k, t in enumerate(self.instance.trees):
            t.write().save(f"{path}/trees/{k}")


class _Reader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model.trees = [DecisionTreeRegressionModel.load(f"{path}/trees/{k}") for k in range(len(model.getOrDefault(model.weights)))]
        return model


class AdaBoostR2Model(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "weight of each tree", typeConverter=TypeConverters.toListFloat)
    training: DataFrame | None = None

    def __init__(self, trees=None, weights=None):
        super().__init__()
        self.trees = list(trees or [])
        if weights is not None:
            self._set(weights=weights)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [f"_r2_{k}" for k in range(len(self.trees))]
        out = df
        for name, tree in zip(names, self.trees):
            out = tree.setFeaturesCol(self.getFeaturesCol()).setPredictionCol(name).transform(out)
        pairs = F.array(*[F.struct(F.col(n).alias("v"), F.lit(float(w)).alias("w")) for n, w in zip(names, self.getOrDefault(self.weights))])
        return out.withColumn(self.getPredictionCol(), weighted_median(pairs)).drop(*names)
