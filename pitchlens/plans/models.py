"""Model stages (Spark ML) of the three prediction problems.

* :func:`make_estimator` builds a *fresh* estimator per call from a model
  type and scikit-learn style hyper-parameters (mapped to MLlib names).
* :class:`Modeler` wraps ``VectorAssembler -> [StringIndexer] -> estimator
  [-> IndexToString]`` with fit / predict / save / load.
* Custom stages: :class:`ZeroCount` (zeros / non-zeros per row) and
  :class:`FastICA` (whitening from one covariance aggregate, then one
  distributed aggregate per fixed-point step).
* :func:`random_search` draws parameter maps from a grid and cross-validates
  them; :func:`size_sweep` fits a grid of forest sizes and records accuracy
  and model size on disk.

Training data never passes through the driver: fitting is MLlib's
distributed tree/optimizer code; only model parameters come back.
"""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as MC
from pyspark.ml import feature as MF
from pyspark.ml import regression as MR
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .adaboost import AdaBoostR2
from .boosting import GradientBoosting
from .dense import DenseClassifier
from .forests import RandomForest
from .kernels import FeatureAgglomeration, Nystroem, RandomFourier
from .trees import ExtraTreesClassifier

CLASSIFIERS = {"rf_classif", "et_classif", "xgb_classif", "xgb_multiclass", "logistic", "dt_classif", "mlp",
               "naive_bayes", "dense"}
REGRESSORS = {"rf_reg", "xgb_reg", "dt_reg", "linear", "elastic_net", "ridge", "ada_reg"}


def zero_count_cols(cols: Sequence[str]) -> list[Column]:
    """Per row: how many of ``cols`` are exactly 0, and how many are not (NULL counts as non-zero)."""
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    n_zero = F.size(F.filter(arr, lambda v: v == 0.0)).cast("int")
    return [n_zero.alias("n_zero"), (F.lit(len(cols)) - n_zero).cast("int").alias("n_nonzero")]


# ---- estimator factory ------------------------------------------------------------------------------

def _feature_subset(v) -> str:
    if v is None:
        return "all"
    if isinstance(v, str):
        return v
    if isinstance(v, float):
        return str(v)
    return str(int(v))


MAX_DEPTH = 30   # the deepest tree MLlib grows

#: Parameters without a counterpart that changes an MLlib fit; every other unknown name is an error.
IGNORED_PARAMS = {"n_jobs", "nthread", "verbose", "silent", "objective", "eval_metric", "booster", "warm_start", "presort",
                  "tree_method", "oob_score", "solver", "multi_class", "num_class"}
_FOREST, _TREE = {"rf_classif", "rf_reg"}, {"dt_classif", "dt_reg"}


def _depth(v) -> int:
    if v is not None and int(v) > MAX_DEPTH:
        raise ValueError(f"max_depth {v}: MLlib grows trees of depth {MAX_DEPTH} at most")
    return MAX_DEPTH if v is None else int(v)


def make_estimator(model_type: str, params: dict | None = None, n_classes: int | None = None):
    """A new MLlib estimator for a model type, with scikit-learn style parameters.

    ``rf_classif`` / ``rf_reg`` are this package's random forests, with MLlib's parameter names; ``et_classif`` is this package's extra-trees, ``xgb_classif`` / ``xgb_reg`` its second-order
    boosting (any number of classes in one fit; ``reg_lambda``, ``reg_alpha``, ``gamma`` and
    ``min_child_weight`` as hessian mass); ``xgb_multiclass`` is one-vs-rest over MLlib's binary boosting.

    MLlib mapping: ``n_estimators`` -> ``numTrees`` (forests) / ``maxIter`` (boosting),
    ``max_depth`` -> ``maxDepth`` (forests and trees: absent or None means unlimited, in
    MLlib 30; more is an error; boosting: absent means 6), ``max_features`` ->
    ``featureSubsetStrategy`` (absent in a regression forest: all),
    ``criterion`` -> ``impurity`` (classifiers only), ``learning_rate`` -> ``stepSize``,
    ``subsample`` -> ``subsamplingRate``, ``min_samples_leaf`` -> ``minInstancesPerNode``
    (``min_samples_split`` must not ask for more than its two children have anyway),
    ``bootstrap`` -> ``bootstrap``, ``alpha`` -> ``regParam``, ``l1_ratio`` -> ``elasticNetParam``,
    ``C`` (logistic) -> ``regParam`` = 1 / (C * rows), set by ``Modeler.fit``. ``IGNORED_PARAMS``
    do not change a fit; MLlib's own names pass through; any other name raises ``ValueError``.
    """
    p = dict(params or {})
    if model_type == "et_classif":
        return _extra_trees(p)
    if model_type in ("dense", "ada_reg"):
        return _own(model_type, p)
    if model_type in ("xgb_classif", "xgb_reg"):
        return _boosting(p, "regression" if model_type == "xgb_reg" else "classification")
    kw: dict = {"seed": p.pop("random_state", 42)} if model_type not in ("linear", "elastic_net", "ridge",
                                                                         "naive_bayes", "logistic") else {}
    if "n_estimators" in p:
        key = "maxIter" if model_type.startswith("xgb") else "numTrees"
        kw[key] = int(p.pop("n_estimators"))
    if "max_depth" in p or model_type in _FOREST | _TREE and "maxDepth" not in p:
        kw["maxDepth"] = _depth(p.pop("max_depth", None))
    elif model_type == "xgb_multiclass" and "maxDepth" not in p:
        kw["maxDepth"] = 6
    if "max_features" in p and model_type in _FOREST:
        kw["featureSubsetStrategy"] = _feature_subset(p.pop("max_features"))
    if model_type == "rf_reg" and "featureSubsetStrategy" not in p:
        kw.setdefault("featureSubsetStrategy", "all")
    if "alpha" in p and model_type in ("elastic_net", "ridge"):
        kw["regParam"] = float(p.pop("alpha"))
    if "l1_ratio" in p and model_type == "elastic_net":
        kw["elasticNetParam"] = float(p.pop("l1_ratio"))
    strength = float(p.pop("C", 1.0)) if model_type == "logistic" else None
    if "criterion" in p:
        crit = p.pop("criterion")
        if model_type in ("rf_classif", "dt_classif"):
            kw["impurity"] = crit
    if "learning_rate" in p:
        kw["stepSize"] = float(p.pop("learning_rate"))
    if "subsample" in p:
        kw["subsamplingRate"] = float(p.pop("subsample"))
    if model_type in _FOREST | _TREE and int(p.get("min_samples_split", 2)) <= 2 * int(p.get("min_samples_leaf", 1)):
        p.pop("min_samples_split", None)
    if "min_samples_leaf" in p:
        kw["minInstancesPerNode"] = int(p.pop("min_samples_leaf"))
    if "bootstrap" in p:
        kw["bootstrap"] = bool(p.pop("bootstrap"))
    est = _build(model_type, kw)
    for k, v in p.items():
        if "_" not in k and est.hasParam(k):
            est._set(**{k: v})
        elif k not in IGNORED_PARAMS:
            raise ValueError(f"{model_type}: parameter {k!r} has no MLlib counterpart")
    if strength is not None and "regParam" not in p:
        est.inverse_strength = strength   # 1 / (C * rows) needs the number of rows: Modeler.fit
    return est


def _extra_trees(p: dict) -> ExtraTreesClassifier:
    """Extra-trees of this package (MLlib has no random thresholds): any depth, any number of classes."""
    if p.pop("bootstrap", False):
        raise ValueError("et_classif: bootstrap is not supported, every tree sees all rows")
    depth, features = p.pop("max_depth", None), p.pop("max_features", "sqrt")
    est = ExtraTreesClassifier(numTrees=int(p.pop("n_estimators", 100)), maxDepth=-1 if depth is None else int(depth),
                               maxFeatures=_feature_subset(features), impurity=p.pop("criterion", "gini"),
                               minInstancesPerNode=int(p.pop("min_samples_leaf", 1)),
                               minInstancesPerSplit=int(p.pop("min_samples_split", 2)), seed=int(p.pop("random_state", 42)))
    for k in p:
        if k not in IGNORED_PARAMS:
            raise ValueError(f"et_classif: unknown parameter {k!r}")
    return est


def _own(model_type: str, p: dict):
    """Dense network and AdaBoost.R2 of this package, by scikit-learn style names."""
    names = {"dense": {"hidden": "hidden", "epochs": "epochs", "batch_size": "batchSize", "dropout": "dropout", "learning_rate": "learningRate",
                       "random_state": "seed"},
             "ada_reg": {"n_estimators": "rounds", "max_depth": "maxDepth", "learning_rate": "learningRate", "loss": "loss", "random_state": "seed"}}[model_type]
    for k in p:
        if k not in names and k not in IGNORED_PARAMS:
            raise ValueError(f"{model_type}: unknown parameter {k!r}")
    return (DenseClassifier if model_type == "dense" else AdaBoostR2)(**{names[k]: v for k, v in p.items() if k in names})


def _boosting(p: dict, task: str) -> GradientBoosting:
    names = {"n_estimators": ("rounds", int), "max_depth": ("maxDepth", int), "learning_rate": ("learningRate", float),
             "reg_lambda": ("regLambda", float), "reg_alpha": ("regAlpha", float), "gamma": ("gamma", float),
             "min_child_weight": ("minChildWeight", float), "subsample": ("subsample", float), "colsample_bytree": ("colsample", float),
             "max_bin": ("maxBins", int), "random_state": ("seed", int)}
    est = GradientBoosting(task=task, **{names[k][0]: names[k][1](p.pop(k)) for k in list(p) if k in names})
    if float(p.pop("scale_pos_weight", 1)) != 1:
        raise ValueError("boosting: scale_pos_weight other than 1 is not supported")
    for k in p:
        if k not in IGNORED_PARAMS:
            raise ValueError(f"boosting: unknown parameter {k!r}")
    return est


def _build(model_type: str, kw: dict, n_classes: int | None = None):
    if model_type == "rf_classif":
        return RandomForest(task="classification", **kw)
    if model_type == "rf_reg":
        return RandomForest(task="regression", **kw)
    if model_type == "xgb_multiclass":
        # the binary models of the classes are independent: fit several at once
        return MC.OneVsRest(classifier=MC.GBTClassifier(**kw), parallelism=4)
    if model_type == "dt_classif":
        return MC.DecisionTreeClassifier(**kw)
    if model_type == "dt_reg":
        return MR.DecisionTreeRegressor(**kw)
    if model_type == "logistic":
        return MC.LogisticRegression(**kw)
    if model_type == "naive_bayes":
        kw.setdefault("modelType", "gaussian")
        return MC.NaiveBayes(**kw)
    if model_type == "mlp":
        return MC.MultilayerPerceptronClassifier(**kw)
    if model_type == "linear":
        return MR.LinearRegression(**kw)
    if model_type == "elastic_net":
        kw.setdefault("elasticNetParam", 0.5)
        return MR.LinearRegression(**kw)
    if model_type == "ridge":
        kw.setdefault("elasticNetParam", 0.0)
        return MR.LinearRegression(**kw)
    raise ValueError(f"unknown model type {model_type!r}")


class Modeler:
    """Features -> model for one target; classification targets are indexed and mapped back.

    ``predict`` returns the input rows with a ``prediction`` column in the
    target's own values (player ids, team ids or coordinates).
    """

    def __init__(self, model_type: str, hyperparameters: dict | None, target: str, features: Sequence[str],
                 pre_stages: Sequence = (), n_classes: int | None = None):
        self.model_type = model_type
        self.params = dict(hyperparameters or {})
        self.target = target
        self.features = list(features)
        self.pre_stages = list(pre_stages)
        self.n_classes = n_classes
        self.model: PipelineModel | None = None

    @property
    def is_classifier(self) -> bool:
        return self.model_type in CLASSIFIERS

    def pipeline(self, estimator=None) -> Pipeline:
        """pre-stages -> assembler -> estimator (reads ``features`` / ``label``)."""
        est = estimator or make_estimator(self.model_type, self.params, self.n_classes)
        pred = "_pred_index" if self.is_classifier else "prediction"
        est.setFeaturesCol("features").setLabelCol("label").setPredictionCol(pred)
        assembler = MF.VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="error")
        return Pipeline(stages=[*self.pre_stages, assembler, est])

    def _labelled(self, df: DataFrame) -> DataFrame:
        """Training rows with a numeric ``label`` (class index, or the target value)."""
        if not self.is_classifier:
            return df.withColumn("label", F.col(self.target).cast("double"))
        if self.indexer is None:
            self.indexer = MF.StringIndexer(inputCol="_target_str", outputCol="label",
                                            stringOrderType="alphabetAsc").fit(
                df.select(F.col(self.target).cast("string").alias("_target_str")))
        return self.indexer.transform(df.withColumn("_target_str", F.col(self.target).cast("string"))) \
            .drop("_target_str")

    indexer = None
    target_type: str | None = None   # of the training rows; a loaded classifier goes by its labels

    def fit(self, training: DataFrame) -> "Modeler":
        """Fit on ``training``; the labelled rows are persisted for the many passes of the fit."""
        data = self._labelled(training).persist(StorageLevel.MEMORY_AND_DISK)
        self.target_type = training.schema[self.target].dataType.simpleString()
        try:
            pipe = self.pipeline()
            weak = [s for s in pipe.getStages() if hasattr(s, "inverse_strength")]
            if weak:
                rows = data.count()
                for s in weak:
                    s.setRegParam(1.0 / (s.inverse_strength * max(rows, 1)))
            self.model = pipe.fit(data)
        finally:
            data.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` with ``prediction`` in the target's own values."""
        if self.model is None:
            raise ValueError("fit or load a model first")
        out = self.model.transform(df)
        if self.is_classifier:
            out = MF.IndexToString(inputCol="_pred_index", outputCol="_pred_label",
                                   labels=self.indexer.labels).transform(out)
            whole = all(x.lstrip("-").isdigit() for x in self.indexer.labels)
            kind = self.target_type or ("bigint" if whole else "double")
            out = out.withColumn("prediction", F.col("_pred_label").cast(kind)).drop("_pred_label", "_pred_index")
        drop = [c for c in ("features", "label", "rawPrediction", "probability") if c in out.columns]
        return out.drop(*drop)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        if self.indexer is not None:
            self.indexer.write().overwrite().save(f"{path}/labels")

    def load(self, path: str) -> "Modeler":
        self.model = PipelineModel.load(f"{path}/model")
        if self.is_classifier:
            self.indexer = MF.StringIndexerModel.load(f"{path}/labels")
        return self


# ---- stacking and feature union ------------------------------------------------------------------------

def stacking_stages(estimators: Sequence, features_col: str = "features") -> list:
    """Stacked classifiers: each model's prediction and probabilities become extra inputs of the next.

    Returns pipeline stages; the final estimator should read ``features_col``.
    """
    stages = []
    cur = features_col
    for i, est in enumerate(estimators):
        pred, prob, raw = f"_s{i}_pred", f"_s{i}_prob", f"_s{i}_raw"
        est.setFeaturesCol(cur).setPredictionCol(pred)
        if hasattr(est, "setProbabilityCol"):
            est.setProbabilityCol(prob).setRawPredictionCol(raw)
        stages.append(est)
        nxt = f"_s{i}_features"
        extra = [pred] + ([prob] if hasattr(est, "setProbabilityCol") else [])
        stages.append(MF.VectorAssembler(inputCols=[*extra, cur], outputCol=nxt))
        cur = nxt
    stages.append(MF.SQLTransformer(statement=f"SELECT *, `{cur}` AS `{features_col}_stacked` FROM __THIS__"))
    return stages


def feature_union(branches: Sequence[str], output: str = "features") -> MF.VectorAssembler:
    """Concatenate vector branches (e.g. ICA output next to an identity copy of the input)."""
    return MF.VectorAssembler(inputCols=list(branches), outputCol=output)


# ---- custom stages -------------------------------------------------------------------------------------

class ZeroCount(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Append ``n_zero`` and ``n_nonzero``: how many input columns are 0 in each row."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *zero_count_cols(self.getInputCols()))


class FastICA(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Independent components (logcosh contrast, symmetric decorrelation).

    Fit: one ``Summarizer``-style aggregate gives mean and covariance (small
    k x k matrix) -> whitening by eigen-decomposition on the driver -> each
    fixed-point step is one distributed aggregate of ``E[z g(Wz)^T]`` and
    ``E[g'(Wz)]`` over the data (``mapInPandas`` partial sums, then a sum),
    until ``max |diag(W_new W^T)| - 1| < tol``. Transform: Arrow-batched matrix
    product per partition.
    """

    nComponents = Param(Params._dummy(), "nComponents", "number of components (None: all)",
                        typeConverter=TypeConverters.identity)
    tol = Param(Params._dummy(), "tol", "convergence tolerance", typeConverter=TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "max fixed-point steps", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)
    minVariance = Param(Params._dummy(), "minVariance", "smallest eigenvalue kept, relative to the largest",
                        typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="ica", nComponents=None, tol=1e-4, maxIter=200, seed=42,
                 minVariance=1e-10):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="ica", nComponents=None, tol=1e-4, maxIter=200, seed=42,
                         minVariance=1e-10)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "FastICAModel":
        # the fixed-point loop passes over the data many times: keep the (narrow) input persisted
        x = df.select(vector_to_array(F.col(self.getInputCol())).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit_persisted(x)
        finally:
            x.unpersist()

    def _fit_persisted(self, x: DataFrame) -> "FastICAModel":
        d = int(x.select(F.size("x")).first()[0])
        sums = _partial_sum(x, lambda a: np.append(a.sum(axis=0), len(a)), (d + 1,))
        n_rows = int(sums[d])
        mean = sums[:d] / max(n_rows, 1)
        cov = _partial_sum(x, lambda a: (a - mean).T @ (a - mean), (d, d)) / max(n_rows - 1, 1)
        eigval, eigvec = np.linalg.eigh(cov)
        order = np.argsort(eigval)[::-1]
        eigval, eigvec = eigval[order], eigvec[:, order]
        # directions without variance have no component: below minVariance of the largest eigenvalue
        rank = int((eigval > max(eigval[0], 0.0) * self.getOrDefault(self.minVariance)).sum()) or 1
        k = min(self.getOrDefault(self.nComponents) or d, rank)
        eigval, eigvec = eigval[:k], eigvec[:, :k]
        eigval = np.maximum(eigval, 1e-12)
        whiten = eigvec / np.sqrt(eigval)                      # d x k
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        w = _sym_decorrelate(rng.standard_normal((k, k)))
        tol, max_iter = self.getOrDefault(self.tol), self.getOrDefault(self.maxIter)
        for _ in range(max_iter):
            def step(a, w=w):
                z = (a - mean) @ whiten                         # rows x k
                wx = z @ w.T
                g = np.tanh(wx)
                gp = 1.0 - g * g
                return np.concatenate([(g.T @ z).ravel(), gp.sum(axis=0)])
            acc = _partial_sum(x, step, (k * k + k,))
            gz = acc[: k * k].reshape(k, k) / n_rows
            gpm = acc[k * k:] / n_rows
            w_new = _sym_decorrelate(gz - gpm[:, None] * w)
            lim = np.max(np.abs(np.abs(np.einsum("ij,ij->i", w_new, w)) - 1.0))
            w = w_new
            if lim < tol:
                break
        model = FastICAModel(mean=mean, unmixing=(whiten @ w.T))
        model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        return model


LANES = 64   # arrays that meet on the driver per step


def _sym_decorrelate(w: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(w @ w.T)
    s = np.maximum(s, 1e-12)
    return (u * (1.0 / np.sqrt(s))) @ u.T @ w


def _partial_sum(x: DataFrame, fn, shape) -> np.ndarray:
    """Sum ``fn(rows as a matrix)`` over all partitions, as a tree.

    Each task reduces its rows to one small array, ``LANES`` tasks add those up, and only
    their sums (at most ``LANES`` arrays, whatever the partition count) reach the driver.
    """
    size = int(np.prod(shape))

    def part(it):
        acc = np.zeros(size)
        for pdf in it:
            if len(pdf):
                a = np.stack(pdf["x"].to_numpy()).astype(float)
                acc += np.asarray(fn(a)).ravel()
        yield pd.DataFrame({"lane": [TaskContext.get().partitionId() % LANES], "p": [acc.tolist()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lane": pdf["lane"].iloc[:1], "p": [np.sum(np.stack(pdf["p"].to_numpy()), axis=0).tolist()]})

    lanes = "lane int, p array<double>"
    parts = x.mapInPandas(part, schema=lanes).groupBy("lane").applyInPandas(add, schema=lanes).collect()
    total = np.zeros(size)
    for r in parts:
        total += np.asarray(r.p)
    return total.reshape(shape)


class FastICAModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted components: ``(x - mean) @ unmixing``; the arrays are Params so the model saves with a pipeline."""

    meanVector = Param(Params._dummy(), "meanVector", "training mean", typeConverter=TypeConverters.toListFloat)
    unmixingFlat = Param(Params._dummy(), "unmixingFlat", "unmixing matrix, row-major",
                         typeConverter=TypeConverters.toListFloat)
    nComponents = Param(Params._dummy(), "nComponents", "number of components", typeConverter=TypeConverters.toInt)

    def __init__(self, mean=None, unmixing=None):
        super().__init__()
        if mean is not None:
            u = np.asarray(unmixing, dtype=float)
            self._set(meanVector=[float(v) for v in np.asarray(mean).ravel()],
                      unmixingFlat=[float(v) for v in u.ravel()], nComponents=int(u.shape[1]))

    @property
    def mean(self) -> np.ndarray:
        return np.asarray(self.getOrDefault(self.meanVector))

    @property
    def unmixing(self) -> np.ndarray:
        k = self.getOrDefault(self.nComponents)
        return np.asarray(self.getOrDefault(self.unmixingFlat)).reshape(-1, k)

    def _transform(self, df: DataFrame) -> DataFrame:
        mean, mix = self.mean, self.unmixing

        def project(v: pd.Series) -> pd.Series:
            a = np.stack(v.to_numpy()).astype(float)
            return pd.Series(list((a - mean) @ mix))

        project = F.pandas_udf(project, "array<double>")

        arr = vector_to_array(F.col(self.getInputCol()))
        # size metadata, so downstream assemblers never infer it from a first row (empty inputs)
        meta = {"ml_attr": {"num_attrs": int(mix.shape[1])}}
        return df.withColumn(self.getOutputCol(), array_to_vector(project(arr)).alias(self.getOutputCol(), metadata=meta))


# ---- transformer / learner catalogues of the search space ------------------------------------------------

def transformer(name: str, input_col: str = "features", output_col: str = "t_features", **kw):
    """Feature transformers of the search space, by name."""
    if name == "binarizer":
        return MF.Binarizer(inputCol=input_col, outputCol=output_col, threshold=kw.get("threshold", 0.0))
    if name == "normalizer":
        return MF.Normalizer(inputCol=input_col, outputCol=output_col, p=kw.get("p", 2.0))
    if name == "pca":
        return MF.PCA(inputCol=input_col, outputCol=output_col, k=kw.get("k", 10))
    if name == "polynomial":
        return MF.PolynomialExpansion(inputCol=input_col, outputCol=output_col, degree=kw.get("degree", 2))
    if name == "min_max":
        return MF.MinMaxScaler(inputCol=input_col, outputCol=output_col)
    if name == "standard":
        return MF.StandardScaler(inputCol=input_col, outputCol=output_col, withMean=True, withStd=True)
    if name == "max_abs":
        return MF.MaxAbsScaler(inputCol=input_col, outputCol=output_col)
    if name == "robust":
        return MF.RobustScaler(inputCol=input_col, outputCol=output_col, withCentering=True, withScaling=True)
    if name == "variance_threshold":
        return MF.VarianceThresholdSelector(featuresCol=input_col, outputCol=output_col,
                                            varianceThreshold=kw.get("threshold", 0.0))
    if name in ("fwe", "percentile", "fpr", "numTopFeatures"):
        sel = MF.UnivariateFeatureSelector(featuresCol=input_col, outputCol=output_col,
                                           labelCol=kw.get("label", "label"), selectionMode=name)
        sel.setFeatureType(kw.get("feature_type", "continuous")).setLabelType(kw.get("label_type", "continuous"))
        sel.setSelectionThreshold(kw.get("threshold", 0.05 if name in ("fwe", "fpr") else 50.0
                                         if name == "percentile" else 10))
        return sel
    if name == "rbf_sampler":
        return RandomFourier(inputCol=input_col, outputCol=output_col, **kw)
    if name == "nystroem":
        return Nystroem(inputCol=input_col, outputCol=output_col, **kw)
    if name == "agglomeration":
        return FeatureAgglomeration(inputCol=input_col, outputCol=output_col, **kw)
    if name == "fast_ica":
        return FastICA(inputCol=input_col, outputCol=output_col, tol=kw.get("tol", 1e-4))
    raise ValueError(f"unknown transformer {name!r}")


def select_from_model(importances: Sequence[float], threshold: float | None = None, input_col="features",
                      output_col="selected") -> MF.VectorSlicer:
    """Keep features whose importance is at least ``threshold`` (default: the mean importance)."""
    imp = np.asarray(importances, dtype=float)
    thr = imp.mean() if threshold is None else threshold
    idx = [int(i) for i in np.nonzero(imp >= thr)[0]] or [int(np.argmax(imp))]
    return MF.VectorSlicer(inputCol=input_col, outputCol=output_col, indices=idx)


def recursive_elimination(df: DataFrame, features: Sequence[str], target: str, model_type: str = "rf_classif",
                          params: dict | None = None, keep: int = 10, step: float = 0.2) -> list[str]:
    """Recursive feature elimination: refit, drop the least important share, until ``keep`` remain."""
    feats = list(features)
    while len(feats) > keep:
        m = Modeler(model_type, params, target, feats).fit(df)
        est = m.model.stages[-1]
        imp = est.featureImportances.toArray() if hasattr(est, "featureImportances") else np.ones(len(feats))
        n_drop = max(1, min(len(feats) - keep, int(len(feats) * step)))
        order = np.argsort(imp)
        drop = {feats[i] for i in order[:n_drop]}
        feats = [f for f in feats if f not in drop]
    return feats


# ---- search and sweeps -------------------------------------------------------------------------------------

def sample_param_maps(estimator, grid: dict, n_iter: int = 30, seed: int = 42) -> list[dict]:
    """``n_iter`` distinct parameter maps drawn from a scikit-learn style grid (mapped to MLlib params)."""
    keys = list(grid)
    combos = list(itertools.product(*[grid[k] for k in keys]))
    rnd = random.Random(seed)
    picks = combos if len(combos) <= n_iter else rnd.sample(combos, n_iter)
    maps = []
    for combo in picks:
        probe = make_estimator(_type_of(estimator), dict(zip(keys, combo)))
        maps.append({estimator.getParam(p.name): v for p, v in probe.extractParamMap().items()
                     if estimator.hasParam(p.name) and probe.isSet(p)})
    return maps


def _type_of(est) -> str:
    name = type(est).__name__
    if name == "GradientBoosting":
        return "xgb_reg" if est.getOrDefault("task") == "regression" else "xgb_classif"
    if name == "RandomForest":
        return "rf_reg" if est.getOrDefault("task") == "regression" else "rf_classif"
    return {"ExtraTreesClassifier": "et_classif", "DenseClassifier": "dense", "AdaBoostR2": "ada_reg",
            "DecisionTreeClassifier": "dt_classif", "DecisionTreeRegressor": "dt_reg",
            "LogisticRegression": "logistic", "LinearRegression": "linear"}.get(name, "rf_classif")


def random_search(df: DataFrame, modeler: Modeler, grid: dict, n_iter: int = 30, folds: int = 3,
                  parallelism: int = 4, seed: int = 42):
    """Random search with k-fold cross-validation; returns (best pipeline model, results DataFrame)."""
    est = make_estimator(modeler.model_type, modeler.params, modeler.n_classes)
    pipe = modeler.pipeline(est)
    maps = sample_param_maps(est, grid, n_iter, seed)
    data = modeler._labelled(df)
    if modeler.is_classifier:
        ev = MulticlassClassificationEvaluator(metricName="accuracy", predictionCol="_pred_index")
    else:
        ev = RegressionEvaluator(metricName="mse")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, numFolds=folds,
                        parallelism=parallelism, seed=seed)
    model = cv.fit(data)
    spark = df.sparkSession
    rows = [(i, str({p.name: v for p, v in m.items()}), float(s)) for i, (m, s) in enumerate(zip(maps, model.avgMetrics))]
    results = spark.createDataFrame(rows, "draw int, params string, " + ("accuracy" if modeler.is_classifier else "mse")
                                    + " double")
    return model.bestModel, results


def size_sweep(train: DataFrame, test: DataFrame, modeler: Modeler, trees: Sequence[int], depths: Sequence[int],
               out_dir: str) -> DataFrame:
    """Fit forests over a (trees x depth) grid; accuracy on ``test``, model size on disk and load time per point."""
    spark = train.sparkSession
    train = train.cache()
    rows = []
    for n, dpt in itertools.product(trees, depths):
        m = Modeler(modeler.model_type, {**modeler.params, "n_estimators": n, "max_depth": dpt},
                    modeler.target, modeler.features).fit(train)
        acc = m.predict(test).agg(F.avg((F.col("prediction") == F.col(modeler.target)).cast("double"))).first()[0]
        path = f"{out_dir.rstrip('/')}/trees{n}_depth{dpt}"
        m.save(path)
        t0 = time.perf_counter()
        Modeler(modeler.model_type, {}, modeler.target, modeler.features).load(path)
        load_sec = time.perf_counter() - t0
        rows.append((n, dpt, float(acc or 0.0), _dir_size(spark, path), float(load_sec)))
    train.unpersist()
    return spark.createDataFrame(rows, "n_estimators int, max_depth int, accuracy double, size_bytes bigint, "
                                       "load_sec double")


def forest_sweep(train: DataFrame, test: DataFrame, modeler: Modeler, trees: Sequence[int], depths: Sequence[int]) -> DataFrame:
    """n_estimators, max_depth, accuracy, hits, n, n_nodes of an extra-trees modeler at every size, from one forest."""
    from .trees import grow_forest, sweep, tried

    pre = Pipeline(stages=modeler.pipeline().getStages()[:-1]).fit(train)
    est = make_estimator("et_classif", {**modeler.params, "n_estimators": max(trees), "max_depth": max(depths)})
    get = est.getOrDefault
    modeler.indexer = None
    arrays = lambda df: cut(pre.transform(modeler._labelled(df)).select(
        vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label")))
    modeler._labelled(train)
    modeler.indexer.setHandleInvalid("keep")             # classes that only the test rows have are never hit
    fit_on, asked = arrays(train), arrays(test)
    n_classes = len(modeler.indexer.labels)
    width = fit_on.select(F.size("x")).first()[0]
    nodes = grow_forest(fit_on, n_classes, get("numTrees"), get("maxDepth"), tried(get("maxFeatures"), width), get("impurity"),
                        get("minInstancesPerSplit"), get("minInstancesPerNode"), get("seed"), inner_counts=True)
    out = sweep(asked, nodes, n_classes, list(trees), list(depths))
    return out.select("n_estimators", "max_depth", (F.col("hits") / F.col("n")).alias("accuracy"), "hits", "n", "n_nodes")


def _dir_size(spark, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())
