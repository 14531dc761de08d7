"""Target encoders for categorical lag columns, as Spark ML estimators.

``fit`` is one hash aggregate over the training rows (one row per category
comes out); ``transform`` is a left join with that table plus a fallback to
the training mean for unseen or NULL categories. The category table is as
large as the category vocabulary (event types: a fixed list), never as
large as the data. Only one scalar (the training mean) reaches the driver,
as model parameters do in every Spark ML estimator.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ne_null_true
from ..session import cut


class _EncoderParams(HasInputCol, HasOutputCol):
    referenceCols = Param(Params._dummy(), "referenceCols",
                          "two columns [target, lagged target] the encoding is computed from",
                          typeConverter=TypeConverters.toListString)
    method = Param(Params._dummy(), "method", "'team_change' (share of rows where the two columns differ) "
                   "or 'distance' (mean of first minus second)", typeConverter=TypeConverters.toString)

    def _check(self):
        refs = self.getOrDefault(self.referenceCols)
        if len(refs) != 2:
            raise ValueError("referenceCols must name exactly 2 columns")
        if self.getOrDefault(self.method) not in ("team_change", "distance"):
            raise ValueError("method must be 'team_change' or 'distance'")


class TargetEncoder(Estimator, _EncoderParams):
    """Replace a category by a statistic of two reference columns over its training rows.

    * ``team_change``: share of rows where ``referenceCols[0] != referenceCols[1]``
      (NULL counts as different from everything, NULL included);
    * ``distance``: mean of ``referenceCols[0] - referenceCols[1]``.

    Unseen and NULL categories get the row-weighted training mean of the
    encoded column.
    """

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, referenceCols=None, method="team_change"):
        super().__init__()
        self._setDefault(method="team_change")
        kwargs = self._input_kwargs
        self._set(**kwargs)
        if not self.isSet(self.outputCol) and self.isSet(self.inputCol):
            self._set(outputCol=self.getInputCol())

    def _fit(self, df: DataFrame) -> "TargetEncoderModel":
        self._check()
        cat = self.getInputCol()
        a, b = self.getOrDefault(self.referenceCols)
        if self.getOrDefault(self.method) == "team_change":
            stat = F.avg(ne_null_true(a, b).cast("double"))
        else:
            stat = F.avg((F.col(a).cast("double") - F.col(b).cast("double")))
        table = (df.where(F.col(cat).isNotNull())
                 .groupBy(F.col(cat).alias("category"))
                 .agg(stat.alias("value"), F.count(F.lit(1)).alias("n_rows")))
        table = cut(table)
        t = table.where(F.col("value").isNotNull())
        mean = t.agg((F.sum(F.col("value") * F.col("n_rows")) / F.sum("n_rows")).alias("mean")).first()["mean"]
        model = TargetEncoderModel(table=table, mean=mean)
        model._set(inputCol=cat, outputCol=self.getOutputCol(), referenceCols=[a, b],
                   method=self.getOrDefault(self.method))
        return model


class TargetEncoderModel(Model, _EncoderParams):
    def __init__(self, table: DataFrame | None = None, mean: float | None = None):
        super().__init__()
        self.table = table  # category, value, n_rows
        self.mean_value = mean

    def mapping(self) -> DataFrame:
        """category -> value."""
        return self.table.select("category", "value")

    def _transform(self, df: DataFrame) -> DataFrame:
        cat, out = self.getInputCol(), self.getOutputCol()
        mapping = self.table.select(F.col("category").alias("_cat"), F.col("value").alias("_val"))
        joined = df.join(mapping, F.col(cat) == F.col("_cat"), "left")
        enc = F.coalesce(F.col("_val"), F.lit(self.mean_value).cast("double"))
        if out in df.columns:
            return joined.select(*[enc.alias(c) if c == out else F.col(c) for c in df.columns])
        return joined.select(*df.columns, enc.alias(out))

    def save(self, path: str) -> None:
        """Persist as parquet: one row per category with the method and columns."""
        a, b = self.getOrDefault(self.referenceCols)
        (self.table.select("category", "value", "n_rows",
                           F.lit(self.getInputCol()).alias("input_col"), F.lit(self.getOutputCol()).alias("output_col"),
                           F.lit(a).alias("ref_a"), F.lit(b).alias("ref_b"),
                           F.lit(self.getOrDefault(self.method)).alias("method"),
                           F.lit(self.mean_value).cast("double").alias("mean"))
         .write.mode("overwrite").parquet(path))

    @classmethod
    def load(cls, spark, path: str, input_col: str, output_col: str | None = None,
             reference_cols=("team_id", "team_id_lag1"), method: str = "team_change") -> "TargetEncoderModel":
        stored = spark.read.parquet(path)
        table = stored.select("category", "value", "n_rows")
        mean = stored.agg(F.first("mean")).first()[0]
        m = cls(table=table, mean=mean)
        m._set(inputCol=input_col, outputCol=output_col or input_col, referenceCols=list(reference_cols), method=method)
        return m


def fit_lag_encoders(train: DataFrame, target: str, lags=(1, 2, 3), method: str = "team_change",
                     target_lag: str | None = None) -> dict[int, TargetEncoderModel]:
    """One encoder per lag for ``type_id_lag<n>`` against (target, target_lag<n>), fitted in one pass.

    Each training row contributes one (lag, category, statistic) triple per
    lag; a single ``groupBy(lag, category)`` fits every encoder, and the
    per-lag means come back together (one small row per lag).
    """
    lags = list(lags)
    base = target_lag or target
    if method == "team_change":
        stat = {n: ne_null_true(target, f"{base}_lag{n}").cast("double") for n in lags}
    elif method == "distance":
        stat = {n: F.col(target).cast("double") - F.col(f"{base}_lag{n}").cast("double") for n in lags}
    else:
        raise ValueError("method must be 'team_change' or 'distance'")
    triples = F.explode(F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"type_id_lag{n}").alias("category"),
                                           stat[n].alias("s")) for n in lags])).alias("t")
    table = (train.select(triples).select("t.*").where(F.col("category").isNotNull())
             .groupBy("lag", "category").agg(F.avg("s").alias("value"), F.count(F.lit(1)).alias("n_rows")))
    table = cut(table)
    means = {r["lag"]: r["mean"] for r in table.where(F.col("value").isNotNull()).groupBy("lag").agg(
        (F.sum(F.col("value") * F.col("n_rows")) / F.sum("n_rows")).alias("mean")).collect()}
    models = {}
    for n in lags:
        m = TargetEncoderModel(table=table.where(F.col("lag") == n).drop("lag"), mean=means.get(n))
        m._set(inputCol=f"type_id_lag{n}", outputCol=f"type_id_lag{n}", referenceCols=[target, f"{base}_lag{n}"],
               method=method)
        models[n] = m
    return models


def encoder_table(models: dict[int, TargetEncoderModel]) -> DataFrame:
    """All lag encoders as one table: lag, category, value, mean."""
    out = None
    for n, m in models.items():
        part = m.table.select(F.lit(n).alias("lag"), F.col("category").cast("int").alias("category"), "value",
                              F.lit(m.mean_value).cast("double").alias("mean"))
        out = part if out is None else out.unionByName(part)
    return out


def apply_lag_encoders(df: DataFrame, models: dict[int, TargetEncoderModel]) -> DataFrame:
    for m in models.values():
        df = m.transform(df)
    return df
