"""Training sets, the train-all job and scoring of every game.

Problem 1 (who is the masked player): window features, NULLs imputed with
training medians, 39 features, target ``player_id``.
Problem 2 (which team has the next event): next-event rows, previous-event
types target-encoded by team-change rate, 9 features, target ``team_id``.
Problem 3 (where is the next event): same rows, types encoded by mean
distance travelled along the axis, 9 features per coordinate, targets
``x_along_team1_axis`` and ``y_along_team1_axis`` (each model fitted on its
own target).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.encode import apply_lag_encoders, fit_lag_encoders
from ..session import cut
from . import models as M
from .features import season_next_event, window_features
from .scoring import feature_medians, impute_with_medians, player_scoring_features, prediction_rows

EVENT_KEY = ("game", "seq")
WINDOW_KEY = ("game", "time_period", "player_id")
P1_FEATURES = K.player_features()
P2_FEATURES = K.next_event_features("x")
P3X_FEATURES = K.next_event_features("x")
P3Y_FEATURES = K.next_event_features("y")

# ---- fixed values: model settings of the train-all job -----------------------------------------------
PLAYER_FOREST = {"n_estimators": 75, "max_depth": 18, "bootstrap": False, "criterion": "gini", "max_features": 0.1}
NEXT_TEAM_FINAL_FOREST = {"n_estimators": 100, "bootstrap": True, "criterion": "entropy", "max_features": 0.75,
                          "min_samples_leaf": 12}
COORDS_FOREST = {"n_estimators": 10}
COORDS_X_BOOST = {"learning_rate": 0.1, "max_depth": 9, "min_child_weight": 18, "n_estimators": 100, "subsample": 0.9}
COORDS_Y_BOOST = {"learning_rate": 0.1, "max_depth": 9, "min_child_weight": 19, "n_estimators": 100, "subsample": 0.95}


# ---- fixed values: the search grids of the three problems ----------------------------------------------------
_FOREST_GRID = {"n_estimators": [50, 100, 200, 500], "max_features": [None, "sqrt", 10, 15, 20],
                "max_depth": [None, 4, 8, 10, 12, 15], "criterion": ["gini", "entropy"]}
_BOOST_GRID = {"learning_rate": [0.01, 0.05, 0.1, 0.3, 0.8], "n_estimators": [30, 75, 150, 300, 500], "max_depth": [4, 7, 10],
               "min_child_weight": [1, 5, 10], "subsample": [1], "colsample_bytree": [0.8, 1], "reg_lambda": [1, 5, 10], "gamma": [0],
               "scale_pos_weight": [1]}
_COORDS_FOREST_GRID = {"n_estimators": [50, 100, 200, 500], "max_features": [2, 4, 6, 8], "max_depth": [4, 8, 10, 12, 15, 20, 30],
                       "criterion": ["gini", "entropy"]}
SEARCH_GRIDS = {
    "player": {"et_classif": _FOREST_GRID, "rf_classif": _FOREST_GRID, "xgb_classif": _BOOST_GRID},
    "next_team": {"rf_classif": {**_FOREST_GRID, "max_features": [None, "sqrt", 2, 6, 9]}, "xgb_classif": _BOOST_GRID},
    "coords_x": {"rf_reg": _COORDS_FOREST_GRID, "xgb_reg": _BOOST_GRID},
    "coords_y": {"rf_reg": _COORDS_FOREST_GRID, "xgb_reg": _BOOST_GRID},
}


def search(me: DataFrame, eligible: DataFrame | None, problem: str, model_type: str | None = None, n_iter: int = 30, folds: int = 3,
           grid: dict | None = None, parallelism: int = 4):
    """Random search with cross-validation on a problem's training rows: (best pipeline model, one row per draw).

    ``n_iter`` draws of the problem's grid for the model type (the first one of the problem by default); accuracy for
    the classifiers, MSE for the coordinates.
    """
    model_type = model_type or next(iter(SEARCH_GRIDS[problem]))
    grid = grid or SEARCH_GRIDS[problem][model_type]
    if problem == "player":
        feats = cut(window_features(me, eligible))
        train, _ = split_rows(feats, default_split(*WINDOW_KEY))
        rows, target, cols = _imputed(train, feature_medians(train, P1_FEATURES)), "player_id", P1_FEATURES
    else:
        target, method = _ENCODER_SETS[{"next_team": "team", "coords_x": "x", "coords_y": "y"}[problem]]
        train, test = next_event_sets(me)
        rows = encode_sets(train, test, method, target).train
        cols = P3Y_FEATURES if problem == "coords_y" else P2_FEATURES
    return M.random_search(cut(rows), M.Modeler(model_type, {}, target, cols), grid, n_iter, folds, parallelism)


def default_split(*keys: str) -> Column:
    """Deterministic 70/30 split by a hash of the row's key (stable across partitionings).

    The key of an event is (game, seq): ``seq`` starts anew in every game of a feed.
    """
    return F.pmod(F.xxhash64(*[F.col(c) for c in keys or EVENT_KEY]), F.lit(100)) < 70


def player_training_set(me: DataFrame, eligible: DataFrame | None) -> tuple[DataFrame, dict]:
    """Window features of eligible players with NULLs replaced by the medians (returned too); computed once."""
    feats = cut(window_features(me, eligible))
    med = feature_medians(feats, P1_FEATURES)
    return impute_with_medians(feats, feats, P1_FEATURES, keep=["game", "player_id", "time_period"],
                               medians=med).withColumn("player_id", F.col("player_id")), med


def next_event_sets(me: DataFrame, split: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Complete next-event rows, computed once, as (training, test) rows."""
    return split_rows(cut(season_next_event(me).na.drop()), split if split is not None else default_split())


def split_rows(df: DataFrame, split: Column) -> tuple[DataFrame, DataFrame]:
    return df.where(split), df.where(~split)


@dataclass
class Encoded:
    train: DataFrame
    test: DataFrame
    encoders: dict


def encode_sets(train: DataFrame, test: DataFrame, method: str, target: str, target_lag: str | None = None) -> Encoded:
    enc = fit_lag_encoders(train, target, K.NEXT_EVENT_LAGS, method, target_lag)
    return Encoded(apply_lag_encoders(train, enc), apply_lag_encoders(test, enc), enc)


def next_team_stack(params: dict | None = None) -> M.Modeler:
    """Stacked next-team classifier: tree -> logistic -> tree -> forest, each seeing its predecessors' outputs."""
    stages = M.stacking_stages([
        M.make_estimator("dt_classif", {"criterion": "entropy", "max_depth": 4, "min_samples_leaf": 10}),
        M.make_estimator("logistic", {}),
        M.make_estimator("dt_classif", {"criterion": "entropy", "max_depth": 4, "min_samples_leaf": 17}),
    ])

    class _Stack(M.Modeler):
        def pipeline(self, estimator=None):
            from pyspark.ml import Pipeline
            from pyspark.ml import feature as MF

            final = estimator or M.make_estimator("rf_classif", {**NEXT_TEAM_FINAL_FOREST, **(params or {})})
            final.setFeaturesCol("features_stacked").setLabelCol("label").setPredictionCol("_pred_index")
            for st in stages:
                if hasattr(st, "setLabelCol"):
                    st.setLabelCol("label")
            assembler = MF.VectorAssembler(inputCols=self.features, outputCol="features")
            return Pipeline(stages=[assembler, *stages, final])

        def predict(self, df):
            out = super().predict(df)
            return out.drop(*[c for c in out.columns if c.startswith("_s") or c == "features_stacked"])

    return _Stack("rf_classif", {}, "team_id", P2_FEATURES)


def player_model(params: dict | None = None, with_ica: bool = True, ica_tol: float = 0.85) -> M.Modeler:
    """Player classifier: [FastICA components next to the raw features] -> forest without bootstrap."""
    pre = []
    feats = P1_FEATURES
    if with_ica:
        from pyspark.ml import feature as MF

        pre = [MF.VectorAssembler(inputCols=P1_FEATURES, outputCol="raw_features"),
               M.FastICA(inputCol="raw_features", outputCol="ica", tol=ica_tol)]
        feats = ["ica", "raw_features"]                  # feature union: components + identity copy
    return M.Modeler("et_classif", {**PLAYER_FOREST, **(params or {})}, "player_id", feats, pre_stages=pre)


def coords_model(axis: str, params: dict | None = None) -> M.Modeler:
    """Boosted regressor of one coordinate: x on min-max scaled features, y on a doubled identity union."""
    from pyspark.ml import feature as MF

    feats = P3X_FEATURES if axis == "x" else P3Y_FEATURES
    if axis == "x":
        pre = [MF.VectorAssembler(inputCols=feats, outputCol="raw_features"),
               MF.MinMaxScaler(inputCol="raw_features", outputCol="scaled")]
        cols, base = ["scaled"], COORDS_X_BOOST
    else:
        pre = [MF.VectorAssembler(inputCols=feats, outputCol="raw_features")]
        cols, base = ["raw_features", "raw_features"], COORDS_Y_BOOST
    return M.Modeler("xgb_reg", {**base, **(params or {})}, f"{axis}_along_team1_axis", cols, pre_stages=pre)


@dataclass
class TrainedModels:
    player: M.Modeler
    medians: dict
    team: M.Modeler
    team_encoders: dict
    x: M.Modeler
    x_encoders: dict
    y: M.Modeler
    y_encoders: dict
    metrics: DataFrame


def train_all(me: DataFrame, eligible: DataFrame | None, out_dir: str | None = None,
              split: Column | None = None, player_params: dict | None = None, team_params: dict | None = None,
              coords_params: dict | None = None, with_ica: bool = True, with_metrics: bool = True) -> TrainedModels:
    """Fit the three problems' models on all rows; optional save under ``out_dir``.

    ``with_metrics=False`` leaves the evaluation out: half of the fits.

    The metrics come from models fitted on the 70 % training rows and applied to the other 30 %;
    the models that are returned (and saved, and scored with) are then fitted on every row, with
    encoders and medians of every row.
    """
    feats = cut(window_features(me, eligible))
    nxt = cut(season_next_event(me).na.drop())
    med = feature_medians(feats, P1_FEATURES)
    e2 = encode_sets(nxt, nxt, "team_change", "team_id")
    ex = encode_sets(nxt, nxt, "distance", "x_along_team1_axis")
    ey = encode_sets(nxt, nxt, "distance", "y_along_team1_axis")
    metrics, player, team, mx, my = together(
        lambda: evaluate(feats, nxt, split, player_params, team_params, coords_params, with_ica) if with_metrics
        else nxt.sparkSession.createDataFrame([], "problem string, metric string, value double"),
        lambda: player_model(player_params, with_ica).fit(_imputed(feats, med)),
        lambda: next_team_stack(team_params).fit(e2.train),
        lambda: coords_model("x", coords_params).fit(ex.train),
        lambda: coords_model("y", coords_params).fit(ey.train))
    tm = TrainedModels(player, med, team, e2.encoders, mx, ex.encoders, my, ey.encoders, metrics)
    if out_dir:
        save_trained(tm, out_dir)
    return tm


def together(*jobs):
    """Results of independent fits, submitted side by side: their many small jobs share the executors."""
    from pyspark.sql import SparkSession

    own = inheritable_thread_target(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(own(j)) for j in jobs]]


def _imputed(feats: DataFrame, medians: dict) -> DataFrame:
    return impute_with_medians(feats, feats, P1_FEATURES, keep=list(WINDOW_KEY), medians=medians)


def predict_coords(ex: Encoded, ey: Encoded, mx: M.Modeler, my: M.Modeler) -> DataFrame:
    """game, seq, both targets, x_pred, y_pred: one row per test event (joined on the event's key)."""
    px = mx.predict(ex.test).select(*EVENT_KEY, "x_along_team1_axis", F.col("prediction").alias("x_pred"))
    py = my.predict(ey.test).select(*EVENT_KEY, "y_along_team1_axis", F.col("prediction").alias("y_pred"))
    return px.join(py, list(EVENT_KEY))


def evaluate_player(feats: DataFrame, params: dict | None = None, with_ica: bool = True) -> tuple[DataFrame, float]:
    """Hold-out evaluation of the player model: (test rows with ``prediction``, accuracy).

    Rows are split by their key; medians and model come from the training rows alone.
    """
    from ..operators import metrics as MT

    train, test = split_rows(feats, default_split(*WINDOW_KEY))
    med = feature_medians(train, P1_FEATURES)
    pred = player_model(params, with_ica).fit(_imputed(train, med)).predict(_imputed(test, med))
    return pred, float(MT.accuracy(pred, "player_id", "prediction").first()[0] or 0.0)


def player_sweep(me: DataFrame, eligible: DataFrame | None, trees, depths, with_ica: bool = True) -> DataFrame:
    """Held-out accuracy and number of nodes of the player forest at every (trees, depth), from one forest."""
    train, test = split_rows(cut(window_features(me, eligible)), default_split(*WINDOW_KEY))
    med = feature_medians(train, P1_FEATURES)
    return M.forest_sweep(_imputed(train, med), _imputed(test, med), player_model(with_ica=with_ica), list(trees), list(depths))


def evaluate(feats: DataFrame, nxt: DataFrame, split: Column | None = None, player_params: dict | None = None,
             team_params: dict | None = None, coords_params: dict | None = None, with_ica: bool = True) -> DataFrame:
    """Metrics of the three problems on held-out rows: problem, metric, value."""
    from ..operators import metrics as MT

    train, test = split_rows(nxt, split if split is not None else default_split())
    e2 = encode_sets(train, test, "team_change", "team_id")
    ex = encode_sets(train, test, "distance", "x_along_team1_axis")
    ey = encode_sets(train, test, "distance", "y_along_team1_axis")
    (_, player_acc), team, mx, my = together(
        lambda: evaluate_player(feats, player_params, with_ica), lambda: next_team_stack(team_params).fit(e2.train),
        lambda: coords_model("x", coords_params).fit(ex.train), lambda: coords_model("y", coords_params).fit(ey.train))
    acc = MT.accuracy(team.predict(e2.test), "team_id", "prediction").first()[0]
    both = cut(predict_coords(ex, ey, mx, my))
    l2 = MT.avg_l2_error(both, "x_along_team1_axis", "y_along_team1_axis", "x_pred", "y_pred").first()[0]
    msex = MT.mse(both, "x_along_team1_axis", "x_pred").first()[0]
    msey = MT.mse(both, "y_along_team1_axis", "y_pred").first()[0]
    return nxt.sparkSession.createDataFrame([
        ("player", "accuracy", player_acc),
        ("next_team", "accuracy", float(acc or 0.0)),
        ("coords", "avg_l2_error", float(l2 or 0.0)),
        ("coords", "l2_accuracy", float(1.0 - (l2 or 0.0) / K.MAX_L2_ERROR)),
        ("coords_x", "mse", float(msex or 0.0)),
        ("coords_y", "mse", float(msey or 0.0)),
    ], "problem string, metric string, value double")


_ENCODER_SETS = {"team": ("team_id", "team_change"), "x": ("x_along_team1_axis", "distance"),
                 "y": ("y_along_team1_axis", "distance")}


def save_trained(tm: TrainedModels, out_dir: str) -> None:
    """Models (Spark ML writer), encoders (one table per lag), medians and metrics under ``out_dir``."""
    spark = tm.metrics.sparkSession
    tm.player.save(f"{out_dir}/player")
    tm.team.save(f"{out_dir}/next_team")
    tm.x.save(f"{out_dir}/coords_x")
    tm.y.save(f"{out_dir}/coords_y")
    for name, encs in (("team", tm.team_encoders), ("x", tm.x_encoders), ("y", tm.y_encoders)):
        for n, m in encs.items():
            m.save(f"{out_dir}/encoders/{name}/lag{n}")
    spark.createDataFrame([(k, v) for k, v in tm.medians.items()], "feature string, median double") \
        .write.mode("overwrite").parquet(f"{out_dir}/medians")
    tm.metrics.write.mode("overwrite").parquet(f"{out_dir}/metrics")


def load_trained(spark, out_dir: str, with_ica: bool = True) -> TrainedModels:
    """Inverse of :func:`save_trained` (medians and encoder means are the only values read to the driver)."""
    from ..operators.encode import TargetEncoderModel

    encs = {}
    for name, (target, method) in _ENCODER_SETS.items():
        encs[name] = {n: TargetEncoderModel.load(spark, f"{out_dir}/encoders/{name}/lag{n}", f"type_id_lag{n}",
                                                 reference_cols=(target, f"{target}_lag{n}"), method=method)
                      for n in K.NEXT_EVENT_LAGS}
    medians = {r.feature: r.median for r in spark.read.parquet(f"{out_dir}/medians").collect()}
    return TrainedModels(
        player=player_model(with_ica=with_ica).load(f"{out_dir}/player"), medians=medians,
        team=next_team_stack().load(f"{out_dir}/next_team"), team_encoders=encs["team"],
        x=coords_model("x").load(f"{out_dir}/coords_x"), x_encoders=encs["x"],
        y=coords_model("y").load(f"{out_dir}/coords_y"), y_encoders=encs["y"],
        metrics=spark.read.parquet(f"{out_dir}/metrics"))


def score_games(me: DataFrame, models: TrainedModels, masked_player: int = 1) -> DataFrame:
    """One prediction row per game: masked player, next team, then y and x on that team's axis."""
    from ..operators.windows import last_rows

    px = player_scoring_features(me, None, masked_player, medians=models.medians)
    pred_player = models.player.predict(px).select("game", F.col("prediction").cast("bigint").alias("player_id"))

    last = last_rows(season_next_event(me), 1)
    lt = apply_lag_encoders(last, models.team_encoders)
    pred_team = models.team.predict(lt).select("game", F.col("prediction").cast("int").alias("team_id"))
    lx = models.x.predict(apply_lag_encoders(last, models.x_encoders)).select(
        "game", F.col("prediction").alias("x_along_team1_axis"))
    ly = models.y.predict(apply_lag_encoders(last, models.y_encoders)).select(
        "game", F.col("prediction").alias("y_along_team1_axis"))
    return prediction_rows(pred_player, pred_team, lx.join(ly, "game"))
