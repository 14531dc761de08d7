"""Registered model queries (Spark ML).

Each query trains on the given tables (through the same feature plans as
the SQL-checked queries). What a fitted model predicts has no SQL twin; a query
returns the rows that it predicts for, with their keys and targets, and facts
about each prediction that must hold (a known class, a finite coordinate), so
that rows and values can be compared. Scalers, counts and the identity copy of
the ICA union are compared by value.
"""

from __future__ import annotations

from pyspark.ml import feature as MF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import cut
from . import boosting as BO
from . import models as M
from . import neighbours as NN
from . import oracle as O
from . import training as TR
from .catalog import (FEAT, MEDIAN_COLS, NEXT, TEST_SET, ZC_SUM, eligible_, features_, me_, query,
                      split_flag)
from .oracle_trees import boost_ctes, draw_sql, forest_ctes
from .scoring import feature_medians, impute_with_medians, player_scoring_features
from .trees import PRIME, tried

# ---- SQL of the row sets ------------------------------------------------------------------------------------

P1 = [*FEAT, "med AS (SELECT " + ", ".join(f'CAST(median("{c}") AS DOUBLE) AS "m_{c}"' for c in MEDIAN_COLS)
      + " FROM feat WHERE player_id IN (SELECT player_id FROM elig))",
      "p1 AS (SELECT f.game, f.player_id, f.time_period, " + ", ".join(
          f'COALESCE(CAST(f."{c}" AS DOUBLE), (SELECT "m_{c}" FROM med)) AS "{c}"' for c in MEDIAN_COLS)
      + " FROM feat f WHERE f.player_id IN (SELECT player_id FROM elig))"]
FULL = "(SELECT * FROM nxt WHERE COLUMNS(*) IS NOT NULL)"
TEST = f"(SELECT * FROM {FULL} WHERE (seq * 7919) % 100 >= 70)"
P1_TEST = "(player_id * 31 + CAST(split_part(time_period, '-', 1) AS BIGINT)) % 10 >= 7"


def _p1(spark, d):
    return TR.player_training_set(me_(spark, d), eligible_(spark, d))


def _p1_sets(spark, d) -> tuple[DataFrame, DataFrame]:
    """Window rows split 70/30 by their key; NULLs of both parts take the medians of the training part."""
    feats = cut(features_(spark, d))
    test = (F.col("player_id") * 31 + F.split("time_period", "-")[0].cast("bigint")) % 10 >= 7
    train = feats.where(~test)
    med = feature_medians(train, TR.P1_FEATURES)
    fill = lambda df: impute_with_medians(df, df, TR.P1_FEATURES, keep=list(TR.WINDOW_KEY), medians=med)
    return fill(train), fill(feats.where(test))


def _p2(spark, d, method="team_change", target="team_id"):
    train, test = TR.next_event_sets(me_(spark, d), split_flag())
    return TR.encode_sets(train, test, method, target)


def _assembled(df, cols, out="features"):
    return MF.VectorAssembler(inputCols=cols, outputCol=out).transform(df)


def _finite(c: str):
    return F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))


def _known(pred: DataFrame, labels: list[str]):
    return pred["prediction"].cast("string").isin(labels)


def _player_forest_sql() -> str:
    """Extra-trees on the imputed window rows, grown by SQL, applied to each game's masked player."""
    x = lambda cols: "[" + ", ".join(cols) + "]"
    test = []
    for c in TR.P1_FEATURES:
        base = f'CAST(q."{c}" AS DOUBLE)'
        test.append(f'COALESCE({f"COALESCE({base}, 0.0)" if c.endswith("_nb") else base}, (SELECT "m_{c}" FROM med))')
    labels = ("labels AS MATERIALIZED (SELECT player_id, CAST(row_number() OVER (ORDER BY CAST(player_id AS VARCHAR)) - 1 AS INTEGER) AS label "
              "FROM (SELECT DISTINCT player_id FROM p1))")
    tr = (f"tr AS MATERIALIZED (SELECT row_number() OVER () AS row, label, {x(f'{chr(34)}{c}{chr(34)}' for c in TR.P1_FEATURES)} AS x "
          "FROM p1 JOIN labels USING (player_id))")
    asked = (f"asked AS MATERIALIZED (SELECT q.game, q.player_id, -row_number() OVER (ORDER BY q.game) AS row, {x(test)} AS x "
             "FROM tfeat q WHERE q.player_id = 1), te AS (SELECT row, x FROM asked)")
    f = TR.PLAYER_FOREST
    trees = forest_ctes(f["n_estimators"], f["max_depth"], tried(str(f["max_features"]), len(TR.P1_FEATURES)))
    return (O.with_(*P1, TEST_SET[-2], O.features_sql("tlp", ["game"], [], prefix="t"), labels, tr, asked, trees)
            + "SELECT game, asked.player_id, labels.player_id AS predicted_player FROM asked JOIN pred USING (row) JOIN labels USING (label)")


@query("ml_player_forest", _player_forest_sql())
def ml_player_forest(spark, d):
    """The extra-trees forest of the reference's settings predicts each game's masked player."""
    train, med = _p1(spark, d)
    m = M.Modeler("et_classif", TR.PLAYER_FOREST, "player_id", TR.P1_FEATURES).fit(train)
    x = m.predict(player_scoring_features(me_(spark, d), None, medians=med))
    return x.select("game", "player_id", F.col("prediction").alias("predicted_player"))


TEAM_SQL = O.with_(*NEXT) + f"SELECT seq, game, team_id, TRUE AS known_team FROM {TEST}"


def _team_facts(pred: DataFrame) -> DataFrame:
    return pred.select("seq", "game", "team_id", pred["prediction"].isin(0, 1).alias("known_team"))


@query("ml_next_team_stacking", TEAM_SQL)
def ml_next_team_stacking(spark, d):
    """M7: stacked tree -> logistic -> tree -> forest for the next team, on the test rows."""
    e = _p2(spark, d)
    return _team_facts(TR.next_team_stack().fit(e.train).predict(e.test))


NEXT_TEAM_BOOST = {"n_estimators": 300, "learning_rate": 0.1, "max_depth": 6, "reg_lambda": 2}   # fixed values: reference settings


@query("ml_next_team_gbt", O.with_(*NEXT) + f"SELECT seq, game, team_id, TRUE AS known_team, 300 AS rounds, TRUE AS loss_falls FROM {TEST}")
def ml_next_team_gbt(spark, d):
    """M4: second-order boosting for the next team, 300 rounds; the training loss falls in every round."""
    e = _p2(spark, d)
    m = M.Modeler("xgb_classif", NEXT_TEAM_BOOST, "team_id", TR.P2_FEATURES).fit(e.train)
    losses = m.model.stages[-1].losses
    return _team_facts(m.predict(e.test)).withColumns({
        "rounds": F.lit(len(losses)), "loss_falls": F.lit(all(b < a for a, b in zip(losses, losses[1:])))})


BOOST_BY_VALUE = {"n_estimators": 5, "learning_rate": 0.3, "max_depth": 3, "reg_lambda": 1.5, "min_child_weight": 10}


def _boost_sql() -> str:
    x = "[" + ", ".join(f'CAST("{c}" AS DOUBLE)' for c in TR.P2_FEATURES) + "]"
    b = BOOST_BY_VALUE
    return O.with_(*NEXT, f"""full_rows AS MATERIALIZED (SELECT *, row_number() OVER () AS row FROM {FULL}),
tr AS MATERIALIZED (SELECT row, team_id AS y, {x} AS x FROM full_rows WHERE (seq * 7919) % 100 < 70),
te AS MATERIALIZED (SELECT row, {x} AS x FROM full_rows WHERE (seq * 7919) % 100 >= 70),
""" + boost_ctes(b["n_estimators"], b["max_depth"], b["learning_rate"], b["reg_lambda"], b["min_child_weight"])) \
        + "SELECT seq, game, round(score, 6) AS score FROM pred JOIN full_rows USING (row)"


@query("ml_boost_scores", _boost_sql())
def ml_boost_scores(spark, d):
    """M4: scores (log-odds) of five rounds of second-order boosting on the raw lag features, by value: SQL finds the same trees."""
    train, test = TR.next_event_sets(me_(spark, d), split_flag())
    m = M.Modeler("xgb_classif", BOOST_BY_VALUE, "team_id", TR.P2_FEATURES).fit(train)
    trees = BO.trees_of(m.model.stages[-1].table())
    rows = test.select("seq", "game", F.array(*[F.col(c).cast("double") for c in TR.P2_FEATURES]).alias("x"))
    return BO.add_scores(rows, trees, "x", 1, 0.0, "s").select("seq", "game", F.round(F.col("s")[0], 6).alias("score"))


PLAYER_SQL = O.with_(*P1) + f"SELECT game, time_period, player_id, TRUE AS known_player FROM p1 WHERE {P1_TEST}"


def _player_facts(m: M.Modeler, test: DataFrame) -> DataFrame:
    pred = m.predict(test)
    return pred.select("game", "time_period", "player_id", _known(pred, m.indexer.labels).alias("known_player"))


@query("ml_player_one_vs_rest", PLAYER_SQL)
def ml_player_one_vs_rest(spark, d):
    """M4: multi-class boosting as one-vs-rest over binary boosted trees, on held-out windows.

    One binary fit per player, so the fits grow with the season's players: a 3-round model here, and the
    multi-class forest (``ml_player_forest``) is the model of the train-all job.
    """
    train, test = _p1_sets(spark, d)
    n = train.select("player_id").distinct().count()
    m = M.Modeler("xgb_multiclass", {"n_estimators": 3, "max_depth": 3}, "player_id", TR.P1_FEATURES, n_classes=n).fit(train)
    return _player_facts(m, test)


PLAYER_BOOST = {"n_estimators": 300, "learning_rate": 0.1, "max_depth": 6, "reg_lambda": 2}   # fixed values: reference settings


@query("ml_player_softmax", O.with_(*P1) + f"""SELECT game, time_period, player_id, TRUE AS known_player, 300 AS rounds, TRUE AS loss_falls,
  TRUE AS beats_mode FROM p1 WHERE {P1_TEST}""")
def ml_player_softmax(spark, d):
    """M4: softmax boosting for the player, all classes in one fit, 300 rounds; it beats the most frequent class on held-out windows."""
    train, test = _p1_sets(spark, d)
    m = M.Modeler("xgb_classif", PLAYER_BOOST, "player_id", TR.P1_FEATURES).fit(train)
    losses = m.model.stages[-1].losses
    pred = cut(m.predict(test).select("game", "time_period", "player_id", "prediction"))
    most = train.groupBy("player_id").count().orderBy(F.desc("count"), "player_id").first()[0]
    hits = pred.agg(F.sum((F.col("prediction") == F.col("player_id")).cast("int")), F.sum((F.col("player_id") == most).cast("int"))).first()
    return pred.select("game", "time_period", "player_id", _known(pred, m.indexer.labels).alias("known_player"), F.lit(len(losses)).alias("rounds"),
                       F.lit(all(b < a for a, b in zip(losses, losses[1:]))).alias("loss_falls"), F.lit((hits[0] or 0) >= (hits[1] or 0)).alias("beats_mode"))


@query("ml_coords_forest", O.with_(*NEXT) + f"SELECT seq, game, TRUE AS finite_x, TRUE AS finite_y FROM {TEST}")
def ml_coords_forest(spark, d):
    """M2: forest regressors for x and y (each fitted on its own target), predictions on the test rows."""
    ex = _p2(spark, d, "distance", "x_along_team1_axis")
    ey = _p2(spark, d, "distance", "y_along_team1_axis")
    mx = M.Modeler("rf_reg", TR.COORDS_FOREST, "x_along_team1_axis", TR.P3X_FEATURES).fit(ex.train)
    my = M.Modeler("rf_reg", TR.COORDS_FOREST, "y_along_team1_axis", TR.P3Y_FEATURES).fit(ey.train)
    both = TR.predict_coords(ex, ey, mx, my)
    return both.select("seq", "game", _finite("x_pred").alias("finite_x"), _finite("y_pred").alias("finite_y"))


@query("ml_coords_boost", O.with_(*NEXT) + f"SELECT seq, game, TRUE AS finite_x FROM {TEST}")
def ml_coords_boost(spark, d):
    """Boosted regressor of x on min-max scaled features (test rows)."""
    ex = _p2(spark, d, "distance", "x_along_team1_axis")
    return TR.coords_model("x").fit(ex.train).predict(ex.test).select("seq", "game", _finite("prediction").alias("finite_x"))


@query("ml_linear_models", O.with_(*NEXT) + f"""SELECT model, count(*) AS n_rows, TRUE AS finite_mse
FROM {TEST}, (SELECT unnest(['elastic_net', 'ridge', 'linear']) AS model) GROUP BY model""")
def ml_linear_models(spark, d):
    """Elastic-net and ridge linear regressions of x (test-set MSE per model)."""
    ex = _p2(spark, d, "distance", "x_along_team1_axis")
    rows = []
    for name in ("elastic_net", "ridge", "linear"):
        m = M.Modeler(name, {"regParam": 0.1}, "x_along_team1_axis", TR.P3X_FEATURES).fit(ex.train)
        rows.append(m.predict(ex.test).select(F.lit(name).alias("model"),
                                              F.pow(F.col("prediction") - F.col("x_along_team1_axis"), 2).alias("se")))
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.groupBy("model").agg(F.avg("se").alias("mse"), F.count(F.lit(1)).alias("n_rows")).select(
        "model", "n_rows", _finite("mse").alias("finite_mse"))


@query("ml_classifiers", O.with_(*NEXT) + f"""SELECT model, count(*) AS n_rows, TRUE AS in_range
FROM {TEST}, (SELECT unnest(['logistic', 'dt_classif', 'naive_bayes']) AS model) GROUP BY model""")
def ml_classifiers(spark, d):
    """Logistic regression, entropy decision tree and Gaussian naive Bayes for the next team."""
    e = _p2(spark, d)
    out = None
    for name, params in (("logistic", {}), ("dt_classif", {"criterion": "entropy", "max_depth": 4}),
                         ("naive_bayes", {"modelType": "gaussian"})):
        m = M.Modeler(name, params, "team_id", TR.P2_FEATURES).fit(e.train)
        acc = m.predict(e.test).select(F.lit(name).alias("model"),
                                       (F.col("prediction") == F.col("team_id")).cast("double").alias("hit"))
        out = acc if out is None else out.unionByName(acc)
    return out.groupBy("model").agg(F.avg("hit").alias("accuracy"), F.count(F.lit(1)).alias("n_rows")).select(
        "model", "n_rows", F.col("accuracy").between(0.0, 1.0).alias("in_range"))


@query("ml_player_mlp", PLAYER_SQL)
def ml_player_mlp(spark, d):
    """Dense network 39 -> 256 -> 512 -> classes for the player, on held-out windows."""
    train, test = _p1_sets(spark, d)
    n = train.select("player_id").distinct().count()
    m = M.Modeler("mlp", {"layers": [len(TR.P1_FEATURES), 256, 512, n], "maxIter": 20, "seed": 42}, "player_id",
                  TR.P1_FEATURES)
    return _player_facts(m.fit(train), test)


@query("ml_player_dense", PLAYER_SQL.replace("TRUE AS known_player", "TRUE AS known_player, TRUE AS beats_mode"))
def ml_player_dense(spark, d):
    """Dense network 39 -> 256 -> 512 -> classes with rectifiers, dropout 0.5, Adam, 500 epochs of batches of 1,024
    rows (the reference's settings), on held-out windows."""
    train, test = _p1_sets(spark, d)
    m = M.Modeler("dense", {"hidden": [256, 512], "epochs": 500, "batch_size": 1024, "dropout": 0.5}, "player_id", TR.P1_FEATURES).fit(train)
    pred = cut(m.predict(test).select("game", "time_period", "player_id", "prediction"))
    most = train.groupBy("player_id").count().orderBy(F.desc("count"), "player_id").first()[0]
    hits = pred.agg(F.sum((F.col("prediction") == F.col("player_id")).cast("int")), F.sum((F.col("player_id") == most).cast("int"))).first()
    return pred.select("game", "time_period", "player_id", _known(pred, m.indexer.labels).alias("known_player"),
                       F.lit((hits[0] or 0) >= (hits[1] or 0)).alias("beats_mode"))


FOURIER = {"gamma": 0.001, "nComponents": 50, "seed": 42}


def _fourier_sql() -> str:
    x = "[" + ", ".join(f'"{c}"' for c in TR.P1_FEATURES) + "]"
    u = lambda salt: f"(({draw_sql(FOURIER['seed'], salt, 'c', 'f', '0')} + 1) / {PRIME + 1}.0)"
    return O.with_(*P1, f"""comps AS (SELECT unnest(range({FOURIER['nComponents']})) AS c),
cells AS (SELECT c, unnest(range({len(TR.P1_FEATURES)})) AS f FROM comps),
freq AS MATERIALIZED (SELECT c, list(sqrt(-2 * ln({u(4)})) * cos(2 * pi() * {u(5)}) * sqrt(2 * {FOURIER['gamma']}) ORDER BY f) AS w,
  2 * pi() * any_value({draw_sql(FOURIER['seed'], 6, 'c', '0', '0')}) / {PRIME}.0 AS b FROM cells GROUP BY c)
""") + f"""SELECT game, player_id, time_period, round(sum(z), 4) AS z_sum, round(max(z) FILTER (WHERE c = 0), 4) AS z_first FROM (
  SELECT game, player_id, time_period, c, sqrt(2.0 / {FOURIER['nComponents']}) * cos(
    list_sum(list_transform(list_zip({x}, w), lambda p: p[1] * p[2])) + b) AS z FROM p1 JOIN freq ON true)
GROUP BY game, player_id, time_period"""


@query("ml_random_fourier", _fourier_sql())
def ml_random_fourier(spark, d):
    """Random Fourier features of the player features, by value (frequencies from a keyed hash)."""
    train, _ = _p1(spark, d)
    z = vector_to_array(F.col("z"))
    out = M.transformer("rbf_sampler", "features", "z", **FOURIER).transform(_assembled(train, TR.P1_FEATURES))
    return out.select("game", "player_id", "time_period", F.round(F.aggregate(z, F.lit(0.0), lambda a, v: a + v), 4).alias("z_sum"),
                      F.round(z[0], 4).alias("z_first"))


@query("ml_agglomeration", O.with_(*P1) + "SELECT game, player_id, time_period, 10 AS n_pooled, 39 AS n_pooled_from, round("
       + " + ".join(f'"{c}"' for c in MEDIAN_COLS) + ", 4) AS total, 10 AS n_marks FROM p1")
def ml_agglomeration(spark, d):
    """The 39 features pooled to 10 by Ward linkage (pooled values times cluster sizes give the features' sum), and a
    Nystroem map of 10 landmarks."""
    train, _ = _p1(spark, d)
    df = _assembled(train, TR.P1_FEATURES)
    model = M.transformer("agglomeration", "features", "pooled", nClusters=10).fit(df)
    labels = model.getOrDefault("labels")
    sizes = [float(labels.count(g)) for g in range(max(labels) + 1)]
    marks = M.transformer("nystroem", "features", "marks", gamma=0.01, nComponents=10).fit(df)
    pooled = vector_to_array(F.col("pooled"))
    total = F.aggregate(F.zip_with(pooled, F.array(*[F.lit(v) for v in sizes]), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return marks.transform(model.transform(df)).select(
        "game", "player_id", "time_period", F.size(pooled).alias("n_pooled"), F.lit(len(labels)).alias("n_pooled_from"),
        F.round(total, 4).alias("total"), F.size(vector_to_array("marks")).alias("n_marks"))


@query("ml_adaboost_r2", O.with_(*NEXT) + f"SELECT seq, game, TRUE AS finite_x, TRUE AS in_range FROM {TEST}")
def ml_adaboost_r2(spark, d):
    """AdaBoost.R2 of the x coordinate (50 trees at most); predictions lie within the training rows' targets."""
    ex = _p2(spark, d, "distance", "x_along_team1_axis")
    m = M.Modeler("ada_reg", {"n_estimators": 50, "learning_rate": 0.1}, "x_along_team1_axis", TR.P3X_FEATURES).fit(ex.train)
    ends = ex.train.agg(F.min("x_along_team1_axis"), F.max("x_along_team1_axis")).first()
    return m.predict(ex.test).select("seq", "game", _finite("prediction").alias("finite_x"), F.col("prediction").between(*ends).alias("in_range"))


def _scaled_sql() -> str:
    lim = ", ".join(f'min("{c}") AS "lo_{c}", max("{c}") AS "hi_{c}", avg("{c}") AS "mu_{c}", stddev_samp("{c}") AS "sd_{c}"'
                    for c in MEDIAN_COLS)
    mm, sd, ma = [], [], []
    for c in MEDIAN_COLS:
        mm.append(f'CASE WHEN "hi_{c}" = "lo_{c}" THEN 0.5 ELSE ("{c}" - "lo_{c}") / ("hi_{c}" - "lo_{c}") END')
        sd.append(f'CASE WHEN "sd_{c}" > 0 THEN ("{c}" - "mu_{c}") / "sd_{c}" ELSE 0 END')
        ma.append(f'"{c}" / CASE WHEN greatest(abs("lo_{c}"), abs("hi_{c}")) = 0 THEN 1 ELSE greatest(abs("lo_{c}"), abs("hi_{c}")) END')
    return (O.with_(*P1, f"lim AS (SELECT {lim} FROM p1)")
            + f"""SELECT game, player_id, time_period, round({' + '.join(mm)}, 4) AS min_max, round({' + '.join(sd)}, 4) AS standard,
  round({' + '.join(ma)}, 4) AS max_abs, {len(MEDIAN_COLS)} AS n_robust FROM p1, lim""")


@query("ml_scalers", _scaled_sql())
def ml_scalers(spark, d):
    """Min-max, standard, max-abs and robust scaling of the player features (row sums of the scaled features)."""
    train, _ = _p1(spark, d)
    df = _assembled(train, TR.P1_FEATURES)
    for name in ("min_max", "standard", "max_abs", "robust"):
        df = M.transformer(name, "features", name).fit(df).transform(df)
    total = lambda c: F.round(F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x), 4).alias(c)
    return df.select("game", "player_id", "time_period", total("min_max"), total("standard"), total("max_abs"),
                     F.size(vector_to_array("robust")).alias("n_robust"))


@query("ml_feature_selection", O.with_(*NEXT) + f"""SELECT seq, game, TRUE AS some_variance, TRUE AS some_fwe, 4 AS n_percentile
FROM {FULL} WHERE (seq * 7919) % 100 < 70""")
def ml_feature_selection(spark, d):
    """Variance threshold, family-wise-error and percentile selection (x model)."""
    ex = _p2(spark, d, "distance", "x_along_team1_axis")
    df = _assembled(ex.train.withColumn("label", F.col("x_along_team1_axis")), TR.P3X_FEATURES)
    out = df
    for name, kw in (("variance_threshold", {"threshold": 0.0}), ("fwe", {"threshold": 0.05}),
                     ("percentile", {"threshold": 0.5})):
        out = M.transformer(name, "features", name, **kw).fit(df).transform(out)
    size = lambda n: F.size(vector_to_array(n))
    return out.select("seq", "game", (size("variance_threshold") > 0).alias("some_variance"),
                      size("fwe").between(1, len(TR.P3X_FEATURES)).alias("some_fwe"), size("percentile").alias("n_percentile"))


@query("ml_feature_transforms", O.with_(*NEXT) + f"""SELECT seq, game, TRUE AS binary, TRUE AS unit_norm, 3 AS n_pca, 54 AS n_poly,
  CAST(type_id_lag1 + 1 AS BIGINT) AS onehot_slot FROM {TEST}""")
def ml_feature_transforms(spark, d):
    """Binarizer, normalizer, PCA, degree-2 polynomial expansion, one-hot of the lag-1 type."""
    train, test = TR.next_event_sets(me_(spark, d), split_flag())
    e = TR.encode_sets(train, test, "team_change", "team_id")
    df = _assembled(e.test, TR.P2_FEATURES)
    df = M.transformer("binarizer", "features", "bin", threshold=0.5).transform(df)
    df = M.transformer("normalizer", "features", "norm", p=2.0).transform(df)
    df = M.transformer("pca", "features", "pca", k=3).fit(df).transform(df)
    df = M.transformer("polynomial", "features", "poly", degree=2).transform(df)
    raw = test.select("seq", "game", F.col("type_id_lag1").cast("double").alias("t"))
    onehot = MF.OneHotEncoder(inputCol="t", outputCol="type_onehot", dropLast=False).fit(raw).transform(raw)
    df = df.join(onehot.select("seq", "game", "type_onehot"), ["game", "seq"])
    norm = F.aggregate(vector_to_array("norm"), F.lit(0.0), lambda a, x: a + x * x)
    return df.select("seq", "game", F.forall(vector_to_array("bin"), lambda x: x.isin(0.0, 1.0)).alias("binary"),
                     (F.abs(norm - 1.0) < 1e-9).alias("unit_norm"), F.size(vector_to_array("pca")).alias("n_pca"),
                     F.size(vector_to_array("poly")).alias("n_poly"),
                     F.array_position(vector_to_array("type_onehot"), 1.0).alias("onehot_slot"))


@query("ml_fastica", O.with_(*P1) + "SELECT game, player_id, time_period, TRUE AS finite, round("
       + " + ".join(f'"{c}"' for c in MEDIAN_COLS) + ", 4) AS identity_sum FROM p1")
def ml_fastica(spark, d):
    """M9/M8: independent components of the player features, next to an identity copy."""
    train, _ = _p1(spark, d)
    df = _assembled(train, TR.P1_FEATURES, "raw")
    model = M.FastICA(inputCol="raw", outputCol="ica", tol=0.85).fit(df)
    out = M.feature_union(["ica", "raw"], "union").transform(model.transform(df)).withColumn("u", vector_to_array("union"))
    n = len(TR.P1_FEATURES)
    copy = F.slice("u", F.size("u") - n + 1, F.lit(n))
    return out.select("game", "player_id", "time_period", F.forall("u", lambda x: F.abs(x) < float("inf")).alias("finite"),
                      F.round(F.aggregate(copy, F.lit(0.0), lambda a, x: a + x), 4).alias("identity_sum"))


@query("ml_zero_count_stage", O.with_(*P1) + f"SELECT game, player_id, time_period, CAST({ZC_SUM} AS INT) AS n_zero, "
       f"CAST({len(MEDIAN_COLS)} - ({ZC_SUM}) AS INT) AS n_nonzero FROM p1")
def ml_zero_count_stage(spark, d):
    """Zero / non-zero counts as a pipeline stage."""
    train, _ = _p1(spark, d)
    return M.ZeroCount(inputCols=TR.P1_FEATURES).transform(train).select(
        "game", "player_id", "time_period", "n_zero", "n_nonzero")


@query("ml_select_from_model", "SELECT unnest([" + ", ".join(f"'{f}'" for f in TR.P2_FEATURES)
       + "]) AS feature, TRUE AS in_range, TRUE AS some_selected, 4 AS n_rfe_kept")
def ml_select_from_model(spark, d):
    """Keep features at least as important as the mean importance of a fitted forest; then RFE."""
    train = cut(_p2(spark, d).train)                     # read by every fit of the elimination
    m = M.Modeler("rf_classif", {"n_estimators": 20, "max_depth": 6}, "team_id", TR.P2_FEATURES).fit(train)
    imp = m.model.stages[-1].featureImportances.toArray()
    some = 1 <= len(M.select_from_model(imp).getIndices()) <= len(imp)
    rfe = M.recursive_elimination(train, TR.P2_FEATURES, "team_id", "rf_classif", {"n_estimators": 10, "max_depth": 4}, keep=4)
    rows = [(f, 0.0 <= float(imp[i]) <= 1.0, some, len(rfe)) for i, f in enumerate(TR.P2_FEATURES)]
    return spark.createDataFrame(rows, "feature string, in_range boolean, some_selected boolean, n_rfe_kept int")


@query("ml_random_search", "SELECT CAST(unnest(range(4)) AS INT) AS draw, TRUE AS finite_mse")
def ml_random_search(spark, d):
    """Random draws of forest settings, 3-fold cross-validated (x model, MSE)."""
    ex = _p2(spark, d, "distance", "x_along_team1_axis")
    grid = {"n_estimators": [10, 20], "max_depth": [4, 8], "max_features": [2, 4]}
    m = M.Modeler("rf_reg", {}, "x_along_team1_axis", TR.P3X_FEATURES)
    _, results = M.random_search(ex.train, m, grid, n_iter=4, folds=3, parallelism=4)
    return results.select("draw", _finite("mse").alias("finite_mse"))


def _knn_sql(k: int = 5) -> str:
    x = "[" + ", ".join(f'"{c}"' for c in TR.P1_FEATURES) + "]"
    ids = "game || '|' || time_period || '|' || CAST(player_id AS VARCHAR)"
    elig = "player_id IN (SELECT player_id FROM elig)"
    med = ", ".join(f'CAST(median("{c}") AS DOUBLE) AS "m_{c}"' for c in TR.P1_FEATURES)
    fill = ", ".join(f'COALESCE(CAST("{c}" AS DOUBLE), (SELECT "m_{c}" FROM med1)) AS "{c}"' for c in TR.P1_FEATURES)
    return O.with_(*FEAT, f"""med1 AS (SELECT {med} FROM feat WHERE {elig} AND NOT ({P1_TEST})),
raw1 AS (SELECT game, player_id, time_period, {fill} FROM feat WHERE {elig}),
tr AS MATERIALIZED (SELECT {ids} AS id, player_id, {x} AS x FROM raw1 WHERE NOT ({P1_TEST})),
te AS MATERIALIZED (SELECT {ids} AS id, {x} AS x FROM raw1 WHERE {P1_TEST}),
pairs AS (SELECT te.id AS qid, tr.id, tr.player_id AS label, round(list_sum(list_transform(list_zip(te.x, tr.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d2
          FROM te JOIN tr ON te.id <> tr.id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM pairs) WHERE rank <= {k}),
votes AS (SELECT qid, label, count(*) AS n FROM near GROUP BY qid, label),
pred AS (SELECT qid, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1)
""") + "SELECT qid, CAST(rank AS INTEGER) AS rank, id, label, d2, prediction, TRUE AS pruned FROM near JOIN pred USING (qid)"


@query("ml_player_knn", _knn_sql())
def ml_player_knn(spark, d):
    """M5: exact k nearest training windows of every held-out window, and the player they vote for.

    ``pruned``: over all queries fewer pairs were compared than there are.
    """
    train, test = _p1_sets(spark, d)
    key = ("game", "time_period", "player_id")
    found = cut(NN.nearest(NN.frame(train, TR.P1_FEATURES, key, "player_id"), NN.frame(test, TR.P1_FEATURES, key), 5))
    compared = found.where("rank = 1").agg(F.sum("compared")).first()[0] or 0
    pairs = train.count() * test.count()
    return found.join(NN.predicted(found), "qid").select("qid", "rank", "id", "label", "d2", "prediction", F.lit(compared < pairs or pairs == 0).alias("pruned"))


SWEEP_TREES, SWEEP_DEPTHS = list(range(60, 151, 5)), list(range(18, 25))   # fixed values: the reference's grid


@query("ml_size_sweep", O.with_(*P1) + f"""SELECT n_estimators, max_depth, (SELECT count(*) FROM p1 WHERE {P1_TEST}) AS n_test, TRUE AS in_range,
  TRUE AS grows FROM (SELECT CAST(60 + 5 * (k // 7) AS INTEGER) AS n_estimators, CAST(18 + k % 7 AS INTEGER) AS max_depth
                      FROM (SELECT unnest(range(133)) AS k))""")
def ml_size_sweep(spark, d):
    """Accuracy and size of the reference's 19 x 7 forests (ICA next to the raw features), read from one forest
    and written as a table."""
    import uuid

    from ..session import shared_path
    from ..sources.store import write_table

    train, test = _p1_sets(spark, d)
    result = M.forest_sweep(train, test, TR.player_model(), SWEEP_TREES, SWEEP_DEPTHS)
    path = shared_path(spark, f"sweep-{uuid.uuid4().hex}")
    write_table(result, f"{path}/results")
    got = spark.read.parquet(f"{path}/results")
    one = got.where(f"n_estimators = {SWEEP_TREES[0]} AND max_depth = {SWEEP_DEPTHS[0]}").first()
    return got.select("n_estimators", "max_depth", F.col("n").alias("n_test"), F.col("accuracy").between(0.0, 1.0).alias("in_range"),
                      (F.col("n_nodes") >= one["n_nodes"]).alias("grows"))


@query("ml_train_all", "SELECT * FROM (VALUES ('player', 'accuracy', TRUE), ('next_team', 'accuracy', TRUE), "
       "('coords', 'avg_l2_error', TRUE), ('coords', 'l2_accuracy', TRUE), ('coords_x', 'mse', TRUE), ('coords_y', 'mse', TRUE)) "
       "t(problem, metric, in_range)")
def ml_train_all(spark, d):
    """The three problems' models (ICA union + forest, stacking, boosted coordinates); held-out metrics."""
    m = TR.train_all(me_(spark, d), eligible_(spark, d), split=split_flag()).metrics
    top = F.when(F.col("metric") == "mse", 1e4).when(F.col("metric") == "avg_l2_error", K.MAX_L2_ERROR).otherwise(1.0)
    return m.select("problem", "metric", F.col("value").between(F.lit(0.0), top).alias("in_range"))


@query("prediction_rows", O.with_(*NEXT) + "SELECT DISTINCT game, TRUE AS known_player, TRUE AS known_team, TRUE AS on_pitch, TRUE AS in_csv FROM nxt")
def prediction_rows_q(spark, d):
    """One prediction row per game (player, team, y, x) from models trained on all rows, through the CSV sink."""
    import uuid

    from ..session import shared_path
    from ..sources.store import write_predictions

    tm = TR.train_all(me_(spark, d), eligible_(spark, d), with_metrics=False)
    out = cut(TR.score_games(me_(spark, d), tm))
    path = shared_path(spark, f"predictions/{uuid.uuid4().hex}")
    write_predictions(out, path)
    back = spark.read.schema("player_id bigint, team_id int, y double, x double").csv(path)
    same = back.join(out.select("player_id", "team_id", "y", "x"), ["player_id", "team_id", "y", "x"], "left_anti").count() == 0
    players = [*map(int, tm.player.indexer.labels), K.FALLBACK_PLAYER]
    on = F.col("x").between(-10.0, 110.0) & F.col("y").between(-10.0, 110.0)
    return out.select("game", F.col("player_id").isin(players).alias("known_player"),
                      F.col("team_id").isin(0, 1).alias("known_team"), on.alias("on_pitch"), F.lit(same).alias("in_csv"))


assert K.FALLBACK_PLAYER  # fixed fallbacks live in constants


def _stream_next_event(spark, d):
    """Streaming: next-event features over the landed event files (foreachBatch, table state), read back."""
    import uuid

    from ..session import shared_path
    from ..sources import fixture as FX
    from ..sources.store import source_key
    from ..streaming.replay import run_replay

    me = FX.match_events(spark, d)
    src = me.inputFiles()[0].rsplit("/", 1)[0]
    run = f"stream/{source_key(spark, f'{d.rstrip(chr(47))}/events.parquet')}-{uuid.uuid4().hex[:8]}"
    return run_replay(spark, src, me.schema, shared_path(spark, run), shared_path(spark, f"{run}/ckpt"))


from . import catalog as _C  # noqa: E402

_C.query("stream_next_event", _C.ORACLE["next_event_dataset"])(_stream_next_event)
