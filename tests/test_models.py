import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pitchlens.plans import models as M


def test_parameter_mapping_to_mllib(spark):
    rf = M.make_estimator("rf_classif", {"n_estimators": 50, "max_depth": None, "max_features": "sqrt",
                                         "criterion": "entropy", "n_jobs": 3})
    assert rf.getNumTrees() == 50 and rf.getMaxDepth() == 30 and rf.getFeatureSubsetStrategy() == "sqrt"
    assert rf.getImpurity() == "entropy"
    et = M.make_estimator("et_classif", {"max_features": 0.1})
    assert et.getOrDefault("maxFeatures") == "0.1" and et.getOrDefault("maxDepth") == -1
    with pytest.raises(ValueError, match="bootstrap"):
        M.make_estimator("et_classif", {"bootstrap": True})
    gbt = M.make_estimator("xgb_reg", {"n_estimators": 30, "learning_rate": 0.3, "subsample": 0.9,
                                       "min_child_weight": 5, "reg_lambda": 2, "objective": "reg:linear"})
    get = gbt.getOrDefault
    assert get("rounds") == 30 and get("learningRate") == 0.3 and get("minChildWeight") == 5.0 and get("regLambda") == 2.0
    assert get("task") == "regression" and get("maxDepth") == 6 and get("subsample") == 0.9
    reg = M.make_estimator("rf_reg", {"criterion": "gini"})      # classifier-only option dropped
    assert reg.getImpurity() == "variance"
    ovr = M.make_estimator("xgb_multiclass", {"n_estimators": 2}, n_classes=5)
    assert type(ovr).__name__ == "OneVsRest"
    a, b = M.make_estimator("rf_reg"), M.make_estimator("rf_reg")
    assert a is not b                                            # a fresh estimator per call


def _blobs(spark, n=240, seed=3):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = [101, 205, 307][i % 3]
        c = {101: (0, 0), 205: (5, 5), 307: (0, 8)}[label]
        rows.append((label, float(c[0] + rnd.normal()), float(c[1] + rnd.normal()), float(rnd.normal())))
    return spark.createDataFrame(rows, "player_id bigint, a double, b double, c double")


def test_modeler_maps_classes_back_and_round_trips(spark, tmp_path):
    df = _blobs(spark)
    m = M.Modeler("rf_classif", {"n_estimators": 10, "max_depth": 5}, "player_id", ["a", "b", "c"]).fit(df)
    pred = m.predict(df)
    acc = pred.agg(F.avg((F.col("prediction") == F.col("player_id")).cast("double"))).first()[0]
    assert acc > 0.9
    assert {r.prediction for r in pred.select("prediction").distinct().collect()} <= {101.0, 205.0, 307.0}
    m.save(str(tmp_path / "m"))
    back = M.Modeler("rf_classif", {}, "player_id", ["a", "b", "c"]).load(str(tmp_path / "m"))
    assert sorted(r.prediction for r in back.predict(df).collect()) == sorted(r.prediction for r in pred.collect())


def test_zero_count_stage(spark):
    df = spark.createDataFrame([(0.0, 1.0, None), (0.0, 0.0, 0.0)], "a double, b double, c double")
    got = [(r.n_zero, r.n_nonzero) for r in M.ZeroCount(inputCols=["a", "b", "c"]).transform(df).collect()]
    assert got == [(1, 2), (3, 0)]


def test_fastica_whitens_and_decorrelates(spark):
    rnd = np.random.default_rng(0)
    s = np.c_[np.sign(rnd.normal(size=600)), rnd.uniform(-1, 1, size=600)]
    x = s @ np.array([[1.0, 0.5], [0.3, 1.0]]).T
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    df = M.feature_union(["a", "b"], "v").transform(df)
    model = M.FastICA(inputCol="v", outputCol="ica", tol=1e-6, maxIter=200).fit(df)
    out = np.array([r.ica for r in model.transform(df).select(vector_to_array("ica").alias("ica")).collect()])
    cov = np.cov(out.T)
    assert np.allclose(np.diag(cov), 1.0, atol=0.05) and abs(cov[0, 1]) < 0.05
    # each component matches one source up to sign and scale
    corr = np.abs(np.corrcoef(np.c_[out, s].T)[:2, 2:])
    assert (corr.max(axis=1) > 0.95).all()


@pytest.mark.parametrize("model_type", ["rf_reg", "xgb_reg", "et_classif"])
def test_random_search_returns_one_row_per_draw(spark, model_type):
    df = _blobs(spark).withColumn("target", F.col("a") * 2 + F.col("b"))
    m = M.Modeler(model_type, {}, "player_id" if model_type == "et_classif" else "target", ["a", "b", "c"])
    best, res = M.random_search(df, m, {"n_estimators": [5, 10], "max_depth": [2, 4]}, n_iter=3, folds=2,
                                parallelism=2)
    assert res.count() == 3 and best is not None


def test_pipeline_with_python_stages_saves_and_loads(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler

    df = _blobs(spark)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="v"),
                            M.FastICA(inputCol="v", outputCol="ica", tol=1e-4),
                            M.ZeroCount(inputCols=["a", "b", "c"])])
    model = pipe.fit(df)
    model.write().overwrite().save(str(tmp_path / "p"))
    back = PipelineModel.load(str(tmp_path / "p"))
    a = [r.ica for r in model.transform(df).select(vector_to_array("ica").alias("ica")).collect()]
    b = [r.ica for r in back.transform(df).select(vector_to_array("ica").alias("ica")).collect()]
    assert np.allclose(np.array(a), np.array(b))


def test_no_silent_parameter_changes(spark):
    with pytest.raises(ValueError, match="max_depth"):
        M.make_estimator("rf_classif", {"max_depth": 50})
    with pytest.raises(ValueError, match="no MLlib counterpart"):
        M.make_estimator("rf_classif", {"max_leaf_nodes": 5})
    for kind in ("rf_classif", "rf_reg", "dt_classif", "dt_reg"):
        assert M.make_estimator(kind).getMaxDepth() == M.make_estimator(kind, {"max_depth": None}).getMaxDepth() == 30
    assert M.make_estimator("rf_reg").getFeatureSubsetStrategy() == "all"
    gbt = M.make_estimator("xgb_reg", {"gamma": 0.2, "colsample_bytree": 0.5, "reg_alpha": 1})
    assert [gbt.getOrDefault(k) for k in ("maxDepth", "gamma", "colsample", "regAlpha")] == [6, 0.2, 0.5, 1.0]
    for kind, params in (("xgb_classif", {"scale_pos_weight": 3}), ("xgb_reg", {"max_leaves": 4}), ("dt_reg", {"reg_lambda": 1}),
                         ("rf_classif", {"min_samples_split": 9, "min_samples_leaf": 2}), ("xgb_multiclass", {"reg_lambda": 2})):
        with pytest.raises(ValueError):
            M.make_estimator(kind, params)
    assert M.make_estimator("rf_classif", {"min_samples_split": 4, "min_samples_leaf": 2}).getMinInstancesPerNode() == 2
    df = _blobs(spark)
    m = M.Modeler("logistic", {"C": 0.01}, "player_id", ["a", "b", "c"]).fit(df)
    assert m.model.stages[-1].getRegParam() == pytest.approx(1 / (0.01 * df.count()))


def test_predicted_ids_keep_their_type(spark):
    big = 2**53 + 1
    df = _blobs(spark).withColumn("player_id", F.col("player_id") + big)
    m = M.Modeler("dt_classif", {"max_depth": 5}, "player_id", ["a", "b", "c"]).fit(df)
    pred = m.predict(df)
    assert dict(pred.dtypes)["prediction"] == "bigint"
    assert {r[0] for r in pred.select("prediction").distinct().collect()} <= {101 + big, 205 + big, 307 + big}


def test_split_and_coordinate_join_use_the_event_key(spark):
    """``seq`` starts anew in every game: games must be split independently and never be paired."""
    from pitchlens.plans import training as TR

    df = spark.range(40).select((F.col("id") % 2).cast("string").alias("game"), (F.col("id") / 2).cast("int").alias("seq"))
    train, test = TR.split_rows(df, TR.default_split())
    both = {(r.game, r.seq) for r in train.collect()}
    assert len(both) + test.count() == 40 and any((g, s) in both and (str(1 - int(g)), s) not in both for g, s in both)

    class Same:
        def predict(self, rows):
            return rows.withColumn("prediction", F.col("seq").cast("double"))

    rows = df.withColumns({"x_along_team1_axis": F.lit(1.0), "y_along_team1_axis": F.lit(2.0)})
    enc = TR.Encoded(rows, rows, {})
    assert TR.predict_coords(enc, enc, Same(), Same()).count() == 40


def test_search_grids_are_accepted_by_their_models():
    import itertools

    from pitchlens.plans.training import SEARCH_GRIDS

    for grids in SEARCH_GRIDS.values():
        for kind, grid in grids.items():
            draws = list(itertools.product(*grid.values()))
            assert len(draws) >= 30
            for draw in draws[::17]:
                M.make_estimator(kind, dict(zip(grid, draw)))
