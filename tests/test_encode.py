from pitchlens.operators.encode import TargetEncoder, TargetEncoderModel


def test_team_change_encoder_and_unseen_mean(spark, tmp_path):
    train = spark.createDataFrame(
        [(1, 1, 1), (1, 1, 0), (1, 0, 0), (2, 1, 1), (None, 1, None)],
        "type_id_lag1 int, team_id int, team_id_lag1 int")
    m = TargetEncoder(inputCol="type_id_lag1", referenceCols=["team_id", "team_id_lag1"]).fit(train)
    table = {r.category: r.value for r in m.table.collect()}
    assert table == {1: 1 / 3, 2: 0.0}
    assert abs(m.mean_value - (3 * (1 / 3) + 0.0) / 4) < 1e-12      # row-weighted, NULL category excluded
    test = spark.createDataFrame([(1,), (2,), (9,), (None,)], "type_id_lag1 int")
    got = sorted((r.type_id_lag1 for r in m.transform(test).collect()))
    assert got == sorted([1 / 3, 0.0, m.mean_value, m.mean_value])
    m.save(str(tmp_path / "enc"))
    back = TargetEncoderModel.load(spark, str(tmp_path / "enc"), "type_id_lag1")
    assert abs(back.mean_value - m.mean_value) < 1e-12


def test_null_counts_as_change(spark):
    train = spark.createDataFrame([(1, None, None)], "c int, a int, b int")
    m = TargetEncoder(inputCol="c", referenceCols=["a", "b"]).fit(train)
    assert m.table.first().value == 1.0


def test_distance_encoder(spark):
    train = spark.createDataFrame([(1, 60.0, 50.0), (1, 40.0, 50.0), (2, 70.0, 50.0)], "c int, a double, b double")
    m = TargetEncoder(inputCol="c", referenceCols=["a", "b"], method="distance").fit(train)
    assert {r.category: r.value for r in m.table.collect()} == {1: 0.0, 2: 20.0}


def test_reference_columns_must_be_two(spark):
    import pytest

    with pytest.raises(ValueError):
        TargetEncoder(inputCol="c", referenceCols=["a"]).fit(spark.createDataFrame([(1, 1)], "c int, a int"))
