"""Dense network: gradients against finite differences, training over several tasks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlens.plans import dense as D
from pitchlens.plans import models as M


def test_gradients_equal_finite_differences():
    r = np.random.default_rng(0)
    net = D.Network([4, 5, 6, 3], seed=1)
    net.flat += 0.1 * r.normal(size=net.flat.shape)      # no unit sits exactly at its kink
    x, y = r.normal(size=(20, 4)), r.integers(0, 3, 20)
    g = net.gradient(x, y)
    for k in r.choice(len(net.flat), 60, replace=False):
        keep = net.flat[k]
        net.flat[k] = keep + 1e-6
        up = net.loss(x, y)
        net.flat[k] = keep - 1e-6
        down = net.loss(x, y)
        net.flat[k] = keep
        assert (up - down) / 2e-6 == pytest.approx(g[k], abs=1e-6)
    dropped = [net.gradient(x, y, 0.5, np.random.default_rng(s)) for s in range(3000)]
    assert np.allclose(np.mean(dropped, axis=0)[-3:], g[-3:], atol=0.05)        # the output bias: dropout keeps the mean signal


@pytest.mark.parametrize("rows_per_task", [20_000, 60])
def test_training_lowers_the_loss_and_predicts(spark, monkeypatch, tmp_path, rows_per_task):
    monkeypatch.setattr(D, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(D, "BLOCK", 100)
    monkeypatch.setattr(D, "FAN_IN", 2)
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0) * 2 + (x[:, 2] > 0)
    df = spark.createDataFrame([(*map(float, a), int(b) + 500) for a, b in zip(x, y)], "a double, b double, c double, who long").repartition(4)
    rows = df.select(F.array("a", "b", "c").alias("x"), (F.col("who") - 500).cast("int").alias("label"))
    losses = [D.train(rows, [3, 32, 32, 4], e, batch=32, dropout=0.1, rate=0.01, local_epochs=5, seed=3).loss(x, y) for e in (5, 15, 40)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.5
    m = M.Modeler("dense", {"hidden": [32, 32], "epochs": 40, "batch_size": 32, "dropout": 0.1, "learning_rate": 0.01}, "who", ["a", "b", "c"]).fit(df)
    pred = m.predict(df)
    assert pred.where("prediction = who").count() > 320
    m.save(str(tmp_path / "m"))
    back = M.Modeler("dense", {}, "who", ["a", "b", "c"]).load(str(tmp_path / "m")).predict(df)
    assert sorted(map(str, back.collect())) == sorted(map(str, pred.collect()))


def test_no_rows_and_unknown_parameters(spark):
    with pytest.raises(ValueError):
        D.train(spark.createDataFrame([], "x array<double>, label int"), [1, 2], 1)
    with pytest.raises(ValueError):
        M.make_estimator("dense", {"layers": 3})
