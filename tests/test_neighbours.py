"""Exact nearest neighbours: against all pairs."""
import numpy as np
import pytest

from pitchlens.plans import neighbours as N


def frame(spark, x, label=True):
    rows = [(f"r{i:04}", v, i % 7) for i, v in enumerate(x)]
    df = spark.createDataFrame([(a, b.tolist() if b is not None else None, c) for a, b, c in rows], "id string, x array<double>, label long").repartition(5)
    return df if label else df.select("id", "x")


def plain(train, queries, k):
    out = {}
    for i, q in enumerate(queries):
        d = sorted((round(float(((v - q) ** 2).sum()), 6), f"r{j:04}") for j, v in enumerate(train))
        out[f"r{i:04}"] = d[:k]
    return out


@pytest.mark.parametrize("kind", ["spread", "grid", "equal"])
@pytest.mark.parametrize("pivots,chunk", [(None, 4096), (30, 20), (1, 50)])
def test_equals_all_pairs(spark, kind, pivots, chunk):
    r = np.random.default_rng(0)
    x = {"spread": r.normal(size=(400, 5)) + 10 * r.integers(0, 6, (400, 1)), "grid": r.integers(0, 4, (400, 3)).astype(float), "equal": np.ones((400, 2))}[kind]
    q = x[:80] + (0.01 if kind == "spread" else 0.0)
    got, compared = {}, 0
    for row in N.nearest(frame(spark, x), frame(spark, q, False), 5, pivots, chunk).orderBy("qid", "rank").collect():
        got.setdefault(row["qid"], []).append((row["d2"], row["id"]))
        assert row["rank"] == len(got[row["qid"]]) and row["label"] == int(row["id"][1:]) % 7
        compared += row["compared"] if row["rank"] == 1 else 0
    assert got == plain(x, q, 5)
    assert compared < 0.5 * len(x) * len(q) if kind == "spread" and pivots != 1 else compared <= len(x) * len(q)


def test_few_rows_nulls_and_votes(spark):
    train = spark.createDataFrame([("a", [0.0], 2), ("b", [1.0], 1), ("c", None, 9)], "id string, x array<double>, label long")
    found = N.nearest(train, spark.createDataFrame([("q", [0.2]), ("n", None)], "id string, x array<double>"), 5)
    assert [(r["qid"], r["rank"], r["id"]) for r in found.orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    assert [tuple(r) for r in N.predicted(found).collect()] == [("q", 1)]
    assert N.nearest(train.limit(0), train, 3).count() == 0 and N.nearest(train, train.limit(0), 3).count() == 0
