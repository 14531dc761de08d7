import random

import pytest

from pyspark.sql import functions as F

from pitchlens.operators.ordered import ordered_lag, ordered_position
from pitchlens.operators.windows import all_but_last, last_rows


def data(spark, n=400, seed=7):
    rnd = random.Random(seed)
    rows = []
    seq = 0
    for i in range(n):
        seq += rnd.randint(1, 5)
        rows.append((rnd.choice(["a", "b", "c"]), rnd.choice([1, 2]), seq, rnd.randint(0, 9), rnd.random()))
    return spark.createDataFrame(rows, "k string, p int, seq bigint, v int, w double")


def collect(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_blocked_lag_equals_window_lag(spark):
    df = data(spark)
    cols = ["k", "p", "seq"] + [f"{c}_lag{n}" for c in ("v", "w") for n in (1, 2, 3)]
    direct = ordered_lag(df, ["k", "p"], "seq", ["v", "w"], [1, 2, 3], strategy="direct")
    for block in (7, 16, 1000):    # many tiny blocks, some with fewer rows than the lag
        blocked = ordered_lag(df, ["k", "p"], "seq", ["v", "w"], [1, 2, 3], block=block, strategy="blocked")
        assert collect(blocked, cols) == collect(direct, cols)


def test_position_blocked_and_global(spark):
    df = data(spark)
    direct = ordered_position(df, ["k"], "seq", strategy="direct")
    blocked = ordered_position(df, ["k"], "seq", block=9, strategy="blocked")
    assert collect(blocked, ["k", "seq", "pos", "n_rows"]) == collect(direct, ["k", "seq", "pos", "n_rows"])
    glob = ordered_position(df, [], "seq", block=11, strategy="blocked")
    got = [r.pos for r in glob.orderBy("seq").collect()]
    assert got == list(range(1, df.count() + 1))


def test_building_a_plan_runs_no_job_and_unknown_strategies_are_refused(spark):
    df = data(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    ordered_lag(df, ["k"], "seq", ["v", "w"], [1, 3], block=13)
    ordered_position(df, ["k"], "seq", block=13)
    last_rows(df, 3, keys=["k"])
    all_but_last(df, 3, keys=["k"])
    assert tracker.getJobIdsForGroup("building") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(ValueError):
        ordered_lag(df, ["k"], "seq", ["v"], [1], strategy="auto")


def test_last_rows_and_all_but_last(spark):
    df = data(spark)
    per_k = {r.k: r.c for r in df.groupBy("k").agg(F.count("*").alias("c")).collect()}
    last = last_rows(df, 2, keys=["k"], block=5)
    assert last.count() == 2 * len(per_k)
    assert collect(last_rows(df, 1, keys=["k"]), df.columns) == collect(last_rows(df, 2, keys=["k"], block=5)
                                                                     .join(df.groupBy("k").agg(F.max("seq").alias("seq")), ["k", "seq"]), df.columns)
    assert all_but_last(df, 10_000, keys=["k"]).count() == 0
    rest = all_but_last(df, 10, keys=["k"])
    assert rest.count() == sum(c - 10 for c in per_k.values())
    mx = {r.k: r.m for r in df.groupBy("k").agg(F.max("seq").alias("m")).collect()}
    assert all(r.seq != mx[r.k] for r in rest.collect())
