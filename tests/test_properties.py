import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitchlens.functions.columns import along_team1_axis
from pitchlens.plans import features as FE
from pitchlens.sources.fixture import match_events

SF = "/root/testdata/sf0.001"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.floats(0, 100, allow_nan=False)), min_size=1, max_size=20))
def test_projection_is_an_involution(spark, pts):
    df = spark.createDataFrame(pts, "team_id int, v double")
    once = df.select("team_id", "v", along_team1_axis("v", "team_id").alias("p"))
    twice = once.select("v", along_team1_axis("p", "team_id").alias("back")).collect()
    assert all(abs(r.v - r.back) < 1e-9 for r in twice)


def _rows(df):
    cols = sorted(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((v is None, v if v is not None else 0) for v in t))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_same_result_for_1_and_8_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = {}
        for n in (1, 8):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            me = match_events(spark, SF).repartition(n)
            out[n] = (_rows(FE.window_features(me)), _rows(FE.season_next_event(me)))
        assert out[1] == out[8]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_zone_shares_sum_to_100_where_defined(spark):
    f = FE.window_features(match_events(spark, SF)).where(F.col("Back").isNotNull() | F.col("Left").isNotNull()
                                                          | F.col("Center").isNotNull() | F.col("Right").isNotNull())
    total = sum((F.coalesce(F.col(z), F.lit(0.0)) for z in ("Back", "Center", "Left", "Right")), F.lit(0.0))
    assert f.where(F.abs(total - 100.0) > 1e-6).count() == 0
