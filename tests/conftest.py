import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

ME_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("game", T.StringType()),
    T.StructField("period_id", T.IntegerType()), T.StructField("game_time_in_sec", T.IntegerType()),
    T.StructField("player_id", T.LongType()), T.StructField("team_id", T.IntegerType()),
    T.StructField("type_id", T.IntegerType()), T.StructField("outcome", T.IntegerType()),
    T.StructField("keypass", T.IntegerType()), T.StructField("assist", T.IntegerType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("zone", T.StringType()),
])


@pytest.fixture(scope="session")
def spark():
    from pitchlens.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="pitchlens-tests")
    yield s


@pytest.fixture
def events(spark):
    """Build canonical match events from dicts (missing fields default sensibly)."""
    def make(rows):
        out = []
        for i, r in enumerate(rows):
            d = {"seq": i, "game": "g", "period_id": 1, "game_time_in_sec": 0, "player_id": 1, "team_id": 1,
                 "type_id": 1, "outcome": 1, "keypass": None, "assist": None, "x": 50.0, "y": 50.0, "zone": "Back"}
            d.update(r)
            out.append(tuple(d[f.name] for f in ME_SCHEMA.fields))
        return spark.createDataFrame(out, ME_SCHEMA)
    return make
