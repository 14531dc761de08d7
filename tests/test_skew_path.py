"""The skew-safe (blocked) plans give the same tables as the single-window plans on real test data."""
import os

import pytest

from pitchlens.plans import features as FE
from pitchlens.sources.fixture import match_events

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def rows(df):
    cols = sorted(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((v is None, v if v is not None else 0) for v in t))


def test_window_features_blocked_equals_direct(spark):
    me = match_events(spark, SF)
    # block of 64 seq units: every game/window is split into many blocks
    blocked = FE.window_features(me, block=64, strategy="blocked")
    direct = FE.window_features(me, strategy="direct")
    assert rows(blocked) == rows(direct)


def test_next_event_and_test_set_blocked_equals_direct(spark):
    me = match_events(spark, SF)
    assert rows(FE.season_next_event(me, block=50, strategy="blocked")) == rows(FE.season_next_event(me, strategy="direct"))
    assert rows(FE.test_set_stats(me, block=40, strategy="blocked")) == rows(FE.test_set_stats(me, strategy="direct"))
