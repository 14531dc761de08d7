from pyspark.sql import functions as F

from pitchlens.operators.windows import next_event_dataset, sliding_windows
from pitchlens.operators.clean import next_event_input


def starts_of(df, seq):
    return sorted(r.start for r in df.where(F.col("seq") == seq).collect())


def test_inclusive_boundaries(events):
    ev = events([{"game_time_in_sec": t} for t in (0, 300, 900, 2700, 2701)])
    w = sliding_windows(ev)
    assert starts_of(w, 0) == [0]
    assert starts_of(w, 1) == [0, 5]
    assert starts_of(w, 2) == [0, 5, 10, 15]       # on a 5-minute mark: 4 windows
    assert starts_of(w, 3) == [30]                 # 45:00 closes the last window
    assert starts_of(w, 4) == []                   # stoppage time: in no window


def test_second_half_windows_and_labels(events):
    ev = events([{"period_id": 2, "game_time_in_sec": 2700}, {"period_id": 2, "game_time_in_sec": 5401},
                 {"period_id": 3, "game_time_in_sec": 100}])
    w = sliding_windows(ev)
    assert starts_of(w, 0) == [45]
    assert starts_of(w, 1) == []
    assert starts_of(w, 2) == []
    assert w.where("seq = 0").first().time_period == "45-60"


def test_windows_per_event_at_most_four(events):
    ev = events([{"game_time_in_sec": t} for t in range(0, 2701, 7)])
    w = sliding_windows(ev)
    assert w.groupBy("seq").count().agg(F.max("count")).first()[0] <= 4


def test_next_event_drops_first_rows_of_each_period(events):
    rows = [{"period_id": 1, "game_time_in_sec": 10 * i, "team_id": i % 2} for i in range(6)]
    rows += [{"period_id": 2, "game_time_in_sec": 2700 + 10 * i, "team_id": i % 2} for i in range(5)]
    ne = next_event_dataset(next_event_input(events(rows)))
    assert ne.count() == (6 - 3) + (5 - 3)
    r = ne.where("seq = 3").first()
    assert (r.type_id_lag1, r.team_id_lag1, r.team_id_lag3) == (1, 0, 0)
    assert r.x_along_team1_axis_lag1 == 50.0
    assert "period_id_lag1" not in ne.columns


def test_next_event_keeps_null_player_rows(events):
    rows = [{"game_time_in_sec": i, "player_id": None if i == 2 else 1} for i in range(6)]
    ne = next_event_dataset(next_event_input(events(rows)))
    assert ne.count() == 3
