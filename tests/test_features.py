from pitchlens.plans import features as FE
from pitchlens.plans.features import window_features


def row(df, **kw):
    q = df
    for k, v in kw.items():
        q = q.where(f"{k} = '{v}'" if isinstance(v, str) else f"{k} = {v}")
    rows = q.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_slice_local_previous_event(events):
    # foul at 299 s, pass at 300 s: in window 0-15 the pass follows the foul (free kick);
    # in window 5-20 the foul is outside, so the pass has no predecessor.
    ev = events([{"game_time_in_sec": 299, "type_id": 4, "player_id": 7},
                 {"game_time_in_sec": 300, "type_id": 1, "player_id": 8}])
    f = window_features(ev)
    assert row(f, player_id=8, time_period="0-15").nb_free_kick == 1
    assert row(f, player_id=8, time_period="5-20").nb_free_kick == 0


def test_null_player_row_dropped_before_lag(events):
    # corner (team event, no player) between a foul and a pass: dropped, so the pass follows the foul
    ev = events([{"game_time_in_sec": 10, "type_id": 4, "player_id": 7},
                 {"game_time_in_sec": 11, "type_id": 6, "player_id": None},
                 {"game_time_in_sec": 12, "type_id": 1, "player_id": 8}])
    f = window_features(ev)
    r = row(f, player_id=8, time_period="0-15")
    assert (r.nb_free_kick, r.nb_corner) == (1, 0)


def test_no_pass_gives_zero_count_and_null_rate(events):
    ev = events([{"game_time_in_sec": 10, "type_id": 4, "player_id": 7, "team_id": 1},
                 {"game_time_in_sec": 11, "type_id": 1, "outcome": 0, "player_id": 8, "team_id": 1}])
    f = window_features(ev)
    r7 = row(f, player_id=7, time_period="0-15")
    assert r7.p_1_nb == 0 and r7.p_1_success_rate is None and r7.p_4_nb == 1
    assert r7.t_1_nb == 1 and r7.t_1_success_rate == 0.0 and r7.t_4_nb == 1


def test_zone_shares(events):
    ev = events([{"game_time_in_sec": 1, "player_id": 7, "zone": "Back"},
                 {"game_time_in_sec": 2, "player_id": 7, "zone": "Left"},
                 {"game_time_in_sec": 3, "player_id": 7, "zone": "Left"},
                 {"game_time_in_sec": 4, "player_id": 7, "zone": None},
                 {"game_time_in_sec": 5, "player_id": 9, "zone": None}])
    f = window_features(ev)
    r7 = row(f, player_id=7, time_period="0-15")
    assert abs(r7.Back + r7.Left - 100.0) < 1e-9
    assert abs(r7.Left - 200.0 / 3) < 1e-9
    assert (r7.Center, r7.Right) == (None, None)          # no located event of the window is there
    r9 = row(f, player_id=9, time_period="0-15")
    assert (r9.Back, r9.Center, r9.Left, r9.Right) == (None, None, None, None)


def test_eligibility_after_team_stats(events, spark):
    ev = events([{"game_time_in_sec": 1, "player_id": 7, "team_id": 1},
                 {"game_time_in_sec": 2, "player_id": 8, "team_id": 1}])
    elig = spark.createDataFrame([(7,)], "player_id bigint")
    f = window_features(ev, elig)
    r = row(f, player_id=7, time_period="0-15")
    assert r.t_1_nb == 2 and r.p_1_nb == 1
    assert f.where("player_id = 8").count() == 0


def test_test_set_hides_last_rows(events):
    rows = [{"game_time_in_sec": i, "player_id": 1 if i < 5 else 2} for i in range(15)]
    f = FE.test_set_stats(events(rows), masked_player=1, last_hidden=10)
    r = f.first()
    assert f.count() == 1 and r.p_1_nb == 5 and r.t_1_nb == 5


def test_zone_absent_from_whole_window_is_null(events):
    # in window 0-15 nobody has a 'Right' event: Right is NULL (no pivot column), other zones 0..100
    ev = events([{"game_time_in_sec": 1, "player_id": 7, "zone": "Back"},
                 {"game_time_in_sec": 2, "player_id": 8, "zone": "Left"}])
    f = window_features(ev)
    r7 = row(f, player_id=7, time_period="0-15")
    assert (r7.Back, r7.Left, r7.Right, r7.Center) == (100.0, 0.0, None, None)


def test_training_rows_are_computed_once(events):
    """What fits read many times is a landed table, not the plan of its windows and lags."""
    from pitchlens.plans import training as TR

    me = events([{"seq": i, "game_time_in_sec": 30 * i, "player_id": 1 + i % 3, "team_id": i % 2} for i in range(40)])
    feats, _ = TR.player_training_set(me, None)
    train, test = TR.next_event_sets(me)
    for df in (feats, train, test):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan and "Join" not in plan


def test_windows_are_lagged_once(events, spark):
    """team totals and zones of a window come from its events; only the players' rows take the lag, once."""
    ev = events([{"game_time_in_sec": 1, "player_id": 7, "team_id": 1}, {"game_time_in_sec": 2, "player_id": 8, "team_id": 1}])
    f = window_features(ev, spark.createDataFrame([(7,)], "player_id bigint"))
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(type_id") == 1 and "format_string" not in plan.split("Aggregate", 1)[1]
    assert [r.time_period for r in f.collect()] == ["0-15"]
