import datetime as dt

from pyspark.sql import types as T

from pitchlens.operators import playtime as PT

RAW = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("game", T.StringType()),
    T.StructField("period_id", T.IntegerType()), T.StructField("game_time_in_sec", T.IntegerType()),
    T.StructField("player_id", T.LongType()), T.StructField("team_id", T.IntegerType()),
    T.StructField("type_id", T.IntegerType()),
    T.StructField("qualifiers", T.ArrayType(T.StructType([T.StructField("qualifier_id", T.IntegerType()),
                                                          T.StructField("value", T.StringType())]))),
])


def raw(spark, rows):
    return spark.createDataFrame([(i, "g", *r) for i, r in enumerate(rows)], RAW)


def lineup(team, ids):
    return (16, 0, None, team, 34, [(30, ", ".join(str(i) for i in ids))])


def test_end_of_periods_last_wins_and_default(spark):
    ev = raw(spark, [(1, 2760, None, 1, 30, []), (1, 2761, None, 0, 30, [])])
    r = PT.end_of_periods(ev).first()
    assert (r.end_first_half, r.end_second_half) == (2761, -1)


def test_play_time_rules(spark):
    starters_home = list(range(1, 12))
    rows = [lineup(1, starters_home + [12, 13]), lineup(0, list(range(21, 32)))]
    rows += [(1, 2760, None, 1, 30, []), (2, 5700, None, 1, 30, [])]       # end1 = 2760, end2 = 5700
    rows += [(2, 3000, 1, 1, 18, []), (2, 3000, 12, 1, 19, [])]             # 1 off at 3000, 12 on
    rows += [(1, 1200, 2, 1, 18, []), (1, 1200, 13, 1, 19, [])]             # 2 off in first half, 13 on
    pt = {r.player_id: r for r in PT.play_time(raw(spark, rows)).collect()}
    assert pt[1].start_game == 0.0 and pt[1].end_game == 3000.0
    assert pt[1].has_played_extra_time_first_half and pt[1].game_time_in_sec == 3000.0 + 60.0
    assert pt[12].start_game == 3000.0 and pt[12].end_game == 5700.0 and pt[12].game_time_in_sec == 2700.0
    assert pt[2].game_time_in_sec == 1200.0 and not pt[2].has_played_extra_time_first_half
    assert pt[13].game_time_in_sec == 5700.0 - 1200.0 + 60.0
    assert pt[5].start_game == 0.0 and pt[5].end_game == 5700.0 and pt[5].game_time_in_sec == 5760.0
    assert 14 not in pt                                         # listed, not starting, never came on
    assert len([p for p in pt if 21 <= p <= 31]) == 11


def test_starting_eleven_first_eleven(spark):
    ev = raw(spark, [lineup(1, list(range(1, 15)))])
    got = [r.player_id for r in PT.starting_eleven(ev).orderBy("slot").collect()]
    assert got == list(range(1, 12))


def test_eligibility_rules(spark):
    pt = spark.createDataFrame([("g", i, 50000.0) for i in (1, 2, 3, 4)] + [("g", 5, 1000.0)],
                               "game string, player_id bigint, game_time_in_sec double")
    players = spark.createDataFrame([
        (1, "1", dt.date(2016, 8, 1)), (2, "1", dt.date(2017, 1, 5)), (3, None, dt.date(2017, 1, 5)),
        (4, None, None), (5, None, None)], "player_id bigint, loan string, arrival_date date")
    moved = spark.createDataFrame([(4,)], "player_id bigint")
    got = sorted(r.player_id for r in PT.eligible_players(pt, players, moved).collect())
    assert got == [1, 3]


def test_duplicate_substitutions_reported_and_first_used(spark):
    from pitchlens.operators.quality import dq_duplicate_substitutions

    ev = raw(spark, [(2, 3000, 7, 1, 19, []), (2, 3100, 7, 1, 19, []), (2, 3200, 8, 1, 18, [])])
    bad = dq_duplicate_substitutions(ev).collect()
    assert [(r.player_id, r.type_id, r.n_events) for r in bad] == [(7, 19, 2)]
    assert PT.substitutions(ev).where("player_id = 7").first().start_game == 3000.0
