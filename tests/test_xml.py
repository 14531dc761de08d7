from pitchlens.operators.clean import clean_game_data
from pitchlens.operators.playtime import end_of_periods, starting_eleven, timed_raw
from pitchlens.sources import xml as X

GAME = """<?xml version="1.0" encoding="utf-8"?>
<Games>
  <Game id="1" home_team_id="149" away_team_id="143">
    <Event id="1" event_id="1" type_id="34" period_id="16" min="0" sec="0" team_id="149" outcome="1" x="0" y="0">
      <Q id="11" qualifier_id="30" value="101, 102, 103, 104, 105, 106, 107, 108, 109, 110, 111, 112"/>
    </Event>
    <Event id="2" event_id="2" type_id="1" period_id="1" min="0" sec="5" player_id="101" team_id="149" outcome="1"
           keypass="1" x="50.5" y="49.5"><Q id="12" qualifier_id="56" value="Back"/><Q id="13" qualifier_id="140" value="4"/></Event>
    <Event id="3" event_id="3" type_id="43" period_id="1" min="0" sec="9" player_id="201" team_id="143" outcome="0" x="1" y="1"/>
    <Event id="4" event_id="4" type_id="4" period_id="1" min="1" sec="0" player_id="201" team_id="143" outcome="0" x="30" y="20"/>
    <Event id="5" event_id="5" type_id="30" period_id="1" min="46" sec="2" team_id="149" outcome="1" x="0" y="0"/>
    <Event id="6" event_id="6" type_id="30" period_id="1" min="46" sec="12" team_id="143" outcome="1" x="0" y="0"/>
  </Game>
</Games>
"""

PLAYERS = """<?xml version="1.0" encoding="utf-8"?>
<SoccerFeed><SoccerDocument>
  <Team short_club_name="Lyon">
    <Player uID="p101" loan="1"><Name>A</Name><Position>Forward</Position>
      <Stat Type="join_date">2016-07-01</Stat><Stat Type="join_date">2017-01-05</Stat></Player>
    <Player uID="p102"><Name>B</Name><Position>Defender</Position><Stat Type="leave_date">2019-06-30</Stat></Player>
  </Team>
  <PlayerChanges><Team short_club_name="Lyon">
    <Player uID="p103"><Name>C</Name><Position>Midfielder</Position></Player>
  </Team></PlayerChanges>
</SoccerDocument></SoccerFeed>
"""


def test_game_feed_round_trip(spark, tmp_path):
    p = tmp_path / "game.xml"
    p.write_text(GAME)
    raw = X.read_game_events(spark, str(p))
    rows = raw.orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2, 3, 4, 5]
    assert rows[1].qualifiers[0].qualifier_id == 56 and rows[1].keypass == 1 and rows[1].x == 50.5
    clean = clean_game_data(raw).orderBy("seq").collect()
    assert [r.type_id for r in clean] == [1, 4, 30, 30]          # line-up (period 16) and deleted (43) gone
    assert clean[0].game == "149-143" and clean[0].team_id == 1 and clean[1].team_id == 0
    assert clean[0].zone == "Back" and clean[1].zone is None and clean[1].game_time_in_sec == 60
    keyed = clean_game_data(raw, with_source=True).first().game
    assert keyed == "149-143@game.xml"
    ev = timed_raw(raw)
    assert end_of_periods(ev).first().end_first_half == 46 * 60 + 12
    assert starting_eleven(ev).count() == 11


def test_registry_feed(spark, tmp_path):
    p = tmp_path / "players.xml"
    p.write_text(PLAYERS)
    players, moved = X.read_players(spark, str(p))
    got = {r.player_id: r for r in players.collect()}
    assert set(got) == {101, 102}
    assert str(got[101].arrival_date) == "2017-01-05" and got[101].loan == "1" and got[101].team_name == "Lyon"
    assert got[102].arrival_date is None and str(got[102].leave_date) == "2019-06-30"
    assert [r.player_id for r in moved.collect()] == [103]


def test_registry_reads_a_row_per_team(spark, tmp_path):
    """Two teams of one document are rows of their own; a team that stands in both sections stays in both."""
    team = '<Team short_club_name="%s"><Player uID="p%d"><Name>%s</Name><Position>Forward</Position></Player></Team>'
    filler = "\n" + "<!-- " + "x" * 3000 + " -->\n"
    doc = ("<SoccerFeed><SoccerDocument>" + team % ("Lyon", 1, "A") + filler + team % ("Nice", 2, "B") + filler + team % ("Lens", 3, "C")
           + "<PlayerChanges>" + team % ("Nice", 2, "B") + team % ("Metz", 4, "D") + "</PlayerChanges></SoccerDocument></SoccerFeed>")
    p = tmp_path / "two.xml"
    p.write_text(doc)
    assert X.read_teams(spark, str(p), "PlayerChanges").count() == 2
    players, moved = X.read_players(spark, str(p))
    assert sorted((r.player_id, r.team_name) for r in players.collect()) == [(1, "Lyon"), (2, "Nice"), (3, "Lens")]
    assert sorted(r.player_id for r in moved.collect()) == [2, 4]
