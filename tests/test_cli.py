"""End to end over XML feeds: train the three problems, save, load, score a game file."""
import random

from pitchlens import cli

HOME = {149: range(101, 115), 143: range(201, 215), 150: range(301, 315)}


def _event(eid, type_id, period, t, team, player=None, outcome=1, quals=(), x=50.0, y=50.0, keypass=None):
    attrs = {"id": eid, "event_id": eid, "type_id": type_id, "period_id": period, "min": t // 60, "sec": t % 60,
             "team_id": team, "outcome": outcome, "x": x, "y": y}
    if player is not None:
        attrs["player_id"] = player
    if keypass:
        attrs["keypass"] = 1
    a = " ".join(f'{k}="{v}"' for k, v in attrs.items())
    q = "".join(f'<Q id="{eid}{i}" qualifier_id="{qid}" value="{val}"/>' for i, (qid, val) in enumerate(quals))
    return f"<Event {a}>{q}</Event>"


def game_xml(home, away, seed):
    rnd = random.Random(seed)
    out, eid = [], 0

    def add(*args, **kw):
        nonlocal eid
        eid += 1
        out.append(_event(eid, *args, **kw))

    for team in (home, away):
        ids = list(HOME[team])
        add(34, 16, 0, team, quals=[(30, ", ".join(str(i) for i in ids))])
    for period, (t0, t1) in ((1, (0, 2760)), (2, (2700, 5700))):
        add(32, period, t0, home)
        for i in range(60):
            team = home if rnd.random() < 0.5 else away
            player = rnd.choice(list(HOME[team])[:11])
            t = t0 + int((t1 - t0 - 30) * i / 60)
            zone = rnd.choice(["Back", "Center", "Left", "Right", None])
            add(rnd.choice([1, 1, 1, 4, 6, 13, 3, 7, 10]), period, t, team, player, rnd.randint(0, 1),
                quals=[(56, zone)] if zone else [], x=round(rnd.uniform(0, 100), 1), y=round(rnd.uniform(0, 100), 1),
                keypass=rnd.random() < 0.1)
        if period == 2:
            add(18, 2, 3000, home, list(HOME[home])[10])
            add(19, 2, 3000, home, list(HOME[home])[11])
        add(30, period, t1, home)
        add(30, period, t1 + 1, away)
    body = "".join(out)
    return f'<?xml version="1.0"?><Games><Game home_team_id="{home}" away_team_id="{away}">{body}</Game></Games>'


def registry_xml():
    teams = "".join(
        f'<Team short_club_name="T{t}">' + "".join(
            f'<Player uID="p{p}"><Name>N{p}</Name><Position>M</Position>'
            f'<Stat Type="join_date">2016-07-01</Stat></Player>' for p in ids) + "</Team>"
        for t, ids in HOME.items())
    return f"<SoccerFeed><SoccerDocument>{teams}<PlayerChanges></PlayerChanges></SoccerDocument></SoccerFeed>"


def test_train_then_score_from_xml(spark, tmp_path):
    games = tmp_path / "games"
    games.mkdir()
    for i, (h, a) in enumerate(((149, 143), (143, 150), (150, 149))):
        (games / f"g{i}.xml").write_text(game_xml(h, a, i))
    (tmp_path / "players.xml").write_text(registry_xml())
    test_game = tmp_path / "test"
    test_game.mkdir()
    (test_game / "t.xml").write_text(game_xml(149, 150, 99).replace('player_id="101"', 'player_id="1"'))
    models = str(tmp_path / "models")
    assert cli.main(["features", "--games", str(games), "--registry", str(tmp_path / "players.xml"),
                     "--out", str(tmp_path / "feat"), "--min-minutes", "0"]) == 0
    feats = spark.read.parquet(str(tmp_path / "feat" / "window_features"))
    assert feats.count() > 0 and set(feats.select("game").distinct().toPandas()["game"]) == {
        "149-143@g0.xml", "143-150@g1.xml", "150-149@g2.xml"}
    assert cli.main(["sweep", "--games", str(games), "--registry", str(tmp_path / "players.xml"), "--min-minutes", "0",
                     "--out", str(tmp_path / "sweep"), "--trees", "2", "7", "2", "--depths", "2", "4", "1"]) == 0
    sizes = spark.read.parquet(str(tmp_path / "sweep")).collect()
    assert {(r.n_estimators, r.max_depth) for r in sizes} == {(t, d) for t in (2, 4, 6) for d in (2, 3)} and all(0 <= r.accuracy <= 1 for r in sizes)
    assert cli.main(["train", "--games", str(games), "--registry", str(tmp_path / "players.xml"),
                     "--models", models, "--min-minutes", "0"]) == 0
    assert cli.main(["score", "--games", str(test_game), "--models", models, "--out", str(tmp_path / "pred")]) == 0
    lines = [ln for p in (tmp_path / "pred").glob("part-*") for ln in p.read_text().splitlines() if ln]
    assert len(lines) == 1
    player, team, y, x = lines[0].split(",")
    assert int(team) in (0, 1) and 0.0 <= float(x) <= 100.0 and 0.0 <= float(y) <= 100.0 and int(player) > 0
