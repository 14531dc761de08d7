from pyspark.sql import functions as F

from pitchlens.sources.store import (drop_old_versions, land, materialize, read_csv_table, source_key, versions, write_predictions,
                                     write_table)


def test_csv_round_trip_and_index_column(spark, tmp_path):
    df = spark.createDataFrame([(101, 50000.0), (102, 48000.5)], "player_id bigint, game_time_in_sec double")
    write_table(df, str(tmp_path / "csv"), fmt="csv")
    back = read_csv_table(spark, str(tmp_path / "csv"), "player_id bigint, game_time_in_sec double")
    assert sorted(r.player_id for r in back.collect()) == [101, 102]
    (tmp_path / "idx.csv").write_text(",player_id,game_time_in_sec\n0,7,48213.0\n1,8,108568.0\n")
    idx = read_csv_table(spark, str(tmp_path / "idx.csv"), index_col=True)
    assert idx.columns == ["player_id", "game_time_in_sec"] and idx.count() == 2


def test_prediction_sink_order(spark, tmp_path):
    df = spark.createDataFrame([(59957, 1, 40.0, 60.0)], "player_id bigint, team_id int, y double, x double")
    write_predictions(df, str(tmp_path / "pred"))
    text = "".join(p.read_text() for p in (tmp_path / "pred").glob("part-*"))
    assert text.strip() == "59957,1,40.0,60.0"


def test_materialize_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    p = str(tmp_path / "ds")
    assert materialize(spark, "x", build, path=p).count() == 3
    assert materialize(spark, "x", build, path=p).count() == 3
    assert len(calls) == 1
    assert materialize(spark, "x", build, path=p, refresh=True).count() == 3 and len(calls) == 2


def test_refresh_keeps_earlier_versions_readable(spark, tmp_path):
    p = str(tmp_path / "ds")
    first = materialize(spark, "x", lambda: spark.range(3), path=p)
    second = materialize(spark, "x", lambda: spark.range(5), path=p, refresh=True)
    assert (first.count(), second.count(), materialize(spark, "x", None, path=p).count()) == (3, 5, 5)
    assert drop_old_versions(spark, p) == 1 and len(versions(spark, p)) == 1 and second.count() == 5


def test_landing_sees_new_files_in_a_partitioned_folder(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(10).withColumn("day", F.lit("a")).write.partitionBy("day").parquet(src)
    before = source_key(spark, src)
    assert land(spark, "t", lambda: spark.read.parquet(src), [src]).count() == 10
    spark.range(9).write.parquet(f"{src}/day=a/more")  # the top folder stays as it was
    assert source_key(spark, src) != before and source_key(spark, f"{src}/*") != source_key(spark, src)
    got = land(spark, "t", lambda: spark.read.option("recursiveFileLookup", True).parquet(src), [src])
    assert got.count() == 19


def test_a_growing_folder_parses_new_files_alone(spark, tmp_path):
    import os
    import uuid

    from pitchlens.sources.store import land_files, manifest
    from pitchlens.sources.xml import read_game_events
    from tests.test_xml import GAME

    folder, name, parsed = tmp_path / "feed with space", f"grow-{uuid.uuid4().hex}", []
    folder.mkdir()

    def parse(paths):
        parsed.append(sorted(os.path.basename(p) for p in paths))
        return read_game_events(spark, paths)

    def counts():
        rows = land_files(spark, name, parse, [str(folder)])
        return {r[0].rsplit("/", 1)[1]: r[1] for r in rows.groupBy("source_file").count().collect()}

    (folder / "a.xml").write_text(GAME)
    (folder / "b.xml").write_text(GAME)
    assert counts() == {"a.xml": 6, "b.xml": 6} and parsed == [["a.xml", "b.xml"]]
    assert counts() == {"a.xml": 6, "b.xml": 6} and len(parsed) == 1
    (folder / "c.xml").write_text(GAME)
    before = land_files(spark, name, parse, [str(folder / "a.xml"), str(folder / "b.xml")])       # c is not asked for
    assert before.count() == 12 and len(parsed) == 1
    assert counts() == {"a.xml": 6, "b.xml": 6, "c.xml": 6} and parsed[1:] == [["c.xml"]]
    (folder / "b.xml").write_text(GAME.replace('<Event id="6"', '<Event id="7" type_id="1" period_id="1" min="1" sec="1" x="1" y="1"/><Event id="6"'))
    assert counts() == {"a.xml": 6, "b.xml": 7, "c.xml": 6} and parsed[2:] == [["b.xml"]]
    os.remove(folder / "a.xml")
    assert counts() == {"b.xml": 7, "c.xml": 6} and len(parsed) == 3
    assert {r["file"].rsplit("/", 1)[1] for r in manifest(spark, name).collect()} == {"b.xml", "c.xml"}
    os.remove(folder / "b.xml")
    os.remove(folder / "c.xml")
    assert counts() == {}


def test_an_empty_folder_lands_no_rows(spark, tmp_path):
    import uuid

    from pitchlens.sources.store import land_files
    from pitchlens.sources.xml import read_game_events

    (tmp_path / "none").mkdir()
    for _ in range(2):
        rows = land_files(spark, f"none-{uuid.uuid4().hex}", lambda p: read_game_events(spark, p), [str(tmp_path / "none")])
        assert rows.count() == 0 and "seq" in rows.columns
