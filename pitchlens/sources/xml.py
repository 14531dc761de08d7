"""Provider XML feeds read with Spark's built-in XML source.

* Game feed: ``Games/Game[@home_team_id,@away_team_id]/Event[@...]/Q[@qualifier_id,@value]``.
  One row per ``Game`` element; events stay in document order through
  ``posexplode`` *inside* the game row, so ``seq`` is the document position
  (a distributed read never reorders elements of one row).
* Registry feed: ``SoccerFeed/SoccerDocument/Team/Player`` plus the transfer
  section ``SoccerDocument/PlayerChanges/Team/Player``.

Explicit schemas: only the attributes we use are parsed, every attribute
is read as a string (as the feed defines them) and cast once here. Many
small files are packed into tasks by the file source; land the result to
Parquet once (see :func:`pitchlens.sources.store.land`) instead of parsing
XML for every query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()

QUALIFIER = T.StructType([T.StructField("_qualifier_id", _S), T.StructField("_value", _S)])

EVENT = T.StructType([T.StructField(f"_{a}", _S) for a in (
    "id", "event_id", "type_id", "period_id", "min", "sec", "player_id", "team_id", "outcome",
    "keypass", "assist", "x", "y")] + [T.StructField("Q", T.ArrayType(QUALIFIER))])

GAME = T.StructType([
    T.StructField("_home_team_id", _S),
    T.StructField("_away_team_id", _S),
    T.StructField("Event", T.ArrayType(EVENT)),
])

STAT = T.StructType([T.StructField("_Type", _S), T.StructField("_VALUE", _S)])
PLAYER = T.StructType([
    T.StructField("_uID", _S), T.StructField("_loan", _S),
    T.StructField("Name", _S), T.StructField("Position", _S),
    T.StructField("Stat", T.ArrayType(STAT)),
])
TEAM = T.StructType([T.StructField("_short_club_name", _S), T.StructField("Player", T.ArrayType(PLAYER))])
DOCUMENT = T.StructType([
    T.StructField("Team", T.ArrayType(TEAM)),
    T.StructField("PlayerChanges", T.StructType([T.StructField("Team", T.ArrayType(TEAM))])),
])


def read_game_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per ``Game`` element: home/away ids, the event array and the source file."""
    if path == []:
        return spark.createDataFrame([], GAME).withColumn("source_file", F.lit(None).cast("string"))
    df = (spark.read.format("xml").option("rowTag", "Game").option("mode", "FAILFAST")
          .schema(GAME).load(path))
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def _int(c: str):
    return F.col(c).cast("int")


def read_game_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Game feed -> provider-shaped event rows (the raw schema of the cleaning step).

    Columns: ``source_file, seq, home_team_id, away_team_id, period_id, min, sec,
    player_id, team_id, type_id, outcome, keypass, assist, x, y,
    qualifiers ARRAY<STRUCT<qualifier_id INT, value STRING>>``. ``seq`` is
    the position of the event in its game element.
    """
    games = read_game_rows(spark, path)
    ev = games.select("source_file", "_home_team_id", "_away_team_id",
                      F.posexplode("Event").alias("seq", "e"))
    quals = F.transform(F.coalesce(F.col("e.Q"), F.array().cast(T.ArrayType(QUALIFIER))),
                        lambda q: F.struct(q["_qualifier_id"].cast("int").alias("qualifier_id"),
                                           q["_value"].alias("value")))
    return ev.select(
        "source_file",
        F.col("seq").cast("bigint").alias("seq"),
        _int("_home_team_id").alias("home_team_id"),
        _int("_away_team_id").alias("away_team_id"),
        F.col("e._period_id").cast("int").alias("period_id"),
        F.col("e._min").cast("int").alias("min"),
        F.col("e._sec").cast("int").alias("sec"),
        F.col("e._player_id").cast("bigint").alias("player_id"),
        F.col("e._team_id").cast("int").alias("team_id"),
        F.col("e._type_id").cast("int").alias("type_id"),
        F.col("e._outcome").cast("int").alias("outcome"),
        F.col("e._keypass").cast("int").alias("keypass"),
        F.col("e._assist").cast("int").alias("assist"),
        F.col("e._x").cast("double").alias("x"),
        F.col("e._y").cast("double").alias("y"),
        quals.alias("qualifiers"),
    )


def read_game_header(spark: SparkSession, path: str) -> DataFrame:
    """Home and away team id of every game file (no event parsing needed downstream)."""
    return read_game_rows(spark, path).select(
        "source_file", _int("_home_team_id").alias("home_team_id"), _int("_away_team_id").alias("away_team_id"))


def read_registry_doc(spark: SparkSession, path: str) -> DataFrame:
    """Registry feed -> one row per ``SoccerDocument`` with its teams and transfers (one task per document)."""
    return (spark.read.format("xml").option("rowTag", "SoccerDocument").option("mode", "FAILFAST")
            .schema(DOCUMENT).load(path))


def registry_teams(doc: DataFrame, section: str = "Team") -> DataFrame:
    """Teams of the main section (``Team``) or of the transfer section (``PlayerChanges``)."""
    arr = F.col("Team") if section == "Team" else F.col("PlayerChanges.Team")
    t = doc.select(F.explode(arr).alias("t"))
    return t.select(F.col("t._short_club_name").alias("_short_club_name"), F.col("t.Player").alias("Player"))


def read_teams(spark: SparkSession, path: str, section: str = "Team") -> DataFrame:
    """Teams of one section of a registry file, streamed a row per ``Team`` element: no row holds the document.

    (A file is one task of the XML reader; many files are many tasks.) The reader finds ``Team`` elements of both sections wherever they stand; those of the transfer section are
    read a second time by their section's own element, and the main section is the rest.
    """
    reader = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(path)
    moved = (reader("PlayerChanges", T.StructType([T.StructField("Team", T.ArrayType(TEAM))])).select(F.explode("Team").alias("t"))
             .select(F.col("t._short_club_name").alias("_short_club_name"), F.col("t.Player").alias("Player")))
    if section != "Team":
        return moved
    # Equal elements may stand in both sections: as many go as the transfer section has.
    key = F.xxhash64(F.to_json(F.struct("_short_club_name", "Player")))
    count = lambda df, name: df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias(name), F.first(F.struct("_short_club_name", "Player")).alias("t"))
    every, out = count(reader("Team", TEAM), "n"), count(moved, "m").drop("t")
    left = every.join(out, "k", "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0))).where("n > 0")
    return (left.select("t", F.explode(F.expr("sequence(1L, n)"))).select(F.col("t._short_club_name").alias("_short_club_name"),
                                                                        F.col("t.Player").alias("Player")))


def read_players(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(all players, transferred players) of a registry file, flattened."""
    from ..operators.playtime import players_from_doc

    return players_from_doc(read_teams(spark, path, "Team")), players_from_doc(read_teams(spark, path, "PlayerChanges"))
