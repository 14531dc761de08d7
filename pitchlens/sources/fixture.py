"""Test-data projections: the driver's generic tables -> match-event tables.

No football feed is shipped with the test data, so the canonical
``match_events`` table is a deterministic projection of the ``events`` table
(one calendar day = one game, a day squeezed to 96 minutes, one user = one
player of a fixed team). The same projection is written in SQL for the DuckDB
oracle (``pitchlens.plans.oracle``); both must give equal rows.

Everything here is plain DataFrame code so that it scales with the inputs:
no driver-side data, no collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _second_of_day_and_date(ts: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """Wall-clock second of day and date of ``ts`` independent of the session zone."""
    if isinstance(dtype, T.TimestampNTZType):
        sod = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("int")
        return sod, ts.cast("date")
    # A TIMESTAMP (instant) column: the file stores UTC wall clock, so use epoch arithmetic.
    secs = F.floor(F.unix_micros(ts) / 1_000_000)
    sod = F.pmod(secs, F.lit(86400)).cast("int")
    day = F.date_from_unix_date(F.floor(secs / 86400).cast("int"))
    return sod, day


def match_events_from(events: DataFrame) -> DataFrame:
    """Project the driver's ``events`` table onto the canonical match-event schema."""
    k = F.get_json_object("props", "$.k").cast("int")
    sod, day = _second_of_day_and_date(F.col("ts"), events.schema["ts"].dataType)
    # The JSON accessor is evaluated once per row: ``k`` is produced by a
    # one-element explode (a Generate), which predicate pushdown cannot inline
    # into the many predicates and CASE branches that read ``k`` above it.
    base = events.select(
        "event_id", "user_id", "event_type", "value",
        F.explode(F.array(k)).alias("k"), F.floor(sod / 15).cast("int").alias("t"), day.alias("d"),
    )
    k, t, et = F.col("k"), F.col("t"), F.col("event_type")
    first_half = t < 2880
    type_id = (
        F.when(et == "view", F.lit(1))
        .when(et == "click", F.when(k % 3 == 0, 1).when(k % 3 == 1, 4).otherwise(6))
        .when(et == "purchase", 13 + k % 4)
        .when(et == "error",
              F.when(k % 8 == 0, 3).when(k % 8 == 1, 7).when(k % 8 == 2, 8).when(k % 8 == 3, 10)
              .when(k % 8 == 4, 17).when(k % 8 == 5, 44).when(k % 8 == 6, 61).otherwise(43))
        .otherwise(F.when(k % 5 == 0, 18).when(k % 5 == 1, 19).otherwise(1))
    )
    zone = (F.when(k % 5 == 1, "Back").when(k % 5 == 2, "Center")
            .when(k % 5 == 3, "Left").when(k % 5 == 4, "Right"))
    return base.select(
        F.col("event_id").alias("seq"),
        F.col("d").cast("string").alias("game"),
        F.when(first_half, 1).otherwise(2).alias("period_id"),
        F.when(first_half, t).otherwise(2700 + t - 2880).alias("game_time_in_sec"),
        F.col("user_id").alias("player_id"),
        (F.col("user_id") % 2).cast("int").alias("team_id"),
        type_id.cast("int").alias("type_id"),
        (k % 2).cast("int").alias("outcome"),
        F.when(k % 10 == 0, 1).alias("keypass"),
        F.when(k % 25 == 0, 1).alias("assist"),
        ((F.floor("value").cast("int") % 101).cast("double")).alias("x"),
        k.cast("double").alias("y"),
        zone.alias("zone"),
    )


def match_events(spark: SparkSession, sf_dir: str, landed: bool = True) -> DataFrame:
    """Canonical event table of ``sf_dir``; by default the landed Parquet copy."""
    if not landed:
        return match_events_from(table(spark, sf_dir, "events"))
    from .store import land

    src = f"{sf_dir.rstrip('/')}/events.parquet"
    # sorted inside each written file (a local sort, no shuffle): row-group statistics on ``game``
    # let per-game reads skip the rest of the file
    return land(spark, "match_events",
                lambda: match_events_from(table(spark, sf_dir, "events")).sortWithinPartitions("game", "seq"), [src])


def raw_events_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider-shaped rows of ``sf_dir`` (see :func:`raw_events`), landed once."""
    from .store import land

    src = f"{sf_dir.rstrip('/')}/events.parquet"
    return land(spark, "raw_events", lambda: raw_events(match_events(spark, sf_dir)), [src])


def period_end_rows(me: DataFrame) -> DataFrame:
    """Two END (type 30) rows per (game, period); the second is later in seq and time.

    The duplicate checks that "the last END event of a period wins".
    """
    ends = me.groupBy("game", "period_id").agg(
        F.max("seq").alias("mseq"), F.max("game_time_in_sec").alias("mt"))
    ends = ends.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    return ends.select(
        (F.lit(1_000_000_000) + F.col("mseq") * 2 + F.col("i")).alias("seq"),
        "game", "period_id",
        (F.col("mt") + F.col("i")).cast("int").alias("game_time_in_sec"),
        F.lit(None).cast("bigint").alias("player_id"),
        F.col("i").cast("int").alias("team_id"),
        F.lit(K.END_PERIOD).alias("type_id"),
        F.lit(1).alias("outcome"),
    )


SALTS = 64


def lineups(me: DataFrame, listed: int = 14) -> DataFrame:
    """One line-up string per (game, team): the ``listed`` smallest player ids, ', '-joined.

    Only distinct (game, team, player) rows are ranked, in two levels: the
    top ``listed`` of each of ``SALTS`` hash buckets of a team first, then the
    top ``listed`` of those candidates -- no task ranks more than one bucket of
    a team, and at most ``listed`` names are gathered per team.
    """
    from pyspark.sql import Window

    players = me.select("game", "team_id", "player_id").where("player_id IS NOT NULL").distinct()
    salt = F.pmod(F.xxhash64("player_id"), F.lit(SALTS))
    w1 = Window.partitionBy("game", "team_id", "_salt").orderBy("player_id")
    cand = players.withColumn("_salt", salt).withColumn("r", F.row_number().over(w1)).where(F.col("r") <= listed)
    w2 = Window.partitionBy("game", "team_id").orderBy("player_id")
    top = cand.withColumn("r", F.row_number().over(w2)).where(F.col("r") <= listed)
    return top.groupBy("game", "team_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "player_id"))),
                                 lambda s: s["player_id"].cast("string")), ", ").alias("value"))


def raw_events(me: DataFrame) -> DataFrame:
    """Provider-shaped rows before cleaning (what the XML scan yields).

    ``match_events`` + two END rows per period + one line-up row (type 34,
    period 16, qualifier 30) per team. The team column carries the provider's
    team id; ``home_team_id``/``away_team_id`` come from the game header; time
    is split into ``min``/``sec``; the zone travels as qualifier 56.
    """
    ends = period_end_rows(me)
    lu = lineups(me).select(
        F.lit(-1).cast("bigint").alias("seq"), "game", F.lit(16).alias("period_id"),
        F.lit(0).alias("game_time_in_sec"), F.lit(None).cast("bigint").alias("player_id"),
        "team_id", F.lit(K.LINE_UP).alias("type_id"), F.lit(1).alias("outcome"),
        F.col("value").alias("lineup"))
    # line-up rows come first in the document: give them seq below every real event
    lu = lu.withColumn("seq", F.lit(-2) - F.col("team_id").cast("bigint"))
    rows = me.unionByName(ends, allowMissingColumns=True).unionByName(lu, allowMissingColumns=True)
    home = F.regexp_replace("game", "-", "").cast("int")
    quals = F.when(F.col("zone").isNotNull(),
                   F.array(F.struct(F.lit(K.QUALIFIER_ZONE).alias("qualifier_id"), F.col("zone").alias("value"))))
    quals = quals.when(F.col("lineup").isNotNull(),
                       F.array(F.struct(F.lit(K.QUALIFIER_ALL_PLAYERS).alias("qualifier_id"),
                                        F.col("lineup").alias("value"))))
    quals = quals.otherwise(F.array().cast("array<struct<qualifier_id:int,value:string>>"))
    return rows.select(
        "seq",
        home.alias("home_team_id"), (home + 1).alias("away_team_id"),
        "period_id",
        (F.col("game_time_in_sec") / 60).cast("int").alias("min"),
        (F.col("game_time_in_sec") % 60).cast("int").alias("sec"),
        "player_id",
        F.when(F.col("team_id") == 1, home).otherwise(home + 1).alias("team_id"),
        "type_id", "outcome", "keypass", "assist", "x", "y",
        quals.alias("qualifiers"),
    )


SQUAD_SIZE = 30


def player_registry_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested player-registry document built from ``customer`` x ``nation``.

    Shape of the provider's season file after the XML scan, one row per team:
    ``_short_club_name``, ``Player ARRAY<STRUCT<_uID, _loan, Name, Position,
    Stat ARRAY<STRUCT<_Type,_VALUE>>>>`` and ``Moved`` (the same shape, for the
    transfer section). A player is a customer; a team is a nation split into
    squads of at most ``SQUAD_SIZE`` customers, so every array is bounded.
    """
    cust = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    squad = (F.col("c_custkey") / SQUAD_SIZE).cast("bigint")
    players = cust.select(
        "c_nationkey", squad.alias("squad"),
        (F.col("c_mktsegment") == "AUTOMOBILE").alias("moved"),
        _player_struct(cust).alias("p"))
    docs = players.groupBy("c_nationkey", "squad").agg(
        F.collect_list("p").alias("Player"),
        F.collect_list(F.when(F.col("moved"), F.col("p"))).alias("Moved"))
    names = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    # nation is a 25-row dimension: a broadcast of fixed size
    return (docs.join(F.broadcast(names), "c_nationkey")
            .select(F.concat_ws(" ", "n_name", F.col("squad").cast("string")).alias("_short_club_name"),
                    "Player", "Moved"))


def _player_struct(cust: DataFrame) -> Column:
    bal = F.col("c_acctbal")
    key = F.col("c_custkey")
    join_date = F.date_format(F.date_add(F.lit("2016-07-01").cast("date"), (key % 240).cast("int")), "yyyy-MM-dd")
    leave_date = F.date_format(F.date_add(F.lit("2018-06-30").cast("date"), (key % 365).cast("int")), "yyyy-MM-dd")
    stat_t = "struct<_Type:string,_VALUE:string>"
    stats = F.array(
        F.struct(F.lit("first_name").alias("_Type"), F.col("c_name").alias("_VALUE")),
        F.struct(F.lit("join_date").alias("_Type"), join_date.alias("_VALUE")),
    )
    # some players carry no leave date, some a second join date (the later entry wins)
    stats = F.when(key % 3 == 0, stats).otherwise(
        F.concat(stats, F.array(F.struct(F.lit("leave_date").alias("_Type"), leave_date.alias("_VALUE")))))
    stats = F.when(key % 7 == 0, F.concat(stats, F.array(F.struct(
        F.lit("join_date").alias("_Type"),
        F.date_format(F.date_add(F.lit("2017-01-01").cast("date"), (key % 30).cast("int")), "yyyy-MM-dd")
        .alias("_VALUE"))))).otherwise(stats).cast(f"array<{stat_t}>")
    return F.struct(
        F.concat(F.lit("p"), key.cast("string")).alias("_uID"),
        F.when(bal < 0, F.lit("1")).alias("_loan"),
        F.col("c_name").alias("Name"),
        F.col("c_mktsegment").alias("Position"),
        stats.alias("Stat"),
    )
