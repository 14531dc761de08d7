"""Playing time and player eligibility.

Inputs are *timed raw* events: provider rows with ``game`` and
``game_time_in_sec`` added but nothing filtered (period ends, line-ups and
substitutions live outside the cleaned table). Every grouping here is per
(game) or per (game, player): at most a few dozen rows per game reach the
joins, so no hot key can form after the first aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import first_n_of_list, qualifier_value, strip_prefix, stat_value


def timed_raw(raw: DataFrame, with_source: bool = False) -> DataFrame:
    """Raw provider rows + ``game`` key + ``game_time_in_sec`` (nothing dropped)."""
    from .clean import add_game_key, add_game_time

    return add_game_time(add_game_key(raw, with_source))


def end_of_periods(ev: DataFrame) -> DataFrame:
    """Game clock of the last END event (in document order) of halves 1 and 2; -1 when absent."""
    ends = ev.where(F.col("type_id") == K.END_PERIOD)
    return ends.groupBy("game").agg(
        F.coalesce(F.expr("max_by(game_time_in_sec, seq) FILTER (WHERE period_id = 1)"), F.lit(-1))
        .cast("int").alias("end_first_half"),
        F.coalesce(F.expr("max_by(game_time_in_sec, seq) FILTER (WHERE period_id = 2)"), F.lit(-1))
        .cast("int").alias("end_second_half"),
    )


def substitutions(ev: DataFrame) -> DataFrame:
    """Per (game, player): clock of coming on (type 19) and going off (type 18).

    The first occurrence in document order is used when a player has several.
    """
    subs = ev.where(F.col("type_id").isin(K.PLAYER_OFF, K.PLAYER_ON) & F.col("player_id").isNotNull())
    return subs.groupBy("game", "player_id").agg(
        F.expr(f"min_by(game_time_in_sec, seq) FILTER (WHERE type_id = {K.PLAYER_ON})").cast("double").alias("start_game"),
        F.expr(f"min_by(game_time_in_sec, seq) FILTER (WHERE type_id = {K.PLAYER_OFF})").cast("double").alias("end_game"),
    )


def starting_eleven(ev: DataFrame, qualifiers: str = "qualifiers") -> DataFrame:
    """The first 11 names of each team's line-up list (qualifier 30 of type-34 events)."""
    lu = ev.where(F.col("type_id") == K.LINE_UP).select(
        "game", "team_id", qualifier_value(qualifiers, K.QUALIFIER_ALL_PLAYERS).alias("_v"))
    lu = lu.where(F.col("_v").isNotNull())
    out = lu.select("game", "team_id", F.posexplode(first_n_of_list("_v", K.STARTERS_PER_TEAM)).alias("slot", "_p"))
    return out.select("game", "team_id", (F.col("slot") + 1).alias("slot"),
                      F.trim(F.col("_p")).cast("bigint").alias("player_id"))


def full_game_players(ev: DataFrame) -> DataFrame:
    """Starters who were never substituted (distinct (game, player))."""
    starters = starting_eleven(ev).select("game", "player_id").distinct()
    return starters.join(substitutions(ev).select("game", "player_id"), ["game", "player_id"], "left_anti")


def play_time(ev: DataFrame) -> DataFrame:
    """Seconds played per (game, player).

    Substituted players: on at ``start`` (0 when never came on), off at
    ``end`` (end of the game when never went off). Starters without a
    substitution play from 0 to the end of the game. A player on the pitch
    across half time also played the first half's stoppage time:
    ``end - start + (end_first_half - 2700) * (start < 2700 < end)``.
    """
    ends = end_of_periods(ev)
    subs = substitutions(ev)
    full = (full_game_players(ev)
            .select("game", "player_id", F.lit(0.0).alias("start_game"), F.lit(None).cast("double").alias("end_game")))
    pt = subs.unionByName(full).join(ends, "game", "left")
    end2 = F.col("end_second_half").cast("double")
    pt = pt.withColumns({
        "start_game": F.coalesce(F.col("start_game"), F.lit(0.0)),
        "end_game": F.coalesce(F.col("end_game"), end2),
    })
    ht = float(K.HALF_TIME_SEC)
    flag = (F.col("start_game") < ht) & (F.col("end_game") > ht)
    pt = pt.withColumn("has_played_extra_time_first_half", flag)
    extra = (F.col("end_first_half").cast("double") - ht) * F.col("has_played_extra_time_first_half").cast("double")
    return pt.select(
        "game", "player_id", "start_game", "end_game", "has_played_extra_time_first_half",
        (F.col("end_game") - F.col("start_game") + extra).alias("game_time_in_sec"),
    )


def play_time_season(pt: DataFrame) -> DataFrame:
    return pt.groupBy("player_id").agg(F.sum("game_time_in_sec").alias("game_time_in_sec"))


def players_over_minutes(pt: DataFrame, minutes: int = K.MIN_SEASON_MINUTES) -> DataFrame:
    return play_time_season(pt).where(F.col("game_time_in_sec") >= minutes * 60)


# ---- player registry ---------------------------------------------------------------

def players_from_doc(doc: DataFrame, section: str = "Player", team_attr: str = "_short_club_name") -> DataFrame:
    """Flatten a registry document (one row per team) to one row per player."""
    p = doc.select(F.col(team_attr).alias("team_name"), F.explode(section).alias("p"))
    return p.select(
        strip_prefix(F.col("p._uID")).cast("bigint").alias("player_id"),
        F.col("p._loan").cast("string").alias("loan"),
        F.col("p.Name").cast("string").alias("name"),
        F.col("p.Position").cast("string").alias("position"),
        F.to_date(stat_value(F.col("p.Stat"), "join_date")).alias("arrival_date"),
        F.to_date(stat_value(F.col("p.Stat"), "leave_date")).alias("leave_date"),
        "team_name",
    )


def loaned_after(players: DataFrame, cutoff: str = K.LOAN_CUTOFF) -> DataFrame:
    """Players on loan whose arrival is on/after ``cutoff`` (winter arrivals)."""
    return players.where((F.col("loan") == "1") & (F.col("arrival_date") >= F.lit(cutoff).cast("date")))


def eligible_players(pt: DataFrame, players: DataFrame, transferred: DataFrame,
                     minutes: int = K.MIN_SEASON_MINUTES, cutoff: str = K.LOAN_CUTOFF) -> DataFrame:
    """Players with enough season minutes, minus transferred players, minus winter loans."""
    over = players_over_minutes(pt, minutes).select("player_id")
    out = over.join(transferred.select("player_id"), "player_id", "left_anti")
    out = out.join(loaned_after(players, cutoff).select("player_id"), "player_id", "left_anti")
    return out.distinct()
