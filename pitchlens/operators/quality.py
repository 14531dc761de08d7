"""Data-quality rules as DataFrames of violations (no driver-side asserts mid-job)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .playtime import starting_eleven, substitutions


def dq_starters(ev: DataFrame, expected: int = 2 * K.STARTERS_PER_TEAM) -> DataFrame:
    """Games whose line-ups do not name exactly ``expected`` starters."""
    n = starting_eleven(ev).groupBy("game").agg(F.count(F.lit(1)).cast("int").alias("n_starters"))
    return n.where(F.col("n_starters") != expected)


def dq_substitutions(ev: DataFrame, max_players: int = K.MAX_SUBSTITUTED) -> DataFrame:
    """Games with more substituted players than allowed."""
    n = substitutions(ev).groupBy("game").agg(F.count(F.lit(1)).cast("int").alias("n_substituted"))
    return n.where(F.col("n_substituted") > max_players)


def dq_duplicate_substitutions(ev: DataFrame) -> DataFrame:
    """(game, player, type) with more than one coming-on (19) or going-off (18) event.

    Play time keeps the first occurrence; these rows report the games where that choice mattered.
    """
    subs = ev.where(F.col("type_id").isin(K.PLAYER_OFF, K.PLAYER_ON) & F.col("player_id").isNotNull())
    n = subs.groupBy("game", "player_id", "type_id").agg(F.count(F.lit(1)).cast("int").alias("n_events"))
    return n.where(F.col("n_events") > 1)


def dq_one_team(sliced: DataFrame, keys: Sequence[str] = ("game", "period_id", "start")) -> DataFrame:
    """(slice, player) pairs seen with more than one team."""
    n = (sliced.groupBy(*keys, "player_id")
         .agg(F.count_distinct("team_id").cast("int").alias("n_teams")))
    return n.where(F.col("n_teams") > 1)


def completeness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number of rows and number of rows without any NULL (one row)."""
    cols = list(cols or df.columns)
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(complete).alias("n_complete"))


def rarest_targets(df: DataFrame, target: str, k: int = 5) -> DataFrame:
    """The ``k`` targets with the fewest complete observations (ties by target).

    A top-k report: the aggregate is distributed, only ``k`` rows come out.
    """
    counts = df.na.drop().groupBy(target).agg(F.count(F.lit(1)).alias("nb_observations"))
    return counts.orderBy("nb_observations", target).limit(k)
