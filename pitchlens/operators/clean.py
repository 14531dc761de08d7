"""Cleaning: projections, filters, fills and casts of the event table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C

# Canonical cleaned columns, in contract order.
CLEAN_COLUMNS = ["game", "type_id", "zone", "period_id", "game_time_in_sec", "player_id", "team_id",
                 "outcome", "keypass", "assist", "x", "y"]


def keep_halves(df: DataFrame, periods: Iterable[int] = (1, 2)) -> DataFrame:
    """Keep first- and second-half events (drops pre/post-match and extra periods)."""
    return df.where(F.col("period_id").isin(*periods))


def drop_events(df: DataFrame, type_ids: Iterable[int] = (K.DELETED_EVENT,)) -> DataFrame:
    """Drop events of the given types; rows with a NULL type are kept (``not in`` semantics)."""
    t = F.col("type_id")
    return df.where(t.isNull() | ~t.isin(*type_ids))


def select_with_defaults(df: DataFrame, columns: Iterable[str], default="0") -> DataFrame:
    """Project ``columns``; a column absent from the input becomes the constant ``default``."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(default).alias(c) for c in columns])


def add_game_time(df: DataFrame) -> DataFrame:
    return df.withColumn("game_time_in_sec", C.game_time("min", "sec"))


def add_game_key(df: DataFrame, with_source: bool = False) -> DataFrame:
    """``game`` = home-away (optionally qualified by the feed file, see :func:`game_key`)."""
    source = "source_file" if with_source and "source_file" in df.columns else None
    return df.withColumn("game", C.game_key("home_team_id", "away_team_id", source))


def binarize_teams(df: DataFrame) -> DataFrame:
    return df.withColumn("team_id", C.binarize_team("team_id", "home_team_id", "away_team_id"))


def zone_from_qualifiers(df: DataFrame, qualifiers: str = "qualifiers") -> DataFrame:
    """Lift qualifier 56 (pitch zone) out of the nested qualifier list."""
    return df.withColumn("zone", C.qualifier_value(qualifiers, K.QUALIFIER_ZONE))


def clean_game_data(raw: DataFrame, with_source: bool = False) -> DataFrame:
    """Raw provider rows -> cleaned canonical columns.

    halves only -> game clock in seconds -> deleted events dropped ->
    ``game`` key -> teams as 1 (home) / 0 (away) -> zone qualifier -> the
    fixed column list. One narrow stage; no shuffle.
    """
    df = keep_halves(raw)
    df = add_game_time(df)
    df = drop_events(df, [K.DELETED_EVENT])
    df = add_game_key(df, with_source)
    df = binarize_teams(df)
    if "qualifiers" in df.columns and "zone" not in df.columns:
        df = zone_from_qualifiers(df)
    return select_with_defaults(df, ["seq", *CLEAN_COLUMNS], default=None)


def clean_events(me: DataFrame) -> DataFrame:
    """The cleaning steps that apply to canonical rows (halves only, deleted events dropped)."""
    return drop_events(keep_halves(me), [K.DELETED_EVENT])


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Column-wise NULL replacement (``fillna`` by dict)."""
    return df.na.fill(dict(values))


def stats_input(me: DataFrame) -> DataFrame:
    """Input of the player-identification features.

    keypass/assist NULL -> 0, zone NULL -> ``no_position``, then every row
    with a NULL in any cleaned column is dropped (so team-level events
    without a player vanish before any "previous event" lag).
    """
    df = clean_events(me)
    df = df.withColumns({
        "keypass": F.coalesce(F.col("keypass").cast("int"), F.lit(0)),
        "assist": F.coalesce(F.col("assist").cast("int"), F.lit(0)),
        "zone": F.coalesce(F.col("zone"), F.lit(K.NO_POSITION)),
    })
    return df.na.drop(subset=CLEAN_COLUMNS)


def next_event_input(me: DataFrame) -> DataFrame:
    """Input of the next-event problems: cleaned rows without period start/end markers,
    with coordinates projected on the home team's attacking axis. No NULL drop."""
    df = drop_events(clean_events(me), [K.START_PERIOD, K.END_PERIOD])
    return df.withColumns({
        "x_along_team1_axis": C.along_team1_axis("x", "team_id"),
        "y_along_team1_axis": C.along_team1_axis("y", "team_id"),
    })


def dropna_rows(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset is not None else None)
