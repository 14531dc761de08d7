"""A season read from the provider's XML feeds: the inputs every job of the package takes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..operators.clean import clean_game_data
from ..operators.playtime import eligible_players, play_time, timed_raw
from ..sources.store import PROJECTION_VERSION, land, land_files
from ..sources.xml import read_game_events, read_players


@dataclass
class Season:
    events: DataFrame        # canonical match events (cleaned rows, document order in ``seq``)
    raw: DataFrame           # provider rows with game key and clock (play time reads these)
    eligible: DataFrame      # player_id of the eligible players


def season_from_xml(spark: SparkSession, games: str, registry: str | None,
                    min_minutes: int = K.MIN_SEASON_MINUTES, cutoff: str = K.LOAN_CUTOFF,
                    with_source: bool = True) -> Season:
    """Game feed files (path or glob) + registry file -> canonical events, timed raw rows, eligibility.

    ``with_source`` qualifies game keys with the feed file, so seasons do not collide.
    """
    # Every feed file is parsed once, here: everything below scans the landed Parquet copies, and a folder
    # that has got a game more parses that game alone.
    name = f"xml_events-{hashlib.sha1(f'{PROJECTION_VERSION}|{games}'.encode()).hexdigest()[:16]}"
    raw = land_files(spark, name, lambda paths: read_game_events(spark, paths), [games])
    events = clean_game_data(raw, with_source)
    ev = timed_raw(raw, with_source)
    if registry:
        players = land(spark, "xml_players", lambda: read_players(spark, registry)[0], [registry])
        moved = land(spark, "xml_moved", lambda: read_players(spark, registry)[1], [registry])
    else:
        empty = spark.createDataFrame([], "player_id bigint, loan string, arrival_date date")
        players, moved = empty, empty.select("player_id")
    elig = eligible_players(play_time(ev), players, moved, min_minutes, cutoff)
    return Season(events, ev, elig)
