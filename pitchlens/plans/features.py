"""Feature datasets: per-window player features and next-event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import counters as CT
from ..operators.clean import next_event_input, stats_input
from ..operators.ordered import DEFAULT_BLOCK, ordered_lag
from ..operators.windows import all_but_last, next_event_dataset, sliding_windows, window_label

SLICE = ["game", "period_id", "start"]


def _features_from_slices(ev: DataFrame, lagged: DataFrame, slice_keys: list[str]) -> DataFrame:
    """Player-grain aggregates of sliced events plus the team totals of the slice.

    ``ev`` holds every event tagged with its slice, ``lagged`` those of the players asked for with ``prev_type_id``
    (the type of the previous event *inside the slice*). One hash aggregate per (slice, player, team) over
    ``lagged``. Team figures and the zones of a slice come from one aggregate of ``ev`` per (slice, team): tasks
    ship a row per slice and team, however many players there are, and the lag has no part in it.
    """
    ok = [f"_p_{e}_ok" for e in K.EVENTS_COMPUTE_SUCCESS_RATE]
    p_a, p_f = CT.success_rate_cols(K.EVENTS_COMPUTE_SUCCESS_RATE, "p_")
    p_a += CT.count_pivot_aggs(K.EVENTS_COMPUTE_NUMBER, "p_")
    p_f += [F.col(f"p_{e}_nb") for e in K.EVENTS_COMPUTE_NUMBER]
    zones = ["_z_all", *[f"_z_{z}" for z in K.ZONES]]
    pkeys, tkeys = [*slice_keys, "player_id", "team_id"], [*slice_keys, "team_id"]
    bools = ["nb_assist", "nb_keypass", "nb_gk_events", "nb_shots", "nb_free_kick", "nb_corner"]
    player = (lagged.groupBy(*pkeys).agg(*CT.bool_counter_aggs("prev_type_id"), *CT.zone_aggs(), *p_a)
              .select(*pkeys, *bools, *zones, *p_f, *ok))
    t_a, t_f = CT.success_rate_cols(K.EVENTS_COMPUTE_SUCCESS_RATE, "t_")
    t_a += CT.count_pivot_aggs(K.EVENTS_COMPUTE_NUMBER, "t_")
    t_f += [F.col(f"t_{e}_nb") for e in K.EVENTS_COMPUTE_NUMBER]
    in_slice = Window.partitionBy(*slice_keys)          # one row per team
    has = [(F.max(f"_z_{z}").over(in_slice) > 0).alias(f"_has_{z}") for z in K.ZONES]
    team = ev.groupBy(*tkeys).agg(*t_a, *CT.zone_aggs()).select(*tkeys, *t_f, *has)
    return (player.join(team, tkeys)
            .select(*pkeys, *bools, *CT.zone_finals(), *p_f, *[c for c in team.columns if c not in tkeys and not c.startswith("_has_")]))


def sliced_events(me: DataFrame, step_min: int = 5, block: int = DEFAULT_BLOCK, strategy: str = "blocked") -> DataFrame:
    """Stats-input events tagged with each 15-minute window containing them, plus
    ``prev_type_id``: the type of the previous event *inside that window*."""
    return _with_previous(sliding_windows(stats_input(me), step_min), SLICE, block, strategy)


def _with_previous(ev: DataFrame, slice_keys: list[str], block: int, strategy: str) -> DataFrame:
    return ordered_lag(ev, slice_keys, "seq", ["type_id"], [1], block=block, strategy=strategy) \
        .withColumnRenamed("type_id_lag1", "prev_type_id")


def window_features(me: DataFrame, eligible: DataFrame | None = None, step_min: int = 5,
                    block: int = DEFAULT_BLOCK, strategy: str = "blocked") -> DataFrame:
    """Per (game, 15-minute window, player) features of the player-identification problem.

    stats input -> overlapping inclusive windows (explode, no join) ->
    previous event type inside each window (skew-safe ordered lag over every
    player's events) -> eligible players (semi join) -> player aggregate, next to
    team totals of the windows themselves, so team counts cover every player.
    The window's label is written once per row of the result.
    """
    ev = sliding_windows(stats_input(me), step_min)
    lagged = _with_previous(ev, SLICE, block, strategy)
    if eligible is not None:
        lagged = lagged.join(eligible.select("player_id").distinct(), "player_id", "left_semi")
    out = _features_from_slices(ev, lagged, SLICE).withColumn("time_period", window_label("start"))
    return out.select("game", "player_id", "team_id", "time_period", *K.player_features()[1:])


def test_set_stats(me: DataFrame, masked_player: int = 1, last_hidden: int = 10,
                   block: int = DEFAULT_BLOCK, strategy: str = "blocked") -> DataFrame:
    """Features of the masked player of each game, over the whole game but its last rows.

    One slice per game: every cleaned event except the last ``last_hidden``
    (those are what the next-event models predict); the masked player's row
    only. Keys: ``game``, ``player_id``, ``team_id``.
    """
    ev = all_but_last(stats_input(me), last_hidden)
    lagged = _with_previous(ev, ["game"], block, strategy).where(F.col("player_id") == masked_player)
    out = _features_from_slices(ev, lagged, ["game"])
    return out.select("game", "player_id", "team_id", *K.player_features()[1:])


def season_next_event(me: DataFrame, block: int = DEFAULT_BLOCK, strategy: str = "blocked") -> DataFrame:
    """Next-event dataset of every game (targets + 3 lags of type, team, x, y)."""
    return next_event_dataset(next_event_input(me), block=block, strategy=strategy)
