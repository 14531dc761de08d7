"""Scoring: features of every game to predict from, and the prediction rows.

The reference scores one game per process; here every game of the input is
scored by one job. The two sub-plans (player identification and next event)
are independent and only meet at the end, joined on ``game``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import along_team1_axis
from ..operators.encode import apply_lag_encoders, fit_lag_encoders
from ..operators.quantiles import exact_medians
from ..operators.setops import conform_schema
from ..operators.windows import last_rows
from .features import test_set_stats


def feature_medians(train: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column over the training rows (radix selection over the columns, landed once).

    Like Spark ML's ``Imputer``, the surrogate values become model parameters
    on the driver: one number per column, never data rows.
    """
    return exact_medians(train, cols)


def impute_with_medians(df: DataFrame, train: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                        medians: dict | None = None) -> DataFrame:
    """Replace NULLs of ``cols`` by the training medians (as DOUBLE)."""
    medians = medians if medians is not None else feature_medians(train, cols)
    return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double")).alias(c)
                              for c in cols])


def player_scoring_features(me: DataFrame, train_features: DataFrame, masked_player: int = 1,
                            medians: dict | None = None) -> DataFrame:
    """Features of the masked player of every game, ready for the player model.

    Conformed to the full feature schema, ``*_nb`` counts NULL -> 0 first,
    then every remaining NULL -> training median.
    """
    feats = K.player_features()
    x = conform_schema(test_set_stats(me, masked_player), ["game", "player_id", *feats])
    x = x.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feats if c.endswith("_nb")})
    return impute_with_medians(x, train_features, feats, keep=["game", "player_id"], medians=medians)


def next_team_scoring_features(next_events: DataFrame, train_flag: Column,
                               lags: Sequence[int] = tuple(K.NEXT_EVENT_LAGS)) -> DataFrame:
    """The last next-event row of every game with its lag types target-encoded.

    Encoders are fitted on the training rows (team-change rate per previous
    event type); the last rows are a handful per game.
    """
    encoders = fit_lag_encoders(next_events.where(train_flag), "team_id", lags)
    last = last_rows(next_events, 1)
    enc = apply_lag_encoders(last, encoders)
    cols = ["seq", "game"] + [c for n in lags for c in (f"type_id_lag{n}", f"team_id_lag{n}", f"x_along_team1_axis_lag{n}")]
    return enc.select(*cols)


def prediction_rows(player_pred: DataFrame, team_pred: DataFrame, coords_pred: DataFrame) -> DataFrame:
    """One row per game: predicted player, next team, then y and x on the predicted team's axis.

    ``player_pred(game, player_id)``, ``team_pred(game, team_id)``,
    ``coords_pred(game, x_along_team1_axis, y_along_team1_axis)``. Missing
    predictions fall back to the fixed defaults.
    """
    fb_team, fb_y, fb_x = K.FALLBACK_NEXT_EVENT
    games = (player_pred.select("game").unionByName(team_pred.select("game"))
             .unionByName(coords_pred.select("game")).distinct())
    out = (games.join(player_pred, "game", "left").join(team_pred, "game", "left").join(coords_pred, "game", "left"))
    team = F.coalesce(F.col("team_id").cast("int"), F.lit(fb_team))
    return out.select(
        "game",
        F.coalesce(F.col("player_id").cast("bigint"), F.lit(K.FALLBACK_PLAYER).cast("bigint")).alias("player_id"),
        team.alias("team_id"),
        F.coalesce(along_team1_axis("y_along_team1_axis", team), F.lit(fb_y)).alias("y"),
        F.coalesce(along_team1_axis("x_along_team1_axis", team), F.lit(fb_x)).alias("x"),
    )
