"""Scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def game_time(minute="min", second="sec") -> Column:
    """Seconds since kick-off of the period clock: ``60*min + sec``."""
    return (_c(minute).cast("int") * 60 + _c(second).cast("int")).cast("int")


def game_key(home="home_team_id", away="away_team_id", source=None) -> Column:
    """Game identifier ``home-away``; with ``source`` (the feed file) ``home-away@file`` so keys of
    different seasons do not collide."""
    key = F.concat_ws("-", _c(home).cast("string"), _c(away).cast("string"))
    if source is None:
        return key
    return F.concat_ws("@", key, F.regexp_extract(_c(source), r"([^/]+)$", 1))


def binarize_team(team="team_id", home="home_team_id", away="away_team_id") -> Column:
    """Home team -> 1, away team -> 0, any other id unchanged."""
    t = _c(team)
    return F.when(t == _c(home), F.lit(1)).when(t == _c(away), F.lit(0)).otherwise(t).cast("int")


def along_team1_axis(value, team="team_id") -> Column:
    """Project a coordinate onto the home team's attacking axis.

    ``team*v + (1-team)*(100-v)``: unchanged for the home team (1), mirrored
    for the away team (0). The same expression maps a prediction back onto
    the axis of the predicted team (it is its own inverse for 0/1 teams).
    """
    t = _c(team).cast("double")
    v = _c(value).cast("double")
    return t * v + (F.lit(1.0) - t) * (F.lit(100.0) - v)


def strip_prefix(uid, prefix: str = "p") -> Column:
    """Provider ids carry a letter prefix (``p123``): remove every occurrence."""
    return F.replace(_c(uid), F.lit(prefix), F.lit(""))


def first_n_of_list(value, n: int = K.STARTERS_PER_TEAM, sep: str = ", ") -> Column:
    """First ``n`` items of a separator-joined list (``split(v, sep)[:n]``)."""
    return F.slice(F.split(_c(value), sep), 1, n)


def qualifier_value(qualifiers, qualifier_id: int) -> Column:
    """Value of the first qualifier with the given id, NULL when absent."""
    hit = F.filter(_c(qualifiers), lambda q: q["qualifier_id"] == F.lit(qualifier_id))
    return F.get(hit, 0)["value"]


def stat_value(stats, stat_type: str) -> Column:
    """Value of a ``Stat`` entry by type; a later duplicate wins; NULL when absent."""
    hit = F.filter(_c(stats), lambda s: s["_Type"] == F.lit(stat_type))
    return F.when(F.size(hit) > 0, F.element_at(hit, -1)["_VALUE"])


def argmax_index(probabilities) -> Column:
    """0-based index of the first maximum of an array of probabilities."""
    p = _c(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def threshold_class(probability, threshold: float = 0.5) -> Column:
    return F.when(_c(probability) > threshold, F.lit(1)).otherwise(F.lit(0))


def ne_null_true(a, b) -> Column:
    """``a != b`` where NULL is different from everything (also from NULL)."""
    return ~F.coalesce(_c(a) == _c(b), F.lit(False))


def safe_ratio(num, den) -> Column:
    """``num/den`` as DOUBLE, NULL when ``den`` is 0 or NULL (ANSI-safe)."""
    return F.try_divide(_c(num).cast("double"), F.nullif(_c(den).cast("double"), F.lit(0.0)))


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` holds, as INT (0 for an empty group)."""
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("int")
