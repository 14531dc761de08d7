"""Counting aggregates per player / team (conditional sums in one hash aggregate).

Every function returns aggregate expressions or a grouped DataFrame; the
callers fold as many of them as possible into one ``groupBy`` so the events
are shuffled once per grain (with map-side partial aggregation, which keeps
hot keys cheap: each task ships one partial row per key).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

# Aggregates are written as SQL expressions: one parsed expression per
# aggregate keeps plan construction cheap for the ~40 aggregates of a slice.


def n_where(cond_sql: str, name: str) -> Column:
    """Number of rows where the SQL condition holds (NULL = false), INT; 0 for no rows."""
    return F.expr(f"CAST(count_if({cond_sql}) AS INT)").alias(name)


def _in(ids) -> str:
    return ", ".join(str(i) for i in ids)


def flag_sum(col: str, name: str | None = None) -> Column:
    """``nb_<col>`` = sum of a 0/1 flag column, INT, 0 for a group without rows."""
    return F.expr(f"CAST(COALESCE(sum(CAST(`{col}` AS INT)), 0) AS INT)").alias(name or f"nb_{col}")


def bool_counter_aggs(prev_type: str = "prev_type_id") -> list[Column]:
    """The six per-player counters: key passes, assists, goalkeeper events,
    shots, passes after a foul (free kicks) and passes after a corner."""
    return [
        flag_sum("assist", "nb_assist"),
        flag_sum("keypass", "nb_keypass"),
        n_where(f"type_id IN ({_in(K.GK_EVENTS)})", "nb_gk_events"),
        n_where(f"type_id IN ({_in(K.SHOT_EVENTS)})", "nb_shots"),
        n_where(f"type_id = {K.PASS} AND `{prev_type}` = {K.FOUL}", "nb_free_kick"),
        n_where(f"type_id = {K.PASS} AND `{prev_type}` = {K.CORNER_AWARDED}", "nb_corner"),
    ]


def count_pivot_aggs(ids: Iterable[int], prefix: str = "") -> list[Column]:
    """``<prefix><id>_nb`` = number of events of each type (a pivot with fixed values)."""
    return [n_where(f"type_id = {e}", f"{prefix}{e}_nb") for e in ids]


def success_rate_cols(ids: Iterable[int], prefix: str = "") -> tuple[list[Column], list[Column]]:
    """Aggregates and final expressions for ``<id>_nb`` and ``<id>_success_rate``.

    Rate = successes (outcome 1) / events; NULL when the group has no event
    of the type (0/0), 0 when it has events but no success.
    """
    aggs, finals = [], []
    for e in ids:
        aggs += [n_where(f"type_id = {e}", f"{prefix}{e}_nb"),
                 n_where(f"type_id = {e} AND outcome = 1", f"_{prefix}{e}_ok")]
        finals += [F.col(f"{prefix}{e}_nb"),
                   F.expr(f"try_divide(CAST(`_{prefix}{e}_ok` AS DOUBLE), NULLIF(CAST(`{prefix}{e}_nb` AS DOUBLE), 0.0))")
                   .alias(f"{prefix}{e}_success_rate")]
    return aggs, finals


def zone_aggs(zones: Sequence[str] = tuple(K.ZONES)) -> list[Column]:
    """Located-event counts per zone (``_z_all``, ``_z_<zone>``) of a group."""
    aggs = [n_where(f"zone IS NOT NULL AND zone <> '{K.NO_POSITION}'", "_z_all")]
    aggs += [n_where(f"zone = '{name}'", f"_z_{name}") for name in zones]
    return aggs


def zone_present(zones: Sequence[str] = tuple(K.ZONES)) -> list[Column]:
    """Whether any located event of a group is in each zone (``_has_<zone>``), over rows with ``_z_`` counts."""
    return [(F.max(f"_z_{name}") > 0).alias(f"_has_{name}") for name in zones]


def zone_finals(zones: Sequence[str] = tuple(K.ZONES)) -> list[Column]:
    """Share (percent) of a player's located events in each zone, of rows with ``_z_`` counts and ``_has_`` flags.

    NULL when the player has no located event. A zone that no located event of the scope has (the frame the
    shares are pivoted over: a window slice, a game) is NULL for everyone (it has no pivot column there),
    otherwise 0..100.
    """
    return [F.expr(f"CASE WHEN `_has_{name}` THEN 100.0D * try_divide(CAST(`_z_{name}` AS DOUBLE), "
                   f"NULLIF(CAST(_z_all AS DOUBLE), 0.0D)) END").alias(name) for name in zones]


def count_pivot(df: DataFrame, keys: Sequence[str], ids: Iterable[int], prefix: str = "") -> DataFrame:
    return df.groupBy(*keys).agg(*count_pivot_aggs(ids, prefix))


def success_rate(df: DataFrame, keys: Sequence[str], ids: Iterable[int], prefix: str = "") -> DataFrame:
    aggs, finals = success_rate_cols(ids, prefix)
    return df.groupBy(*keys).agg(*aggs).select(*keys, *finals)


def agg_stats(df: DataFrame, keys: Sequence[str], ids_number: Iterable[int] = tuple(K.EVENTS_COMPUTE_NUMBER),
              ids_rate: Iterable[int] = tuple(K.EVENTS_COMPUTE_SUCCESS_RATE), prefix: str = "") -> DataFrame:
    """Counts and success rates per key in one aggregate (``p_``/``t_`` grains)."""
    aggs, finals = success_rate_cols(ids_rate, prefix)
    aggs += count_pivot_aggs(ids_number, prefix)
    finals += [F.col(f"{prefix}{e}_nb") for e in ids_number]
    return df.groupBy(*keys).agg(*aggs).select(*keys, *finals)


def zone_share(df: DataFrame, keys: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Zone shares per ``keys`` (e.g. game, player), pivoted within ``scope`` (e.g. game).

    The zones of a scope are one partial aggregate, joined back on the scope: no task holds a whole scope.
    """
    present = df.groupBy(*scope).agg(*zone_aggs()).groupBy(*scope).agg(*zone_present())
    return df.groupBy(*keys).agg(*zone_aggs()).join(present, list(scope)).select(*keys, *zone_finals())


def pct_of_total(df: DataFrame, keys: Sequence[str], category: str, name: str = "pct") -> DataFrame:
    """Count per (keys, category) as a percentage of the keys' total.

    The window runs over the aggregated counts (one row per category), so a
    group never holds more rows than it has categories.
    """
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    return counts.select(*keys, category,
                         (F.lit(100.0) * F.col("_n") / F.sum("_n").over(w)).alias(name))


def bool_counters(df: DataFrame, keys: Sequence[str], prev_type: str = "prev_type_id") -> DataFrame:
    return df.groupBy(*keys).agg(*bool_counter_aggs(prev_type))


def outer_counters(df: DataFrame, keys: Sequence[str], prev_type: str = "prev_type_id") -> DataFrame:
    """The six counters as six aggregates combined by full outer joins on ``keys``.

    Same result as :func:`bool_counters` (every aggregate sees the same key
    set); kept for callers that build counters from different inputs.
    """
    parts = [df.groupBy(*keys).agg(a) for a in bool_counter_aggs(prev_type)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys), "full_outer")
    return out
