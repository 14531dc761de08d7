"""Event-time windows and document-order lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .ordered import DEFAULT_BLOCK, lag_name, ordered_lag, ordered_position


def sliding_windows(df: DataFrame, step_min: int = 5, length_min: int = K.WINDOW_MIN,
                    first_half=K.FIRST_HALF_STARTS, second_half=K.SECOND_HALF_STARTS) -> DataFrame:
    """Assign each event to every overlapping window that contains it.

    Period 1 windows start at ``first_half[0] .. first_half[1]`` minutes,
    period 2 at ``second_half[0] .. second_half[1]``, every ``step_min``
    minutes, each ``length_min`` long with **both** ends inclusive (an event
    exactly on a 5-minute mark belongs to 4 windows of 15 minutes). Events
    after the last window (stoppage time) are in none; other periods in none.

    An equi-form range join: each row is exploded into its (at most
    ceil(length/step)+1) candidate starts; no join and no shuffle.
    Adds ``start`` (minutes) and ``time_period`` (``"s-e"`` label).
    """
    t = F.col("game_time_in_sec")
    p = F.col("period_id")
    starts = (F.when(p == 1, F.sequence(F.lit(first_half[0]), F.lit(first_half[1]), F.lit(step_min)))
              .when(p == 2, F.sequence(F.lit(second_half[0]), F.lit(second_half[1]), F.lit(step_min))))
    hits = F.filter(starts, lambda s: t.between(s * 60, (s + length_min) * 60))
    out = df.withColumn("start", F.explode(hits))
    return out.withColumn("time_period", window_label("start", length_min))


def window_label(start: str, length_min: int = K.WINDOW_MIN) -> Column:
    return F.format_string("%d-%d", F.col(start), F.col(start) + length_min)


def lag_columns(df: DataFrame, cols: Sequence[str], lags: Sequence[int], keys=("game",), order="seq",
                block: int = DEFAULT_BLOCK, strategy: str = "blocked") -> DataFrame:
    """Shift the given columns by each lag in document order inside a game."""
    return ordered_lag(df, list(keys), order, list(cols), list(lags), block=block, strategy=strategy)


def next_event_dataset(events: DataFrame, columns_to_lag: Sequence[str] = tuple(K.NEXT_EVENT_COLS_TO_LAG),
                       lags: Sequence[int] = tuple(K.NEXT_EVENT_LAGS), keys=("game",),
                       block: int = DEFAULT_BLOCK, strategy: str = "blocked") -> DataFrame:
    """Targets of each event next to the lagged context of the previous events.

    Keeps only rows whose period equals the period of **every** lagged row
    (so the first ``max(lags)`` events of each period go, and NULL lags go),
    then drops the lagged period columns.
    """
    if "period_id" not in columns_to_lag:
        raise ValueError("period_id must be among the lagged columns")
    targets = ["seq", *keys, "period_id", "team_id", "x_along_team1_axis", "y_along_team1_axis"]
    base = events.select(*dict.fromkeys(targets + list(columns_to_lag)))
    lagged = ordered_lag(base, list(keys), "seq", list(columns_to_lag), list(lags), block=block,
                         strategy=strategy)
    cond = F.lit(True)
    for n in lags:
        cond = cond & (F.col("period_id") == F.col(lag_name("period_id", n)))
    keep = [lag_name(c, n) for n in lags for c in columns_to_lag if c != "period_id"]
    return lagged.where(cond).select(*dict.fromkeys(targets + keep))


def last_rows(df: DataFrame, n: int = 1, keys=("game",), order="seq", block: int = DEFAULT_BLOCK) -> DataFrame:
    """The last ``n`` rows of each group in document order (``tail(n)`` per game).

    ``n = 1`` is a partial aggregate (``max_by``): no row is shuffled. More rows come from the last rows of
    each ``seq`` block (a window per block), of which the last ``n`` per group are kept.
    """
    keys = list(keys)
    if n == 1:
        rest = [c for c in df.columns if c not in keys]
        last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
        return last.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])
    part = Window.partitionBy(*keys, "_part").orderBy(F.desc(order))
    top = (df.withColumn("_part", F.floor(F.col(order) / F.lit(block)))
           .withColumn("_back", F.row_number().over(part)).where(F.col("_back") <= n))
    return (top.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
            .where(F.col("_back") <= n).select(*df.columns))


def last_order(df: DataFrame, n: int, keys=("game",), order="seq") -> DataFrame:
    """(keys, _cut): the ``n``-th largest ``order`` of each group, NULL if it has fewer rows.

    Two partial aggregates of one number per row: the ``n`` largest per (keys, salt), then of those.
    """
    keys = list(keys)
    largest = F.slice(F.reverse(F.sort_array(F.collect_list(order))), 1, n)
    salted = df.select(*keys, order, F.floor(F.col(order) / F.lit(4096)).alias("_part"))
    some = salted.groupBy(*keys, "_part").agg(largest.alias("_top"))
    top = F.reverse(F.sort_array(F.flatten(F.collect_list("_top"))))
    return some.groupBy(*keys).agg(F.get(top, F.lit(n - 1)).alias("_cut"))


def all_but_last(df: DataFrame, n: int = 10, keys=("game",), order="seq") -> DataFrame:
    """Every row except the last ``n`` of each group (``head(-n)`` per game).

    The cut-off (the ``n``-th largest ``order``, one number per group) comes from an aggregate; the rows are
    only filtered by an equi-join with it.
    """
    cut = last_order(df, n, keys, order)
    return df.join(cut, list(keys)).where(F.col(order) < F.col("_cut")).select(*df.columns)
