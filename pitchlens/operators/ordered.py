"""Order-dependent operators (lag, position) that survive hot keys.

The event feed is ordered by document position ``seq`` inside a game. A plain
``Window.partitionBy(game).orderBy(seq)`` sends every row of a game to one
task; if one game (or slice) holds a third of all rows, that task holds a third
of the data. Here the rows are windowed by ``(keys, seq block)`` instead, so one
window group holds at most ``block`` rows when ``seq`` is unique inside
``keys``, and a small table with one row per (keys, block) carries what a
block needs from the blocks before it:

* lag: the last ``max(offsets)`` rows before the block, as an array of structs
  (the tails of the blocks before it, from a window over the one-row-per-block
  table). A row takes a lag from inside its block where there is one, else from
  that array. One equi-join with the small table on the rows' own partitioning;
* position: the number of rows in earlier blocks (a running sum).

For a feed whose ``seq`` starts anew in every game a game is one block, and the
plan costs about what a plain window does. This is the only plan unless the
caller asks for ``strategy="direct"`` (the plain window), e.g. to compare. The
windows over the small table hold one row per ``block`` values of ``seq`` and key:
a game of 10**9 events has a thousand of them. Nothing runs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 20

_BLK, _RN, _CNT, _OFF, _PREV = "_blk", "_rn", "_cnt", "_off", "_prev"


def lag_name(col: str, n: int) -> str:
    return f"{col}_lag{n}"


def _check(strategy: str) -> None:
    if strategy not in ("blocked", "direct"):
        raise ValueError("strategy must be 'blocked' or 'direct'")


def with_block(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn(_BLK, F.floor(F.col(order) / F.lit(block)).cast("bigint"))


def block_offsets(blocked: DataFrame, keys: Sequence[str], count_col: str | None = None) -> DataFrame:
    """(keys, block) -> rows of ``keys`` in earlier blocks (and in all of them): one row per block."""
    counts = blocked.groupBy(*keys, _BLK).agg(F.count(F.lit(1)).alias(_CNT))
    w = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(_CNT).over(w), F.lit(0)).cast("bigint").alias(_OFF)]
    if count_col:
        cols.append(F.sum(_CNT).over(Window.partitionBy(*keys)).cast("bigint").alias(count_col))
    return counts.select(*keys, _BLK, *cols)


def ordered_position(df: DataFrame, keys: Sequence[str], order: str, pos_col: str = "pos",
                     count_col: str = "n_rows", block: int = DEFAULT_BLOCK, strategy: str = "blocked") -> DataFrame:
    """Add the 1-based position of each row inside ``keys`` (by ``order``) and the group size."""
    _check(strategy)
    keys = list(keys)
    if not keys:
        # one global order: a constant key keeps every join an equi-join
        out = ordered_position(df.withColumn("_all", F.lit(0)), ["_all"], order, pos_col, count_col, block, strategy)
        return out.drop("_all")
    if strategy == "direct":
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumns({pos_col: F.row_number().over(w).cast("bigint"),
                               count_col: F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    df = with_block(df, order, block)
    rn = F.row_number().over(Window.partitionBy(*keys, _BLK).orderBy(order))
    # one shuffle of the rows by (keys, block); the small offsets side joins on that partitioning
    out = (df.withColumn(_RN, rn).join(block_offsets(df, keys, count_col), [*keys, _BLK])
           .withColumn(pos_col, (F.col(_OFF) + F.col(_RN)).cast("bigint")))
    return out.drop(_BLK, _RN, _OFF)


def ordered_lag(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
                offsets: Sequence[int] = (1,), block: int = DEFAULT_BLOCK, strategy: str = "blocked") -> DataFrame:
    """Add ``<col>_lag<n>`` = value of ``col`` ``n`` rows earlier inside ``keys`` (by ``order``).

    Exactly ``lag(col, n) OVER (PARTITION BY keys ORDER BY order)``; NULL when
    there is no such row.
    """
    _check(strategy)
    keys, cols, offsets = list(keys), list(cols), sorted(set(offsets))
    if strategy == "direct":
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumns({lag_name(c, n): F.lag(c, n).over(w) for c in cols for n in offsets})
    df = with_block(df, order, block)
    part = [*keys, _BLK]
    w = Window.partitionBy(*part).orderBy(order)
    body = df.withColumns({_RN: F.row_number().over(w), **{lag_name(c, n): F.lag(c, n).over(w)
                                                           for c in cols for n in offsets}})
    out = body.join(_before_block(df, keys, order, cols, max(offsets)), part, "left")
    fixed = {}
    for n in offsets:
        # the row before the block's first row is the last of the array
        at = F.get(F.col(_PREV), F.size(_PREV) - (F.lit(n) - F.col(_RN) + 1))
        for c in cols:
            fixed[lag_name(c, n)] = F.when(F.col(_RN) > n, F.col(lag_name(c, n))).otherwise(at[c])
    return out.withColumns(fixed).drop(_BLK, _RN, _PREV)


def _before_block(df: DataFrame, keys: list[str], order: str, cols: list[str], h: int) -> DataFrame:
    """(keys, block) -> the last rows before the block, oldest first (at least ``h`` of them if there are)."""
    row = F.struct(F.col(order).alias("_order"), *[F.col(c).alias(c) for c in cols])
    if h == 1:  # one row per block: a hash aggregate, no window over the rows
        tails = df.groupBy(*keys, _BLK).agg(*[F.max_by(F.col(c), F.col(order)).alias(f"_last_{c}") for c in cols])
        tails = tails.select(*keys, _BLK, F.array(F.struct(*[F.col(f"_last_{c}").alias(c) for c in cols])).alias("_tail"))
    else:
        back = F.row_number().over(Window.partitionBy(*keys, _BLK).orderBy(F.desc(order)))
        tails = (df.select(*keys, _BLK, row.alias("_row"), back.alias("_back")).where(F.col("_back") <= h)
                 .groupBy(*keys, _BLK).agg(F.sort_array(F.collect_list("_row")).alias("_tail")))
    w = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(-h, -1)  # h blocks hold h rows: none is empty
    return tails.select(*keys, _BLK, F.flatten(F.collect_list("_tail").over(w)).alias(_PREV))
