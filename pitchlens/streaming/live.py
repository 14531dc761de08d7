"""Live next-event features with Structured Streaming.

The scoring step predicts the next event of a game from its last three
events. On a live feed that is a stateful streaming operator: per game the
state holds only the last ``max(lags)`` events (bounded, a few numbers per
game), and every arriving event emits the feature row that predicts the
event after it -- the same rows as the batch next-event dataset.

* ``groupBy("game").applyInPandasWithState``: per micro-batch and game the
  new events are sorted by ``seq`` after the state's tail; lags never look
  further back than the tail, so state stays O(lags) per game.
* A game's state is dropped when its second-half END event arrives (the
  final whistle is part of the feed), so finished games do not accumulate.
  No timeout is needed, which also lets ``availableNow`` runs terminate.
* Events of a game must arrive in document order across micro-batches (an
  append-only feed). Inside a micro-batch any order is fine.
* The work per task is bounded by the micro-batch size
  (``maxFilesPerTrigger`` on file sources).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K
from ..functions.columns import along_team1_axis
from ..operators.clean import clean_events

LAGGED = ["period_id", "type_id", "team_id", "x_along_team1_axis", "y_along_team1_axis"]
_TYPES = {"seq": T.LongType(), "period_id": T.IntegerType(), "type_id": T.IntegerType(),
          "team_id": T.IntegerType(), "x_along_team1_axis": T.DoubleType(), "y_along_team1_axis": T.DoubleType()}

STATE_SCHEMA = T.StructType([T.StructField(c, T.ArrayType(_TYPES[c])) for c in ["seq", *LAGGED]])


def output_schema(lags: Sequence[int] = tuple(K.NEXT_EVENT_LAGS)) -> T.StructType:
    fields = [T.StructField("seq", T.LongType()), T.StructField("game", T.StringType()),
              T.StructField("period_id", T.IntegerType()), T.StructField("team_id", T.IntegerType()),
              T.StructField("x_along_team1_axis", T.DoubleType()), T.StructField("y_along_team1_axis", T.DoubleType())]
    for n in lags:
        for c in LAGGED[1:]:
            fields.append(T.StructField(f"{c}_lag{n}", _TYPES[c]))
    return T.StructType(fields)


def _typed(values: pd.Series, dtype: T.DataType) -> list:
    """State values with the state schema's Python types (pandas may have widened ints to floats)."""
    conv = float if isinstance(dtype, T.DoubleType) else int
    return [None if pd.isna(v) else conv(v) for v in values]


def _advance(lags: Sequence[int]):
    depth = max(lags)
    markers = [K.START_PERIOD, K.END_PERIOD]

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(pdfs), ignore_index=True)
        final_whistle = bool(((batch["type_id"] == K.END_PERIOD) & (batch["period_id"] == 2)).any())
        new = batch[~batch["type_id"].isin(markers)].sort_values("seq", kind="stable").reset_index(drop=True)
        if state.exists:
            tail = pd.DataFrame({c: list(v) for c, v in zip(["seq", *LAGGED], state.get)})
            n_tail = len(tail)
            frame = pd.concat([tail[["seq", *LAGGED]], new[["seq", *LAGGED]]], ignore_index=True)
        else:
            n_tail = 0
            frame = new[["seq", *LAGGED]].reset_index(drop=True)
        out = new[["seq", "period_id", "team_id", "x_along_team1_axis", "y_along_team1_axis"]].copy()
        out.insert(1, "game", key[0])
        keep = pd.Series(True, index=out.index)
        for n in lags:
            shifted = frame.shift(n).iloc[n_tail:].reset_index(drop=True)
            keep &= (shifted["period_id"] == out["period_id"].to_numpy()).to_numpy()
            for c in LAGGED[1:]:
                out[f"{c}_lag{n}"] = shifted[c].to_numpy()
        if final_whistle:
            state.remove()
        elif len(frame):
            last = frame.iloc[-depth:]
            state.update(tuple(_typed(last[c], _TYPES[c]) for c in ["seq", *LAGGED]))
        out = out[keep.to_numpy()]
        if len(out):
            for c in ("period_id", "team_id", *[f"{c}_lag{n}" for n in lags for c in ("type_id", "team_id")]):
                out[c] = out[c].astype("int32")
            yield out

    return fn


def live_next_event_features(events: DataFrame, lags: Sequence[int] = tuple(K.NEXT_EVENT_LAGS)) -> DataFrame:
    """Streaming canonical events -> next-event feature rows, one per event with full context.

    Period start/end markers reach the state function (the final whistle
    closes the game) but produce no rows, as in the batch dataset.
    """
    ev = clean_events(events).withColumns({
        "x_along_team1_axis": along_team1_axis("x", "team_id"),
        "y_along_team1_axis": along_team1_axis("y", "team_id"),
    }).select("seq", "game", *LAGGED)
    return ev.groupBy("game").applyInPandasWithState(
        _advance(list(lags)), outputStructType=output_schema(lags), stateStructType=STATE_SCHEMA,
        outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout)


def run_file_stream(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str, checkpoint_dir: str,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Process every file present in ``source_dir`` (``availableNow``) and return the sink as a table.

    Source: Parquet files of canonical events; sink: Parquet, exactly-once
    through the checkpoint (which must live in shared storage on a cluster).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    q = (live_next_event_features(stream).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint_dir).option("path", sink_dir)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(output_schema()).parquet(sink_dir)
