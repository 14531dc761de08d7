"""Next-event features over a stream of event files, with table state (``foreachBatch``).

For large micro-batches (backfills, replays of a season) a per-game Python
state function would hold a whole game of one batch in one task. Here every
micro-batch runs the distributed, skew-safe batch operator instead, and the
state between batches is a small table -- the last ``max(lags)`` events of
every open game -- written per batch to shared storage:

1. ``tail`` = state of the latest committed batch; ``new`` = cleaned events of
   this batch; lags are computed over ``tail`` + ``new`` (ordered lag, blocked
   when a game is hot) and only rows of ``new`` are emitted;
2. the next state is the last rows per game of ``tail`` + ``new``, without the
   games whose final whistle (second-half END) arrived in this batch.

Each batch writes its output and state under its own batch id (overwrite),
so a re-run of a failed batch is idempotent; the stream checkpoint makes the
source exactly-once. Events of a game must arrive in document order across
batches (an append-only feed); inside a batch any order is fine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..operators.clean import next_event_input
from ..operators.ordered import lag_name, ordered_lag
from ..operators.windows import last_rows
from .live import LAGGED, output_schema

_STATE_COLS = ["seq", "game", *LAGGED]
STATE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("game", T.StringType()),
    T.StructField("period_id", T.IntegerType()), T.StructField("type_id", T.IntegerType()),
    T.StructField("team_id", T.IntegerType()), T.StructField("x_along_team1_axis", T.DoubleType()),
    T.StructField("y_along_team1_axis", T.DoubleType()),
])


def _committed(spark: SparkSession, root: str, below: int) -> str | None:
    """Path of the newest ``batch=<id>`` directory under ``root`` with id < ``below`` and a _SUCCESS marker."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    best = None
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("batch="):
            i = int(name.split("=", 1)[1])
            ok = fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath().toString() + "/_SUCCESS"))
            if i < below and ok and (best is None or i > best[0]):
                best = (i, st.getPath().toString())
    return best[1] if best else None


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, sink_dir: str, state_dir: str,
                  lags: Sequence[int] = tuple(K.NEXT_EVENT_LAGS)) -> None:
    """One micro-batch: emit next-event rows of the new events, advance the per-game tail table."""
    lags = list(lags)
    batch = batch.persist()          # read twice: new events and final whistles
    try:
        _process(spark, batch, batch_id, sink_dir, state_dir, lags)
    finally:
        batch.unpersist()


def _process(spark: SparkSession, batch: DataFrame, batch_id: int, sink_dir: str, state_dir: str,
             lags: list[int]) -> None:
    prev = _committed(spark, state_dir, batch_id)
    tail = spark.read.schema(STATE_SCHEMA).parquet(prev) if prev else spark.createDataFrame([], STATE_SCHEMA)
    new = next_event_input(batch).select(*_STATE_COLS)
    _check_order(new, tail)
    both = new.withColumn("_new", F.lit(True)).unionByName(tail.withColumn("_new", F.lit(False)))
    lagged = ordered_lag(both, ["game"], "seq", LAGGED, lags)
    keep = F.col("_new")
    for n in lags:
        keep = keep & (F.col("period_id") == F.col(lag_name("period_id", n)))
    cols = [f.name for f in output_schema(lags).fields]
    lagged.where(keep).select(*cols).write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    closed = batch.where((F.col("type_id") == K.END_PERIOD) & (F.col("period_id") == 2)).select("game").distinct()
    nxt = last_rows(both.drop("_new"), max(lags), keys=["game"]).join(closed, "game", "left_anti")
    nxt.select(*_STATE_COLS).write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}")


def _check_order(new: DataFrame, tail: DataFrame) -> None:
    """Lags are right only if the events of an open game arrive in order: stop the stream if they do not."""
    late = (new.groupBy("game").agg(F.min("seq").alias("first"))
            .join(tail.groupBy("game").agg(F.max("seq").alias("last")), "game").where("first <= last").limit(3).collect())
    if late:
        raise ValueError("events arrive out of order: " + ", ".join(
            f"game {r['game']} has seq {r['first']} after {r['last']}" for r in late))


def run_replay(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str, checkpoint_dir: str,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream every file present in ``source_dir`` (``availableNow``) through :func:`process_batch`.

    Output, state and checkpoint live under shared storage; returns the output as a table.
    """
    sink, state = f"{out_dir}/out", f"{out_dir}/state"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    q = (stream.writeStream.foreachBatch(lambda df, bid: process_batch(spark, df, bid, sink, state))
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    cols = [f.name for f in output_schema().fields]
    return spark.read.schema(output_schema()).parquet(f"{sink}/batch=*").select(*cols)
