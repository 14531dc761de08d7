"""Exact k nearest neighbours over Voronoi cells.

Training rows go to the cell of their nearest pivot (pivots are a bounded sample of the rows). From the cells'
distances a query knows a radius that holds k rows for sure; it visits the cells that can have a row within it:
by the triangle inequality (distance to the pivot less the cell's radius) and by the hyperplane between
its own pivot and the cell's. Cells are cut into chunks, so a cell with a third of all rows is many groups;
queries and chunks meet on (cell, chunk), where rows too far from the pivot for any of the queries are
left out, and the best k of each visit merge per query.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

PIVOTS = 256          # at most
CHUNK_ROWS = 4096
DIGITS = 6            # squared distances are compared rounded to so many digits, ties by key
SLACK = 1e-6          # above the rounding of distances and bounds


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """Points of n rows at most, the first by a hash of their point; equal points once."""
    picked = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(4 * n).collect()
    return np.unique(np.array([r["x"] for r in picked], float), axis=0)[:n]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - pivots) ** 2).sum(-1), 0.0))


def _matrix(col) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _celled(pivots: np.ndarray):
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                d = _distances(_matrix(part.column(1)), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                                 [*part.schema.names, "cell", "far"])

    return run


def _visits(pivots: np.ndarray, cells: np.ndarray, radius: np.ndarray, near: list[np.ndarray], chunks: np.ndarray, k: int):
    """Queries -> one row per (cell, chunk) that may hold one of the k nearest, with the radius that holds k rows."""
    between = _distances(pivots, pivots)
    reach = np.concatenate(near)
    owner = np.repeat(cells, [len(v) for v in near])

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                d = _distances(_matrix(part.column(1)), pivots)
                sure = np.sort(d[:, owner] + reach, axis=1)
                limit = sure[:, min(k, sure.shape[1]) - 1] + SLACK
                own = d.argmin(1)
                low = d[:, cells] - radius
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d[:, cells] ** 2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * between[own][:, cells])
                plane = np.where(np.isfinite(plane), plane, 0.0)
                q, c = np.nonzero(np.maximum(low, plane) <= limit[:, None])
                times = chunks[c]
                q, c = np.repeat(q, times), np.repeat(c, times)
                ends = np.cumsum(times)
                chunk = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
                taken = part.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(cells[c].astype(np.int32)), pa.array(chunk.astype(np.int32)),
                                                  pa.array(limit[q]), pa.array(d[q, cells[c]])], ["qid", "qx", "cell", "chunk", "bound", "qfar"])

    return run


def _met(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries of a chunk against its rows: the best k of each query and how many pairs were compared."""
        q, x = _matrix(left["qx"].combine_chunks()), _matrix(right["x"].combine_chunks())
        order = np.argsort(right["far"].to_numpy(), kind="stable")
        far, x = right["far"].to_numpy()[order], x[order]
        ids = right["id"].take(pa.array(order)).to_numpy(zero_copy_only=False)
        labels = right["label"].take(pa.array(order)).to_numpy(zero_copy_only=False)
        qfar, bound, qids = left["qfar"].to_numpy(), left["bound"].to_numpy(), left["qid"].to_pylist()
        lo, hi = np.searchsorted(far, qfar - bound, "left"), np.searchsorted(far, qfar + bound, "right")
        out = {c: [] for c in ("qid", "id", "label", "d2", "compared")}
        for i in range(len(q)):
            d2 = np.round(((x[lo[i]:hi[i]] - q[i]) ** 2).sum(1), DIGITS)
            n = len(d2)
            if n > k:
                at = np.flatnonzero(d2 <= np.partition(d2, k - 1)[k - 1])
            else:
                at = np.arange(n)
            at = at[np.lexsort((ids[lo[i]:hi[i]][at], d2[at]))][:k]
            m = max(1, len(at))          # a visit without a row still tells that nothing was compared
            out["qid"] += [qids[i]] * m
            out["id"] += ids[lo[i]:hi[i]][at].tolist() or [None]
            out["label"] += labels[lo[i]:hi[i]][at].tolist() or [None]
            out["d2"] += d2[at].tolist() or [None]
            out["compared"] += [n] + [0] * (m - 1)
        return pa.table({"qid": pa.array(out["qid"], pa.string()), "id": pa.array(out["id"], pa.string()), "label": pa.array(out["label"], pa.int64()),
                         "d2": pa.array(out["d2"], pa.float64()), "compared": pa.array(out["compared"], pa.int64())})

    return run


def nearest(train: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """qid, rank (from 1), id, label, d2 (squared distance), compared (training rows the query was compared with).

    ``train`` has (id string, x array<double>, label long), ``queries`` (id string, x). All k nearest rows by
    (d2 rounded, id), or all rows where there are fewer. NULL vectors take no part.
    """
    train = cut(train.where(F.col("x").isNotNull()).select("id", "x", F.col("label").cast("long").alias("label")))
    queries = queries.where(F.col("x").isNotNull()).select("id", "x")
    empty = "qid string, rank int, id string, label long, d2 double, compared long"
    n = train.count()
    if not n:
        return train.sparkSession.createDataFrame([], empty)
    points = _pivots(train, pivots or max(1, min(PIVOTS, int(np.sqrt(n)))))
    celled = cut(train.mapInArrow(_celled(points), "id string, x array<double>, label long, cell int, far double"))
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("far"))
    # The k smallest distances to each pivot: best k per (cell, task) first, then of those; at most k x pivots values.
    small = (celled.withColumn("part", F.spark_partition_id()).withColumn("r", rank).where(F.col("r") <= k)
             .groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("far")), 1, k).alias("near")))
    stats = (celled.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).join(small, "cell").orderBy("cell").collect())
    chunks = np.array([-(-r["n"] // chunk_rows) for r in stats])
    per_cell = F.element_at(F.create_map(*[F.lit(int(v)) for r, c in zip(stats, chunks) for v in (r["cell"], c)]), F.col("cell"))
    parts = celled.withColumn("chunk", F.pmod(F.xxhash64("id"), per_cell.cast("long")).cast("int"))
    visits = queries.mapInArrow(
        _visits(points, np.array([r["cell"] for r in stats]), np.array([r["radius"] for r in stats]), [np.array(r["near"], float) for r in stats], chunks, k),
        "qid string, qx array<double>, cell int, chunk int, bound double, qfar double")
    met = visits.groupBy("cell", "chunk").cogroup(parts.groupBy("cell", "chunk")).applyInArrow(
        _met(k), "qid string, id string, label long, d2 double, compared long")
    best = Window.partitionBy("qid").orderBy(F.col("d2").asc_nulls_last(), "id")
    all_ = Window.partitionBy("qid")
    return (met.withColumn("rank", F.row_number().over(best)).withColumn("compared", F.sum("compared").over(all_))
            .where((F.col("rank") <= k) & F.col("id").isNotNull()).select("qid", "rank", "id", "label", "d2", "compared"))


def predicted(found: DataFrame) -> DataFrame:
    """qid, prediction: the most frequent label of a query's neighbours, the smallest of equals."""
    votes = found.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("qid").agg(F.min(F.struct(-F.col("n"), F.col("label"))).getField("label").alias("prediction"))


def frame(df: DataFrame, features: Sequence[str], key: Sequence[str], label: str | None = None) -> DataFrame:
    """(id, x[, label]) of a feature table; the id joins the key columns by '|'."""
    out = [F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x")]
    return df.select(*out, *([F.col(label).cast("long").alias("label")] if label else []))
