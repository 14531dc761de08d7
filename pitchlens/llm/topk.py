"""Exact top-k inner products: tiled matrix products and a merge tree of per-query lists.

Queries are packed into tiles and candidates into shards. Every tile meets every shard through an
equi-join on a (tile, lane) grid: shards are dealt to lanes, and a task multiplies one tile by the
shards of one lane, keeping the best k per query. Lists merge eight lanes at a time until one list
per query is left. No task holds more than one tile, one shard and the lists of that tile.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitchlens.llm._common import cut, shuffle_partitions

FAN_IN = 8
_PACK = "dim int, pack long, ids binary, vecs binary, marks binary"
_LISTS = "tile long, dim int, lane long, ids binary, best binary, own binary, times binary"
LOW = np.iinfo(np.int64).min


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>), n: distinct (id, vector) rows and how many there are. Vectors that are NULL, empty or
    hold NULL or non-finite components, and rows without an id, take no part."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    ok = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ok)
            .groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")))


def _packed(rows: int):
    """(id, v, mark) rows -> blocks of at most ``rows`` vectors of one length, packed as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = 0

        def block(dim):
            nonlocal made
            i, v, m = (np.concatenate(x) for x in zip(*held.pop(dim)))
            order = np.argsort(i, kind="stable")
            made += 1
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "pack": pa.array([made], pa.int64()),
                                               "ids": [i[order].tobytes()], "vecs": [v[order].tobytes()], "marks": [m[order].tobytes()]})

        for b in batches:
            ids, marks = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            lst = b.column(1)
            off = np.asarray(lst.offsets)
            flat = lst.values.to_numpy(zero_copy_only=False)
            size = np.diff(off)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                for k in range(0, len(at), rows):
                    part = at[k:k + rows]
                    held.setdefault(int(dim), []).append((ids[part], flat[off[part][:, None] + np.arange(dim)].astype(np.float64), marks[part]))
                    if sum(len(x[0]) for x in held[int(dim)]) >= rows:
                        yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    return run


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers: exact at any size."""
    return np.array([scale * n // d for n, d in map(float.as_integer_ratio, x.ravel().tolist())], object).reshape(x.shape)


def products(q: np.ndarray, c: np.ndarray, scale: int) -> np.ndarray:
    """Exact integer inner products of floor(scale * x); sums beyond the range of int64 end at its limits."""
    with np.errstate(over="ignore"):
        a, b = np.floor(scale * q), np.floor(scale * c)
    top = float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0))
    bound = top[0] * top[1] * q.shape[1]
    if bound < 2**53:  # every partial sum is an exact double
        return (a @ b.T).astype(np.int64)
    if bound < 2**62 and max(top) < 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    wide = _whole(q, scale) @ _whole(c, scale).T
    return np.clip(wide, LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores, ties to the smaller id; LOW marks an empty place. ids: one row or one per row."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > 4 * k:  # partial selection: all that reach the k-th score, then the exact order
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        r, c = np.nonzero(scores >= kth[:, None])
    else:
        r, c = np.nonzero(scores > LOW)
    s, i = scores[r, c], ids[r, c]
    order = np.lexsort((i, ~s, r))
    r, s, i = r[order], s[order], i[order]
    first = np.searchsorted(r, np.arange(len(scores)))
    place = np.arange(len(r)) - first[r]
    ok = (place < k) & (s > LOW)
    out_s = np.full((len(scores), k), LOW, np.int64)
    out_i = np.full((len(scores), k), -1, np.int64)
    out_s[r[ok], place[ok]], out_i[r[ok], place[ok]] = s[ok], i[ok]
    return out_s, out_i


def _scored(k: int, scale: int, block: int = 256):
    """Lists of a tile over one lane; shards of the same lane that follow each other share a list."""

    def rows(at, s, i, own, times):
        return pa.RecordBatch.from_pydict({
            "tile": pa.array([at[0]], pa.int64()), "dim": pa.array([at[1]], pa.int32()),
            "lane": pa.array([at[2]], pa.int64()), "ids": [i.tobytes()], "best": [s.tobytes()], "own": [own], "times": [times]})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for r in b.to_pylist():
                own = np.frombuffer(r["q_ids"], np.int64)
                q = np.frombuffer(r["q_vecs"]).reshape(len(own), r["dim"])
                ids = np.frombuffer(r["ids"], np.int64)
                c = np.frombuffer(r["vecs"]).reshape(len(ids), r["dim"])
                first = np.flatnonzero(np.frombuffer(r["marks"], np.int64))
                out_s, out_i = [], []
                for a in range(0, len(q), block):
                    s = products(q[a:a + block], c, scale)
                    x, y = np.nonzero(own[a:a + block, None] == ids[first])
                    same = (q[a + x] == c[first[y]]).all(axis=1)
                    s[x[same], first[y[same]]] = LOW  # every row but the query's own
                    x, y = best(s, ids, k)
                    out_s.append(x)
                    out_i.append(y)
                at, s, i = (r["tile"], r["dim"], r["lane"]), np.concatenate(out_s), np.concatenate(out_i)
                if held and held[0] == at:
                    s, i = best(np.hstack([held[1], s]), np.hstack([held[2], i]), k)
                elif held:
                    yield rows(*held)
                held = at, s, i, r["q_ids"], r["times"]
        if held:
            yield rows(*held)

    return run


def merge_lists(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """One list per query of a tile from several."""
    own = np.frombuffer(pdf["own"].iloc[0], np.int64)
    s = i = None
    for x, y in zip(pdf["best"], pdf["ids"]):
        x, y = np.frombuffer(x, np.int64).reshape(len(own), k), np.frombuffer(y, np.int64).reshape(len(own), k)
        s, i = best(np.hstack([s, x]), np.hstack([i, y]), k) if s is not None else (x, y)
    out = pdf.iloc[:1].copy()
    out["best"], out["ids"] = [s.tobytes()], [i.tobytes()]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vec_col: str = "embedding", tile_rows: int = 2048, shard_rows: int = 4096, lanes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query by integer inner product.

    Candidates are all rows of ``vectors`` but the query's own; ties go to the smaller id. Rows that repeat an id are
    rows of their own, with the same or another vector; equal rows are scored once and count as many times as the list
    has places. Vectors that are not usable take no part; vectors of different length are not compared. Fewer than k
    candidates give fewer rows. Scores beyond the range of a long are its limits (ties to the smaller id there too).
    """
    lanes = lanes or max(FAN_IN**2, FAN_IN * shuffle_partitions(vectors.sparkSession))
    tiles = cut(usable(queries, id_col, vec_col).mapInArrow(_packed(tile_rows), _PACK)
                .select("dim", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("marks").alias("times"),
                        F.monotonically_increasing_id().alias("tile")))
    # Of equal rows k + 1 are enough: k places, and the query's own row, which is the first of them.
    copies = usable(vectors, id_col, vec_col).select("id", "v", F.posexplode(F.array_repeat(F.lit(0), F.least("n", F.lit(k + 1)).cast("int"))).alias("at", "_"))
    shards = copies.select("id", "v", (F.col("at") == 0).cast("long").alias("mark")).mapInArrow(_packed(shard_rows), _PACK).select(
        F.col("dim").alias("s_dim"), "ids", "vecs", "marks", F.pmod(F.xxhash64("ids", "vecs"), F.lit(lanes)).alias("lane"))
    every_lane = F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))
    # The grid: a tile goes to every lane; a shard goes to its lane once per tile.
    numbers = tiles.select("tile", F.col("dim").alias("t_dim"))
    at_lanes = tiles.withColumn("lane", F.explode(every_lane))
    spread = (numbers.withColumn("lane", F.explode(every_lane))
              .join(shards, "lane").where(F.col("t_dim") == F.col("s_dim")).select("tile", "lane", "ids", "vecs", "marks"))
    pairs = spread.join(at_lanes, ["tile", "lane"])
    lists = pairs.select("tile", "dim", "lane", "q_ids", "q_vecs", "ids", "vecs", "marks", "times").mapInArrow(_scored(k, scale), _LISTS)
    width = lanes
    while True:
        lists = lists.groupBy("tile", "lane").applyInPandas(lambda pdf: merge_lists(pdf, k), _LISTS)
        if width == 1:
            break
        width = -(-width // FAN_IN)
        lists = lists.withColumn("lane", F.floor(F.col("lane") / FAN_IN))
    out = lists.mapInArrow(_unpacked(k), "query_id long, rank int, vec_id long, score long, times long")
    return out.select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_")).drop("_")


def _unpacked(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = np.frombuffer(r["own"], np.int64)
                s, i = np.frombuffer(r["best"], np.int64), np.frombuffer(r["ids"], np.int64)
                ok = s > LOW
                yield pa.RecordBatch.from_pydict({
                    "query_id": np.repeat(own, k)[ok], "rank": np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))[ok],
                    "vec_id": i[ok], "score": s[ok], "times": np.repeat(np.frombuffer(r["times"], np.int64), k)[ok]})

    return run
