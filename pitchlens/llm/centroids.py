"""Centroid clustering with a vantage-point tree over the centroids, rebuilt and broadcast each round.

Vectors become integers, so distances and means are exact. A round builds a tree of the k centroids on the
driver (k is a parameter), broadcasts it, and every task finds the nearest centroid of its vectors by best-first
branch and bound: a subtree is entered while its lower bound does not pass the best distance so far (the
bound counts as inside, so ties are seen), leaf and vantage distances are exact integers, and of equal
distances the smaller number wins. Tasks return one sum vector per cluster; sums merge as a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitchlens.llm._common import tree_merge

LEAF = 2
FRONTIER = 1 << 21    # cells of (vectors, tree nodes) at a time
SLACK = 1e-12         # relative; the rounding of a bound's square roots is below 1e-15
LONG = np.iinfo(np.int64).max


@dataclass
class VantageTree:
    """Nodes of a vantage-point tree: a leaf has members; an inner node a vantage point and two children, each with
    the range of its members' distances to the vantage point."""

    points: np.ndarray                   # (k, dim) int64
    vantage: list[int] = field(default_factory=list)
    members: list[np.ndarray] = field(default_factory=list)
    children: list[tuple[tuple[int, float, float], ...]] = field(default_factory=list)

    @classmethod
    def build(cls, points: np.ndarray) -> VantageTree:
        tree = cls(points)
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            ids, parent, side = todo.pop()
            node = len(tree.vantage)
            if parent is not None:
                tree.children[parent] = tuple((node, *c[1:]) if k == side else c for k, c in enumerate(tree.children[parent]))
            if len(ids) <= LEAF:
                tree.vantage.append(-1)
                tree.members.append(ids)
                tree.children.append(())
                continue
            # The point farthest from the first one sees the others best apart.
            first = squared(points[ids], points[ids[0]])
            v = ids[int(first.argmax())]
            rest = ids[ids != v]
            d = np.sqrt(squared(points[rest], points[v]).astype(np.float64))
            order = np.argsort(d, kind="stable")
            half = len(rest) // 2
            sides = [s for s in (order[:half], order[half:]) if len(s)]
            tree.vantage.append(int(v))
            tree.members.append(np.zeros(0, np.int64))
            tree.children.append(tuple((-1, float(d[s].min()), float(d[s].max())) for s in sides))
            todo += [(rest[s], node, k) for k, s in enumerate(sides)]
        return tree

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest point of every row of x."""
        step = max(1, FRONTIER // len(self.vantage))
        parts = [self._search(x[k:k + step]) for k in range(0, len(x), step)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64),) * 2

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, who = np.full(len(x), LONG), np.full(len(x), len(self.points))
        bound = np.full((len(x), len(self.vantage)), np.inf)  # of the nodes that wait
        bound[:, 0] = 0
        rows = np.arange(len(x))

        def met(r: np.ndarray, point: int) -> np.ndarray:
            d = squared(x[r], self.points[point])
            better = (d < best[r]) | (d == best[r]) & (point < who[r])
            best[r[better]], who[r[better]] = d[better], point
            return d

        while len(rows):
            node = bound[rows].argmin(axis=1)
            low = bound[rows, node]
            go = low <= np.sqrt(best[rows].astype(np.float64))
            rows, node, low = rows[go], node[go], low[go]
            bound[rows, node] = np.inf
            for n in np.unique(node).tolist():
                at = node == n
                r = rows[at]
                if self.vantage[n] < 0:
                    for p in self.members[n].tolist():
                        met(r, p)
                    continue
                d = np.sqrt(met(r, self.vantage[n]).astype(np.float64))
                for child, lo, hi in self.children[n]:
                    gap = np.maximum(lo - d, d - hi) - SLACK * (d + hi)
                    bound[r, child] = np.maximum(low[at], gap)
        return who, best


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = x - point
    return (d * d).sum(axis=1)


class Assigner:
    """Nearest centroids of quantised vectors; values too large for exact 64-bit sums are compared as Python integers."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.largest = max((abs(c) for v in centroids for c in v), default=0)
        self.tree = VantageTree.build(np.array(centroids, np.int64)) if self._small(0) else None

    def _small(self, largest: int) -> bool:
        return len(self.centroids[0]) * (self.largest + largest) ** 2 < 1 << 62

    def assign(self, x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x: (n, dim) finite doubles -> (cluster, squared distance, integers); int64, or objects where values are large."""
        q = np.floor(scale * x)
        top = np.abs(q).max(axis=1, initial=0)
        small = self.tree is not None and (top < 2**53).all() and self._small(int(top.max(initial=0)))
        if small:
            q = q.astype(np.int64)
            return *self.tree.nearest(q), q
        whole = np.array([[_floor(scale, v) for v in r] for r in x.tolist()], object).reshape(x.shape)
        cluster, distance = np.zeros(len(x), np.int64), np.empty(len(x), object)
        for k, row in enumerate(whole):
            distance[k], cluster[k] = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), n) for n, c in enumerate(self.centroids))
        return cluster, distance, whole


def _floor(scale: int, v: float) -> int:
    """Exact floor(scale * v), also where the product is no finite double."""
    n, d = v.as_integer_ratio()
    return scale * n // d


def _vectors(col) -> np.ndarray:
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _blocks(batches: Iterable[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, 1 << 13):
            part = b.slice(k, 1 << 13)
            yield part, _vectors(part.column(place))


def _sums(shared, scale: int, with_distance: bool):
    """Per task and cluster: the number of vectors and the exact sum of the vectors (or of their distances)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, held = Assigner(shared.value), {}
        for _, x in _blocks(batches, 0):
            cluster, distance, q = a.assign(x, scale)
            for c in np.unique(cluster).tolist():
                at = cluster == c
                add = [_exact_sum(distance[at])] if with_distance else [_exact_sum(q[at, j]) for j in range(q.shape[1])]
                n, s = held.get(c, (0, [0] * len(add)))
                held[c] = (n + int(at.sum()), [p + r for p, r in zip(s, add, strict=True)])
        if held:
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(list(held), pa.int32()), "n": pa.array([n for n, _ in held.values()], pa.int64()),
                                              "sums": [[str(v) for v in s] for _, s in held.values()]})

    return run


def _exact_sum(v: np.ndarray) -> int:
    """Sum as a Python integer: in int64 by halves of the bits, which 2**13 rows cannot overflow."""
    if v.dtype == object:
        return sum(v.tolist())
    return (int((v >> 32).sum()) << 32) + int((v & 0xFFFFFFFF).sum())


def _added(g: pd.DataFrame) -> pd.DataFrame:
    total = [sum(int(v) for v in col) for col in zip(*g["sums"], strict=True)]
    return pd.DataFrame({"cluster": [g["cluster"].iloc[0]], "n": [int(g["n"].sum())], "sums": [[str(v) for v in total]], "lane": [g["lane"].iloc[0]]})


_SUMS = "cluster int, n long, sums array<string>"


def _collected(kept: DataFrame, centroids: list[list[int]], scale: int, with_distance: bool) -> dict[int, tuple[int, list[int]]]:
    shared = kept.sparkSession.sparkContext.broadcast(centroids)
    parts = kept.select("x").mapInArrow(_sums(shared, scale, with_distance), _SUMS)
    out = {r["cluster"]: (r["n"], [int(v) for v in r["sums"]]) for r in tree_merge(parts, ["cluster"], _added, _SUMS).collect()}
    shared.unpersist()
    return out


def _assigned(shared, scale: int, own: list[int]):
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in shared.value]
    cap = lambda v: min(int(v), int(LONG))
    whole, own = cap(sum(own)), [cap(v) for v in own]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Assigner(shared.value)
        for b, x in _blocks(batches, 1):
            cluster, distance, _ = a.assign(x, scale)
            where = cluster.tolist()
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(cluster, pa.int32()), pa.array([cap(d) for d in distance.tolist()], pa.int64()),
                pa.array([own[c] for c in where], pa.int64()), pa.array([whole] * len(where), pa.int64()),
                pa.array([digests[c] for c in where])],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector, repeated rows each.

    Kept are vectors of exactly ``dim`` components, none NULL or non-finite; a component x becomes floor(scale * x).
    The first centroids are the k vectors with the smallest sha256 of "<seed>:<vec_id>" (rows of equal ids in the order of
    their components; NULL ids last). Fewer vectors than k give as many centroids; none, or an empty table, no row.
    An empty cluster keeps its centroid. Sums and distances are exact at any size of values; a result column
    that does not fit a long is its largest value. Columns of other names do no harm. Per round the driver
    gets k sum vectors; the vectors themselves are read anew and never shuffled.
    """
    kept = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda v: v.cast("double")).alias("x"))
            .where((F.size("x") == dim) & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(order.asc_nulls_last(), F.col("x")).limit(k).select("x").collect()
    centroids = [[_floor(scale, v) for v in r["x"]] for r in first]
    if not centroids:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    for _ in range(rounds):
        sums = _collected(kept, centroids, scale, with_distance=False)
        centroids = [[s // sums[c][0] for s in sums[c][1]] if c in sums else v for c, v in enumerate(centroids)]
    own = _collected(kept, centroids, scale, with_distance=True)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    return kept.mapInArrow(_assigned(shared, scale, [own[c][1][0] if c in own else 0 for c in range(len(centroids))]), _RESULT)


def sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB SQL for the rows of ``cluster`` on ``embeddings``."""
    parts = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale}.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cent0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM kept
  ORDER BY c LIMIT {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
near{r} AS MATERIALIZED (
  SELECT rid, c, d FROM (
    SELECT rid, c, d, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS n FROM (
      SELECT a.rid, b.c, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
      FROM kept a JOIN cent{r} b ON b.c >= 0)) WHERE n = 1)""")
        if r < rounds:
            parts.append(f"""
cent{r + 1} AS MATERIALIZED (
  SELECT b.c, coalesce(m.v, b.v) AS v FROM cent{r} b LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
      SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT n.c, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS j FROM kept k JOIN near{r} n USING (rid)) GROUP BY c, j) GROUP BY c) m
  ON m.c = b.c)""")
    return f"""WITH {",".join(parts)}
SELECT k.vec_id, n.c AS cluster, n.d AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(b.v, ',')) AS centroid_sha256
FROM kept k JOIN near{rounds} n USING (rid) JOIN cent{rounds} b ON b.c = n.c
"""
