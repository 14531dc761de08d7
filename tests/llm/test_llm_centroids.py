"""Centroid clustering: against plain loops over Python integers, and its SQL."""
import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from pitchlens.llm import centroids
from pitchlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
VECS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                     *[T.StructField(c, T.StringType()) for c in ("x", "cluster", "lane", "n", "sums")]])


def plain(rows, k, rounds, dim, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * __import__("fractions").Fraction(c)) for c in v], v) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    cent = [q for _, q, _ in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(cent))

    for _ in range(rounds):
        where = [near(q)[1] for _, q, _ in kept]
        for n in range(len(cent)):
            own = [q for (_, q, _), w in zip(kept, where) if w == n]
            if own:
                cent[n] = [sum(col) // len(own) for col in zip(*own)]
    found = [(i, *near(q)[::-1]) for i, q, _ in kept]
    total = [sum(d for _, w, d in found if w == n) for n in range(len(cent))]
    top = 2**63 - 1
    return sorted(((i, w, min(d, top), min(total[w], top), min(sum(total), top),
                    hashlib.sha256(",".join(map(str, cent[w])).encode()).hexdigest()) for i, w, d in found), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 5) for i, v in rows], VECS)


def test_odd_vectors_ties_and_repeats(spark):
    r = np.random.default_rng(0)
    grid = [(k, [float(x) for x in r.integers(-2, 3, 4) / 1024]) for k in range(60)]  # many ties and equal vectors
    odd = [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf")] * 4),
           (105, []), (7, [0.5, 0.25, -0.125, 3.0]), (7, [0.0, 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4])]
    rows = grid + odd
    for k, rounds in ((1, 2), (5, 4), (100, 3)):
        assert rows_of(centroids.cluster(frame(spark, rows).repartition(6), k, rounds, 4)) == plain(rows, k, rounds, 4)
    assert centroids.cluster(frame(spark, odd[:6]), 3, 2, 4).count() == 0
    assert centroids.cluster(frame(spark, []), 3, 2, 4).count() == 0


def test_large_values_are_exact(spark):
    rows = [(k, [x, -x, 1e-300, 0.5]) for k, x in enumerate((1.0, 2.0, 1e6, 1e10, 1e30, 1.7e308, -3.5e20, 1e300))]
    assert rows_of(centroids.cluster(frame(spark, rows), 3, 3, 4)) == plain(rows, 3, 3, 4)


@settings(max_examples=80, deadline=None)
@given(points=st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=40),
       asked=st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=30))
def test_tree_search_equals_a_linear_one(points, asked):
    tree = centroids.VantageTree.build(np.array(points, np.int64))
    who, d = tree.nearest(np.array(asked, np.int64))
    want = [min((sum((a - b) ** 2 for a, b in zip(q, p)), n) for n, p in enumerate(points)) for q in asked]
    assert list(zip(d.tolist(), who.tolist())) == want


def test_tree_prunes():
    r = np.random.default_rng(1)
    points = np.concatenate([r.integers(0, 100, (200, 2)) + c for c in (0, 100_000, 200_000)]).astype(np.int64)
    met = []
    real = centroids.squared
    try:
        centroids.squared = lambda x, p: (met.append(len(x)), real(x, p))[1]
        tree = centroids.VantageTree.build(points)
        met.clear()
        tree.nearest(points[:50])
    finally:
        centroids.squared = real
    assert sum(met) < 50 * 600 / 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_query_equals_its_sql(spark):
    got = rows_of(QUERIES["op12_centroids"](spark, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(ORACLE["op12_centroids"]).fetchall(), key=str) and len(got) > 0
