import math

import numpy as np
from hypothesis import given, settings, strategies as st

from pitchlens.operators import quantiles as Q


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=True), min_size=1, max_size=30))
def test_bits_sort_like_the_values(v):
    x = np.array(v)
    bits = Q.sortable_bits(x)
    order = np.argsort(bits, kind="stable")
    want = np.sort(x)
    assert np.array_equal(x[order] + 0.0, want + 0.0, equal_nan=True)
    assert all(math.isnan(a) and math.isnan(b) or a == b for a, b in zip((Q.from_bits(int(k)) for k in bits), v))


def test_medians_equal_numpy(spark):
    r = np.random.default_rng(0)
    n = 501
    cols = {"a": r.normal(size=n), "b": np.round(r.normal(size=n)), "c": np.where(r.random(n) < 0.5, 0.0, -0.0), "d": r.normal(size=n) * 1e300,
            "e": np.repeat(5.0, n)}
    rows = [[None if i % 7 == 0 and c != "e" else float(cols[c][i]) for c in cols] + [None, float(i % 2) if i < 2 else None] for i in range(n)]
    df = spark.createDataFrame([tuple(x) for x in rows], ", ".join(f"{c} double" for c in [*cols, "none", "two"])).repartition(6)
    got = Q.exact_medians(df, [*cols, "none", "two"])
    for k, c in enumerate(cols):
        kept = [x[k] for x in rows if x[k] is not None]
        assert got[c] == np.median(kept)
    assert got["none"] is None and got["two"] == 0.5


def test_ranks_of_integers_and_no_rows(spark):
    df = spark.range(1000).selectExpr("id * id AS v")
    assert Q.order_statistics(df, ["v"], lambda n: [0, 10, n - 1]) == [[0.0, 100.0, 999.0 ** 2]]
    assert Q.exact_medians(df.where("v < 0"), ["v"]) == {"v": None}
