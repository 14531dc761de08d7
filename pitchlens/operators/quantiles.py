"""Exact order statistics of many columns by radix selection.

A double's bits, with the sign turned so that they sort like the values, are read 16 at a time from the top. One
aggregate counts the next 16 bits of all columns, for values that share a wanted rank's bits so far; the
counts say which bits the ranks have, and the next pass looks at those values alone. Four passes settle all
columns, and what a task or the driver holds is columns x buckets at most, never a column's values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

DIGIT = 16
_TOP = np.uint64(1 << 63)


def sortable_bits(x: np.ndarray) -> np.ndarray:
    """uint64 in the order of the doubles; -0.0 is 0.0, NaN is above all."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >= _TOP, ~bits, bits | _TOP)


def from_bits(bits: int) -> float:
    raw = bits & ~(1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _digits(done: int, prefixes: list[set[int]]):
    """Per column and prefix of ``done`` bits: how often each value of the next bits occurs in a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for c, wanted in enumerate(prefixes):
                col = b.column(c).drop_null().to_numpy(zero_copy_only=False)
                bits = sortable_bits(col.astype(np.float64))
                for p in wanted:
                    mine = bits if done == 0 else bits[bits >> np.uint64(64 - done) == np.uint64(p)]
                    digit = (mine >> np.uint64(64 - done - DIGIT)) & np.uint64((1 << DIGIT) - 1)
                    count = np.bincount(digit.astype(np.int64), minlength=1 << DIGIT)
                    held[c, p] = held.get((c, p), 0) + count
        for (c, p), count in held.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), c, np.int32)), pa.array([str(p)] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(count[at])],
                ["col", "prefix", "digit", "n"])

    return run


def order_statistics(df: DataFrame, cols: Sequence[str], ranks) -> list[list[float | None]]:
    """Per column the values at the ranks (from 0) that ``ranks(number of its values)`` names; NULLs do not count."""
    cols = list(cols)
    table = cut(df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)]))
    prefixes, todo = [{0} for _ in cols], None
    for done in range(0, 64, DIGIT):
        counts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        seen = (table.mapInArrow(_digits(done, prefixes), "col int, prefix string, digit int, n long")
                .groupBy("col", "prefix", "digit").agg(F.sum("n").alias("n")))
        for r in seen.toPandas().sort_values("digit").itertuples():
            counts.setdefault((r.col, int(r.prefix)), []).append((r.digit, r.n))
        if todo is None:
            sizes = [sum(n for _, n in counts.get((c, 0), ())) for c in range(len(cols))]
            todo = [[(0, k) for k in ranks(n)] if n else [] for n in sizes]
        for c, wanted in enumerate(todo):
            for i, (prefix, k) in enumerate(wanted):
                for digit, n in counts[c, prefix]:
                    if k < n:
                        wanted[i] = prefix << DIGIT | digit, k
                        break
                    k -= n
            prefixes[c] = {p for p, _ in wanted}
    return [[from_bits(p) for p, _ in wanted] if wanted else [] for wanted in todo]


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact interpolating median of each column (None without values); NULLs do not count."""
    found = order_statistics(df, cols, lambda n: [(n - 1) // 2, n // 2])
    return {c: 0.5 * v[0] + 0.5 * v[1] if v else None for c, v in zip(cols, found)}
