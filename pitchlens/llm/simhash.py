"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are dealt to tiles by the population counts of their two halves. The Hamming
distance of two fingerprints is at least the sum of the differences of those counts, so only tile
pairs within the radius meet; a tile with many fingerprints is split into chunks, and every chunk
pair is one task's block: numpy exclusive-or and bit counts over sub-tiles of quarter counts, which are
skipped by the same rule. A block returns a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pitchlens.llm._common import cut, fresh, shuffle_partitions
from pitchlens.llm.components import components

SEED = 42


def shingles(text: bytes, size: int) -> list[bytes]:
    """Word shingles of a lower-cased text; fewer words than size: the whole sequence; none: []."""
    words = text.split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is set if it is in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k:k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows, np.uint64)
            for r, t in enumerate(b.column(1)):
                sh = shingles((t.as_py() or b"").lower(), size)  # bytes.lower() changes A-Z only
                out[r] = fingerprint(np.fromiter(map(xxhash.xxh64_intdigest, sh, repeat(SEED)), np.uint64, len(sh)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row; NULL text counts as empty."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
            .mapInArrow(_fingerprints(size), "doc_id long, fp long"))


def _bit_rows(fp: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of equal parts of each fingerprint."""
    return np.bitwise_count(fp.astype("<u8").view(f"<u{8 // parts}").reshape(-1, parts)).astype(np.int16)


def linked(x: np.ndarray, y: np.ndarray, radius: int, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with at most ``radius`` differing bits, in blocks of bounded size.

    Both sides are cut into sub-tiles of equal quarter counts; sub-tile pairs beyond the radius are skipped.
    """
    def tiles(v):
        q = _bit_rows(v, 4)
        order = np.lexsort(q.T)
        kinds, first, size = np.unique(q[order], axis=0, return_index=True, return_counts=True)
        o = np.argsort(first)
        return kinds[o], first[o], size[o], order

    if len(x) * len(y) <= block:
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
        if len(i):
            yield i, j
        return
    kx, fx, sx, ox = tiles(x)
    ky, fy, sy, oy = tiles(y)
    for a in range(len(kx)):
        near = np.flatnonzero(np.abs(ky - kx[a]).sum(axis=1) <= radius)
        if not len(near):
            continue
        ia = ox[fx[a]:fx[a] + sx[a]]
        jb = np.concatenate([oy[fy[b]:fy[b] + sy[b]] for b in near])
        step = max(1, block // max(1, min(len(jb), block)))
        for p in range(0, len(ia), step):
            for q in range(0, len(jb), block):
                i, j = np.nonzero(np.bitwise_count(x[ia[p:p + step], None] ^ y[None, jb[q:q + block]]) <= radius)
                if len(i):
                    yield ia[p + i], jb[q + j]


def merge_links(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of linked nodes in place: root[n] ends as the smallest node of n's part."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _block(radius: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        fp = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
        left = rows["side"].to_numpy() == 0
        x = fp[left]
        y = fp[~left] if key[0].as_py() != key[1].as_py() else x
        nodes = np.concatenate([x, y]) if y is not x else x
        shift = len(x) if y is not x else 0
        root = np.arange(len(nodes))
        for i, j in linked(x, y, radius):
            merge_links(root, i, j + shift)
        child = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"u": nodes[child].view(np.int64), "v": nodes[root[child]].view(np.int64)})

    return run


def links(prints: DataFrame, radius: int = 3, tile_rows: int = 1 << 14) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all links within the radius."""
    spark = prints.sparkSession
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF)))
    tiled = prints.select("fp", (half(32) * 64 + half(0)).cast("int").alias("tile"))
    # At most 33 * 33 tiles exist whatever the input is, so their counts and neighbours are bounded.
    counts = {r["tile"]: r["count"] for r in tiled.groupBy("tile").count().collect()}
    chunks = {t: -(-c // tile_rows) for t, c in counts.items()}
    reach = range(-radius, radius + 1)
    near = [(t, chunks[t], u, chunks[u]) for t in chunks for dh in reach for dl in reach
            if abs(dh) + abs(dl) <= radius and (u := t + 64 * dh + dl) in chunks
            and 0 <= t % 64 + dl <= 32]
    if not near:
        return spark.createDataFrame([], "u long, v long")
    grid = spark.createDataFrame(near, "tile int, own int, other_tile int, others int")
    mine = F.col("tile").cast("long") * (1 << 40) + F.pmod(F.xxhash64("fp"), F.col("own"))
    met = (tiled.join(F.broadcast(grid), "tile")
           .select("fp", mine.alias("me"), F.col("other_tile").cast("long").alias("other_tile"),
                   F.explode(F.sequence(F.lit(0).cast("long"), F.col("others").cast("long") - 1)).alias("chunk"))
           .withColumn("it", F.col("other_tile") * (1 << 40) + F.col("chunk")))
    blocks = met.select(F.least("me", "it").alias("a"), F.greatest("me", "it").alias("b"),
                        (F.col("me") > F.col("it")).cast("int").alias("side"), "fp")
    return blocks.groupBy("a", "b").applyInArrow(_block(radius), "u long, v long")


def classes(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text",
            tile_rows: int = 1 << 14) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id.

    component_id is the smallest id reachable over links of at most ``radius`` differing bits, the row
    itself included. Texts without words have fingerprint zero and link like any other. NULL ids keep
    their links but never name a component; a component of NULL ids alone has a NULL component_id.
    """
    rows = cut(fingerprints(docs, size, id_col, text_col))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints, radius, tile_rows))
    placed = cut(prints.join(roots, prints["fp"] == roots["node"], "left")
                 .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    final = cut(placed.join(named, "root").select("fp", "component_id"))
    return rows.join(final, "fp").select("doc_id", "fp", "component_id")


def keep_rows(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group (the smallest id), with the columns of docs; of rows that share that id one stays.

    Rows of a group of NULL ids alone all stay: no id tells them apart.
    """
    c, m, k = fresh(docs, "component", "members", "row")
    found = cut(classes(docs, size, radius, id_col, text_col))
    keep = (found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias(m)).withColumnRenamed("doc_id", c))
    lone = found.where("component_id is null").limit(1)
    names = [F.col(f"`{x}`") for x in docs.columns]
    rows = docs.join(keep, docs[id_col].cast("long") == F.col(c))
    once = rows.where(F.col(m) == 1).select(*names)
    more = rows.where(F.col(m) > 1).groupBy(c).agg(F.first(F.struct(*names)).alias(k)).select(f"{k}.*")
    out = once.unionByName(more)
    return out if lone.isEmpty() else out.unionByName(docs.where(F.col(id_col).isNull()))
