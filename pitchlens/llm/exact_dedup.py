"""Exact dedup with a cuckoo-filter index.

Rows are reduced twice through the same index: first inside each input partition (so that a text
held by a third of all rows leaves one row per partition), then, after one shuffle of the distinct
texts by digest bucket, inside each bucket. A filter hit is only a hint; the text stored with the
slot decides. The larger doc_id wins: the live digest of the loser is deleted and the winner's
inserted. A full filter doubles and is filled again from the stored keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitchlens.llm._common import cut, fresh, shuffle_partitions

SLOTS = 4          # slots per filter bucket
MAX_KICKS = 200    # relocations before the filter doubles
FLUSH_BYTES = 32 << 20  # texts an input partition holds before it hands its distinct ones on

REPS = "bucket long, digest string, text string, keep_id long, n long, n_keep long"
_REPS = pa.schema([("bucket", pa.int64()), ("digest", pa.string()), ("text", pa.string()), ("keep_id", pa.int64()),
                   ("n", pa.int64()), ("n_keep", pa.int64())])


class Entry:
    """A live text: content for verification, id that stays, rows, rows that carry that id."""

    __slots__ = ("key", "text", "keep_id", "n", "n_keep")

    def __init__(self, key: str, text: str, keep_id, n: int, n_keep: int):
        self.key, self.text, self.keep_id, self.n, self.n_keep = key, text, keep_id, n, n_keep


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints whose slots point at the stored entries.

    Keys are lowercase hex digests (32 digits or more). Different texts under one key are allowed:
    the stored content tells them apart.
    """

    def __init__(self, buckets: int = 64):
        self.size, self.resizes = 0, 0
        self._alloc(buckets)

    def _alloc(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.entries: list[Entry | None] = [None] * (buckets * SLOTS)

    def _places(self, key: str) -> tuple[int, int, int]:
        fp = int(key[:4], 16) or 1
        b = int(key[4:20], 16) & self.mask
        return fp, b, self._other(b, fp)

    def _other(self, b: int, fp: int) -> int:
        return b ^ ((fp * 0x5BD1E995) & self.mask)

    def _slot(self, key: str, text: str) -> int:
        fp, a, b = self._places(key)
        for bucket in (a, b) if a != b else (a,):
            base = bucket * SLOTS
            for s in range(base, base + SLOTS):
                if self.prints[s] == fp:
                    e = self.entries[s]
                    if e.key == key and e.text == text:  # the filter only hints, the content decides
                        return s
        return -1

    def find(self, key: str, text: str) -> Entry | None:
        s = self._slot(key, text)
        return None if s < 0 else self.entries[s]

    def insert(self, entry: Entry) -> None:
        self.size += 1
        while entry is not None:
            entry = self._place(entry)
            if entry is not None:
                self._grow()

    def _place(self, entry: Entry) -> Entry | None:
        """Store an entry; what is left over after MAX_KICKS relocations."""
        fp, a, b = self._places(entry.key)
        for bucket in (a, b):
            base = bucket * SLOTS
            for s in range(base, base + SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.entries[s] = fp, entry
                    return None
        bucket = b
        for kick in range(MAX_KICKS):
            s = bucket * SLOTS + (kick + fp) % SLOTS
            fp, self.prints[s] = self.prints[s], fp
            entry, self.entries[s] = self.entries[s], entry
            bucket = self._other(bucket, fp)
            base = bucket * SLOTS
            for t in range(base, base + SLOTS):
                if not self.prints[t]:
                    self.prints[t], self.entries[t] = fp, entry
                    return None
        return entry

    def _grow(self) -> None:
        """Double the filter, again if need be, and fill it from the stored keys."""
        live = [e for e in self.entries if e is not None]
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._alloc(buckets)
            if all(self._place(e) is None for e in live):
                return

    def delete(self, key: str, text: str) -> Entry | None:
        s = self._slot(key, text)
        if s < 0:
            return None
        e, self.entries[s], self.prints[s] = self.entries[s], None, 0
        self.size -= 1
        return e

    def add(self, key: str, text: str, keep_id, n: int = 1, n_keep: int = 1) -> bool:
        """Count rows of a text; True if the text is new. The largest id replaces the live digest."""
        e = self.find(key, text)
        if e is None:
            self.insert(Entry(key, text, keep_id, n, n_keep))
            return True
        n_all = e.n + n
        if keep_id == e.keep_id:
            e.n, e.n_keep = n_all, e.n_keep + n_keep
        elif keep_id is not None and (e.keep_id is None or keep_id > e.keep_id):
            self.delete(key, text)
            self.insert(Entry(key, text, keep_id, n_all, n_keep))
        else:
            e.n = n_all
        return False

    def live(self) -> Iterator[Entry]:
        return (e for e in self.entries if e is not None)


def _rows(bucket, index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    live = list(index.live())
    for i in range(0, len(live), 2000):
        part = live[i:i + 2000]
        yield pa.RecordBatch.from_arrays([
            pa.array([bucket(e.key) for e in part], pa.int64()), pa.array([e.key for e in part], pa.string()),
            pa.array([e.text for e in part], pa.string()), pa.array([e.keep_id for e in part], pa.int64()),
            pa.array([e.n for e in part], pa.int64()), pa.array([e.n_keep for e in part], pa.int64())], schema=_REPS)


def _local(n_buckets: int):
    bucket = lambda key: int(key[:15], 16) % n_buckets

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = CuckooIndex(), 0
        for b in batches:
            for i, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if index.add(d, t, i):
                    held += len(t)
                    if held > FLUSH_BYTES:
                        yield from _rows(bucket, index)
                        index, held = CuckooIndex(), 0
        yield from _rows(bucket, index)

    return run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: one bucket's index is held at a time."""
    index, at = CuckooIndex(), None
    names = [f.name for f in _REPS if f.name not in ("text", "bucket")]

    def done(index):
        for r in _rows(lambda key: 0, index):
            yield r.select(names)

    for b in batches:
        cols = [b.column(k).to_pylist() for k in range(6)]
        for bucket, d, t, i, n, k in zip(*cols):
            if bucket != at:
                yield from done(index)
                index, at = CuckooIndex(), bucket
            index.add(d, t, i, n, k)
    yield from done(index)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: digest, keep_id, n (rows), n_keep (rows that carry keep_id)."""
    n = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.sha2(text.cast("binary"), 256).alias("d"), text.alias("t"))
    reps = rows.mapInArrow(_local(64 * n), REPS)
    merged = reps.repartition(n, "bucket").sortWithinPartitions("bucket")
    return merged.mapInArrow(_merge, "digest string, keep_id long, n long, n_keep long")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    NULL text counts as empty. Of equal texts the row with the largest id stays. NULL ids lose to any
    id; a text held by NULL ids alone has keep_id NULL and keeps those rows. Rows that repeat both id
    and text cannot be told apart and get the same decision (``keep_rows`` leaves one of them).
    """
    g = groups(docs, id_col, text_col).select(F.col("digest").alias("text_sha256"), "keep_id", F.col("n").alias("group_size"))
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    return rows.join(g, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs; of rows repeated as a whole (id and text) one stays."""
    d, k, m = fresh(docs, "digest", "stays", "repeats")
    g = cut(groups(docs, id_col, text_col)).select(F.col("digest").alias(d), F.col("keep_id").alias(k), F.col("n_keep").alias(m))
    rows = docs.withColumn(d, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).join(g, d)
    rows = rows.where(F.col(id_col).cast("long").eqNullSafe(F.col(k)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.where(F.col(m) == 1).select(*names)
    more = rows.where(F.col(m) > 1).groupBy(d).agg(F.first(F.struct(*names)).alias(k)).select(f"{k}.*")
    return once.unionByName(more)
