"""Substring dedup: passages of 50 words or more that also start in a document with a smaller id.

A window is ``span`` consecutive words. Its anchor is the sub-window of ``gram`` words with the smallest
hash (leftmost of equals), so equal windows have equal anchors and consecutive windows mostly share
one: a run of them is a segment, the unit of everything that is shuffled.

1. Count-min prefilter. Every input partition sketches its anchors (``ROWS`` counter rows); sketches are
   added block by block into one bit per counter: counted twice or more. Counters only overestimate, so
   a window whose words occur in two documents always passes.
2. Exact pass over the segments that pass. Anchors met in two documents are kept. Where all segments
   of an anchor are one sequence of words, its smallest document decides for all its windows. For
   the other anchors segments of equal words are grouped, then their windows by 128-bit identity (anchor
   hash, window hash) to the smallest document id. Only those carry window hashes, found again in a
   pass over the texts with a bit table of these anchors: reading twice is cheaper than keeping them.
3. Every segment learns which of its windows start in a smaller document; the words they cover go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitchlens.llm._common import cut, mix64, tree_merge
from pitchlens.llm._text import Words, chunks, prefix_hash, range_hash, string_buffers

SPAN, GRAM = 50, 25
ROWS = 2
BLOCK_BITS = 16
#: Bits of one sketch row. Four per anchor or more are aimed at; the upper bound keeps what is broadcast under
#: ROWS * 2**MAX_BITS / 8 bytes = 64 MB. Beyond it the prefilter lets more windows through, never fewer.
MIN_BITS, MAX_BITS = 18, 28
_B1, _B2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_ROW_KEYS = [0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of x[i:i + width] for every full window i."""
    n = len(x) - width + 1
    at = np.arange(len(x))
    have = 1
    while have < width:  # windows of `have` -> windows of up to twice that
        step = min(have, width - have)
        a, b = at[:len(at) - step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        have += step
    return at[:n]


class Segments:
    """Segments of the documents of a chunk: runs of windows with one anchor."""

    def __init__(self, w: Words, span: int, gram: int):
        h = w.hashes()
        n = len(h)
        z = np.zeros(0, np.int64)
        self.words, self.first, self.last, self.anchor = h, z, z, np.zeros(0, np.uint64)
        if n < span:
            return
        self.pre = prefix_hash(h, _B1)
        g = np.arange(n - gram + 1)
        grams = range_hash(self.pre, g, g + gram, _B1)
        low = sliding_argmin(grams, span - gram + 1)
        doc = w.doc
        inside = doc[:n - span + 1] == doc[span - 1:]
        start = np.flatnonzero(inside)
        if not len(start):
            return
        a = low[start]
        new = np.append(True, (np.diff(a) != 0) | (np.diff(start) != 1))
        self.first = start[new]
        self.last = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
        self.anchor = mix64(grams[a[new]])
        self.doc, self.span = doc, span


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix64(anchor ^ np.uint64(_ROW_KEYS[row])) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(bits: int, span: int, gram: int):
    """Counters of one partition, saturated at two, as (row, block, places counted once, places counted more)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows() -> Iterator[pa.RecordBatch]:
            anchors = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            for row in range(ROWS):
                cell, count = np.unique(cells(anchors, row, bits), return_counts=True)
                block = cell >> BLOCK_BITS
                cuts = np.searchsorted(block, kinds := np.unique(block), "left")
                low = (cell & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
                parts = [(low[a:b], count[a:b] > 1) for a, b in zip(cuts, np.append(cuts[1:], len(cell)))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(kinds), row, np.int32)), pa.array(kinds.astype(np.int32)),
                    pa.array([p[~m].tobytes() for p, m in parts], pa.binary()),
                    pa.array([p[m].tobytes() for p, m in parts], pa.binary())], ["row", "block", "once", "more"])

        n = 0
        for b in batches:
            for w in chunks(b.column(0)):
                held.append(Segments(w, span, gram).anchor)
                n += len(held[-1])
                if n > 2_000_000:
                    yield from rows()
                    n = 0
        yield from rows()

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counters of a block over several partitions, saturated at two."""
    count = np.zeros(1 << BLOCK_BITS, np.uint8)
    for once, more in zip(pdf["once"], pdf["more"]):
        one = np.frombuffer(once, np.uint16)
        count[one] = np.minimum(count[one] + 1, 2)  # places are distinct within a partition
        count[np.frombuffer(more, np.uint16)] = 2
    return pdf.iloc[:1].assign(once=[np.flatnonzero(count == 1).astype(np.uint16).tobytes()],
                               more=[np.flatnonzero(count == 2).astype(np.uint16).tobytes()])


def _as_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit per counter of a block: counted twice or more."""
    for b in batches:
        out = []
        for more in b.column(3).to_pylist():
            flag = np.zeros(1 << BLOCK_BITS, np.uint8)
            flag[np.frombuffer(more, np.uint16)] = 1
            out.append(np.packbits(flag).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["row", "block", "bits"])


SKETCH = "row int, block int, once binary, more binary"


def prefilter(texts: DataFrame, bits: int, span: int, gram: int) -> np.ndarray:
    """(ROWS, 2**bits / 8) bytes: which counters of the merged sketch were counted twice or more."""
    return bit_table(texts.mapInArrow(_sketch(bits, span, gram), SKETCH), bits)


def bit_table(parts: DataFrame, bits: int) -> np.ndarray:
    merged = tree_merge(parts, ["row", "block"], _merged, SKETCH).mapInArrow(_as_bits, "row int, block int, bits binary")
    out = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for r in merged.toLocalIterator():
        out[r["row"], r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _cells(bits: int):
    """Counters of a list of anchors, in the form of a sketch in which every counter was met twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchors = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for row in range(ROWS):
                cell = np.unique(cells(anchors, row, bits))
                kinds, first = np.unique(cell >> BLOCK_BITS, return_index=True)
                low = np.split((cell & ((1 << BLOCK_BITS) - 1)).astype(np.uint16), first[1:])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(kinds), row, np.int32)), pa.array(kinds.astype(np.int32)),
                    pa.array([b""] * len(kinds), pa.binary()),
                    pa.array([x.tobytes() for x in low], pa.binary())], ["row", "block", "once", "more"])

    return run


def _segments(shared, bits: int, span: int, gram: int, windows: bool):
    """Segments whose anchors the bit table holds: anchor, digest d of the words, document, and either the
    text's key, the first window and the number of windows, or the hashes of the windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for w in chunks(b.column(2)):
                s = Segments(w, span, gram)
                may = np.ones(len(s.anchor), bool)
                for row in range(ROWS):
                    c = cells(s.anchor, row, bits)
                    may &= (table[row, c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                if not may.any():
                    continue
                first, last, anchor = s.first[may], s.last[may], s.anchor[may]
                alt = prefix_hash(s.words, _B2)
                digest = range_hash(alt, first, last + span, _B2)
                size = last - first + 1
                doc = s.doc[first]
                cols = [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(ids[w.first + doc].astype(np.int64))]
                if windows:
                    ends = np.cumsum(size)
                    win = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
                    wh = range_hash(alt, win, win + span, _B2).view(np.int64)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(wh)))
                    yield pa.RecordBatch.from_arrays(cols, ["anchor", "d", "doc_id", "wh"])
                else:
                    cols += [pa.array(keys[w.first + doc]), pa.array((first - w.bounds[doc]).astype(np.int32)),
                             pa.array(size.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["anchor", "d", "doc_id", "key", "first", "n"])

    return run


def _kept(span: int):
    """Whole text and its removed windows -> counts and the kept words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = string_buffers(b.column(1))
            runs = b.column(2).to_pylist()
            n_words, n_removed, sha, texts = [], [], [], []
            for r in range(b.num_rows):
                raw = data[off[r]:off[r + 1]]
                words = raw.tobytes().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for m in runs[r] or ():
                    mask, i = m["mask"], m["first"]
                    while mask:
                        if mask & 1:
                            gone[i] += 1
                            gone[i + span] -= 1
                        mask >>= 1
                        i += 1
                stay = np.cumsum(gone)[:-1] == 0
                text = b" ".join(words if stay.all() else [words[k] for k in np.flatnonzero(stay)])
                n_words.append(len(words))
                n_removed.append(int((~stay).sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(sha), pa.array(texts, pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def removed(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the row's text), runs: array of (first, mask): windows first + k with bit k set are removed."""
    if not (1 <= gram <= span and span - gram <= 60):
        raise ValueError("gram must be at most span, and span - gram at most 60")
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    anchors = size // 6 * 2 // (span - gram + 2) + 1
    bits = min(MAX_BITS, max(MIN_BITS, int(4 * anchors - 1).bit_length()))
    shared = spark.sparkContext.broadcast(prefilter(rows.select("text"), bits, span, gram))
    found = rows.mapInArrow(_segments(shared, bits, span, gram, False), "anchor long, d long, doc_id long, key long, first int, n int")
    both = cut(found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("d").alias("d"),
                                           F.max("d").alias("d_max"))
               .where("lo < hi").select("anchor", "lo", "d", (F.col("d") == F.col("d_max")).alias("one")))
    several = spark.sparkContext.broadcast(bit_table(both.where("not one").select("anchor").mapInArrow(_cells(bits), SKETCH), bits))
    distinct = cut(rows.mapInArrow(_segments(several, bits, span, gram, True), "anchor long, d long, doc_id long, wh array<long>")
                   .groupBy("anchor", "d").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("wh").alias("wh")))
    windows = distinct.select("anchor", "d", "lo", "hi", F.posexplode("wh").alias("k", "w"))
    # The tables of verdicts are cut so that the joins with them shuffle both sides, which lets hot keys be split.
    least = cut(windows.groupBy("anchor", "w").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
                .where("least < most").drop("most"))
    marked = (windows.drop("lo", "hi").join(least, ["anchor", "w"]).groupBy("anchor", "d")
              .agg(F.collect_list(F.struct("k", "least")).alias("at")))
    # An anchor of one sequence may pass the bit table of the others too; its verdict is taken once.
    verdict = cut(both.where("one").select("anchor", "d", "lo").join(marked, ["anchor", "d"], "full"))
    mask = F.expr("""if(lo is not null, if(lo < doc_id, shiftleft(1L, n) - 1, 0L),
        aggregate(at, 0L, (m, x) -> if(x.least < doc_id, m | shiftleft(1L, x.k), m)))""")
    hit = (found.join(verdict, ["anchor", "d"]).select("doc_id", "key", "first", mask.alias("mask")).where("mask <> 0"))
    return hit.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "mask")).alias("runs"))


def dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text (words joined by one space).

    A word goes if a window of ``span`` words of its document covers it whose words also start in a
    document with a smaller id. NULL texts have no words; rows with a NULL id keep their words and
    take none from others; rows that share an id are one document to each other.
    """
    gone = cut(removed(docs, span, gram, id_col, text_col)).select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "runs")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(gone, (F.col("doc_id").cast("long") == F.col("i")) & (F.xxhash64("text") == F.col("k")), "left")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.select("doc_id", "text", "runs").mapInArrow(
        _kept(span), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
