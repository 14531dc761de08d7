"""Vectorised words of whole texts: boundaries and 64-bit hashes from Arrow string buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Python string objects are never made; a batch
is cut into chunks of whole documents of about ``chunk_bytes`` so that the working arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pitchlens.llm._common import MASK64, mix64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes outside ASCII letters, digits and multi-byte characters: separators of plain words.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Odd bases of the polynomial hashes (modulo 2**64).
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            k = 1
            while k < size:
                p[k:2 * k] = p[:k] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
            out.append(p)
        have = _POWERS[base] = (out[0], out[1])
    return have


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """s with s[i] = sum of values[j] * base**j over j < i (uint64, wraps)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, max(1, len(values)))[0][:len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Position-free hash of values[lo:hi]: equal ranges of values give equal hashes."""
    inv = powers(base, max(1, len(prefix)))[1]
    return mix64((prefix[hi] - prefix[lo]) * inv[lo])


@dataclass
class Words:
    """Words of the documents first .. first + n_docs - 1 of a batch."""

    first: int
    n_docs: int
    buf: np.ndarray     # bytes of the chunk (lower-cased if asked for)
    start: np.ndarray   # byte range of each word in buf
    end: np.ndarray
    bounds: np.ndarray  # words bounds[d] .. bounds[d + 1] - 1 are those of document d

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes and length."""
        pre = prefix_hash(self.buf.astype(np.uint64) + np.uint64(1), BASE)
        h = range_hash(pre, self.start, self.end, BASE)
        return mix64(h + (self.end - self.start).astype(np.uint64) * np.uint64(BASE))

    def stems(self, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of every word and of the first n bytes of words longer than n, for each n."""
        pre, doc = prefix_hash(self.buf.astype(np.uint64) + np.uint64(1), BASE), self.doc
        size = self.end - self.start
        h, d = [], []
        for n in (0, *sizes):
            w = slice(None) if n == 0 else np.flatnonzero(size > n)
            to = self.end if n == 0 else self.start[w] + n
            h.append(mix64(range_hash(pre, self.start[w], to, BASE) + np.uint64((n + 1) * BASE & MASK64)))
            d.append(doc[w])
        return np.concatenate(h), np.concatenate(d)


def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; NULL counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), off


def chunks(col, lower: bool = False, chunk_bytes: int = 1 << 20, gap: np.ndarray = SPACE) -> Iterator[Words]:
    """The words of a string column, chunk by chunk (whole documents). gap: which bytes separate words."""
    data, off = string_buffers(col)
    n, d = len(off) - 1, 0
    while d < n:
        e = max(d + 1, int(np.searchsorted(off, off[d] + chunk_bytes, "right")) - 1)
        e = min(e, n)
        buf = data[off[d]:off[e]]
        yield split(LOWER[buf] if lower else buf, off[d:e + 1] - off[d], d, gap)
        d = e


def split(buf: np.ndarray, off: np.ndarray, first: int = 0, gap: np.ndarray = SPACE) -> Words:
    n = len(off) - 1
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return Words(first, n, buf, z, z, np.zeros(n + 1, np.int64))
    solid = ~gap[buf]
    full = off[:-1][np.diff(off) > 0]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[full] = solid[full]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = off[1:][np.diff(off) > 0] - 1
    ends[last] = solid[last]
    start = np.flatnonzero(begins)
    return Words(first, n, buf, start, np.flatnonzero(ends) + 1, np.searchsorted(start, off))
