"""SentencePiece encoding with seeded merge dropout, and lossless decoding.

Merges follow the agenda of merge-type models: the adjacent pair with the best score goes first, ties
to the left. With dropout, a candidate (place, split, piece) is skipped when a hash of it, keyed by the
seed, the document's id and the chunk's place in it, falls under the rate: every occurrence of a word draws
its own, one seed always gives one segmentation and another seed another. Pieces never hold white space
after a letter, so text falls into chunks (spaces + word) that are merged on their own. Equal chunks are
merged once per batch without dropout; occurrences that skip none of the candidates met on that way share
the result, the others are merged one by one, many at a time in numpy.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitchlens.llm._common import MASK64, mix64
from pitchlens.llm._text import prefix_hash, range_hash

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
NEVER = np.int32(2**31 - 1)
WIDE = 48            # chunks of more characters use the heap agenda
TEXT_CHARS = 2 << 20  # characters per working set
_GOLD = 0x9E3779B97F4A7C15


def _mix(x: int) -> int:
    """splitmix64 finaliser of one integer."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK64
    return x ^ (x >> 31)


class Pieces:
    """A merge-type piece vocabulary: at most as many entries as the model file has (a fixed public file)."""

    def __init__(self, names: list[str], scores: list[float], byte_ids: list[int], ordinary: list[bool]):
        self.n = len(names)
        self.byte_ids = np.array(byte_ids, np.int32)
        place = {p: i for i, p in enumerate(names) if ordinary[i]}
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in place.values()}, reverse=True))}
        self.rank = np.array([order.get(scores[i], 0) if ordinary[i] else NEVER for i in range(self.n)], np.int32)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in place.items():
            if len(p) == 1 and p != " ":
                self.char_id[ord(" " if p == "▁" else p)] = i
        self.char_id[0x2581] = -1  # a literal U+2581 goes to bytes, or it would decode as a space
        pairs = {}
        for p, i in place.items():
            for k in range(1, len(p)):
                a, b = place.get(p[:k]), place.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = i
        self.pairs = pairs
        self._hash(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        if any("▁" in p.lstrip("▁") for p in place):
            raise ValueError("pieces that span words are not supported")
        joined = {c for p in place if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in joined)
        self.pattern = f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +"
        raw = [bytes([byte_ids.index(i)]) if i in set(byte_ids) else names[i].replace("▁", " ").encode() if ordinary[i] else b""
               for i in range(self.n)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_off = np.cumsum(self.raw_len) - self.raw_len
        lead = (self.raw & 0xC0) != 0x80
        self.chars = np.add.reduceat(np.append(lead, False).astype(np.int64), np.minimum(self.raw_off, len(lead)))

    def _hash(self, keys: np.ndarray, piece: np.ndarray) -> None:
        """Table of the pairs with open places, at least four slots a pair."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slot_key, self.slot_piece = np.full((1 << self.bits) + 1, -1, np.int64), np.zeros((1 << self.bits) + 1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.slot_key[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.slot_key[slot[won]], self.slot_piece[slot[won]] = keys[won], piece[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, piece, slot = keys[rest], piece[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.view(np.uint64) * np.uint64(_GOLD) >> np.uint64(64 - self.bits)).view(np.int64)

    def merged(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the pairs that merge, their pieces)."""
        slot = self._slot(pair)
        found = self.slot_key[slot]
        hit = found == pair
        more = np.flatnonzero(~hit & (found >= 0))
        while len(more):  # another pair holds the slot
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[slot[more]]
            hit[more] = found == pair[more]
            more = more[(found >= 0) & (found != pair[more])]
        at = np.flatnonzero(hit)
        return at, self.slot_piece[slot[at]]

    def joined(self, sym: np.ndarray) -> np.ndarray:
        """Piece of each symbol with the one after it (-1: none, also for the last), of flat or two-dimensional symbols."""
        out = np.full(sym.shape, -1, np.int32)
        a, b = sym[..., :-1].ravel(), sym[..., 1:].ravel()
        some = np.flatnonzero((a >= 0) & (b >= 0))
        at, p = self.merged(a[some].astype(np.int64) * self.n + b[some])
        inner = np.full(len(a), -1, np.int32)
        inner[some[at]] = p
        out[..., :-1] = inner.reshape(sym[..., :-1].shape)
        return out

    @classmethod
    def load(cls, path: str = PIECES) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(names, [sp.get_score(i) for i in range(n)], byte_ids, [not s for s in special])


class Dropout:
    """Skip rule: candidate (key of the occurrence, start, left length, piece) goes when its hash is under the rate."""

    def __init__(self, rate: float, seed: int):
        self.limit = min(MASK64, int(rate * 2**64))
        self.seed = _mix((seed + 1) * _GOLD & MASK64)

    def one(self, key: int, start: int, left: int, piece: int) -> bool:
        x = (key ^ self.seed) + start * _GOLD + left * 0xD6E8FEB86659FD93 + piece * 0xA0761D6478BD642F
        return _mix(x & MASK64) < self.limit

    def many(self, key, start, left, piece) -> np.ndarray:
        u = np.uint64
        x = ((key ^ u(self.seed)) + start.astype(u) * u(_GOLD) + left.astype(u) * u(0xD6E8FEB86659FD93)
             + piece.astype(u) * u(0xA0761D6478BD642F))
        return mix64(x) < u(self.limit)


def merge_one(v: Pieces, ids: list[int], key: int, drop: Dropout | None, met: list | None = None) -> list[int]:
    """Agenda of one chunk: symbols (piece ids, -1 unknown) -> merged symbols, -1 left in place.

    Without ``drop`` nothing is skipped; ``met`` collects the candidates (start, left length, piece).
    """
    n = len(ids)
    sym, size, nxt, prv = list(ids), [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and sym[i] >= 0 and sym[j] >= 0:
            p = v.pairs.get(sym[i] * v.n + sym[j])
            if p is not None and met is not None:
                met.append((i, size[i], p))
            if p is not None and not (drop and drop.one(key, i, size[i], p)):
                heapq.heappush(agenda, (int(v.rank[p]), i, size[i], size[j], p))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, i, a, b, p = heapq.heappop(agenda)
        j = i + a
        if size[i] != a or j >= n or nxt[i] != j or size[j] != b:
            continue
        sym[i], size[i], nxt[i], size[j] = p, a + b, nxt[j], 0
        if nxt[i] < n:
            prv[nxt[i]] = i
        if prv[i] >= 0:
            offer(prv[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = nxt[i]
    return out


def merge_many(v: Pieces, sym: np.ndarray, key: np.ndarray, drop: Dropout | None,
               met: list | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same agenda for many chunks of one width: (n, width) symbols -> symbols and a mask of those left.

    ``met`` collects arrays (row, start, left length, piece) of the candidates. ``first``, if given, has the piece of each
    symbol with the next one (-1: none), as :meth:`Pieces.joined` finds it.
    """
    n, w = sym.shape
    nxt = np.tile(np.arange(1, w + 1, dtype=np.int16), (n, 1))
    prv = np.tile(np.arange(-1, w - 1, dtype=np.int16), (n, 1))
    live = np.ones((n, w), bool)
    rank = np.full((n, w), NEVER, np.int32)
    made = np.zeros((n, w), np.int32)

    def offer(r: np.ndarray, i: np.ndarray) -> None:
        j = nxt[r, i]
        rank[r, i] = NEVER
        ok = j < w
        r, i, j = r[ok], i[ok], j[ok]
        a, b = sym[r, i], sym[r, j]
        ok = (a >= 0) & (b >= 0)
        r, i, j, a, b = r[ok], i[ok], j[ok], a[ok], b[ok]
        at, p = v.merged(a.astype(np.int64) * v.n + b)
        r, i, j = r[at], i[at], j[at]
        if met is not None:
            met.append((r, i, j - i, p))
        if drop and drop.limit:
            stay = ~drop.many(key[r], i, j - i, p)
            r, i, p = r[stay], i[stay], p[stay]
        rank[r, i], made[r, i] = v.rank[p], p

    if w > 1:
        first = v.joined(sym) if first is None else first
        r, i = np.nonzero(first[:, :w - 1] >= 0)
        p = first[r, i]
        if met is not None:
            met.append((r, i, np.ones(len(r), np.int64), p))
        if drop and drop.limit:
            stay = ~drop.many(key[r], i, np.ones(len(r), np.int64), p)
            r, i, p = r[stay], i[stay], p[stay]
        rank[r, i], made[r, i] = v.rank[p], p
    rows = np.arange(n)
    while len(rows):
        i = rank[rows].argmin(axis=1)
        go = rank[rows, i] < NEVER
        rows, i = rows[go], i[go]
        if not len(rows):
            break
        j = nxt[rows, i]
        sym[rows, i], live[rows, j], rank[rows, j] = made[rows, i], False, NEVER
        k = nxt[rows, j]
        nxt[rows, i] = k
        inside = k < w
        prv[rows[inside], k[inside]] = i[inside]
        before = prv[rows, i]
        left = before >= 0
        offer(rows[left], before[left])
        offer(rows, i)
    return sym, live


def _flat(lists: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(lists) if lists else np.zeros(0, np.int64)


def _gather(off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices off[k] .. off[k] + size[k] - 1 for all k, in order."""
    ends = np.cumsum(size)
    return np.repeat(off - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    def __init__(self, v: Pieces, rate: float, seed: int, variants: int = 0):
        """variants: 0, or a number of segmentations that a chunk is limited to."""
        self.v, self.drop, self.variants, self.seed = v, Dropout(rate, seed), variants, seed
        self.find = re.compile(v.pattern).findall

    def batch(self, keys: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). keys: an integer per text that its dropout depends on."""
        parts = [self.find(" " + t) if t else [] for t in texts]
        count = np.array([len(p) for p in parts], np.int64)
        names = dict.fromkeys(chain.from_iterable(parts))
        place = {c: k for k, c in enumerate(names)}
        chunk = np.fromiter(map(place.__getitem__, chain.from_iterable(parts)), np.int64, int(count.sum()))
        del parts
        cps = np.frombuffer("".join(names).encode("utf-32-le"), "<u4")
        width = np.fromiter(map(len, names), np.int64, len(names))
        start = np.cumsum(width) - width
        met: list[tuple[np.ndarray, ...]] = []
        sym = self.v.char_id[cps]
        pairs = self.v.joined(sym)  # of the letters as they stand: looked up once for all occurrences of a chunk
        ids, size = self._merge(cps, sym, pairs, start, width, None, None, met if self.drop.limit else None)
        which = chunk
        if self.drop.limit and len(chunk):
            doc = np.repeat(mix64(np.array([(k ^ self.seed * _GOLD) & MASK64 for k in keys], np.uint64)), count)
            nth = np.arange(len(chunk)) - np.repeat(np.cumsum(count) - count, count)
            key = mix64(doc + nth.astype(np.uint64))
            if self.variants:
                pre = prefix_hash(cps.astype(np.uint64) + np.uint64(1), _GOLD)
                key = mix64(range_hash(pre, start, start + width, _GOLD)[chunk] + key % np.uint64(self.variants))
            skips = np.flatnonzero(self._skips(chunk, key, met, len(names)))
            more, wide = self._merge(cps, sym, pairs, start[chunk[skips]], width[chunk[skips]], key[skips], self.drop)
            which = chunk.copy()
            which[skips] = len(names) + np.arange(len(skips))
            ids, size = np.append(ids, more), np.append(size, wide)
        off = np.cumsum(size) - size
        out = ids[_gather(off[which], size[which])]
        per = np.add.reduceat(np.append(size[which], 0), np.minimum(np.cumsum(count) - count, len(which))) if len(count) else count
        return out, np.where(count > 0, per, 0)

    def _skips(self, chunk: np.ndarray, key: np.ndarray, met: list[tuple[np.ndarray, ...]], n: int) -> np.ndarray:
        """Per occurrence whether it skips a candidate of its chunk's plain agenda."""
        row, start, left, piece = (np.concatenate(x) if met else np.zeros(0, np.int64) for x in (zip(*met) if met else [()] * 4))
        order = np.argsort(row, kind="stable")
        start, left, piece = start[order], left[order], piece[order]
        size = np.bincount(row, minlength=n)
        off = np.cumsum(size) - size
        out = np.zeros(len(chunk), bool)
        todo = np.flatnonzero(size[chunk] > 0)
        nth = 0
        while len(todo):  # one candidate of every occurrence at a time, until one is skipped or none is left
            at = off[chunk[todo]] + nth
            hit = self.drop.many(key[todo], start[at], left[at], piece[at])
            out[todo[hit]] = True
            nth += 1
            todo = todo[~hit]
            todo = todo[size[chunk[todo]] > nth]
        return out

    def _merge(self, cps: np.ndarray, all_sym: np.ndarray, pairs: np.ndarray, o: np.ndarray, s: np.ndarray, key: np.ndarray | None, drop: Dropout | None,
               met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of ids of each) of the chunks cps[o:o + s]."""
        v = self.v
        # Symbols that are left, with their chunk, place and code point (for bytes).
        owner, places, symbols = [], [], []
        chars = v.chars.tolist() if (s > WIDE).any() else []
        for w in np.unique(s):
            rows = np.flatnonzero(s == w)
            if w > WIDE:
                for r in rows:
                    ids = v.char_id[cps[o[r]:o[r] + w]].tolist()
                    seen = None if met is None else []
                    left = merge_one(v, ids, 0 if key is None else int(key[r]), drop, seen)
                    if seen:
                        met.append((np.full(len(seen), r), *np.array(seen, np.int64).T))
                    symbols.append(np.array(left, np.int64))
                    step = [1 if x < 0 else chars[x] for x in left]
                    places.append(np.cumsum(step) - step + o[r])
                    owner.append(np.full(len(left), r))
                continue
            for a in range(0, len(rows), 1 << 15):
                part = rows[a:a + (1 << 15)]
                at = o[part][:, None] + np.arange(w)
                seen = None if met is None else []
                sym, live = merge_many(v, all_sym[at], None if key is None else key[part], drop, seen, pairs[at])
                if seen:
                    met += [(part[r], *rest) for r, *rest in seen]
                r, c = np.nonzero(live)
                symbols.append(sym[r, c].astype(np.int64))
                places.append(at[r, c])
                owner.append(part[r])
        owner, places, symbols = _flat(owner), _flat(places), _flat(symbols)
        order = np.argsort(owner, kind="stable")
        owner, places, symbols = owner[order], places[order], symbols[order]
        # Unknown characters become their UTF-8 bytes.
        odd = symbols < 0
        wide = np.ones(len(symbols), np.int64)
        if odd.any():
            raw = "".join(map(chr, cps[places[odd]])).encode()
            lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            wide[odd] = np.diff(np.append(np.flatnonzero(lead), len(raw)))
        out = np.repeat(symbols, wide)
        if odd.any():
            out[np.repeat(odd, wide)] = v.byte_ids[np.frombuffer(raw, np.uint8)]
        return out.astype(np.int32), np.bincount(owner, weights=wide, minlength=len(s)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids; the space put before the text by encoding goes."""
        return self.decode_all(ids, np.array([0, len(ids)]))[0].tobytes()

    def decode_all(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, offsets) of the texts with ids[off[k]:off[k + 1]]."""
        size = self.v.raw_len[ids]
        raw = self.v.raw[_gather(self.v.raw_off[ids], size)]
        off = np.append(0, np.cumsum(size))[off]
        first = off[:-1][np.diff(off) > 0]
        first = first[raw[first] == 0x20]
        keep = np.ones(len(raw), bool)
        keep[first] = False
        return raw[keep], off - np.searchsorted(first, off, "left")


def _encoded(v: Pieces, rate: float, seed: int, variants: int, keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(v, rate, seed, variants)
        for b in batches:
            keys = [0 if k is None else k for k in b.column(0).to_pylist()]
            texts = [t or "" for t in b.column(1).to_pylist()]
            a = 0
            while a < len(texts):
                e, n = a, 0
                while e < len(texts) and (e == a or n + len(texts[e]) <= TEXT_CHARS):
                    n += len(texts[e])
                    e += 1
                ids, size = enc.batch(keys[a:e], texts[a:e])
                off = np.append(0, np.cumsum(size))
                back, at = enc.decode_all(ids, off)
                raw, flat = memoryview(ids.astype("<i4")).cast("B"), (4 * off).tolist()
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(a, e - a), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())),
                    pa.LargeStringArray.from_buffers(e - a, pa.py_buffer(at), pa.py_buffer(back)).cast(pa.string()),
                    pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(flat, flat[1:])]),
                    *[c.slice(a, e - a) for c in b.columns[2:]]],
                    ["key", "ids", "decoded", "ids_sha256", *keep])
                a = e

    return run


def encode(docs: DataFrame, rate: float = 0.1, seed: int = 0, variants: int = 0, model: str = PIECES,
           id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, ids (array<int>), decoded, ids_sha256 (of the ids as little-endian int32) and the columns of ``keep`` per input row.

    ``decoded`` is the text decoded from the ids and always equals the text (NULL: the empty text, no
    ids). With rate 0 the ids are those of the plain encoder. Otherwise every occurrence of a chunk draws
    its own dropout from the seed, the document's id and its place there; ``variants`` above 0 limits a chunk to so
    many segmentations. The model file is read by the driver and its pieces (a fixed table) go along with the tasks.
    """
    v = Pieces.load(model)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"), *keep)
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_encoded(v, rate, seed, variants, list(keep)),
                           f"key long, ids array<int>, decoded string, ids_sha256 string{kept}").withColumnRenamed("key", "doc_id")
