"""Alignment of two tokenizers over a corpus, each distinct text tokenised and aligned once.

Rows are shuffled by their full text into distinct texts with their multiplicity; each is tokenised by a
byte-level merge vocabulary (A) and a merge-type piece model (B) and aligned by byte offsets. The corpus
counts of linked id pairs weight every distinct text by its multiplicity, and the measures are joined back
to the doc_ids by the text's digest.

Both tokenizers begin a token at a space or line end that follows a character that is no white space, whatever
else stands around, so a text falls into units (from such a place to the next) that are tokenised on their
own, and units may be joined to texts for tokenising; a bounded memory keeps the alignment of units met.

Distinct texts are packed into batches, whose links lie in a few blocks by A id: the batch's distinct pairs
and, per text, the places of its pairs among them. Counts merge per block as a tree; counts and links of
a block meet on a (block, lane) grid, lanes dealing the batches, so no task holds more than one block's
counts and one batch of links at a time.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitchlens.llm._common import cut, tree_merge
from pitchlens.llm.token_counts import TOKENIZER, byte_characters

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_CHARS = 1 << 21    # characters per working set; a longer text is taken in parts
KNOWN_UNITS = 200_000    # units whose alignment a worker keeps
BLOCKS = 16
LANE_BYTES = 1 << 24     # packed links per task of the grid
HOT_SHARE = 10_000       # texts with more than 1/HOT_SHARE of all rows (so fewer than HOT_SHARE texts) are broadcast
BETWEEN = re.compile(r"(?<=\S)(?=[ \n])")
JOINED = 2000            # units that are tokenised as one text

_TEXT_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
_PACKED = ("batch string, block int, pairs binary, places binary, times binary, mult binary, digests array<string>, "
           + ", ".join(f"{c} array<long>" for c in _TEXT_COLUMNS) + ", groups_sha256 array<string>")


def pack(x: np.ndarray) -> bytes:
    """Integers, best ascending, as differences in byte planes, compressed."""
    d = np.diff(x.astype(np.int64), prepend=0)
    return pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(d) else b""


def unpack(b: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel())


def sealed(x: np.ndarray) -> bytes:
    """pack with the number of values in front."""
    return len(x).to_bytes(8, "big") + pack(x)


def opened(b: bytes) -> np.ndarray:
    return unpack(b[8:], int.from_bytes(b[:8], "big"))


def _ragged(off: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(off - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def links(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A index, B index) of all tokens whose byte ranges overlap; both cover the same bytes without gaps."""
    start_a = np.append(0, end_a[:-1])
    start_b = np.append(0, end_b[:-1])
    lo, hi = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    a = np.repeat(np.arange(len(end_a)), hi - lo)
    return a, _ragged(lo, hi - lo)


class Tokens:
    """Ids and bytes of one tokenizer. ``encode`` takes texts that begin with a space or line end."""

    def __init__(self, raw: list[bytes], encode):
        self.encode = encode
        self.size = np.array([len(r) for r in raw], np.int64)
        self.off = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    @classmethod
    def byte_level(cls, path: str) -> Tokens:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as fh:
            spec = fh.read()
        t, as_byte, data = Tokenizer.from_str(spec), byte_characters(), json.loads(spec)
        t.encode_special_tokens = True
        many = getattr(t, "encode_batch_fast", t.encode_batch)
        names = data["model"]["vocab"]
        raw = [b""] * t.get_vocab_size(with_added_tokens=True)
        for s, i in names.items():
            raw[i] = bytes(as_byte[c] for c in s if c in as_byte)
        return cls(raw, lambda texts: [e.ids for e in many(texts, add_special_tokens=False)])

    @classmethod
    def pieces(cls, path: str) -> Tokens:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
               for i in range(sp.get_piece_size())]
        if any(b"\n" in r and len(r) > 1 or b" " in r.lstrip(b" ") for r in raw):
            raise ValueError("pieces that span words or lines are not supported")
        head = len(sp.encode("x"))  # the model puts a space before a text
        return cls(raw, lambda texts: [x[head:] for x in sp.encode(["x" + t for t in texts], num_threads=1)])

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[_ragged(self.off[ids], self.size[ids])]

    def units(self, units: list[str], size: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all units, unit of each, units spelled back). size, truth: the units' bytes. Joined units are
        tokenised at once; where a joined text is not spelled back, its units are tokenised one by one."""
        ids, who, ok = [], [], np.ones(len(units), bool)
        ends = np.append(0, np.cumsum(size))
        # A unit that ends in white space (a text's end) ends its joined text.
        last = [k for k, u in enumerate(units) if u[-1:].isspace()]
        cuts = sorted({0, len(units), *range(0, len(units), JOINED), *(k + 1 for k in last)})
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        for (i, j), got in zip(spans, self.encode(["".join(units[i:j]) for i, j in spans]), strict=True):
            got = np.array(got, np.int64)
            to = np.cumsum(self.size[got])
            if np.array_equal(self.spelled(got), truth[ends[i]:ends[j]]) and np.isin(ends[i + 1:j + 1] - ends[i], to).all():
                ids.append(got)
                who.append(i + np.searchsorted(ends[i + 1:j + 1] - ends[i], to, "left"))
                continue
            for k, one in zip(range(i, j), self.encode(units[i:j]), strict=True):
                one = np.array(one, np.int64)
                ok[k] = np.array_equal(self.spelled(one), truth[ends[k]:ends[k + 1]])
                ids.append(one)
                who.append(np.full(len(one), k))
        return np.concatenate(ids), np.concatenate(who), ok


class Aligner:
    """Aligns units and remembers them. pair = A id * number of B ids + B id."""

    def __init__(self, a: Tokens, b: Tokens, keep: int = KNOWN_UNITS):
        self.a, self.b, self.keep, self.width = a, b, keep, len(b.size)
        self.ends = {(s, sep): np.array([f"{i}{sep}".encode() for i in range(len(t.size))], object)
                     for s, t, seps in ((0, a, ",|"), (1, b, ",;")) for sep in seps}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.good: list[np.ndarray] = [np.zeros(0, bool)]
        self.counts: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
        self.names: list[bytes] = []
        self.pairs: list[np.ndarray] = [np.zeros(0, np.int64)]

    def settle(self, units: list[str]) -> None:
        """Tokenise and align units that are new."""
        spelled = [u.encode() for u in units]
        size = np.array([len(x) for x in spelled], np.int64)
        truth = np.frombuffer(b"".join(spelled), np.uint8)
        done = [t.units(units, size, truth) for t in (self.a, self.b)]
        ids, unit, ok = [x[0] for x in done], [x[1] for x in done], done[0][2] & done[1][2]
        for s in (0, 1):
            go = ok[unit[s]]
            ids[s], unit[s] = ids[s][go], unit[s][go]
        end = [np.cumsum(t.size[i]) for t, i in ((self.a, ids[0]), (self.b, ids[1]))]
        border = np.intersect1d(end[0], end[1], assume_unique=True)
        group = [np.searchsorted(border, e, "left") for e in end]
        x, y = links(end[0], end[1])
        n = len(units)
        n_links = np.bincount(unit[0][x], minlength=n)
        n_groups = np.bincount(unit[0][np.isin(end[0], border, assume_unique=True)], minlength=n)
        counts = np.stack([np.bincount(unit[0], minlength=n), np.bincount(unit[1], minlength=n), n_groups, n_links], 1)
        # Groups as text: A ids, then B ids, of each group.
        last = [np.append(g[1:] != g[:-1], True)[:len(g)] for g in group]
        words = [np.where(last[s], self.ends[s, "|;"[s]][ids[s]], self.ends[s, ","][ids[s]]) for s in (0, 1)]
        order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        words = np.concatenate(words)[order]
        per = np.cumsum(counts[:, 0] + counts[:, 1])
        words = words.tolist()
        self.names += [b"".join(words[i:j]) for i, j in zip([0, *per[:-1].tolist()], per.tolist(), strict=True)] if n else []
        first = len(self.known)
        self.known.update((u, first + k) for k, u in enumerate(units))
        self.good.append(ok)
        self.counts.append(counts)
        self.pairs.append(ids[0][x] * self.width + ids[1][y])

    def _joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for name in ("good", "counts", "pairs"):
            x = getattr(self, name)
            if len(x) > 1:
                setattr(self, name, [np.concatenate(x)])
        return self.good[0], self.counts[0], self.pairs[0]

    def align(self, parts: list[tuple[int, str]], n: int, digests: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """parts: (text number, part that begins at a unit). -> (bad texts, counts (n, 4), text << 40 | pair ascending,
        times each occurs); the parts' groups go to the texts' digests."""
        if len(self.known) > self.keep:
            self.clear()
        cut_up = [BETWEEN.split(p) for _, p in parts]
        size = np.array([len(u) for u in cut_up], np.int64)
        new = [u for u in dict.fromkeys(chain.from_iterable(cut_up)) if u not in self.known]
        if new:
            self.settle(new)
        good, counts, pairs = self._joined()
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut_up)), np.int64, int(size.sum()))
        text = np.repeat(np.array([k for k, _ in parts], np.int64), size)
        bad = np.zeros(n, bool)
        bad[text[~good[which]]] = True
        total = np.stack([np.bincount(text, weights=counts[which, c], minlength=n).astype(np.int64) for c in range(4)], 1)
        ends = np.cumsum(size).tolist()
        names, place = self.names, which.tolist()
        for (k, _), i, j in zip(parts, [0, *ends[:-1]], ends, strict=True):
            digests[k].update(b"".join([names[u] for u in place[i:j]]))
        n_links = counts[:, 3]
        off = np.cumsum(n_links) - n_links
        stay = ~bad[text]
        which, text = which[stay], text[stay]
        key = np.repeat(text << 40, n_links[which]) | pairs[_ragged(off[which], n_links[which])]
        key, times = np.unique(key, return_counts=True)
        return bad, total, key, times


class _Held:
    """A digest that withholds the last byte: the groups' last separator does not count."""

    def __init__(self):
        self.inner, self.last = hashlib.sha256(), b""

    def update(self, b: bytes) -> None:
        if b:
            self.inner.update(self.last + b[:-1])
            self.last = b[-1:]

    def hexdigest(self) -> str:
        return self.inner.hexdigest()


@functools.lru_cache(2)
def _aligner(a: str, b: str) -> Aligner:
    """One per worker and pair of files; its memory of units outlives tasks and is bounded."""
    return Aligner(Tokens.byte_level(a), Tokens.pieces(b))


def parts_of(text: str, k: int) -> Iterator[tuple[int, str]]:
    """space + text in parts of about BATCH_CHARS characters that begin at units."""
    text, a = " " + text, 0
    while len(text) - a > BATCH_CHARS and (m := BETWEEN.search(text, a + BATCH_CHARS)):
        yield k, text[a:m.start()]
        a = m.start()
    yield k, text[a:]


def block_of(pair: np.ndarray, width: int) -> np.ndarray:
    """The block of a pair, by its A id."""
    return ((pair // width).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BLOCKS


def _batch(al: Aligner, digests: list[str], mult: np.ndarray, texts: list[str]) -> list[dict]:
    """Rows of one batch of distinct texts: one (block -1) with the texts' own measures, one for each block with links."""
    n = len(texts)
    bad, total = np.zeros(n, bool), np.zeros((n, 4), np.int64)
    hashed = [_Held() for _ in texts]
    keys, times, held, chars = [], [], [], 0
    for part in chain.from_iterable(parts_of(t, k) for k, t in enumerate(texts) if t):
        if held and chars + len(part[1]) > BATCH_CHARS:
            held, chars = _add(al, held, n, hashed, bad, total, keys, times), 0
        held.append(part)
        chars += len(part[1])
    _add(al, held, n, hashed, bad, total, keys, times)
    key, count = (np.concatenate(keys), np.concatenate(times)) if keys else (np.zeros(0, np.int64),) * 2
    if len(keys) > 1:  # parts of one text
        key, back = np.unique(key, return_inverse=True)
        count = np.bincount(back, weights=count).astype(np.int64)
    total[bad] = 0
    stay = ~bad[key >> 40]
    key, count = key[stay], count[stay]
    text, pair = key >> 40, key & (1 << 40) - 1
    sha = [h.hexdigest() if t and not b else "" for h, t, b in zip(hashed, texts, bad, strict=True)]
    out = [{"batch": digests[0], "block": -1, "digests": digests, "mult": sealed(mult), "groups_sha256": sha,
            **{c: total[:, k].tolist() for k, c in enumerate(_TEXT_COLUMNS)}}]
    block = block_of(pair, al.width)
    for b in np.unique(block).tolist():
        at = np.flatnonzero(block == b)
        pairs, place = np.unique(pair[at], return_inverse=True)
        out.append({"batch": digests[0], "block": b, "pairs": sealed(pairs), "places": sealed(text[at] * len(pairs) + place),
                    "times": sealed(count[at]), "mult": sealed(mult)})
    return out


def _add(al, held, n, hashed, bad, total, keys, times) -> list:
    if held:
        b, t, key, many = al.align(held, n, hashed)
        bad |= b
        total += t
        keys.append(key)
        times.append(many)
    return []


def _aligned(a: str, b: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(a, b)
        schema = pa.schema([("batch", pa.string()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("pairs", "places", "times", "mult")],
                            ("digests", pa.list_(pa.string())), *[(c, pa.list_(pa.int64())) for c in _TEXT_COLUMNS],
                            ("groups_sha256", pa.list_(pa.string()))])
        digests, mult, texts, chars = [], [], [], 0
        for rb in batches:
            for d, m, t in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if texts and chars + len(t) > BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(_batch(al, digests, np.array(mult, np.int64), texts), schema)
                    digests, mult, texts, chars = [], [], [], 0
                digests.append(d)
                mult.append(m)
                texts.append(t)
                chars += len(t)
        if texts:
            yield pa.RecordBatch.from_pylist(_batch(al, digests, np.array(mult, np.int64), texts), schema)

    return run


def _links_of(pairs: bytes, places: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pairs, places = opened(pairs), opened(places)
    text, place = np.divmod(places, len(pairs))
    return pairs, text, place, opened(times)


def _sum(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate(pairs), return_inverse=True)
    out = np.zeros(len(key), np.int64)
    np.add.at(out, back, np.concatenate(counts))
    return key, out


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pairs, places, mult) -> per task and block the pairs and the number of documents that hold each."""
    held: dict[int, tuple[list, list]] = {}
    for rb in batches:
        for block, pairs, places, mult in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            pairs, places, mult = opened(pairs), opened(places), opened(mult)
            text, place = np.divmod(places, len(pairs))
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, place, mult[text])
            p, c = held.setdefault(block, ([], []))
            p.append(pairs)
            c.append(n)
            if len(p) >= 16:
                held[block] = tuple([x] for x in _sum(p, c))
    for block, (p, c) in held.items():
        p, c = _sum(p, c)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "pairs": [sealed(p)], "counts": [sealed(c)]})


def _merged(g: pd.DataFrame) -> pd.DataFrame:
    p, c = _sum([opened(x) for x in g["pairs"]], [opened(x) for x in g["counts"]])
    return pd.DataFrame({"block": [g["block"].iloc[0]], "pairs": [sealed(p)], "counts": [sealed(c)], "lane": [g["lane"].iloc[0]]})


def best_of(pairs: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Whether a pair's count is the highest of its A id (pairs ascending)."""
    a = pairs // width
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])[:len(a)])
    top = np.maximum.reduceat(counts, first) if len(a) else counts
    return counts == np.repeat(top, np.diff(np.append(first, len(a))))


def _measured(width: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Links of a lane's batches and the counts of their block -> per batch n_best and count_sum of its texts."""
        known = [(opened(p), opened(c)) for p, c in zip(right["pairs"].to_pylist(), right["counts"].to_pylist(), strict=True)]
        out = {"batch": [], "best": [], "sums": []}
        for k in range(left.num_rows):
            r = {c: left[c][k].as_py() for c in ("batch", "pairs", "places", "times", "n")}
            pairs, text, place, times = _links_of(r["pairs"], r["places"], r["times"])
            all_pairs, all_counts = known[0]
            at = np.searchsorted(all_pairs, pairs)
            if k == 0:
                best = best_of(all_pairs, all_counts, width)
            n_best, sums = np.zeros(r["n"], np.int64), np.zeros(r["n"], np.int64)
            np.add.at(sums, text, times * all_counts[at][place])
            np.add.at(n_best, text, times * best[at][place])
            out["batch"].append(r["batch"])
            out["best"].append(sealed(n_best))
            out["sums"].append(sealed(sums))
        return pa.table({"batch": pa.array(out["batch"], pa.string()), "best": pa.array(out["best"], pa.binary()),
                         "sums": pa.array(out["sums"], pa.binary())})

    return run


def _finished(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """A batch's texts and its blocks' sums -> one row per text."""
    r = left.to_pylist()[0]
    n = len(r["digests"])
    best, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for b, s in zip(right["best"].to_pylist(), right["sums"].to_pylist(), strict=True):
        best += opened(b)
        sums += opened(s)
    return pa.table({"digest": r["digests"], "mult": opened(r["mult"]), **{c: pa.array(r[c], pa.int64()) for c in _TEXT_COLUMNS},
                     "n_best": best, "count_sum": sums, "groups_sha256": pa.array(r["groups_sha256"], pa.string())})


def measures(docs: DataFrame, tokenizer: str, pieces: str, text_col: str) -> DataFrame:
    """One row per distinct text: digest, mult (rows that hold it), the contract's measures."""
    distinct = docs.groupBy(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("mult"))
    texts = distinct.select(F.sha2("text", 256).alias("digest"), "mult", "text")
    packed = cut(texts.mapInArrow(_aligned(tokenizer, pieces), _PACKED))
    linked = packed.where("block >= 0")
    width = len(Tokens.pieces(pieces).size)
    parts = linked.select("block", "pairs", "places", "mult").mapInArrow(_counted, "block int, pairs binary, counts binary")
    counts = tree_merge(parts, ["block"], _merged, "block int, pairs binary, counts binary")
    held = packed.agg(F.sum(F.octet_length("pairs") + F.octet_length("places") + F.octet_length("times"))).first()[0] or 0
    lanes = 1 + held // (BLOCKS * LANE_BYTES)
    grid = linked.select("batch", "block", F.pmod(F.xxhash64("batch"), F.lit(lanes)).alias("lane"), "pairs", "places", "times",
                         F.conv(F.hex(F.substring("mult", 1, 8)), 16, 10).cast("int").alias("n"))
    copies = counts.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    sums = grid.groupBy("block", "lane").cogroup(copies.groupBy("block", "lane")).applyInArrow(
        _measured(width), "batch string, best binary, sums binary")
    texts = packed.where("block = -1").select("batch", "digests", "mult", *_TEXT_COLUMNS, "groups_sha256")
    return texts.groupBy("batch").cogroup(sums.groupBy("batch")).applyInArrow(
        _finished, "digest string, mult long, " + ", ".join(f"{c} long" for c in (*_TEXT_COLUMNS, "n_best", "count_sum"))
        + ", groups_sha256 string")


def align(docs: DataFrame, tokenizer: str = TOKENIZER, pieces: str = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per input row, repeated rows each.

    A NULL or empty text, and one that either tokenizer does not spell back (a literal U+2581), has zeros and
    an empty digest. A NULL id stays NULL; its text still counts. An id pair counts every row that holds
    its text. A very long text is tokenised in parts that begin at units; a unit without any space is taken
    whole. An empty table gives no row; columns of other names do no harm. Texts held by more than one row
    in 10,000 of all (fewer than 10,000 texts whatever the size) are joined back by a broadcast, the others by
    a shuffle, so no join key has many rows.
    """
    per_text = cut(measures(docs, tokenizer, pieces, text_col))
    rows = per_text.agg(F.sum("mult")).first()[0] or 0
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("digest"))
    hot = F.broadcast(per_text.where(F.col("mult") * HOT_SHARE > rows))
    rest = per_text.where(F.col("mult") * HOT_SHARE <= rows)
    names = ["doc_id", *_TEXT_COLUMNS, "n_best", "count_sum", "groups_sha256"]
    often = ids.join(hot, "digest").select(names)
    seldom = ids.join(hot.select("digest"), "digest", "left_anti").join(rest, "digest").select(names)
    return often.unionByName(seldom)
