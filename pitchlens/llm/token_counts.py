"""Token counts of whole texts by a tokenizer compiled to deterministic finite-state transducers.

Two transducers run one after the other, both over chunks of equal size that are processed side by side:

* The split transducer reads character classes (eleven states) and marks where the tokenizer's pattern
  begins a new pre-token. Every chunk's map (start state -> end state) is computed, the maps are composed
  by a parallel prefix scan, and the chunks then run once more from their true start states.
* The merge transducer reads the bytes of pre-tokens. A merge vocabulary is first seen as an unambiguous
  nondeterministic transducer: a state is a place in the trie of the tokens' bytes and the token that ends
  where that place's first byte begins; a path is a valid one when every two adjacent tokens are what the
  merges give for their bytes, and every prefix has one such path. Its weighted subset construction, with
  residual counts, is deterministic: a transition carries by how many the count of emitted tokens changes.
  It is built as states are met and kept in a bounded table. A pre-token's first byte resets the state,
  so a chunk's map is constant after its first reset; the part before it, and chunks inside one very
  long pre-token, get their map at the start states that occur, and the maps are chained.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitchlens.llm._text import string_buffers

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
WORK_BYTES = 1 << 22     # text per working set; longer texts are cut before a blank that ends a word
SPLIT_CHUNK = 64
MERGE_CHUNK = 256
TABLE_BITS = 22          # slots of the transition table; at half its slots in use it starts anew
NEVER = np.int64(1 << 40)

# Character classes and states of the split transducer.
END, SPACE, BLANK, QUOTE, STMD, RV, E, L, LETTER, DIGIT, OTHER = range(11)
FRESH, WORD, NUMBER, SIGNS, SPACE1, SPACES, BLANK1, BLANKS, QUOTE1, QUOTE_RV, QUOTE_L = range(11)
#: Marks of a transition: a pre-token begins at this character, at the one before.
HERE, BEFORE = 1, 2


def _split_table() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by [state, class] of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    letters = {STMD, RV, E, L, LETTER}

    def first(c):
        return {END: FRESH, SPACE: SPACE1, BLANK: BLANK1, QUOTE: QUOTE1, DIGIT: NUMBER, OTHER: SIGNS}.get(c, WORD)

    def joined(c):
        """After a blank that belongs to what follows."""
        return WORD if c in letters else NUMBER if c == DIGIT else SIGNS

    def step(s, c):
        begin = (first(c), 0 if c == END else HERE)
        if s == WORD and c in letters or s == NUMBER and c == DIGIT or s == SIGNS and c in (OTHER, QUOTE):
            return s, 0
        if s in (SPACE1, SPACES, BLANK1, BLANKS):
            if c in (SPACE, BLANK):
                return (SPACES if c == SPACE else BLANKS), 0
            if c == END:
                return FRESH, 0
            if s in (SPACE1, SPACES):
                return joined(c), 0 if s == SPACE1 else BEFORE
            return begin[0], begin[1] | (BEFORE if s == BLANKS else 0)
        if s == QUOTE1:
            if c == STMD:
                return FRESH, 0
            if c in (RV, L):
                return (QUOTE_RV if c == RV else QUOTE_L), 0
            if c in (OTHER, QUOTE):
                return SIGNS, 0
        if s in (QUOTE_RV, QUOTE_L):
            if c == (E if s == QUOTE_RV else L):
                return FRESH, 0
            return (WORD, BEFORE) if c in letters else (begin[0], begin[1] | BEFORE)
        return begin

    cells = [[step(s, c) for c in range(11)] for s in range(11)]
    return np.array([[x for x, _ in r] for r in cells], np.uint8), np.array([[x for _, x in r] for r in cells], np.uint8)


NEXT, MARKS = _split_table()
#: The states that a class can lead to (three at most, padded), and which of them each state goes to.
IMAGE = np.array([(lambda v: np.pad(v, (0, 3 - len(v)), mode="edge"))(np.unique(NEXT[:, c])) for c in range(11)], np.uint8)
PLACE = np.array([[int(np.flatnonzero(IMAGE[c] == NEXT[s, c])[0]) for s in range(11)] for c in range(11)], np.uint8)


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of (n, states) maps by doubling: out[k] = maps[k] after ... after maps[0]."""
    out, d = maps.copy(), 1
    while d < len(out):
        out[d:] = np.take_along_axis(out[d:], out[:-d].astype(np.int64), axis=1)
        d *= 2
    return out


def split_marks(symbols: np.ndarray) -> np.ndarray:
    """Which symbols (classes, END after every text) begin a pre-token."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, bool)
    lanes = -(-n // SPLIT_CHUNK)
    cols = np.full(lanes * SPLIT_CHUNK, END, np.uint8)
    cols[:n] = symbols
    cols = np.ascontiguousarray(cols.reshape(lanes, SPLIT_CHUNK).T)
    flat = NEXT.ravel()
    reach = np.ascontiguousarray(IMAGE[cols[0]].T)
    for t in range(1, SPLIT_CHUNK):
        reach = flat[reach * np.uint8(11) + cols[t]]
    maps = np.take_along_axis(reach.T, PLACE[cols[0]].astype(np.int64), axis=1)
    state = np.full(lanes, FRESH, np.uint8)
    state[1:] = compose_scan(maps)[:-1, FRESH]
    marks, out = np.empty_like(cols), MARKS.ravel()
    for t in range(SPLIT_CHUNK):
        at = state * np.uint8(11) + cols[t]
        marks[t] = out[at]
        state = flat[at]
    marks = marks.T.reshape(-1)[:n]
    here = (marks & HERE) > 0
    here[:-1] |= (marks[1:] & BEFORE) > 0
    return here


class Classes:
    """Class of a code point, as the tokenizer itself splits it; settled when a code point is first met."""

    def __init__(self, pre_tokenize):
        self.pre_tokenize = pre_tokenize
        self.known = np.full(0x110000, 255, np.uint8)
        for chars, kind in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L), ("'", QUOTE), (" ", SPACE)):
            for c in chars:
                self.known[ord(c)] = kind

    def of(self, cps: np.ndarray) -> np.ndarray:
        out = self.known[cps]
        if (out == 255).any():
            for c in np.unique(cps[out == 255]).tolist():
                self.known[c] = self._probe(chr(c))
            out = self.known[cps]
        return out

    def _probe(self, c: str) -> int:
        def together(a: str) -> bool:
            return len(self.pre_tokenize(a)) == 1

        return LETTER if together("x" + c) else DIGIT if together("0" + c) else OTHER if together("!" + c) else BLANK


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte place of each) of UTF-8 bytes."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    first = buf[lead].astype(np.uint32)
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        last = len(buf) - 1
        at, b0 = lead[wide], first[wide]
        b1, b2, b3 = (buf[np.minimum(at + k, last)].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        first[wide] = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(
            b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
    return first, lead


class MergeVocabulary:
    """A byte-level merge vocabulary: trie of the tokens' bytes, merge ranks, the two parts of every token."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]):
        """tokens: bytes by id. merges: (left id, right id, id of the result), the first merged first."""
        n = self.n = len(tokens)
        self.birth, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for r, (a, b, t) in enumerate(merges):
            if self.birth[t] >= 0 or any(self.birth[x] < 0 and len(tokens[x]) > 1 for x in (a, b)):
                raise ValueError("a token is made by two merges, or before its parts")
            self.birth[t], self.left[t], self.right[t] = r, a, b
        keys = np.array([a * n + b for a, b, _ in merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int64)
        made = np.flatnonzero(self.birth >= 0)
        usable = np.ones(n, bool)
        usable[made] = self._stands(self.left[made], self.right[made], own=True)
        for t in made[np.argsort(self.birth[made])]:
            usable[t] &= usable[self.left[t]] & usable[self.right[t]]
        if sorted(tokens[t] for t in np.flatnonzero(self.birth < 0) if len(tokens[t]) == 1) != [bytes([b]) for b in range(256)]:
            raise ValueError("not a byte-level vocabulary")
        usable &= (self.birth >= 0) | np.array([len(t) == 1 for t in tokens])
        edges: dict[int, int] = {}
        token_of = [-1]
        for t in np.flatnonzero(usable).tolist():
            node = 0
            for b in tokens[t]:
                node = edges.setdefault(node << 8 | b, len(token_of))
                if node == len(token_of):
                    token_of.append(-1)
            token_of[node] = t
        self.token_of = np.array(token_of, np.int64)
        order = sorted(edges)
        self.edge_keys, self.edge_to = np.array(order, np.int64), np.array([edges[k] for k in order], np.int64)
        self.inner = np.zeros(len(token_of), bool)
        self.inner[self.edge_keys >> 8] = True

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return self._find(self.edge_keys, self.edge_to, node << 8 | byte, -1)

    def _stands(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> np.ndarray:
        """Whether the merges give exactly tokens a, b for a's bytes followed by b's.

        Going back in time from the two finished tokens, the one made later is taken apart on the side
        that faces the other; no merge across the border may be due while both parts were there. Among
        equal merges the leftmost goes first. own: the merge of a and b themselves does not count.
        """
        a, b = a.copy(), b.copy()
        gone_a, gone_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        good, todo = np.ones(len(a), bool), np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            rank = self._find(self.pair_keys, self.pair_rank, x * self.n + y, NEVER)
            if own:
                gone_a[todo] = gone_b[todo] = rank
                rank, own = np.full(len(todo), NEVER), False
            bad = (rank < gone_a[todo]) & (rank <= gone_b[todo]) & (rank < NEVER)
            good[todo[bad]] = False
            bx, by = self.birth[x], self.birth[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            todo, x, y, bx, by = todo[go], x[go], y[go], bx[go], by[go]
            late = bx > by
            gone_a[todo[late]], a[todo[late]] = bx[late], self.right[x[late]]
            gone_b[todo[~late]], b[todo[~late]] = by[~late], self.left[y[~late]]
        return good

    def follows(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether token may follow the token before (-1: none, the pre-token's start)."""
        out = before < 0
        some = np.flatnonzero(~out)
        out[some] = self._stands(before[some], token[some])
        return out


class MergeTransducer:
    """The deterministic merge transducer, built as it is used.

    A state is a list of (trie node, token before its first byte, tokens emitted since), one for every
    begin of a token that may still go on, the longest first. Transitions are kept in a hash table of
    fixed size by (state, byte); when half of it is in use, states and transitions are dropped and built
    anew, so memory has a bound whatever the texts hold.
    """

    def __init__(self, v: MergeVocabulary, bits: int = TABLE_BITS):
        self.v, self.first_bits = v, bits
        self.clear()

    def clear(self) -> None:
        self.bits = self.first_bits
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros(1 << self.bits, np.int64)  # next state << 8 | change + 128
        self.used = 0
        self.names: dict[bytes, int] = {}
        self.off, self.items, self.n_items = np.zeros(1 << 12, np.int64), np.zeros((1 << 14, 3), np.int64), 0
        self._intern([np.array([[0, -1, 0]], np.int64)])

    def _intern(self, lists: list[np.ndarray]) -> list[int]:
        out = []
        for x in lists:
            name = x.tobytes()
            k = self.names.get(name)
            if k is None:
                k = self.names[name] = len(self.names)
                if k + 2 > len(self.off):
                    self.off = np.append(self.off, np.zeros_like(self.off))
                while self.n_items + len(x) > len(self.items):
                    self.items = np.concatenate([self.items, np.zeros_like(self.items)])
                self.items[self.n_items:self.n_items + len(x)] = x
                self.n_items += len(x)
                self.off[k + 1] = self.n_items
            out.append(k)
        return out

    @property
    def full(self) -> bool:
        return self.used * 2 >= 1 << self.first_bits

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, change of the number of tokens) of many transitions at once."""
        key = state << 8 | byte
        slot = self._slot(key)
        found = self.keys[slot]
        value = self.value[slot]
        odd = np.flatnonzero(found != key)
        if len(odd):
            value[odd] = self._probe(key[odd], slot[odd])
        return value >> 8, (value & 255) - 128

    def _probe(self, key: np.ndarray, slot: np.ndarray) -> np.ndarray:
        out, todo, last = np.full(len(key), -1, np.int64), np.arange(len(key)), len(self.keys) - 1
        slot = slot.copy()
        while len(todo):
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.value[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            slot[todo] = (slot[todo] + 1) & last
        new = np.flatnonzero(out < 0)
        if len(new):
            uniq, back = np.unique(key[new], return_inverse=True)
            made = np.concatenate([self._build(uniq[k:k + (1 << 14)]) for k in range(0, len(uniq), 1 << 14)])
            self._put(uniq, made)
            out[new] = made[back]
        return out

    def _put(self, key: np.ndarray, value: np.ndarray) -> None:
        while (self.used + len(key)) * 2 > len(self.keys) * 3 // 2:  # one step may bring many: grow rather than lose any
            keys, values = self.keys[self.keys >= 0], self.value[self.keys >= 0]
            self.bits += 1
            self.keys, self.value, self.used = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
            self._put(keys, values)
        self.used += len(key)
        slot, last = self._slot(key), len(self.keys) - 1
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.value[slot[won]] = key[won], value[won]
            rest = np.ones(len(key), bool)
            rest[won] = False
            key, value, slot = key[rest], value[rest], slot[rest]
            slot = np.where(self.keys[slot] >= 0, (slot + 1) & last, slot)

    def _build(self, key: np.ndarray) -> np.ndarray:
        """Transitions of new (state, byte) pairs: one step of the weighted subset construction."""
        v, state = self.v, key >> 8
        size = self.off[state + 1] - self.off[state]
        ends = np.cumsum(size)
        at = np.repeat(self.off[state] - (ends - size), size) + np.arange(ends[-1])
        owner = np.repeat(np.arange(len(key)), size)
        node, before, since = self.items[at].T
        child = v.child(node, (key & 255)[owner])
        alive = child >= 0
        owner, child, before, since = owner[alive], child[alive], before[alive], since[alive]
        token = v.token_of[child]
        cand = np.flatnonzero(token >= 0)
        cand = cand[v.follows(before[cand], token[cand])]
        if not np.array_equal(owner[cand], np.arange(len(key))):
            raise ValueError("a prefix without exactly one valid last token")
        change = 1 - since[cand]
        go = v.inner[child]
        rows = np.stack([child, before, since + change[owner]], 1)[go]
        size = np.bincount(owner[go], minlength=len(key)) + 1
        ends = np.cumsum(size)
        flat = np.zeros((ends[-1], 3), np.int64)
        tail = np.zeros(ends[-1], bool)
        tail[ends - 1] = True
        flat[~tail], flat[ends - 1, 1] = rows, token[cand]
        to = self._intern(np.split(flat, ends[:-1]))
        return np.array(to, np.int64) << 8 | (change + 128)

    def run(self, cols: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end state, tokens) of many byte strings, given as columns with their lengths, from given states."""
        order = np.argsort(-size, kind="stable")
        cols, size, state = cols[:, order], size[order], state[order].copy()
        total = np.zeros(len(size), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t, "left"))
            state[:k], change = self.step(state[:k], cols[t, :k])
            total[:k] += change
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def count(self, buf: np.ndarray, begins: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text buf[off[d]:off[d + 1]]; begins: which bytes are the first of a pre-token."""
        n = len(buf)
        if n == 0:
            return np.zeros(len(off) - 1, np.int64)
        if self.full:
            self.clear()
        lanes = -(-n // MERGE_CHUNK)
        pad = lanes * MERGE_CHUNK - n

        def columns(x, fill):
            return np.ascontiguousarray(np.append(x, np.full(pad, fill, x.dtype)).reshape(lanes, MERGE_CHUNK).T)

        cols, reset = columns(buf, 0).astype(np.int64), columns(begins, True)
        state, change = np.zeros(lanes, np.int64), np.zeros((MERGE_CHUNK, lanes), np.int16)
        head = np.where(reset.any(0), reset.argmax(0), MERGE_CHUNK)
        for t in range(MERGE_CHUNK):
            live = np.flatnonzero(head <= t)
            if not len(live):
                continue
            whole = len(live) == lanes
            s, r, b = (state, reset[t], cols[t]) if whole else (state[live], reset[t, live], cols[t, live])
            to, c = self.step(np.where(r, 0, s), b)
            if whole:
                state, change[t] = to, c
            else:
                state[live], change[t, live] = to, c
        sums = np.append(0, np.cumsum(change.T.reshape(-1)[:n], dtype=np.int64))
        out = sums[off[1:]] - sums[off[:-1]]
        # The parts before a chunk's first reset, from the state at the end of the chunk before.
        start = np.append(0, state[:-1])
        inside = np.flatnonzero(head == MERGE_CHUNK)
        more = np.zeros(lanes, np.int64)
        if len(inside):
            self._chain(cols, inside, state, start, more)
        lead = np.flatnonzero((head > 0) & (head < MERGE_CHUNK))
        more[lead] = self.run(cols[:, lead], head[lead], start[lead])[1]
        doc = np.searchsorted(off, np.arange(lanes) * MERGE_CHUNK, "right") - 1
        np.add.at(out, doc[head > 0], more[head > 0])
        return out

    def _chain(self, cols, inside, state, start, more) -> None:
        """Chunks that lie inside one pre-token: maps at the states that occur, run side by side, then chained."""
        name = {k: cols[:, k].tobytes() for k in inside.tolist()}
        maps: dict[tuple[bytes, int], tuple[int, int]] = {}

        def settle(wanted: set[tuple[int, int]]) -> None:
            fresh = list({(name[k], s): (k, s) for k, s in wanted if (name[k], s) not in maps}.values())
            if fresh:
                k = np.array([x for x, _ in fresh])
                end, total = self.run(cols[:, k], np.full(len(k), MERGE_CHUNK), np.array([s for _, s in fresh], np.int64))
                for (c, s), e, t in zip(fresh, end.tolist(), total.tolist(), strict=True):
                    maps[name[c], s] = e, t

        settle({(k, 0) for k in name})
        settle({(k, maps[name[k - 1], 0][0]) if k - 1 in name else (k, int(start[k])) for k in name})
        todo = inside.tolist()
        while todo:
            missing, rest = set(), []
            for k in todo:
                s = int(state[k - 1])
                if k - 1 in rest[-1:]:
                    rest.append(k)
                elif (name[k], s) in maps:
                    state[k], more[k] = maps[name[k], s]
                else:
                    missing.add((k, s))
                    rest.append(k)
            settle(missing)
            todo = rest
        start[1:] = state[:-1]


class Counter:
    """Counts tokens of whole texts by one tokenizer file."""

    def __init__(self, spec: str, v: MergeVocabulary | None = None, bits: int = TABLE_BITS):
        from tokenizers import Tokenizer

        data = json.loads(spec)
        pre, model = data["pre_tokenizer"], data["model"]
        if (data["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["dropout"]
                or model.get("ignore_merges") or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in data["added_tokens"])):
            raise ValueError("only plain byte-level merge tokenizers are supported")
        self.classes = Classes(Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str)
        special = sorted((a["content"].encode() for a in data["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self.transducer = MergeTransducer(v or vocabulary(spec), bits)

    def count(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text buf[off[d]:off[d + 1]] (UTF-8), special strings in the texts as one token each."""
        cuts, extra = off, np.zeros(len(off) - 1, np.int64)
        if self.special is not None and len(buf) and self.special.search(buf.tobytes()):
            spans = np.array([(off[d] + m.start(), off[d] + m.end(), d) for d in range(len(off) - 1)
                              for m in self.special.finditer(buf[off[d]:off[d + 1]].tobytes())], np.int64).reshape(-1, 3)
            np.add.at(extra, spans[:, 2], 1)
            stay = np.ones(len(buf), bool)
            for a, b, _ in spans:
                stay[a:b] = False
            moved = np.append(0, np.cumsum(stay))
            cuts, off, buf = np.sort(np.append(moved[off], moved[spans[:, 0]])), moved[off], buf[stay]
        cps, place = code_points(buf)
        ends = np.searchsorted(place, cuts[1:])
        symbols = np.insert(self.classes.of(cps), ends, END)
        marks = split_marks(symbols)
        begins = np.zeros(len(buf), bool)
        begins[place] = marks[np.arange(len(place)) + np.searchsorted(ends, np.arange(len(place)), "right")]
        return self.transducer.count(buf, begins, off) + extra


def byte_characters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as: printable Latin-1 bytes as themselves,
    the others, in order, as the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    odd = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(odd)}}


def vocabulary(spec: str) -> MergeVocabulary:
    """The merge vocabulary of a tokenizer file (its JSON text)."""
    model, as_byte = json.loads(spec)["model"], byte_characters()
    names = model["vocab"]
    tokens = [b""] * (max(names.values()) + 1)
    for t, i in names.items():
        tokens[i] = bytes(as_byte[c] for c in t)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return MergeVocabulary(tokens, [(names[a], names[b], names[a + b]) for a, b in pairs])


def pieces_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cut points, text of each piece): texts longer than a working set are cut before a space that follows an ASCII
    letter or digit, where a pre-token begins whatever stands around."""
    cut, doc = [0], []
    plain = np.zeros(256, bool)
    plain[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    for d in np.flatnonzero(np.diff(off) > WORK_BYTES).tolist():
        a = int(off[d])
        while off[d + 1] - a > WORK_BYTES:
            look = buf[a + WORK_BYTES:off[d + 1]]
            # Cuts are looked for a block at a time; a text without any is taken whole.
            at = -1
            for k in range(0, len(look) - 1, 1 << 16):
                part = look[k:k + (1 << 16) + 1]
                hit = np.flatnonzero(plain[part[:-1]] & (part[1:] == 0x20))
                if len(hit):
                    at = k + int(hit[0]) + 1
                    break
            if at < 0:
                break
            a += WORK_BYTES + at
            cut.append(a)
            doc.append(d)
    points = np.sort(np.append(off, np.array(cut[1:], np.int64)))
    owner = np.sort(np.append(np.arange(len(off) - 1), np.array(doc, np.int64)))
    return points, owner


def _counted(spec: str, v: MergeVocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(spec, v)
        for b in batches:
            buf, off = string_buffers(b.column(1))
            points, owner = pieces_of(buf, off)
            tokens, k = np.zeros(b.num_rows, np.int64), 0
            while k < len(owner):
                e = max(k + 1, int(np.searchsorted(points, points[k] + WORK_BYTES, "right")) - 1)
                e = min(e, len(owner))
                np.add.at(tokens, owner[k:e], counter.count(buf[points[k]:points[e]], points[k:e + 1] - points[k]))
                k = e
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(tokens)], ["key", "n_bytes", "n_tokens"])

    return run


def count(docs: DataFrame, limit: int = 512, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) per input row, repeated rows each.

    Counts are those of the tokenizer's library without begin, end or added tokens; special strings inside
    a text are one token. A NULL or empty text has none; a NULL id stays NULL; an empty table gives no
    row; columns of other names do no harm. One pass over the texts without a shuffle: a row's work is
    proportional to its text, a working set is 4 MB or one text without a place to cut, and a task holds
    one bounded transition table. The vocabulary's tables (a fixed public file) go along with the tasks.
    """
    with open(tokenizer, encoding="utf-8") as fh:
        spec = fh.read()
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_counted(spec, vocabulary(spec)), "key long, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
