"""Language ID by segmentation-marginalised unigram pieces.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability in a
language is the sum, over all ways to cut it into pieces, of the product of their probabilities
(forward algorithm); a text's is the product over its words. Piece probabilities come from expected
counts (forward-backward) over the training texts, starting from equal probabilities. Distinct words of
a working set are scored once, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from pitchlens.llm._common import fresh, id_mod, tree_merge
from pitchlens.llm._text import Words, chunks, prefix_hash, range_hash
from pitchlens.llm.pieces import PIECES

CHUNK_BYTES = 1 << 20
KNOWN_WORDS = 300_000  # distinct words a task remembers
BLOCK = 1 << 10      # pieces per row of partial counts
EVEN = 1e-3          # share of equal probabilities in each language's pieces (bounds them from below)
RESCALE = 32         # characters after which the sums of a word are scaled anew
_BASE = 0xC2B2AE3D27D4EB4F
_WORDS = 1 << 14     # words per forward block


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)


class Trie:
    """Piece lookup by hash of a character range; id 0 stands for any single character without a piece."""

    def __init__(self, names: list[str]):
        self.names = sorted({p.replace("▁", " ") for p in names if p})
        size = np.array([len(p) for p in self.names])
        self.longest = int(size.max())
        codes = _codes("".join(self.names))
        off = np.cumsum(size) - size
        h = range_hash(prefix_hash(codes, _BASE), off, off + size, _BASE)
        order = np.argsort(h)
        self.hash, self.id = h[order], (order + 1).astype(np.int32)
        self.n = len(self.names) + 1
        self.seen = np.zeros(1 << 20, bool)
        slot = (self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)
        self.seen[slot] = True
        self.at = np.zeros(1 << 20, np.int32)  # one piece of each slot; slots of several are looked up by search
        self.at[slot] = np.arange(len(slot))
        self.several = np.zeros(1 << 20, bool)
        self.several[np.flatnonzero(np.bincount(slot, minlength=1 << 20) > 1)] = True

    @classmethod
    def load(cls, path: str = PIECES) -> Trie:
        """Ordinary pieces of a public model file (read by the driver; a fixed table goes to the tasks)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([sp.id_to_piece(i) for i in range(sp.get_piece_size())
                    if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))])

    def ids(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(longest, n): id of the piece of m + 1 characters that starts at each place; -1 for none.

        ends: per place, the end of the word it is in.
        """
        pre, at = prefix_hash(codes, _BASE), np.arange(len(codes))
        out = np.full((self.longest, len(codes)), -1, np.int32)
        out[0] = 0
        lo = at
        for m in range(1, self.longest + 1):
            lo = lo[lo + m <= ends[lo]]
            if not len(lo):
                break
            h = range_hash(pre, lo, lo + m, _BASE)
            slot = (h & np.uint64((1 << 20) - 1)).astype(np.int64)
            may = np.flatnonzero(self.seen[slot])
            at, h, slot = lo[may], h[may], slot[may]
            k = self.at[slot]
            hit = self.hash[k] == h
            odd = np.flatnonzero(~hit & self.several[slot])
            k[odd] = np.minimum(np.searchsorted(self.hash, h[odd]), len(self.hash) - 1)
            hit[odd] = self.hash[k[odd]] == h[odd]
            out[m - 1, at[hit]] = self.id[k[hit]]
        return out


def kinds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the distinct words, index of one word of each, index of each word's kind)."""
    return np.unique(words.hashes(), return_index=True, return_inverse=True)


def spelled(words: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the given words, each after a space; their sizes with the space)."""
    lo, size = words.start[some], words.end[some] - words.start[some]
    ends = np.cumsum(size + 1)
    raw = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint8)
    inside = np.flatnonzero(_inside(ends, size))
    raw[inside] = words.buf[np.repeat(lo - (ends - size), size) + inside]
    codes = _codes(raw.tobytes().decode("utf-8", "replace"))
    start = np.flatnonzero(codes == np.uint64(0x21))
    return codes, np.diff(np.append(start, len(codes)))


class Known:
    """Values of words seen in this task by hash; emptied when it holds over KNOWN_WORDS words."""

    def __init__(self, width: int):
        self.hash, self.value = np.zeros(0, np.uint64), np.zeros((0, width))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash, whether it is there)."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return at, self.hash[at] == h

    def add(self, h: np.ndarray, value: np.ndarray) -> None:
        """h: sorted hashes that are not there yet."""
        at = np.searchsorted(self.hash, h)
        self.hash, self.value = np.insert(self.hash, at, h), np.insert(self.value, at, value, axis=0)


def _inside(ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """True at the places of words, False at the spaces before them."""
    out = np.ones(ends[-1] if len(ends) else 0, bool)
    out[ends - size - 1] = False
    return out


def _by_length(start: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    size = end - start
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for same in np.split(order, cuts):
        for k in range(0, len(same), _WORDS):
            if len(same[k:k + _WORDS]):
                yield same[k:k + _WORDS]


def _chart(pid: np.ndarray, prob: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forward (or backward) sums over segmentations of words of one length.

    pid: (longest piece, length, n) ids at each start. Returns (length + 1, n, langs) sums and the logarithms
    of the factors divided out along the way, per place, so that long words stay in range.
    """
    longest, size, n = pid.shape
    a = np.zeros((size + 1, n, prob.shape[1]))
    log = np.zeros((size + 1, n, prob.shape[1]))
    a[size if back else 0] = 1.0
    for step in range(1, size + 1):
        j = size - step if back else step
        for m in range(1, min(longest, step) + 1):
            ids = pid[m - 1, j if back else j - m]
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                src = j + m if back else j - m
                term = a[src, hit] * prob[ids[hit]]
                if step > RESCALE:
                    term *= np.exp(log[src, hit] - log[j + 1 if back else j - 1, hit])
                a[j, hit] += term
        log[j] = log[j + 1 if back else j - 1]
        if step % RESCALE == 0:
            top = a[j]
            log[j] += np.log(top)
            a[j] = 1.0
    return a, log


def word_scores(trie: Trie, prob: np.ndarray, codes, start, end) -> np.ndarray:
    """(words, languages): log probability of each word summed over its segmentations."""
    pid = trie.ids(codes, np.repeat(end, end - start))
    out = np.zeros((len(start), prob.shape[1]))
    for rows in _by_length(start, end):
        at = start[rows] + np.arange(end[rows[0]] - start[rows[0]])[:, None]
        a, log = _chart(pid[:, at], prob, back=False)
        out[rows] = np.log(a[-1]) + log[-1]
    return out


def expected(trie: Trie, prob: np.ndarray, codes, start, end, count: np.ndarray) -> np.ndarray:
    """(languages, pieces): expected piece counts of words that occur count[word, language] times."""
    pid = trie.ids(codes, np.repeat(end, end - start))
    langs = count.shape[1]
    out = np.zeros((langs, trie.n))
    for rows in _by_length(start, end):
        at = start[rows] + np.arange(end[rows[0]] - start[rows[0]])[:, None]
        size = len(at)
        p = pid[:, at]
        f, fl = _chart(p, prob, back=False)
        b, bl = _chart(p, prob, back=True)
        z, zl = f[-1], fl[-1]
        for m in range(1, min(trie.longest, size) + 1):
            ids = p[m - 1, :size - m + 1]
            i, r = np.nonzero(ids >= 0)
            if not len(r):
                continue
            ids = ids[i, r]
            g = f[i, r] * prob[ids] * b[i + m, r] / z[r] * np.exp(fl[i, r] + bl[i + m, r] - zl[r])
            for lang in range(langs):
                out[lang] += np.bincount(ids, weights=g[:, min(lang, g.shape[1] - 1)] * count[rows[r], lang], minlength=trie.n)
    return out


def _e_step(trie: Trie, prob: np.ndarray, langs: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(langs)}
        total = np.zeros((len(langs), trie.n))
        known, held = Known(len(langs)), []

        def settle():
            """Expected counts of the words held; each was spelled once, in the order of ``held``."""
            nonlocal total, known, held
            for h, codes, size in held:  # a chunk's new words at a time
                end = np.cumsum(size)
                total += expected(trie, prob, codes.astype(np.uint64), end - size, end, known.value[known.find(h)[0]])
            known, held = Known(len(langs)), []

        for b in batches:
            lang = np.array([place[x] for x in b.column(1).to_pylist()], np.int64)
            for w in chunks(b.column(0), chunk_bytes=CHUNK_BYTES):
                if not len(w.start):
                    continue
                h, first, kind = kinds(w)
                count = np.bincount(kind * len(langs) + lang[w.first + w.doc], minlength=len(h) * len(langs))
                count = count.reshape(-1, len(langs)).astype(float)
                at, there = known.find(h)
                known.value[at[there]] += count[there]
                codes, size = spelled(w, first[~there])
                held.append((h[~there], codes.astype(np.uint32), size))
                known.add(h[~there], count[~there])
                if len(known.hash) > KNOWN_WORDS:
                    settle()
        settle()
        at = [(k, a) for k in range(len(langs)) for a in range(0, trie.n, BLOCK) if total[k, a:a + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([
            pa.array([langs[k] for k, _ in at], pa.string()), pa.array([a for _, a in at], pa.int32()),
            pa.array([total[k, a:a + BLOCK].tobytes() for k, a in at], pa.binary())], ["lang", "first", "counts"])

    return run


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf.iloc[:1].copy()
    out["counts"] = [np.sum([np.frombuffer(x) for x in pdf["counts"]], axis=0).tobytes()]
    return out


def fit(train: DataFrame, trie: Trie, rounds: int = 1, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, (pieces, languages) probabilities) from all rows of train with a non-NULL language.

    Each round is one pass over the texts; partial counts are added by piece block. The number of
    languages is expected to be small: tasks hold a table of languages times pieces (a fixed number).
    """
    rows = train.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    prob = np.full((trie.n, 1), 1.0 / trie.n)
    for _ in range(rounds if langs else 0):
        parts = rows.mapInArrow(_e_step(trie, prob, langs), "lang string, first int, counts binary")
        summed = tree_merge(parts, ["lang", "first"], _sum, "lang string, first int, counts binary").collect()
        total = np.full((len(langs), trie.n), 1e-9)
        for r in summed:
            c = np.frombuffer(r["counts"])
            total[langs.index(r["lang"]), r["first"]:r["first"] + len(c)] += c
        prob = ((1 - EVEN) * total / total.sum(axis=1, keepdims=True) + EVEN / trie.n).T.copy()
    return langs, prob


def _predicted(trie: Trie, langs: list[str], prob: np.ndarray, text_at: int, schema: list[str]):
    """All columns as they come, with the predicted language and its posterior behind them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(len(langs))
        for b in batches:
            total = np.zeros((b.num_rows, len(langs)))
            text = b.column(text_at)
            letters = b.column(b.num_columns - 1)  # texts without letters are not scored
            for w in chunks(pa.compute.if_else(letters, text, pa.scalar("", text.type)), chunk_bytes=CHUNK_BYTES):
                if not len(w.start):
                    continue
                h, first, kind = kinds(w)
                at, there = known.find(h)
                codes, size = spelled(w, first[~there])
                end = np.cumsum(size)
                s = np.empty((len(h), len(langs)))
                s[there] = known.value[at[there]]
                s[~there] = word_scores(trie, prob, codes, end - size, end)
                known.add(h[~there], s[~there])
                if len(known.hash) > KNOWN_WORDS:
                    known = Known(len(langs))
                for k in range(len(langs)):
                    total[w.first:w.first + w.n_docs, k] = np.bincount(w.doc, weights=s[kind, k], minlength=w.n_docs)
            top = total.argmax(axis=1)
            post = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            pred = pa.compute.if_else(letters, pa.array([langs[k] for k in top], pa.string()), "und")
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pred, pa.compute.if_else(letters, pa.array(post), 0.0)], schema)

    return run


def predict(docs: DataFrame, trie: Trie, langs: list[str], prob: np.ndarray, text_col: str = "text",
            pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score (posterior under equal priors) as two more columns.

    ``und`` with score 0 for texts that are NULL or have no letter, or if no language was learned. Ties
    go to the first language by name.
    """
    if not langs:
        return docs.withColumns({pred: F.lit("und"), score: F.lit(0.0)})
    ok = fresh(docs, "letters")[0]
    flagged = docs.withColumn(ok, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    names = [*docs.columns, pred, score]
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    return flagged.mapInArrow(_predicted(trie, langs, prob, at, names), schema)


def identify(docs: DataFrame, model: str = PIECES, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows with crc32(id) mod 5 <> 0, predicted for all.

    A NULL id is neither learned from nor held out. Only the text enters a prediction.
    """
    trie = Trie.load(model)
    langs, prob = fit(docs.where(id_mod(id_col, 5) != 0), trie, rounds, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predict(rows, trie, langs, prob).select(
        "doc_id", F.coalesce(id_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_rows(docs: DataFrame, model: str = PIECES, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang") -> DataFrame:
    """Rows whose language can be told, with the columns of docs; a NULL language is filled with the prediction.

    Rejected: texts that are NULL or have no letter. Where no row has a language there is nothing to
    learn; rows with letters then stay as they are.
    """
    trie = Trie.load(model)
    langs, prob = fit(docs.where(id_mod(id_col, 5) != 0), trie, rounds, text_col, lang_col)
    if not langs:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    pred, score = fresh(docs, "lang_pred", "lang_score")
    return (predict(docs, trie, langs, prob, text_col, pred, score).where(F.col(pred) != "und")
            .select(*[F.coalesce(F.col(f"`{c}`"), F.col(pred)).alias(c) if c.lower() == lang_col.lower() else F.col(f"`{c}`")
                      for c in docs.columns]))
