"""Token counts by compiled transducers: against the tokenizer's library and plain versions."""
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pitchlens.llm import token_counts as tc
from pitchlens.llm._text import string_buffers

SPEC = open(tc.TOKENIZER, encoding="utf-8").read()
BITS = ["'s", "'re", "'ll", "'sun", "don't", "<|endoftext|>", "<|endof", "  ", "\n\n", "\t", "xxxx", "----", "é", "日本", "😀", "\x1c", "²", "Ⅷ",
        " ", "a", "e", "t", "r", "l", "v", "'", "0", "9", ".", "!", " ", "　", "▁", "ſ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(SPEC)


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(SPEC)


def counts(counter, texts):
    buf, off = string_buffers(pa.array(texts, pa.string()))
    return counter.count(buf, off).tolist()


def plain(library, texts):
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(BITS), max_size=30).map("".join) | st.text(max_size=30), min_size=1, max_size=30))
def test_counts_equal_the_library(library, counter, texts):
    assert counts(counter, texts) == plain(library, texts)


def test_long_runs(library, counter):
    r = random.Random(3)
    texts = ["x" * 5000, "日本語" * 2000, "ab" * 4000, " " * 3001, "-" * 3000 + "'s", "a" * 4097 + " b", "",
             "".join(r.choice("0123456789abcdef") for _ in range(6000)), "<|endoftext|>" * 3, " <|endoftext|>\n\n x"]
    assert counts(counter, texts) == plain(library, texts)


def test_a_small_table_starts_anew(library):
    small = tc.Counter(SPEC, bits=8)
    r = random.Random(4)
    for _ in range(3):
        texts = ["".join(r.choice("abcdefgh 0123") for _ in range(400)) for _ in range(20)]
        assert counts(small, texts) == plain(library, texts)
    assert small.transducer.full or small.transducer.used < 128


def test_longer_texts_are_cut_at_words(library, counter, monkeypatch):
    monkeypatch.setattr(tc, "WORK_BYTES", 100)
    text = "it's a long text, isn't it?  Yes\n 12 34 " * 30
    buf, off = string_buffers(pa.array(["short", text, "x" * 500, None]))
    points, owner = tc.pieces_of(buf, off)
    assert (owner == 1).sum() > 5 and (owner == 2).sum() == 1
    got = np.bincount(owner, weights=counter.count(buf, points), minlength=4)
    assert got.tolist() == plain(library, ["short", text, "x" * 500, ""])


def test_scan_composes_maps_in_order():
    r = np.random.default_rng(1)
    maps = r.integers(0, 5, (37, 5)).astype(np.uint8)
    want, now = [], np.arange(5)
    for m in maps:
        now = m[now]
        want.append(now)
    assert (tc.compose_scan(maps) == np.array(want)).all()


def test_own_vocabulary_against_plain_merging():
    """A made-up vocabulary with merges of equal letters: the transducer counts what merging pair by pair gives."""
    as_char = {b: c for c, b in tc.byte_characters().items()}
    names = [as_char[b] for b in range(256)]
    merges = [("a", "a"), ("a", "b"), ("aa", "a"), ("b", "ab"), ("aa", "aa"), ("ab", "ab"), ("aaaa", "b"), ("c", "aaa")]
    spec = json.loads(SPEC)
    spec["model"]["vocab"] = {t: i for i, t in enumerate([*names, *(a + b for a, b in merges)])}
    spec["model"]["merges"] = [list(m) for m in merges]
    spec["added_tokens"] = []

    def merged(word):
        word = list(word)
        while True:
            due = [(merges.index((x, y)), k) for k, (x, y) in enumerate(zip(word, word[1:])) if (x, y) in merges]
            if not due:
                return len(word)
            k = min(due)[1]
            word[k:k + 2] = [word[k] + word[k + 1]]

    c = tc.Counter(json.dumps(spec))
    r = random.Random(9)
    words = ["".join(r.choice("aaabc") for _ in range(r.randint(1, 40))) for _ in range(400)]
    assert counts(c, words) == [merged(w) for w in words]


def test_vocabulary_checks():
    with pytest.raises(ValueError):
        tc.MergeVocabulary([bytes([b]) for b in range(256)] + [b"ab", b"abc"], [(256, 99, 257), (97, 98, 256)])
    spec = json.loads(SPEC)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        tc.Counter(json.dumps(spec))


def test_query_on_edge_rows(library, docs, doc_rows, no_docs):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.count(docs).collect()), key=str)
    n = plain(library, [t or "" for _, t, _, _ in doc_rows])
    assert got == sorted(((i, len((t or "").encode()), k, k > 512) for (i, t, _, _), k in zip(doc_rows, n)), key=str)
    assert tc.count(no_docs).count() == 0
