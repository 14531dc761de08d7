"""Alignment of two tokenizers: against a plain version that tokenises every whole text and counts by loops."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitchlens.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(alignment.TOKENIZER)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)


def plain(libraries, rows):
    """The contract, text by text and token by token."""
    t, sp = libraries
    as_byte = alignment.byte_characters()
    name = {i: bytes(as_byte[c] for c in s) for s, i in t.get_vocab(with_added_tokens=False).items() if all(c in as_byte for c in s)}

    def piece(i):
        s = sp.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if sp.is_byte(i) else s.replace("▁", " ").encode()

    done = []
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a, b = t.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        if not text or b"".join(name[i] for i in a) != want or b"".join(map(piece, b)) != want:
            done.append((doc_id, 0, 0, [], []))
            continue

        def spans(ids, spell):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(spell(i)), i))
                at = out[-1][1]
            return out

        sa, sb = spans(a, name.__getitem__), spans(b, piece)
        cuts = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        groups = [([i for _, e, i in sa if lo < e <= hi], [i for _, e, i in sb if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)] \
            if len(text) < 3000 else None
        linked, k = [], 0
        for s, e, i in sa:
            while sb[k][1] <= s:
                k += 1
            j = k
            while j < len(sb) and sb[j][0] < e:
                linked.append((i, sb[j][2]))
                j += 1
        if groups is None:  # the same by pointers, for long texts
            groups, ia, ib = [], 0, 0
            for hi in cuts:
                ga, gb = [], []
                while ia < len(sa) and sa[ia][1] <= hi:
                    ga.append(sa[ia][2])
                    ia += 1
                while ib < len(sb) and sb[ib][1] <= hi:
                    gb.append(sb[ib][2])
                    ib += 1
                groups.append((ga, gb))
        done.append((doc_id, len(a), len(b), groups, linked))
    count = Counter(p for *_, linked in done for p in set(linked))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for doc_id, n_a, n_b, groups, linked in done:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(linked), sum(count[p] == top[p[0]] for p in linked),
                    sum(count[p] for p in linked), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_whole_query_equals_the_plain_version(libraries, docs, doc_rows):
    got = collected(alignment.align(docs))
    assert got == plain(libraries, [(i, t) for i, t, _, _ in doc_rows])


ODD = ["", None, " ", "  ", "a ", "a  ", " a", "\n", "a\n", "a\n\nb", "a\n b", "a \nb", "\n\n x", "▁x", "x▁", "ok text ▁", "<s> </s> <unk> <0x41>",
       "<|endoftext|> a<|endoftext|>", "naïve\tcafé\r\n日本語 😀 ́x", " nbsp　wide", "a\x1c b\x85 c", "x" * 300, "日本語" * 200, "don't we'll 'tis",
       "1234567 89", "a" * 50 + "\n" + "b" * 50, "same", "same", "same", "word\nword word\nword "]


def test_odd_texts_and_small_memory(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "JOINED", 3)
    r = random.Random(2)
    bits = ["a", "the", " ", "  ", "\n", "'s", "é", "日", "▁", "12", ".", "\t", " of", " "]
    rows = list(enumerate(ODD)) + [(1000 + k, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for k in range(300)] + [(None, "same")]
    al = alignment.Aligner(alignment.Tokens.byte_level(alignment.TOKENIZER), alignment.Tokens.pieces(alignment.PIECES), keep=10)
    want = {x[0]: x for x in plain(libraries, rows)}
    for k in range(0, len(rows), 40):
        part = [x for x in rows[k:k + 40] if x[0] is not None]
        main, *linked = alignment._batch(al, [str(i) for i, _ in part], np.ones(len(part), np.int64), [t or "" for _, t in part])
        got = zip(main["n_a"], main["n_b"], main["n_groups"], main["n_links"], main["groups_sha256"])
        assert list(got) == [(*want[i][1:5], want[i][7]) for i, _ in part]
        times = sum(int(alignment.opened(x["times"]).sum()) for x in linked)
        assert times == sum(main["n_links"])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert collected(alignment.align(df)) == plain(libraries, rows)


def test_long_texts_in_parts_and_more_lanes(spark, libraries, monkeypatch):
    text = "One line here.\nAnother, with  blanks \n and it's ends\n\n" * 40
    rows = [(1, text), (2, text + "x"), (3, "short"), (4, text)]
    want = plain(libraries, rows)
    monkeypatch.setattr(alignment, "BATCH_CHARS", 64)
    monkeypatch.setattr(alignment, "LANE_BYTES", 50)
    al = alignment._aligner(alignment.TOKENIZER, alignment.PIECES)
    assert "".join(p for _, p in alignment.parts_of(text, 0)) == " " + text and len(list(alignment.parts_of(text, 0))) > 10
    main, *_ = alignment._batch(al, ["d"], np.ones(1, np.int64), [text])
    assert (main["n_a"][0], main["n_b"][0], main["n_groups"][0], main["n_links"][0]) == want[0][1:5] and main["groups_sha256"][0] == want[0][7]
    assert collected(alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_no_rows(no_docs):
    assert alignment.align(no_docs).count() == 0


def test_packed_integers():
    r = np.random.default_rng(0)
    for x in (np.zeros(0, np.int64), np.sort(r.integers(0, 1 << 60, 500)), np.array([5, 3, -7], np.int64)):
        assert (alignment.opened(alignment.sealed(x)) == x).all()


def test_best_of_ties():
    pairs = np.array([10, 11, 12, 20, 31, 35])
    assert alignment.best_of(pairs, np.array([3, 3, 1, 7, 2, 9]), 10).tolist() == [True, True, False, True, False, True]
