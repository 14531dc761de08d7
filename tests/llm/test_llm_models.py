"""Language ID, toxicity, language model, piece encoding, page text, mixing and search against plain versions."""
import hashlib
import itertools
import math
import os
import zlib
from fractions import Fraction
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitchlens.llm import langid, maxent_lm, mixing, page_text, pieces, topk, toxicity
from pitchlens.llm._text import chunks

SF = "/root/testdata/sf0.001"
has_model = pytest.mark.skipif(not os.path.exists(pieces.PIECES), reason="piece model not present")


def mod5(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 5


# --- words -------------------------------------------------------------------------------------------------

def test_words_are_those_of_bytes_split():
    texts = ["a  b\tc\n", None, "", " x", "é日 y\x0bz\x0c", "A" * 50 + " b"]
    arr = pa.array(["skip me", *texts])[1:]
    for size in (1, 7, 1 << 20):
        got = []
        for w in chunks(arr, chunk_bytes=size):
            assert w.first == len(got)
            got += [[w.buf[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.bounds, w.bounds[1:])]
        assert got == [(t or "").encode().split() for t in texts]


def test_word_hashes_depend_on_the_word_alone():
    seen = {}
    texts = ["ab abc b ab", "abc c ab ba", " ".join(map(str, range(2000)))]
    for w in chunks(pa.array(texts), chunk_bytes=1):
        for k, h in enumerate(w.hashes()):
            assert seen.setdefault(w.buf[w.start[k]:w.end[k]].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


# --- language ID -------------------------------------------------------------------------------------------

@has_model
def test_forward_sums_all_segmentations():
    trie = langid.Trie(["a", "b", "▁", "ab", "ba", "aba", "▁a", "b▁"])
    ids = {n: k + 1 for k, n in enumerate(trie.names)}
    rng = np.random.default_rng(0)
    prob = rng.random((trie.n, 2))
    for w in chunks(pa.array(["abab é" + "ba" * 30])):
        h, first, kind = langid.kinds(w)
        codes, size = langid.spelled(w, first)
        end = np.cumsum(size)
        got = langid.word_scores(trie, prob, codes, end - size, end)
        counts = langid.expected(trie, prob[:, :1], codes, end - size, end, np.ones((len(h), 1)))
        for k in range(len(w.start)):
            word = " " + w.buf[w.start[k]:w.end[k]].tobytes().decode()
            if len(word) < 12:  # every way to cut the word
                total = np.zeros(2)
                for cuts in itertools.product([0, 1], repeat=len(word) - 1):
                    parts, last = [], 0
                    for p, c in enumerate([*cuts, 1], 1):
                        if c:
                            parts.append(word[last:p])
                            last = p
                    one = [ids.get(x, 0 if len(x) == 1 else None) for x in parts]
                    if None not in one:
                        total += np.prod(prob[one], axis=0)
                assert np.allclose(np.log(total), got[kind[k]])
        sizes = np.array([1, *map(len, trie.names)])
        assert np.isclose((counts[0] * sizes).sum(), len(codes))  # expected pieces cover every character


@has_model
def test_whole_vocabulary_is_used():
    trie = langid.Trie.load()
    assert trie.longest == max(map(len, trie.names)) == 16
    word = max(trie.names, key=len)
    codes = langid._codes(word)
    assert trie.ids(codes, np.full(len(codes), len(codes)))[trie.longest - 1, 0] == trie.names.index(word) + 1


def test_language_id(docs, doc_rows):
    got = langid.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(doc_rows)
    letters = Counter((i, any(c.isalpha() for c in t or "")) for i, t, *_ in doc_rows)
    assert Counter((r["doc_id"], r["lang_pred"] != "und") for r in rows) == letters
    assert all(r["held_out"] == (mod5(r["doc_id"]) == 0) and 0 <= r["score"] <= 1 for r in rows)
    truth = {i: lang for i, _, lang, _ in doc_rows if i is not None and 0 <= i < 9000}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


@has_model
def test_language_id_without_training_rows(edge_docs, no_docs):
    none = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(no_docs).count() == 0
    kept = langid.keep_rows(none)
    assert kept.columns == none.columns and kept.count() == none.where("text rlike '\\\\p{L}'").count()


# --- toxicity ----------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_labels(spark):
    bad, rng = ["vile", "rotten"], np.random.default_rng(0)
    rows, labels = [], []
    for n in range(900):
        words = [f"w{k}" for k in rng.integers(0, 60, 30)]
        toxic, low = int(n % 3 == 0), int(n % 4 == 0)
        words += [bad[n % 2]] * toxic + ["spam"] * low
        rows.append((n, " ".join(words)))
        if n < 600:
            labels.append((n, 1 - low, toxic))
    rows += [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if 600 <= r["doc_id"] < 900]
    assert all(r["toxic"] == (r["doc_id"] % 3 == 0) for r in held)
    assert all((r["p_toxic_low_quality"] > 0.5) == (r["doc_id"] % 12 == 0) for r in held)
    odd = [r for r in got if r["doc_id"] >= 2000]
    assert odd[0]["p_toxic"] == odd[1]["p_toxic"] and not odd[0]["toxic"]


def test_chain_feeds_earlier_categories():
    words = np.zeros(0, np.uint32)
    y = np.array([0, 1] * 50, float)
    odds = toxicity._log_odds(y[:, None] * 0.8 + 0.1)
    m = toxicity.fit_one(words, np.zeros(0, np.int64), y, odds)
    assert m.earlier[0] > 0.5 and ((toxicity.apply_one(m, words, np.zeros(0, np.int64), 100, odds) > 0.5) == y).all()


def test_copies_share_a_fold(spark):
    """Copies of a text are predicted by a model that saw none of them, so a lone copied word tells nothing out of fold."""
    rows = [(k, f"copy {k // 20} words w{k // 20}a w{k // 20}b w{k // 20}c", (k // 20) % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    chain = {"a": F.col("y"), "b": F.col("y")}
    models = toxicity.fit(df, chain, 400)
    assert len(models[1].earlier) == 1 and models[1].earlier[0] < 1.0


def test_toxicity_of_odd_labels(spark, edge_docs):
    labels = spark.createDataFrame([(9015, 1, 1), (9015, 0, 0), (9010, 1, 0), (None, 1, 1), (77777, 0, 1), (9012, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.classify(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["p_toxic"] <= 1 for r in got)


def test_toxicity_without_labels(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(edge_docs, none).collect()
    assert len(rows) == edge_docs.count() and {r["p_toxic"] for r in rows} == {0.5}
    assert toxicity.classify(no_docs, none).count() == 0


# --- language model ----------------------------------------------------------------------------------------

def test_language_model(docs, doc_rows, monkeypatch):
    monkeypatch.setattr(maxent_lm, "VOCAB", 300)  # most words go through the join
    tok = [(i, [*(t or "").encode().lower().split(), None]) for i, t, *_ in doc_rows]
    c = Counter(x for i, t in tok if mod5(i) not in (1, None) for x in t)
    n, low = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    want = sorted((i is None, i or 0, len(t), sum(1 for x in t if c[x]), round(sum(math.log10(c[x] + 0.5) - low for x in t), 5))
                  for i, t in tok)
    rows = maxent_lm.score(docs).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want], atol=1e-4)
    assert {r["train_tokens"] for r in rows} == {n}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in tok if mod5(i) == 1}
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_is_a_distribution():
    """For any history the probabilities of all vocabulary words, the end and the rest add up to one."""
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(1, 2**63, 500, dtype=np.uint64))
    count, cls = rng.integers(1, 90, 500), rng.integers(0, maxent_lm.CLASSES - 1, 500)
    cls[cls == maxent_lm.END_CLASS] += 1
    per = np.bincount(cls, weights=count, minlength=maxent_lm.CLASSES)
    weights = rng.normal(size=(maxent_lm.FEATURES * maxent_lm.BUCKETS, maxent_lm.CLASSES)).astype(np.float32)
    rows = maxent_lm.history(h[:40], np.array([0, 15, 40]))
    p = np.exp(maxent_lm.scores(weights, np.zeros(maxent_lm.CLASSES, np.float32), rows))
    total = (p[:, cls] * (count / per[cls])).sum(axis=1) + p[:, [c for c in range(maxent_lm.CLASSES) if per[c] == 0]].sum(axis=1)
    assert np.allclose(total, 1, atol=1e-4)


def test_history_parts_equal_the_whole():
    tok = np.random.default_rng(1).integers(0, 2**63, 9000, dtype=np.uint64)
    bounds = np.array([0, 1, 1, 4095, 4097, 4100, 9000])
    whole = maxent_lm.history(tok, bounds)
    for k in range(0, 9000, maxent_lm.BATCH):
        assert (maxent_lm.history_part(tok, bounds, k) == whole[k:k + maxent_lm.BATCH]).all()


def test_gradient_steps_raise_the_likelihood():
    rng = np.random.default_rng(0)
    tok = rng.integers(0, 20, 4000).astype(np.uint64)
    rows = maxent_lm.history(tok, np.array([0, 4000]))
    cls = np.append(0, tok[:-1] % 5).astype(np.int64)  # told by the last word
    w, b = np.zeros((maxent_lm.FEATURES * maxent_lm.BUCKETS, maxent_lm.CLASSES), np.float32), np.zeros(maxent_lm.CLASSES, np.float32)
    sq = np.ones_like(w)
    lp = [maxent_lm.gradient_step(w, b, sq, rows, cls) / 4000 for _ in range(30)]
    assert lp[0] < -3 and lp[-1] > -0.3


def test_language_model_of_no_rows(no_docs):
    assert maxent_lm.score(no_docs).count() == 0


# --- pieces ------------------------------------------------------------------------------------------------

TEXTS = ["", "Hello  world\n\n again", "▁ literal ▁▁ x", "naïve 日本語 😀 \t end ", "a" * 300 + " " + "the " * 20, "<s> </s> <0x0A>"]


@has_model
def test_pieces_without_dropout_equal_the_plain_encoder():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.PIECES)
    ids, size = pieces.Encoder(pieces.Pieces.load(), 0, 0, 4).batch(list(range(len(TEXTS))), TEXTS)
    off = np.append(0, np.cumsum(size))
    for k, t in enumerate(TEXTS):
        if "▁" not in t:
            assert ids[off[k]:off[k + 1]].tolist() == sp.encode(t)


@has_model
def test_dropout_varies_and_decodes(docs, doc_rows):
    runs = {}
    for rate, seed in ((0.0, 1), (0.2, 1), (0.2, 2)):
        rows = pieces.encode(docs, rate=rate, seed=seed).collect()
        want = Counter((i, t or "") for i, t, *_ in doc_rows)
        assert Counter((r["doc_id"], r["decoded"]) for r in rows) == want
        runs[rate, seed] = {r["doc_id"]: r["ids"] for r in rows if r["doc_id"] is not None}
    assert runs[0.2, 1] != runs[0.2, 2] and runs[0.2, 1] != runs[0.0, 1]
    again = {r["doc_id"]: r["ids"] for r in pieces.encode(docs.repartition(3), rate=0.2, seed=1).collect() if r["doc_id"] is not None}
    assert again == runs[0.2, 1]  # the seed decides, not the partitions


@has_model
def test_heap_and_matrix_agendas_agree():
    v, drop = pieces.Pieces.load(), pieces.Dropout(0.3, 5)
    rng = np.random.default_rng(0)
    words = [" " + w for w in ("internationalisation", "thethethe", "abababab", "überraschung", "x")] * 20
    for w in words:
        ids, key = v.char_id[[ord(c) for c in w]], np.array([rng.integers(0, 2**63)], np.uint64)
        sym, live = pieces.merge_many(v, ids[None].copy(), key, drop)
        assert pieces.merge_one(v, ids.tolist(), int(key[0]), drop) == sym[0][live[0]].tolist()


@has_model
def test_every_occurrence_draws_its_own_dropout(spark):
    v, seed, rate, n = pieces.Pieces.load(), 3, 0.1, 4000
    drop, word = pieces.Dropout(rate, seed), " internationalisation"
    docs = spark.createDataFrame([(d, (word * n)[1:]) for d in (1, 2)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, rate=rate, seed=seed).collect()}
    plain, kinds = tuple(pieces.merge_one(v, v.char_id[[ord(c) for c in word]].tolist(), 0, pieces.Dropout(0, 0))), Counter()
    for d in (1, 2):
        base, want = pieces.mix64(np.array([(d ^ seed * pieces._GOLD) & pieces.MASK64], np.uint64)), []
        for k in range(n):
            key = int(pieces.mix64(base + np.uint64(k))[0])
            want.append(tuple(pieces.merge_one(v, v.char_id[[ord(c) for c in word]].tolist(), key, drop)))
        assert got[d] == list(itertools.chain.from_iterable(want))
        kinds.update(want)
    assert len(kinds) > 100 and 0 < kinds[plain] < 2 * n
    pair = v.char_id[[ord(c) for c in " t"]].tolist()  # one candidate: skipped in a share of the rate
    pieces_of = pieces.Encoder(v, rate, seed).batch(list(range(20000)), ["t"] * 20000)[1]
    assert len(pieces.merge_one(v, pair, 0, pieces.Dropout(0, 0))) == 1 and abs((pieces_of == 2).mean() - rate) < 0.01


@has_model
def test_pieces_of_no_rows(no_docs):
    assert pieces.encode(no_docs).count() == 0


# --- page text ---------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/x>%s</a></ul></nav><div class="cookie-notice">We use cookies</div>
%s<aside>side</aside><form><input>f</form><footer>&copy; %s</footer></body></html>"""


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, row string")
    return {r["page_id"]: r for r in page_text.extract(df).collect()}


def test_page_text_of_articles(spark):
    art = "<article><h1>Head &amp; more</h1><p>One <b>two</b>\n three<br>four &lt;p&gt;&nbsp;x<p>five<div class=comments>no</div></article>"
    rows = [(1, "http://a.com/x/1", PAGE % ("n1", art, "1"), "h", "r"), (2, "http://a.com/x/2", PAGE % ("n2", art, "2"), "h", "r"),
            (3, None, None, None, None), (4, "http://b.com/", "", None, None), (5, "::", PAGE % ("n", art, "y"), "h", "r"),
            (6, "http://c.com/a", "<p>plain &eacute; page<p>no marks", "h", "r")]
    got = extracted(spark, rows)
    want = "Head & more One two three four <p> x five"
    assert [got[k]["text"] for k in (1, 2, 5)] == [want] * 3 and got[1]["n_chars"] == len(want)
    assert got[3]["text"] == got[4]["text"] == "" and got[3]["n_chars"] == 0 and got[3]["url"] is None
    assert got[6]["text"] == "plain é page no marks"


def test_shared_lines_of_unmarked_pages_go(spark):
    def page(k):
        return f"<div>Welcome to our site</div><div>Top stories</div><p>story {k} part one<p>story {k} part two<div>Call us</div>"

    rows = [(k, f"https://www.site.org/{'ab'[k % 2]}/{k}", page(k), None, None) for k in range(40)]
    rows += [(100, "https://solo.org/", page(100), None, None), (101, "https://twin.org/1", page(7), None, None), (102, "https://twin.org/2", page(7), None, None)]
    got = extracted(spark, rows)
    assert all(got[k]["text"] == f"story {k} part one story {k} part two" for k in range(40))
    assert got[100]["text"].startswith("Welcome") and got[101]["text"] == got[102]["text"] and "story 7" in got[101]["text"]


def test_copies_of_an_unmarked_page_ask_a_page_of_other_content(spark):
    def page(k):
        return f"<div>Welcome to our site</div><div>Top stories</div><p>story {k} part one<p>story {k} part two<div>Call us</div>"

    rows = [(k, f"https://run.org/b?copy={k}", page(1), None, None) for k in range(6)]
    rows += [(10, "https://run.org/m/b", page(1), None, None), (20, "https://run.org/a", page(2), None, None)]
    got = extracted(spark, rows)
    assert len(got) == 8
    assert {got[k]["text"] for k in (0, 1, 2, 3, 4, 5, 10)} == {"story 1 part one story 1 part two"}
    assert got[20]["text"] == "story 2 part one story 2 part two"


def test_differences_decide_beside_marked_parts(spark):
    def cards(k, body):
        return (f"<div>Top menu</div><div>{body}</div><article class='teaser'><p>See also</article>"
                f"<article class='teaser'><p>card {k}</article><div>Imprint</div>")

    def wrapped(k):
        return (f"<div class='page has-sidebar'><div class=share>Share {k}</div><main><p>wrapped text {k} that is long enough</main>"
                f"<div class=promo-box>{'only here' if k == 1 else ''}</div><div>Call us</div></div>")

    rows = [(k, f"http://cards.org/{k}", cards(k, f"long body {k} outside of any mark, as many sites have it"), None, None) for k in (1, 2, 3)]
    rows += [(10 + k, f"http://wrap.org/{k}", wrapped(k), None, None) for k in (1, 2, 3)]
    rows += [(20, "http://form.org/", "<form id=form1><div class=menu>m</div><p>page in a form, all of it</form>", None, None)]
    got = extracted(spark, rows)
    for k in (1, 2, 3):
        assert got[k]["text"] == f"long body {k} outside of any mark, as many sites have it card {k}"
        assert got[10 + k]["text"] == f"wrapped text {k} that is long enough"
    assert got[20]["text"] == "page in a form, all of it"


def test_furniture_always_goes_whatever_a_neighbour_has(spark):
    nav = "<nav><a href=/>Home</a></nav>"
    extra = "<div class='comments'><p>nasty reader comment</div><div class=ad>BUY NOW</div>"
    rows = [(1, "http://w.org/a", nav + "<article><p>T1 body one<p>text here</article>" + extra, None, None),
            (2, "http://w.org/b", nav + "<article><p>T2 other body</article>", None, None),
            (3, "http://lone.org/b", "<article><p>T3 lone<div class=comment>no</div></article>" + extra, None, None)]
    got = extracted(spark, rows)
    assert {k: got[k]["text"] for k in got} == {1: "T1 body one text here", 2: "T2 other body", 3: "T3 lone"}


def test_lines_of_articles_that_recur_on_the_host_go(spark):
    rows = [(k, f"http://many.org/{k:02}", f"<article><p>Story {k} begins<p>Share this story<p>and story {k} ends</article>", None, None)
            for k in range(10)]
    quote = "<p>quoted by a second page</article>"
    rows += [(20 + k, f"http://quotes.org/{k}", f"<article><p>essay {k}{quote if k in (1, 2) else '</article>'}", None, None) for k in range(6)]
    rows += [(30 + k, f"http://two.org/{k}", f"<article><p>page {k}<p>both say this</article>", None, None) for k in range(2)]
    got = extracted(spark, rows)
    assert all(got[k]["text"] == f"Story {k} begins and story {k} ends" for k in range(10))
    assert got[21]["text"] == "essay 1 quoted by a second page" and got[22]["text"] == "essay 2 quoted by a second page"
    assert got[30]["text"] == "page 0 both say this"


def test_alignment_of_many_lines_is_quick():
    r = np.random.default_rng(3)
    x = r.permutation(200_000)
    y = np.append(r.permutation(100_000), x[::2])
    got = page_text.common(x, y)
    assert (np.diff(got) > 0).all() and len(got) >= 100_000


def test_common_is_a_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        kinds = rng.choice([5, 400])  # few kinds of lines: by rows; many: by matching pairs
        x, y = rng.integers(0, kinds, rng.integers(0, 12)), rng.integers(0, kinds, rng.integers(0, 12))
        if kinds > 5 and len(x) > 3 and len(y) > 3:
            y[:3] = x[:3][rng.permutation(3)]
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, j in itertools.product(range(len(x)), range(len(y))):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (x[i] == y[j]))
        at = page_text.common(x, y)
        it = iter(y)
        assert len(at) == best[-1, -1] and all(any(v == u for u in it) for v in x[at])
        order = np.argsort(y, kind="stable")
        pairs = page_text._by_matches(order, np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right"))
        assert len(pairs) == len(at)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_page_text_of_given_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in page_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?(p|br|h1)>", "\n", body))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_page_text_of_no_rows(spark):
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- mixing ------------------------------------------------------------------------------------------------

def check_mix(got, rows, share, block_rows):
    """Every block within its release and due slot, and every source less than a block from its target until one runs out."""
    assert [r["position"] for r in got] == list(range(len(rows)))
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    assert all(r["release"] <= r["slot"] < r["due"] for r in got)
    done, slots = Counter(), sorted({(r["slot"], r["source"] or "-") for r in got})
    ends = Counter((s or "-") for _, s in rows)
    total = sum(share.values())
    for t, (slot, s) in enumerate(slots):
        if any(done[x] * block_rows >= ends[x] for x in share if share[x]):
            return t
        assert slot == t
        done[s] += 1
        assert all(abs(done[x] - share[x] / total * (t + 1)) < 1 + 1e-3 for x in share)
    return len(slots)


def test_mixing_stays_within_a_block(spark):
    rows = [(n, s) for s, k in (("a", 400), ("b", 300), ("c", 200), (None, 60)) for n in range(k)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    w = {"a": 0.41, "b": 0.33, "c": 0.2, None: 0.06}
    got = mixing.mix(docs, w, block_rows=2).orderBy("position").collect()
    assert check_mix(got, rows, {(k or "-"): v for k, v in w.items()}, 2) > 300


def test_mixing_holds_uneven_weights_over_a_long_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 64)
    w = {"a": math.sqrt(2), "b": 1.0, "tiny": 0.0003}
    rows = [(n, s) for s, k in (("a", 9000), ("b", 6500), ("tiny", 2)) for n in range(k)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), w, block_rows=1).orderBy("position").collect()
    assert check_mix(got, rows, w, 1) > 15_000
    assert [r["due"] - r["release"] > 5000 for r in got if r["source"] == "tiny"] == [True, True]


def test_mixing_many_sources_and_weight_zero(spark):
    rows = [(n, f"s{n % 3000}") for n in range(9000)] + [(n, "never") for n in range(5)] + [(n, "not named") for n in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, {**{f"s{k}": 1 + k % 2 for k in range(3000)}, "never": 0}, block_rows=1).orderBy("position").collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows) and [r["position"] for r in got] == list(range(len(rows)))
    assert {r["source"] for r in got[-10:]} == {"never", "not named"}
    none = mixing.mix(docs.where("source IN ('never', 'not named')"), {"x": 1.0}, block_rows=2).orderBy("position").collect()
    assert [r["source"] for r in none] == ["never"] * 5 + ["not named"] * 5
    with pytest.raises(ValueError):
        mixing.mix(docs, {"never": -1})


def test_blocks_grow_to_bound_the_fold(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SLOTS", 50)
    rows = [(n, "ab"[n % 2]) for n in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=2).orderBy("position").collect()
    assert len({r["slot"] for r in got}) <= 50 and [r["position"] for r in got] == list(range(1000))


def test_rows_of_one_id_are_numbered_together(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(None, "a")] * 500 + [(1, "a")] * 3 + [(n, "b") for n in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string").repartition(6), block_rows=4).collect()
    assert sorted(r["position"] for r in got) == list(range(603)) and Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)


def test_mixing_edges(docs, doc_rows, no_docs):
    got = mixing.mix(docs, block_rows=3).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, _, _, s in doc_rows)
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    out = mixing.ordered_rows(docs, block_rows=3)
    assert out.columns == docs.columns and Counter(map(str, out.collect())) == Counter(map(str, docs.collect()))
    assert mixing.mix(no_docs).count() == 0 and mixing.ordered_rows(no_docs).count() == 0


# --- search ------------------------------------------------------------------------------------------------

def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(n, [float(x) for x in rng.integers(-2, 3, 4) / 2]) for n in range(400)]
    rows += [(500, None), (501, [1.0, None, 0.0, 1.0]), (502, [1.0, float("nan"), 0.0, 1.0]), (503, [float("inf")] * 4), (None, [1.0] * 4),
             (504, []), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (700, [2.0**40] * 4), (701, [2.0**40] * 4), (10, [9.0, 9.0, 9.0, 9.0]),
             (800, [1e300, -1.0, 0.5, 0.0]), (100, [0.5, 0.5, 0.0, 1.0]), (200, rows[200][1]), *[(300, rows[300][1])] * 9, *[(55, [9.5] * 4)] * 12]
    df = spark.createDataFrame([(i, v, "c", "c") for i, v in rows], "vec_id long, embedding array<double>, ids string, lane string").repartition(4)
    got = Counter(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=7, tile_rows=2, shard_rows=16, lanes=9).collect())
    vec = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for k, (q, u) in enumerate(vec):
        if q % 100 == 0:
            all_ = [(i, max(1 - 2**63, min(sum(a * b for a, b in zip(v, u)), 2**63 - 1))) for n, (i, v) in enumerate(vec) if n != k and len(v) == len(u)]
            want.update((q, r + 1, i, s) for r, (i, s) in enumerate(sorted(all_, key=lambda x: (-x[1], x[0]))[:7]))
    assert got == want


def test_top_k_of_repeated_ids_equals_its_sql(spark):
    import duckdb

    from pitchlens.llm.queries import ORACLE

    rows = [(100, [1.0, 2.0]), (1, [0.5, 1.0]), (1, [3.0, 1.0]), (2, [0.25, 0.0]), (100, [2.0, 2.0]), (200, [1.0, 1.0]), (200, [1.0, 1.0])]
    got = sorted(tuple(r) for r in topk.top_k(*(lambda df: (df, df.where("vec_id % 100 = 0")))(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(con.execute(ORACLE["op10_topk"]).fetchall())


def test_top_k_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


# --- the pipeline ------------------------------------------------------------------------------------------

@has_model
def test_pipeline_against_plain_stages(spark, docs, tmp_path):
    import corpus_pipeline
    from tests.llm.test_llm_dedup import plain_components, plain_print

    path = str(tmp_path / "in")
    docs.write.parquet(f"{path}/documents.parquet")
    got = corpus_pipeline.run(spark, path).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    best = {}
    for i, t in rows:
        best[t] = max(best.get(t, (False, 0)), (i is not None, i or 0))
    rows = [(i, t) for t, (known, i) in best.items() if known]
    fps = {i: plain_print(t) for i, t in rows}
    root = plain_components(sorted(set(fps.values())))
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows if i in set(least.values())}
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == want and len(got) == len(want)
    assert len(corpus_pipeline.STAGES) == 5


@has_model
def test_pipeline_tells_the_place_in_the_mix(spark, tmp_path):
    import corpus_pipeline

    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        rows = [(n, " ".join(f"word{(n * 31 + k * k * 7) % 9973}" for k in range(5 + n % 90 * (n % 7))), "abc"[n % 3] if n % 5 else None)
                for n in range(1200)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        want = {r["doc_id"]: r["position"] for r in mixing.mix(docs).collect()}
        path = str(tmp_path / "mixed")
        corpus_pipeline.mixed(spark, docs, "").write.parquet(path)
        assert sum(f.endswith(".parquet") for f in os.listdir(path)) > 1
        got = corpus_pipeline.encoded(spark, spark.read.parquet(path), "").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert {r["doc_id"]: r["mix_position"] for r in got} == want and len(got) == len(rows)


# --- merging of partial results ----------------------------------------------------------------------------

def test_tree_merge_in_several_levels(spark, monkeypatch):
    from pitchlens.llm import _common

    monkeypatch.setattr(_common, "FAN_IN", 2)
    df = spark.range(0, 1000, 1, 9).select((F.col("id") % 3).alias("k"), F.lit(1).cast("long").alias("n"))
    got = _common.tree_merge(df, ["k"], lambda pdf: pdf.iloc[:1].assign(n=[pdf["n"].sum()]), "k long, n long")
    assert got.columns == ["k", "n"] and {r["k"]: r["n"] for r in got.collect()} == {0: 334, 1: 333, 2: 333}
