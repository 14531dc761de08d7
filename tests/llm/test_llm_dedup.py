"""Exact, near and substring dedup against plain versions over sf0.001 plus odd rows."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pitchlens.llm import components, exact_dedup, simhash, substring_dedup


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def by_row(rows):
    return Counter(tuple(r) for r in rows)


def test_cuckoo_index_inserts_deletes_and_grows():
    index, rng, live = exact_dedup.CuckooIndex(2), random.Random(3), {}
    for n in range(4000):
        t = f"text {rng.randrange(1500)}"
        if rng.random() < 0.3 and t in live:
            assert index.delete(sha(t), t).keep_id == live.pop(t)
        else:
            index.add(sha(t), t, n)
            live[t] = n
    assert {e.text: e.keep_id for e in index.live()} == live and index.size == len(live) and index.resizes > 3
    assert index.find(sha("never"), "never") is None and index.delete(sha("never"), "never") is None


def test_cuckoo_hits_are_verified_against_content():
    index = exact_dedup.CuckooIndex()
    key = "ab" * 32
    assert index.add(key, "one", 1) and index.add(key, "other", 2)  # one digest, two texts
    assert not index.add(key, "one", 5) and index.find(key, "one").keep_id == 5 and index.find(key, "other").n == 1


def test_exact_dedup(docs, doc_rows):
    groups = defaultdict(list)
    for i, t, *_ in doc_rows:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, sha(t))] += 1
    got = exact_dedup.assign(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert by_row(got.collect()) == want


def test_exact_keep_rows(docs, doc_rows):
    out = exact_dedup.keep_rows(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in out.collect()]
    keep = {}
    for i, t, *_ in doc_rows:
        keep[t or ""] = max(keep.get(t or "", (False, 0)), (i is not None, i or 0))
    assert sorted((t, i) for i, t in got) == sorted((t, i) for t, (_, i) in keep.items())


def test_flush_keeps_results(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FLUSH_BYTES", 50)
    rows = [("k%02d" % (n % 7)) * 10 for n in range(100)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"i": list(range(100)), "d": [sha(t) for t in rows], "t": rows})
    parts = list(exact_dedup._local(8)([batch]))
    assert len(parts) > 1 and sum(sum(b["n"].to_pylist()) for b in parts) == 100
    merged = sorted((b for p in parts for b in p.to_pylist()), key=lambda r: r["bucket"])
    out = [r for b in exact_dedup._merge([pa.RecordBatch.from_pylist(merged, schema=exact_dedup._REPS)]) for r in b.to_pylist()]
    assert {r["digest"]: (r["keep_id"], r["n"]) for r in out} == {
        sha(t): (max(n for n in range(100) if rows[n] == t), rows.count(t)) for t in set(rows)}


def plain_print(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def plain_components(fps, radius=3):
    fps, par = list(fps), list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {f: find(k) for k, f in enumerate(fps)}


def test_simhash_classes(docs, doc_rows):
    fps = [plain_print(t) for _, t, *_ in doc_rows]
    root = plain_components(sorted(set(fps)))
    least = defaultdict(list)
    for (i, *_), f in zip(doc_rows, fps):
        if i is not None:
            least[root[f]].append(i)
    want = Counter((i, f - (1 << 64) if f >> 63 else f, min(least[root[f]], default=None)) for (i, *_), f in zip(doc_rows, fps))
    assert by_row(simhash.classes(docs, tile_rows=16).collect()) == want


def test_simhash_keep_rows(docs):
    out = simhash.keep_rows(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    want = {r["component_id"] for r in simhash.classes(docs).collect()}
    assert set(got) == want and max(got.values()) == 1


def test_linked_matches_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    x = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)])
    want = {(a, b) for a, b in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3))}
    for block in (1 << 10, 1 << 30):
        got = [(a, b) for i, j in simhash.linked(x, x, 3, block) for a, b in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parts = defaultdict(set)
    for n, r in got.items():
        parts[r].add(n)
    assert sorted(map(len, parts.values())) == [2, 100, 201]


def plain_removed(rows, span=50):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - span + 1):
                key = tuple(w[k:k + span])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if i is not None and first[tuple(w[k:k + span])] < i:
                gone[k:k + span] = [True] * span
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_substring_dedup(docs, doc_rows):
    got = substring_dedup.dedup(docs)
    want = plain_removed(doc_rows)
    assert by_row(got.drop("kept_text").collect()) == want and sum(k[2] for k in want) > 200
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_substring_dedup_short_spans(spark):
    rng = random.Random(2)
    rows = [(n, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for n in range(60)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), span=8, gram=3)
    assert by_row(got.drop("kept_text").collect()) == plain_removed(rows, 8)


def test_prefilter_never_misses(spark):
    """A sketch far too small lets everything pass and changes nothing."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdef") for _ in range(30)) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:5]], "text string")
    shared = substring_dedup.prefilter(df, 18, 10, 5)
    assert np.unpackbits(shared).sum() > 0


def test_sliding_argmin():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 26):
        x = rng.integers(0, 9, 80)
        assert substring_dedup.sliding_argmin(x, width).tolist() == [k + int(x[k:k + width].argmin()) for k in range(80 - width + 1)]


def test_empty_tables(no_docs):
    assert exact_dedup.assign(no_docs).count() == 0 and exact_dedup.keep_rows(no_docs).columns == no_docs.columns
    assert simhash.classes(no_docs).count() == 0 and simhash.keep_rows(no_docs).count() == 0
    assert substring_dedup.dedup(no_docs).count() == 0


def test_id_types_are_kept(docs):
    small = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert dict(exact_dedup.assign(small).dtypes)["doc_id"] == "int"
