import random
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import documents, empty, odd_rows, prose

from rippleflow.llm import components as cc
from rippleflow.llm import minhash


def shingle_weights(text, idf):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    raw = b" ".join(low)
    h, _ = minhash.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    rare = dict(zip(low, (idf[minhash._counter(np.array([x]))[0]] for x in h)))
    if not low:
        return {}
    grams = [tuple(low[i : i + 5]) for i in range(len(low) - 4)] or [tuple(low)]
    return {g: n * sum(rare[w] for w in g) / len(g) for g, n in Counter(grams).items()}


def similarity(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def brute(spark, rows):
    f, n = minhash.document_frequencies(documents(spark, rows))
    idf = minhash.idf_weights(f, n)
    vectors, root = [shingle_weights(t, idf) for _, t, *_ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, v in enumerate(vectors):
        for k in v:
            by[k].add(i)
    for i, j in {(i, j) for g in by.values() for i in g for j in g if i < j}:
        if similarity(vectors[i], vectors[j]) >= 0.8 - 1e-12:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def family(seed, n, words=120, edits=6):
    rng, base, out = random.Random(seed), prose(seed, words).split(), []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    texts = [prose(i, 60 + i % 50) for i in range(60)] + [t for k in range(8) for t in family(500 + k, 9)] + family(900, 60, edits=3)
    common = prose(7777, 40)
    texts += [prose(2000 + i, 60) + " " + common for i in range(40)]
    random.Random(3).shuffle(texts)
    return [(i, t, None, None, None) for i, t in enumerate(texts)]


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 32)
    monkeypatch.setattr(minhash, "HUBS", 8)
    rows = corpus()
    want, least = brute(spark, rows), {}
    for (i, *_), r in zip(rows, want):
        least[r] = min(i, least.get(r, i))
    got = {r.doc_id: r for r in minhash.digest(documents(spark, rows)).collect()}
    assert {i: got[i].class_id for i in got} == {i: least[r] for (i, *_), r in zip(rows, want)}
    sizes = Counter(want)
    assert all(got[i].class_size == sizes[r] for (i, *_), r in zip(rows, want))
    assert sorted(i for i in got if got[i].kept) == sorted(least.values())


def test_star_classes_in_split_groups_equal_brute_force(spark, monkeypatch):
    """Variants are near to their base only; second groups are split too."""
    monkeypatch.setattr(minhash, "CHUNK", 8)
    monkeypatch.setattr(minhash, "HUBS", 2)
    rng, texts = random.Random(8), [prose(40 + i, 60) for i in range(10)]
    for k in range(2):
        base = prose(3000 + k, 120).split()
        texts.append(" ".join(base))
        for i in range(60):
            w, at = list(base), rng.randrange(5, 50)
            for x in (at, at + 60):
                w[x] = f"q{k}x{i}x{x}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows, least = [(i, t, None, None, None) for i, t in enumerate(texts)], {}
    want = brute(spark, rows)
    for i, r in enumerate(want):
        least.setdefault(r, i)
    assert sorted(Counter(want).values())[-2:] == [61, 61]
    got = {r.doc_id: r.class_id for r in minhash.digest(documents(spark, rows)).collect()}
    assert got == {i: least[r] for i, r in enumerate(want)}


def test_words_equal_a_regular_expression():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab \t\néA\x0b\x00.", k=rng.randint(0, 30))).encode() for _ in range(200)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, owner = minhash.words(raw, offsets)
    found = [(i, w.lower()) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert owner.tolist() == [i for i, _ in found]
    assert len({(w, x) for (_, w), x in zip(found, h.tolist())}) == len({w for _, w in found}) == len(set(h.tolist()))


def test_shared_samples_estimate_weighted_similarity():
    rng, n = np.random.default_rng(5), 400
    code = rng.integers(0, 2**63, n, dtype=np.uint64)
    wa, wb = rng.gamma(2, 1, n), rng.gamma(2, 1, n)
    wb[: n // 2] = wa[: n // 2]
    true, got = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), []
    for seed in range(40):
        s = minhash.Sampler(seed)
        one, two = (s.sample(np.zeros(n, np.int64), np.sort(code), w[np.argsort(code)], 1) for w in (wa, wb))
        got.append((one == two).mean())
    assert abs(np.mean(got) - true) < 0.04


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}
    for u, v in edges:
        a, b = root.setdefault(u, {u}), root.setdefault(v, {v})
        if a is not b:
            a |= b
            for x in b:
                root[x] = a
    df = spark.createDataFrame(edges, "u long, v long")
    want = {x: min(g) for x, g in root.items() if min(g) != x}
    assert dict(map(tuple, cc.components(df).collect())) == want


def test_odd_rows(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    out = minhash.digest(docs).collect()
    assert len(out) == len(rows)
    assert {r.class_id for r in out if r.doc_id in (1, 2)} == {1} and sum(r.kept for r in out if r.class_size == 4) == 1
    kept = minhash.deduplicate(docs).collect()
    assert len(kept) == len(rows) - 3 and sum(r.text == rows[0][1] for r in kept) == 1
    assert minhash.digest(empty(spark)).count() == 0 and minhash.deduplicate(empty(spark)).count() == 0
    clash = docs.withColumnRenamed("lang", "node").withColumnRenamed("source", "__row")
    assert minhash.deduplicate(clash).columns == clash.columns
