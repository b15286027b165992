"""Fingerprints against sets of shingles, one text at a time."""

import hashlib
import random

import numpy as np
import pytest
from helpers import documents, empty, odd_rows, prose

from rippleflow.llm import fingerprints as P


def all_hashes(text):
    one = np.frombuffer(text.encode(), np.uint8)
    return np.unique(P.shingle_hashes(one, np.array([0, len(one)]))[1]) if len(one) else np.zeros(0, np.uint64)


def by_hand(rows):
    """The digest, with every text's hashes computed alone and kept by the definition."""

    def key(r):
        return (r[0] is None, -(r[0] or 0))

    def keep(text):
        h = all_hashes(text)
        return [int(x) for i, x in enumerate(h) if i < P.FLOOR or x < P.THRESHOLD]

    ordered = sorted(rows, key=key)
    out = []
    for i, r in enumerate(ordered):
        text, following = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        out.append((r[0], len(text), hashlib.sha256(new.encode()).hexdigest(), "".join(f"{x:016x}" for x in keep(text)), "".join(f"{x:016x}" for x in keep(new))))
    return out


def first_columns(df):
    return [tuple(r)[:5] for r in df.collect()]


def test_equals_hand_count(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, prose(i % 40, rng.choice([0, 1, 3, 5, 40, 90, 700, 2500])), "en", "a", None) for i in rng.sample(range(1000), 120)]
    want = sorted(by_hand(rows))
    assert sorted(first_columns(P.digest(documents(spark, rows)))) == want
    monkeypatch.setattr(P, "RANGE_BYTES", 20_000)  # many ranges
    assert sorted(first_columns(P.digest(documents(spark, rows).repartition(5)))) == want


def test_odd_rows(spark, monkeypatch):
    rows = [r for r in odd_rows() if r[0] not in (1, None)] + [(1, "é one", "en", "a", 1), (None, "x y z", None, None, None)]
    assert sorted(first_columns(P.digest(documents(spark, rows))), key=str) == sorted(by_hand(rows), key=str)
    monkeypatch.setattr(P, "RANGE_BYTES", 500)
    got = P.digest(documents(spark, odd_rows())).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows())
    one = P.digest(documents(spark, [(3, "a b c d e f g h", "en", "a", 1)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b c d a b c d"[:8] + b"a b c d"[:7]).hexdigest() and one.near_next == 1.0
    assert P.digest(empty(spark)).count() == 0
    clash = documents(spark, odd_rows()).selectExpr("*", "1 AS bucket", "2 AS ghost", "3 AS k0", "4 AS h", "'x' AS fingerprint")
    assert P.digest(clash).count() == len(odd_rows())
    blank = P.digest(documents(spark, [(1, None, "", "", 0), (2, " \n", "", "", 0)])).collect()
    assert all(r.fingerprint == "" and r.near_next == 1.0 for r in blank)


def test_equal_rows_and_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_BYTES", 1000)
    rows = [(7, prose(1, 60), "en", "a", 1)] * 30 + [(i, prose(1, 60), "en", "a", 1) for i in range(20)]
    got = P.digest(documents(spark, rows).repartition(6)).collect()
    assert len(got) == 50 and len({r.fingerprint for r in got}) == 1 and all(r.near_next == 1.0 for r in got)


@pytest.mark.parametrize("size", [30, 400, 6000])
def test_estimates(size):
    errors = []
    for seed in range(12):
        rng = random.Random(seed)
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        share = rng.random()
        other = base[: int(size * share)] + [f"v{rng.randrange(10**6)}" for _ in range(size - int(size * share))]
        a, b = " ".join(base), " ".join(other)
        x, y = set(all_hashes(a).tolist()), set(all_hashes(b).tolist())
        s, t = P._sketches_of([a, b])
        errors.append(P.likeness(s, t) - len(x & y) / len(x | y))
        assert abs(P.containment(s, t) - len(x & y) / len(x)) < 0.2
    assert np.abs(errors).max() < (1e-12 if size < P.FLOOR else 0.2) and abs(np.mean(errors)) < 0.06


def test_containment_of_unequal_documents():
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**6)}" for _ in range(30000)]
    part = long[5000:5600]
    s, t = P._sketches_of([" ".join(part), " ".join(long)])
    assert P.containment(s, t) > 0.95 and abs(P.containment(t, s) - 600 / 30000) < 0.01


def test_merging_and_round_trip(spark):
    texts = [prose(i, n) for i, n in enumerate([3, 50, 80, 900, 4000, 0])]
    found = P._sketches_of(texts)
    for i in range(6):
        assert (P.from_text(P.to_text(found[i])) == found[i]).all()
        for j in range(6):
            both = np.union1d(all_hashes(texts[i]), all_hashes(texts[j]))
            assert P.merged(found[i], found[j]).tolist() == [x for k, x in enumerate(both.tolist()) if k < P.FLOOR or x < int(P.THRESHOLD)]
    docs = documents(spark, [(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(texts)])
    assert {r.doc_id: r.fingerprint for r in P.fingerprint(docs).collect()} == {i: P.to_text(s) for i, s in enumerate(found)}
    got = {(r.key, r.hash) for r in P.collection_hashes(docs, "source").collect()}
    assert got == {("ab"[i % 2], int(np.uint64(x).astype(np.int64))) for i, t in enumerate(texts) for x in all_hashes(t) if x < P.THRESHOLD}


def test_few_shingles_that_repeat():
    text = " ".join(["a b c d e f g h"] * 3000)
    assert P._sketches_of([text])[0].tolist() == all_hashes(text).tolist()
