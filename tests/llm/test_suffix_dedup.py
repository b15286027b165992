import hashlib
import random
from collections import Counter

import pytest
from helpers import documents, empty, odd_rows

from rippleflow.llm import suffix_dedup


def brute(texts):
    n, count, out = suffix_dedup.LENGTH, Counter(), []
    for t in texts:
        count.update(t[i : i + n] for i in range(len(t) - n + 1))
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        kept = bytes(c for c, m in zip(t, mark) if not m)
        runs = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out.append((len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def mosaic(seed, n):
    rng, words = random.Random(seed), ["ab", "cde", "the", "of", "é", "xyz", "tion"]
    passages = [" ".join(rng.choices(words, k=rng.randint(40, 160))) for _ in range(10)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                parts.append(p[a : a + rng.randint(20, 600)])
            else:
                parts.append(" ".join(rng.choices(words, k=rng.randint(1, 60))))
        rows.append((i, " ".join(parts), None, None, None))
    return rows


def check(spark, rows):
    got = suffix_dedup.digest(documents(spark, rows)).collect()
    want = brute([(t or "").encode() for _, t, *_ in rows])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    return sum(w[1] for w in want)


def test_equals_brute_force(spark):
    assert check(spark, [*mosaic(4, 150), (900, "a" * 1000, None, None, None), (901, "ab" * 700, None, None, None)]) > 10000


def test_groups_that_are_split_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST", 5)
    assert check(spark, mosaic(5, 120)) > 5000


def test_long_texts_in_parts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 700)
    assert check(spark, mosaic(6, 80)) > 2000


def test_odd_rows(spark):
    check(spark, [r for r in odd_rows() if r[0] != 7])
    assert suffix_dedup.digest(empty(spark)).count() == 0
    clash = documents(spark, mosaic(7, 20)).withColumnRenamed("lang", "__spans").withColumnRenamed("source", "at")
    assert suffix_dedup.remove_repeats(clash).count() == 20


@pytest.mark.parametrize("seed", range(5))
def test_every_window_names_one_anchor_and_equal_windows_equal_ones(seed):
    import numpy as np

    rng = random.Random(seed)
    part = bytes(rng.choices(b"abcd ", k=700))
    a, b = part, bytes(rng.choices(b"abcd ", k=333)) + part
    named = []
    for raw in (a, b):
        at, first, last, h, _ = suffix_dedup.anchors(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
        places = {s: (i, x) for i, f, e, x in zip(at, first, last, h) for s in range(f, e + 1)}
        assert sorted(places) == list(range(len(raw) - suffix_dedup.LENGTH + 1))
        named.append(places)
    assert all(named[0][s][0] + 333 == named[1][s + 333][0] and named[0][s][1] == named[1][s + 333][1] for s in named[0])


def test_intervals_and_maximal_repeats():
    assert sorted(suffix_dedup.intervals([0, 1, 3, 0, 2])) == [(1, 0, 2), (2, 3, 4), (3, 1, 2)]
    x = bytes(range(65, 91)) * 20
    rng = random.Random(1)
    left = bytes(rng.choices(b"pq", k=100))
    contexts = [(left + x[:300], 20, 100), (b"z" + left[1:] + x[:300], 20, 100), (left[:50] + b"!" * 50 + x[:300], 20, 100)]
    got = suffix_dedup.repeats(contexts)
    assert (-100, 180) not in got[2] and max(e for _, e in got[0]) == 180 and min(s for s, _ in got[0]) == -99
