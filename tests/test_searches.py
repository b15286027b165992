"""Searches by bits in tasks: several words, chunks and components; no bits are written."""

import random
from collections import Counter, deque

import pytest

from rippleflow.operators import graph, searches


@pytest.mark.parametrize("words", [8, 1 << 23])
def test_counts_and_what_is_written(spark, monkeypatch, words):
    monkeypatch.setattr(searches, "WORDS", words)
    rng, written = random.Random(6), []
    for m in (graph, searches):
        monkeypatch.setattr(m, "cut", lambda x, kept=m.cut: (written.extend(t for _, t in x.dtypes), kept(x))[1])
    edges = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(700)} | {(900 + i, 901 + i) for i in range(30)} | {(950, i) for i in range(960, 1100)})
    ahead, want = {}, Counter()
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    for s in ahead:
        seen, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v in ahead.get(u, set()) - set(seen):
                seen[v] = seen[u] + 1
                queue.append(v)
        want.update((v, d) for v, d in seen.items() if d)
    got = graph.distance_counts(spark.createDataFrame(edges, "src long, dst long"))
    assert {(r.node, r.d): r.n for r in got.collect()} == want
    assert written and "binary" not in written
