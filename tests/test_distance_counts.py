"""Counts of distances by bits, against a search from every node."""

import random
from collections import Counter, deque

from rippleflow.operators import graph


def made(seed=4):
    rng = random.Random(seed)
    e = {(rng.randrange(60), rng.randrange(60)) for _ in range(110)} | {(100, 101), (101, 102), (102, 100), (7, 7)}
    return sorted(e)


def want(edges, sources=None):
    out = Counter()
    for s in {a for a, _ in edges} if sources is None else sources:
        seen, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v in {b for a, b in edges if a == u} - set(seen):
                seen[v] = seen[u] + 1
                queue.append(v)
        out.update((v, d) for v, d in seen.items() if d)
    return out


def test_counts_equal_a_search_from_every_node(spark):
    edges = made()
    df = spark.createDataFrame(edges + edges[:5], "src long, dst long")
    assert {(r.node, r.d): r.n for r in graph.distance_counts(df).collect()} == dict(want(edges))
    some = spark.createDataFrame([(1,), (2,), (2,), (100,), (999,)], "node long")
    assert {(r.node, r.d): r.n for r in graph.distance_counts(df, some).collect()} == dict(want(edges, {1, 2, 100}))


def test_sources_beyond_one_block(spark):
    n = 70_000  # three blocks of places; all lead to node -1, then to node -2
    df = spark.range(n).selectExpr("id AS src", "-1L AS dst").union(spark.createDataFrame([(-1, -2)], "src long, dst long"))
    assert {(r.node, r.d): r.n for r in graph.distance_counts(df).collect()} == {(-1, 1): n, (-2, 1): 1, (-2, 2): n}


def test_empty(spark):
    assert graph.distance_counts(spark.createDataFrame([], "src long, dst long")).count() == 0
