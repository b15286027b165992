"""Graph operators on hand-made networks and against plain algorithms on random ones."""

import itertools
import random
from collections import defaultdict, deque

import pytest

from rippleflow.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def table(df):
    return {r[0]: r[1] for r in df.collect()}


CYCLE_TAIL = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 1), (4, 6), (5, 7)]


def random_graph(seed, n=24, m=50):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def search(pairs, s):
    out, dist, queue = defaultdict(list), {s: 0}, deque([s])
    for a, b in pairs:
        out[a].append(b)
    while queue:
        x = queue.popleft()
        for y in out[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                queue.append(y)
    return dist


def test_tiers_of_chain_isolates_and_closed_cycles(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (8, 9), (9, 8)]
    assert table(graph.tiers(edges(spark, pairs), nodes(spark, [1, 2, 3, 4, 8, 9, 10]))) == {1: 3, 2: 2, 3: 1, 4: 0, 8: None, 9: None, 10: -1}


def test_bow_tie(spark):
    assert table(graph.bow_tie(edges(spark, CYCLE_TAIL))) == {1: "LSCC", 2: "LSCC", 3: "LSCC", 4: "OUT", 6: "OUT", 5: "IN", 7: "TENDRILS_IN"}


def test_components(spark):
    pairs = random_graph(3, 30, 40)
    both = pairs + [(b, a) for a, b in pairs]
    weak = {x: min(search(both, x)) for x in {x for p in pairs for x in p}}
    assert table(graph.weak_components(edges(spark, pairs))) == weak
    reach = {x: set(search(pairs, x)) for x in weak}
    strong = {x: max(y for y in reach[x] if x in reach[y]) for x in weak}
    assert table(graph.strong_components(edges(spark, pairs))) == strong


def test_distances_and_closeness(spark):
    pairs = random_graph(4)
    ids = sorted({x for p in pairs for x in p})
    want = {(s, x): d for s in ids for x, d in search(pairs, s).items() if d}
    assert {(r.source, r.node): r.d for r in graph.distances(edges(spark, pairs)).collect()} == want
    got = table(graph.closeness(edges(spark, pairs), nodes(spark, ids)))
    for x in ids:
        ds = [d for (s, y), d in want.items() if y == x]
        assert got[x] == pytest.approx((len(ds) / sum(ds)) * (len(ds) / (len(ids) - 1)) if ds else 0)


def all_paths(pairs, s, t):
    """All shortest paths."""
    dist = search(pairs, s)
    if t not in dist:
        return []
    back = defaultdict(list)
    for a, b in pairs:
        if a in dist and dist.get(b) == dist[a] + 1:
            back[b].append(a)

    def up(x):
        return [[s]] if x == s else [p + [x] for y in back[x] for p in up(y)]

    return up(t)


def test_betweenness_of_nodes_and_edges(spark):
    pairs = random_graph(5, 16, 36)
    ids = sorted({x for p in pairs for x in p})
    node, edge, n = defaultdict(float), defaultdict(float), len(ids)
    for s, t in itertools.permutations(ids, 2):
        paths = all_paths(pairs, s, t)
        for p in paths:
            for x in p[1:-1]:
                node[x] += 1 / len(paths)
            for e in zip(p, p[1:]):
                edge[e] += 1 / len(paths)
    got = table(graph.betweenness(edges(spark, pairs), nodes(spark, ids)))
    assert all(got[x] == pytest.approx(node[x] / ((n - 1) * (n - 2))) for x in ids)
    for r in graph.edge_betweenness(edges(spark, pairs), nodes(spark, ids)).collect():
        assert r.betweenness == pytest.approx(edge[r.src, r.dst] / (n * (n - 1)))


def test_core_numbers(spark):
    pairs = random_graph(6, 20, 60)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    core, k, left = {}, 0, {x: set(v) for x, v in near.items()}
    while left:
        x = min(left, key=lambda y: len(left[y]))
        k = max(k, len(left[x]))
        core[x] = k
        for y in left.pop(x):
            left[y].discard(x)
    assert table(graph.core_numbers(edges(spark, pairs))) == core


def test_pagerank_sums_to_one_and_is_stable(spark):
    pairs = random_graph(7)
    ids = sorted({x for p in pairs for x in p})
    rank = table(graph.pagerank(edges(spark, pairs), nodes(spark, ids)))
    assert sum(rank.values()) == pytest.approx(1)
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    loose = sum(rank[x] for x in ids if not out[x])
    for x in ids:
        flow = sum(rank[a] / len(out[a]) for a, b in pairs if b == x)
        assert rank[x] == pytest.approx(0.15 / len(ids) + 0.85 * (flow + loose / len(ids)), abs=1e-4)


def test_communities_beat_single_nodes_and_one_block(spark):
    blocks = [(10 * b + i, 10 * b + j) for b in range(4) for i in range(6) for j in range(6) if i < j]
    pairs = blocks + [(0, 10), (10, 20), (20, 30)]
    e = edges(spark, pairs)
    found = graph.communities(e)
    labels = table(found)
    assert all(len({labels[10 * b + i] for i in range(6)}) == 1 for b in range(4))
    assert graph.modularity(e, found) > 0.6
    assert graph.modularity(e, found.withColumn("community", found["community"] * 0)) == pytest.approx(0)


def test_empty_graph(spark):
    e = edges(spark, [])
    assert graph.weak_components(e).count() == graph.strong_components(e).count() == graph.core_numbers(e).count() == graph.distances(e).count() == 0
