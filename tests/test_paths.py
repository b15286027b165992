"""Bounded searches, sketches and batches against searches from every node."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from rippleflow.operators import graph, paths


def df(spark, pairs):
    return spark.createDataFrame(pairs or [], "src long, dst long")


def search(near, s):
    seen, todo = {s: 0}, deque([s])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def neighbours(pairs, both=True):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        if both:
            near.setdefault(b, set()).add(a)
    return near


def connected(seed, n, m):
    rng = random.Random(seed)
    return [(i, rng.randrange(i)) for i in range(1, n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


SHAPES = {
    "path": [(i, i + 1) for i in range(7)],
    "grid": [(4 * i + j, 4 * i + j + 1) for i in range(3) for j in range(3)] + [(4 * i + j, 4 * i + j + 4) for i in range(2) for j in range(4)],
    "tree": [(i, (i - 1) // 2) for i in range(1, 15)],
    "random": connected(4, 18, 9),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_diameter(spark, name):
    near = neighbours(SHAPES[name])
    assert paths.diameter(df(spark, SHAPES[name]), batch=7) == max(max(search(near, s).values()) for s in near)


def test_diameter_holds_no_square(spark, monkeypatch):
    """Searches of the fringe go by batches: never more than a batch's rows a node."""
    most = []
    kept = paths.cut
    monkeypatch.setattr(paths, "cut", lambda x: (y := kept(x), most.append(y.count()))[0])
    pairs = SHAPES["random"]
    paths.diameter(df(spark, pairs), batch=2)
    assert max(most) <= max(2 * 18, 2 * len(set(map(frozenset, pairs))))


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_eccentricities(spark, name):
    near = neighbours(SHAPES[name])
    both, nodes = df(spark, sorted({(a, b) for a in near for b in near[a]})), sorted(near)[::2]
    got = {r.node: r.ecc for r in paths.eccentricities(both, spark.createDataFrame([(x,) for x in nodes], "node long")).collect()}
    assert got == {x: max(search(near, x).values()) for x in nodes}


def test_hubs_settle_their_partners(spark, monkeypatch):
    """Leaves of hubs that reach all in time are not searched: one search, not one for every few dozen leaves."""
    calls, kept = [], paths.eccentricities
    monkeypatch.setattr(paths, "eccentricities", lambda both, sources: (calls.append(sources.count()), kept(both, sources))[1])
    pairs = [(i, j) for i in range(6) for j in range(i)] + [(i % 6, 100 + i) for i in range(120)]
    assert paths.diameter(df(spark, pairs), least=6) == 3
    assert len(calls) == 1 and calls[0] < 20


def test_no_edges(spark):
    none = df(spark, [])
    assert paths.diameter(none) == 0 and paths.reach_sketches(none).count() == 0
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert {r.betweenness for r in paths.betweenness(none, nodes).collect()} == {0.0} and paths.edge_betweenness(none, nodes).count() == 0


@pytest.mark.parametrize("lg_k", [6, 12])
def test_sketches_keep_their_bound(spark, lg_k):
    rng = random.Random(11)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(900)) if a != b})
    near = neighbours(pairs, both=False)
    got = {r.node: r for r in paths.reach_sketches(df(spark, pairs), lg_k).collect()}
    assert set(got) == {x for p in pairs for x in p}
    errors, totals = [], []
    for v, r in got.items():
        d = search(near, v)
        n, total = len(d) - 1, sum(d.values())
        if n:
            errors.append(r.reached / n - 1)
            totals.append(r.total / total - 1)
        else:
            assert (r.reached, r.total) == (0, 0)
    bound = 1.04 / 2 ** (lg_k / 2)
    spread = lambda x: (sum(e * e for e in x) / len(x)) ** 0.5
    assert spread(errors) < 1.5 * bound and spread(totals) < 2 * bound


def test_closeness_sketch(spark):
    pairs = SHAPES["grid"]
    nodes = graph.nodes_of(df(spark, pairs))
    exact = {r.node: r.closeness for r in graph.closeness(df(spark, pairs), nodes).collect()}
    assert {r.node: r.closeness for r in paths.closeness_sketch(df(spark, pairs), nodes).collect()} == pytest.approx(exact, rel=0.02)


def test_betweenness_in_batches(spark, tmp_path):
    pairs = sorted(set(SHAPES["random"]))
    e, nodes = df(spark, pairs), graph.nodes_of(df(spark, pairs))
    whole = {r.node: r.betweenness for r in graph.betweenness(e, nodes).collect()}
    links = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(e, nodes).collect()}
    folder = str(tmp_path / "sums")
    assert {r.node: r.betweenness for r in paths.betweenness(e, nodes, 9, folder).collect()} == pytest.approx(whole)
    assert {(r.src, r.dst): r.betweenness for r in paths.edge_betweenness(e, nodes, 9).collect()} == pytest.approx(links)
    # A stopped job: one batch lost its end, and only it is made again.
    kept = sorted((tmp_path / "sums").iterdir())
    assert len(kept) == 2
    (kept[1] / "_SUCCESS").unlink()
    times = {p: (p / "_SUCCESS").stat().st_mtime_ns for p in kept[:1]}
    assert {r.node: r.betweenness for r in paths.betweenness(e, nodes, 9, folder).collect()} == pytest.approx(whole)
    assert (kept[1] / "_SUCCESS").exists() and all((p / "_SUCCESS").stat().st_mtime_ns == t for p, t in times.items())


def test_sampled_betweenness_is_within_its_bound(spark):
    pairs = sorted(set(SHAPES["random"]))
    e, nodes = df(spark, pairs), graph.nodes_of(df(spark, pairs))
    whole = {r.node: r.betweenness for r in graph.betweenness(e, nodes).collect()}
    some = nodes.orderBy(F.md5(F.col("node").cast("string"))).limit(9)
    got = {r.node: r.betweenness for r in paths.betweenness(e, nodes, 9, sample=some).collect()}
    assert max(abs(got[v] - whole[v]) for v in whole) <= paths.sample_bound(18, 9) and sum(got.values()) > 0
    assert paths.sample_bound(1000, 400) < paths.sample_bound(1000, 100)


def test_core_numbers_of_long_chains(spark, monkeypatch):
    """A chain needs no more rounds than a short one; mixed with denser parts all values are right."""
    rounds = []
    kept = graph.cut
    monkeypatch.setattr(graph, "cut", lambda x: (rounds.append(1), kept(x))[1])
    counts = []
    for n in (60, 240):
        rounds.clear()
        got = graph.core_numbers(df(spark, [(i, i + 1) for i in range(n)])).collect()
        assert len(got) == n + 1 and {r.core for r in got} == {1}
        counts.append(len(rounds))
    assert counts[1] - counts[0] <= 12  # components' labels take a few jumps more
    pairs = [(a, b) for a in range(6) for b in range(a)] + [(i, i + 1) for i in range(5, 12)] + [(100 + i, 100 + (i + 1) % 5) for i in range(5)] + [(200, 201)]
    core = {r.node: r.core for r in graph.core_numbers(df(spark, pairs)).collect()}
    assert all(core[i] == 5 for i in range(6)) and all(core[i] == 1 for i in range(6, 13)) and all(core[100 + i] == 2 for i in range(5)) and core[200] == 1


def test_betweenness_writes_no_row_a_source_and_node(spark, monkeypatch):
    """Two separate rings with chords: no more rows are written than there are links, whatever the number of pairs."""
    rng = random.Random(11)
    pairs = sorted({(100 * c + i, 100 * c + j) for c in (0, 1) for i in range(20) for j in ((i + 1) % 20, rng.randrange(20)) if i != j})
    near, back, whole = neighbours(pairs, both=False), neighbours([(b, a) for a, b in pairs], both=False), {}
    for s in near:
        d = search(near, s)
        count, delta = {s: 1.0}, dict.fromkeys(d, 0.0)
        for v in sorted(d, key=d.get)[1:]:
            count[v] = sum(count[u] for u in back[v] if d.get(u) == d[v] - 1)
        for v in sorted(d, key=d.get, reverse=True)[:-1]:
            whole[v] = whole.get(v, 0.0) + delta[v]
            for u in back[v]:
                if d.get(u) == d[v] - 1:
                    delta[u] += count[u] / count[v] * (1 + delta[v])
    most, kept = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda x: (y := kept(x), most.append(y.count()))[0])
    monkeypatch.setattr(paths, "CELLS", 300)  # a few sources at a time
    e, n = df(spark, pairs), len(near)
    got = {r.node: r.betweenness for r in paths.betweenness(e, graph.nodes_of(e)).collect()}
    assert got == pytest.approx({v: t / ((n - 1) * (n - 2)) for v, t in whole.items()})
    assert most and max(most) <= len(pairs)
