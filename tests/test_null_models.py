"""Null models and clustering by copy against counts by hand; places that survive another input order."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rippleflow.functions.random import u01
from rippleflow.operators import null_models, order


def network(seed, n=26, m=90):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b} | {(1, 0), (0, 1)})


def directed_by_hand(edges, n):
    """Triangles in all directions around every node, by enumeration."""
    s = set(edges)
    total = 0.0
    for i in {x for e in edges for x in e}:
        tot = sum(i in e for e in s)
        mutual = sum((b, a) in s for a, b in s if a == i)
        found = 0
        near = {b for a, b in s if a == i} | {a for a, b in s if b == i}
        for j, k in combinations(sorted(near), 2):
            found += (((i, j) in s) + ((j, i) in s)) * (((j, k) in s) + ((k, j) in s)) * (((k, i) in s) + ((i, k) in s))
        total += found / (tot * (tot - 1) - 2 * mutual) if found else 0.0
    return total / n


def undirected_by_hand(edges, n):
    s = {frozenset(e) for e in edges}
    near = {i: {j for e in s if i in e for j in e if j != i} for e in s for i in e}
    closed = {i: sum(frozenset(p) in s for p in combinations(x, 2)) for i, x in near.items()}
    local = sum(2 * closed[i] / (len(x) * (len(x) - 1)) for i, x in near.items() if len(x) > 1)
    wedges = sum(len(x) * (len(x) - 1) / 2 for x in near.values())
    return local / n, sum(closed.values()) / wedges if wedges else 0.0


def test_clustering_by_copy(spark):
    graphs = {c: network(c) for c in range(4)} | {4: [(1, 2), (2, 3)]}
    df = spark.createDataFrame([(c, a, b) for c, e in graphs.items() for a, b in e], "copy int, src long, dst long")
    got = {r.copy: r.clustering for r in null_models.directed_clustering(df, 30).collect()}
    assert got == pytest.approx({c: directed_by_hand(e, 30) for c, e in graphs.items()}) and got[4] == 0
    both = {r.copy: (r.clustering, r.transitivity) for r in null_models.undirected_clustering(df, 30).collect()}
    for c, e in graphs.items():
        assert both[c] == pytest.approx(undirected_by_hand(e, 30))


def test_copies_keep_degrees(spark):
    edges = network(9, 60, 200)
    df = spark.createDataFrame(edges, "src long, dst long")
    e = null_models.directed_copies(df, u01, 20).collect()
    assert {r.copy for r in e} == set(range(20)) and len({(r.copy, r.src, r.dst) for r in e}) == len(e) and all(r.src != r.dst for r in e)
    for c in range(20):
        mine = [(r.src, r.dst) for r in e if r.copy == c]
        assert 0.8 * len(edges) <= len(mine) <= len(edges) and set(mine) != set(edges)
        for side in (0, 1):
            assert all(sum(x[side] == v for x in mine) <= sum(x[side] == v for x in edges) for v in range(60))
    u = null_models.undirected_copies(df, u01, 10).collect()
    links = {frozenset(x) for x in edges}
    for c in range(10):
        mine = [(r.src, r.dst) for r in u if r.copy == c]
        assert all(a < b for a, b in mine) and 0.8 * len(links) <= len(mine) <= len(links)
        assert all(sum(v in x for x in mine) <= sum(v in x for x in links) for v in range(60))
    assert sorted(map(tuple, null_models.directed_copies(df.repartition(7), u01, 20).collect())) == sorted(map(tuple, e))


def test_summary(spark):
    """A ring of cliques is far more clustered than chance; mean and deviation are those of the copies."""
    edges = [(c * 5 + a, c * 5 + b) for c in range(12) for a in range(5) for b in range(a)] + [(c * 5, (c * 5 + 6) % 60) for c in range(12)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.measure: r for r in null_models.clustering_against_chance(df, u01, 6, 5).collect()}
    copies = null_models.directed_copies(df, u01, 6).collect()
    xs = [directed_by_hand([(r.src, r.dst) for r in copies if r.copy == c], 60) for c in range(6)]
    mean = sum(xs) / 6
    sd = (sum((x - mean) ** 2 for x in xs) / 6) ** 0.5
    r = got["directed"]
    assert (r.observed, r.null_mean, r.null_sd, r.copies) == pytest.approx((directed_by_hand(edges, 60), mean, sd, 6))
    assert r.z == pytest.approx((r.observed - mean) / sd) and r.ratio > 3 and got["transitivity"].ratio > 3 and got["undirected"].copies == 5
    assert null_models.clustering_against_chance(df.limit(0), u01).count() == 0


def test_places_do_not_depend_on_the_order_of_input(spark):
    """What is dealt was written first: reading it twice, as a lost task would, gives each row the same place and range."""
    rows = [(i % 7, i) for i in range(500)] + [(3, 3)] * 200
    df = spark.createDataFrame(rows, "x int, y int")
    for given in (df, df.orderBy(F.desc("y")).repartition(9)):
        got = [tuple(r) for r in order.numbered(given, ["x", "y"], "k").collect()]
        assert [g[:2] for g in sorted(got, key=lambda g: g[2])] == sorted(rows) and sorted(g[2] for g in got) == list(range(700))
    plan = order.numbered(df, ["x"], "k")._jdf.queryExecution().toString()
    assert "rand(" not in plan
