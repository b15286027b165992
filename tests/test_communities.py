"""Louvain levels on graphs with known communities; the result cache."""

import random
import time

import pytest

from rippleflow.operators import cache, communities, graph
from rippleflow.sources import adapter

#: The friendships of a club of 34 members, by the lower member.
CLUB = {1: [2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 18, 20, 22, 32], 2: [3, 4, 8, 14, 18, 20, 22, 31], 3: [4, 8, 9, 10, 14, 28, 29, 33], 4: [8, 13, 14], 5: [7, 11], 6: [7, 11, 17], 7: [17], 9: [31, 33, 34], 10: [34], 14: [34], 15: [33, 34], 16: [33, 34], 19: [33, 34], 20: [34], 21: [33, 34], 23: [33, 34], 24: [26, 28, 30, 33, 34], 25: [26, 28, 32], 26: [32], 27: [30, 34], 28: [34], 29: [32, 34], 30: [33, 34], 31: [33, 34], 32: [33, 34], 33: [34]}


def cliques(n, size):
    """A ring of n cliques, neighbours joined by one link."""
    edges = [(c * size + a, c * size + b) for c in range(n) for a in range(size) for b in range(a)]
    return edges + [(c * size, ((c + 1) % n) * size + 1) for c in range(n)], {v: v // size for v in range(n * size)}


def planted(groups, size, inside, outside, seed):
    rng = random.Random(seed)
    n = groups * size
    edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < (inside if a // size == b // size else outside)]
    return edges, {v: v // size for v in range(n)}


def modularity(edges, of):
    """By the definition, over distinct undirected links."""
    links = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    m, degree, inner = len(links), {}, 0
    for a, b in links:
        inner += of[a] == of[b]
        degree[of[a]] = degree.get(of[a], 0) + 1
        degree[of[b]] = degree.get(of[b], 0) + 1
    return inner / m - sum((d / (2 * m)) ** 2 for d in degree.values())


GRAPHS = {"cliques": cliques(24, 5), "planted": planted(5, 24, 0.4, 0.02, 3), "club": ([(a, b) for a, bs in CLUB.items() for b in bs], None)}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_levels_beat_one_level_and_the_known_groups(spark, name):
    edges, known = GRAPHS[name]
    df = spark.createDataFrame(edges, "src long, dst long")
    found = communities.louvain_levels(df)
    best = max(q for _, q in found)
    for members, q in found:
        of = {r.node: r.community for r in members.collect()}
        assert abs(modularity(edges, of) - q) < 1e-12 and all(min(v for v in of if of[v] == c) == c for c in set(of.values()))
    one = {r.node: r.community for r in graph.communities(df).collect()}
    assert best >= modularity(edges, one) - 1e-12
    assert best >= (modularity(edges, known) - 1e-12 if known else 0.40)


def test_planted_groups_are_found(spark):
    edges, known = GRAPHS["planted"]
    of = {r.node: r.community for r in communities.louvain(spark.createDataFrame(edges, "src long, dst long").repartition(7)).collect()}
    pairs = [(of[a] == of[b]) == (known[a] == known[b]) for a in of for b in of if a < b]
    assert sum(pairs) / len(pairs) > 0.97


def test_weights_loops_and_levels(spark):
    """Contraction keeps the modularity: a graph of communities with loops is worth what its communities were."""
    edges, known = cliques(6, 4)
    links = communities.weighted(spark.createDataFrame(edges, "src long, dst long"))
    m2 = 2 * len({tuple(sorted(e)) for e in edges})
    members = spark.createDataFrame(list(known.items()), "node long, community long")
    coarse = communities.contract(links, members)
    assert abs(communities.quality(coarse, m2) / m2**2 - modularity(edges, known)) < 1e-12
    assert {(r.src, r.dst): r.w for r in coarse.where("src = dst").collect()} == {(c, c): 12 for c in range(6)}
    alone = communities.contract(coarse, spark.createDataFrame([(c, c) for c in range(6)], "node long, community long"))
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, coarse.collect()))
    again = communities.louvain_levels(spark.createDataFrame([(r.src, r.dst, r.w // 2 if r.src == r.dst else r.w) for r in coarse.collect() if r.src <= r.dst], "src long, dst long, w long"))
    assert max(q for _, q in again) >= modularity(edges, known) - 1e-12


def test_no_edges_and_one_edge(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert communities.louvain(empty).count() == 0
    assert {r.community for r in communities.louvain(spark.createDataFrame([(5, 3), (3, 5), (4, 4)], "src long, dst long")).collect()} == {3}


def test_cache_reads_recomputes_and_forgets(spark, tmp_path):
    source, calls = tmp_path / "in", []
    spark.range(5).write.parquet(str(source))

    def make():
        calls.append(1)
        return spark.read.parquet(str(source)).selectExpr("id * 2 AS x")

    call = lambda **p: cache.cached(spark, "double", [str(source)], p, make, str(tmp_path / "kept"))
    assert sorted(r.x for r in call(a=1).collect()) == sorted(r.x for r in call(a=1).collect()) == [0, 2, 4, 6, 8] and len(calls) == 1
    call(a=2)
    assert len(calls) == 2  # other parameters
    time.sleep(1.1)
    spark.range(7).write.mode("overwrite").parquet(str(source))
    assert call(a=1).count() == 7 and len(calls) == 3  # changed input
    for marker in (tmp_path / "kept" / "double").glob("*/done"):
        marker.unlink()  # as if the job had died before its end
    assert call(a=1).count() == 7 and len(calls) == 4
    for done in (tmp_path / "kept" / "double").glob("*/*/_SUCCESS"):
        done.unlink()  # a table without its end
    assert call(a=1).count() == call(a=1).count() == 7 and len(calls) == 5
    assert cache.drop_older(spark, 3600, folder=str(tmp_path / "kept")) == 0
    assert cache.drop_older(spark, 0, "double", str(tmp_path / "kept")) == 3
    assert call(a=1).count() == 7 and len(calls) == 6


def test_cache_keeps_the_first_of_two(spark, tmp_path):
    """A job that ends second reads what the first has published."""

    def slow():
        cache.cached(spark, "one", [], {}, lambda: spark.range(3), str(tmp_path))
        return spark.range(4)

    assert cache.cached(spark, "one", [], {}, slow, str(tmp_path)).count() == 3


def test_communities_form_links_once(spark, monkeypatch):
    """Components and levels read links that were written, not the lines that they are made from."""
    class Seen(Exception):
        pass

    def look(edges):
        raise Seen(edges._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(adapter, "largest_component", look)
    with pytest.raises(Seen) as seen:
        adapter.Network(spark, "/root/testdata/sf0.001")["communities"]
    assert "l_suppkey" not in str(seen.value) and "Join" not in str(seen.value)
