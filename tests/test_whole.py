"""Queries over the whole network, on lines of which the thin network holds none."""

from collections import deque

import pytest

from rippleflow.plans import catalog

OEM = 10_000_000
ORDERS = {1: 1, 2: 2, 3: 1, 4: 3, 5: 4}
LINES = [(1, 1, 1, 11), (1, 2, 2, 12), (1, 3, 3, 13), (2, 1, 3, 13), (2, 2, 1, 14), (3, 1, 4, 15), (3, 2, 2, 12), (4, 1, 2, 16), (4, 2, 4, 17), (5, 1, 7, 18)]  # order, number, supplier, part


def links():
    out = {(s, OEM + ORDERS[o]) for o, _, s, _ in LINES}
    return out | {(a[2], b[2]) for a, b in zip(LINES, LINES[1:], strict=False) if a[0] == b[0] and a[2] != b[2]}


def lengths(e):
    found = []
    for s in {x for p in e for x in p}:
        seen, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v in sorted({b for a, b in e if a == u} - set(seen)):
                seen[v] = seen[u] + 1
                queue.append(v)
        found += [d for d in seen.values() if d]
    return found


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    put = lambda rows, schema, name, *cols: spark.createDataFrame(rows, schema).selectExpr(*(cols or ["*"])).write.parquet(f"{d}/{name}.parquet")
    put([(o, c) for o, c in ORDERS.items()], "o_orderkey long, o_custkey long", "orders")
    put([(o, p, s, n, 10.0, 1.0, "N", "2024-01-01") for o, n, s, p in LINES], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, d string", "lineitem", "* EXCEPT (d)", "CAST(d AS TIMESTAMP_NTZ) AS l_shipdate")
    put([(c, 1, 0.0) for c in set(ORDERS.values())], "c_custkey long, c_nationkey int, c_acctbal double", "customer")
    put([(s, 1, 0.0) for s in {x[2] for x in LINES}], "s_suppkey long, s_nationkey int, s_acctbal double", "supplier")
    return d


@pytest.mark.parametrize("name", ["G10_path_lengths", "G10_sampled_lengths"])
def test_path_lengths(spark, data, name):
    e = links()
    part = {p for p in e if 7 not in p}  # supplier 7 and its customer are a component of their own
    want = lengths(e) if name == "G10_path_lengths" else lengths(part | {(b, a) for a, b in part})
    got = catalog.queries()[name](spark, data).first()
    assert (got.pairs, got["mean"]) == (len(want), pytest.approx(sum(want) / len(want), abs=1e-6))


@pytest.mark.parametrize("name", ["G16_edge_betweenness", "Z21_edge_products"])
def test_every_link(spark, data, name):
    assert {(r.src, r.dst) for r in catalog.queries()[name](spark, data).select("src", "dst").distinct().collect()} == links()


def test_cores(spark, data):
    got = {r.firm_id: r.core for r in catalog.queries()["G26_core_numbers"](spark, data).collect()}
    assert set(got) == {x for p in links() for x in p} and got[7] == 1 and max(got.values()) == 3


def test_clustering(spark, data):
    got = {r.measure: r.observed for r in catalog.queries()["G20_clustering_null"](spark, data).collect()}
    assert got["undirected"] > 0 and got["transitivity"] > 0
