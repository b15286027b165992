"""Rivals and overlap pools against brute force, with products that all firms offer."""

import random

import pytest

from rippleflow.operators import pools
from rippleflow.plans import network

SCHEMA = "firm_id long, product long"


def made(seed, firms=60, products=40):
    """Skewed offers: product 0 of every firm, product 1 of half of them, equal portfolios, repeated rows and nulls."""
    rng = random.Random(seed)
    rows = [(10 * f, 0) for f in range(firms)] if seed % 2 else []
    rows += [(10 * f, 1) for f in range(0, firms, 2)]
    rows += [(10 * rng.randrange(firms), 2 + int(products * rng.random() ** 3)) for _ in range(2 * firms)]
    rows += [(7, 900), (8, 900), (9, 901)] + rows[:5] + [(None, 1), (20, None)]
    return rows


def of(rows):
    out = {}
    for f, p in rows:
        if f is not None and p is not None:
            out.setdefault(f, set()).add(p)
    return out


@pytest.mark.parametrize("heavy", [0, 1, 12, 1000])
@pytest.mark.parametrize("seed", [2, 3])
def test_counts_for_any_limit_of_heavy_products(spark, heavy, seed):
    rows = made(seed)
    own = of(rows)
    want = {f: n for f in own if (n := sum(1 for g in own if g != f and own[f] & own[g]))}
    got = {r.firm_id: r.rivals for r in network.rival_counts(spark.createDataFrame(rows, SCHEMA), heavy).collect()}
    assert got == want
    assert 9 not in got and got[7] == 1


def test_counts_over_several_blocks_of_bits(spark):
    n = 70_000  # places beyond two blocks of 32,768
    df = spark.range(n).selectExpr("id AS firm_id", "0L AS product").union(spark.range(0, n, 7).selectExpr("id", "1L")).union(spark.createDataFrame([(n, 2), (5, 2)], SCHEMA))
    got = network.rival_counts(df, 100)
    assert {(r.rivals, r["count"]) for r in got.groupBy("rivals").count().collect()} == {(n - 1, n - 1), (n, 1), (1, 1)}


def test_pairs_and_weights(spark):
    rows = made(3)
    own = of(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = {(f, g) for f in own for g in own if f != g and own[f] & own[g]}
    assert sorted(map(tuple, network.rivals(df).collect())) == sorted(pairs)
    lost = spark.createDataFrame([(10,), (10,), (7,), (9,), (12345,)], "firm_id long")
    got = {(r.lost, r.rival): r.weight for r in network.overlap_pool(df, lost).collect()}
    assert got == {(f, g): pytest.approx(len(own[f] & own[g]) / len(own[f])) for f, g in pairs if f in (10, 7, 9)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert network.rival_counts(none).count() == network.rivals(none).count() == network.overlap_pool(none, none).count() == 0


@pytest.mark.parametrize("asked", [None, (10, 7, 9, 12345)])
def test_sharing_in_small_groups(spark, monkeypatch, asked):
    """Groups of a few offers and few counters at a time give the same; no pair of firms is shuffled."""
    own = of(made(5))
    monkeypatch.setattr(pools, "GROUPED", 7)
    monkeypatch.setattr(pools, "COUNTERS", 100)
    offers = spark.createDataFrame([(f, p) for f in own for p in own[f]], "firm long, b long")
    some = None if asked is None else spark.createDataFrame([(f,) for f in asked], "firm long")
    found = pools.sharing(offers, asked=some)
    want = {(f, g, len(own[f] & own[g]), len(own[f])) for f in own for g in own if f != g and own[f] & own[g] and (asked is None or f in asked)}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    if asked is None:
        counts = {f: sum(1 for x in want if x[0] == f) for f in own}
        assert {r.firm: r.others for r in pools.sharing(offers, pairs=False).collect()} == {f: n for f, n in counts.items() if n}
