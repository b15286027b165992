"""The band join against all pairs, one by one."""

import random
import zlib
from collections import defaultdict

import pytest

from rippleflow.llm import bands as B

ITEMS = "item_id long, name string, price double"
LINES = "sale_id long, line_no int, item_id long, quantity int, amount double"


def by_hand(items, lines):
    found = []
    for item_id, _, price in items:
        near = []
        if price is not None:
            p = int((100 * price + 0.5) // 1)
            for sale, line, item, q, amount in lines:
                if None in (sale, item, q, amount) or item == item_id:
                    continue
                u = (2 * int((100 * amount + 0.5) // 1) + q) // (2 * q)
                gap = abs(u - p)
                if gap <= 100 or 1000 * gap <= max(u, p):
                    near.append((gap, u, sale, line is None, line or 0, item, zlib.crc32(f"{sale},{'' if line is None else line},{item}".encode())))
        near.sort()
        total = (len(near), sum(x[0] for x in near), sum(x[6] for x in near))
        for rank, x in enumerate(near[:2], 1):
            found.append((item_id, rank, x[0], x[1], x[2], None if x[3] else x[4], x[5], *total))
        if not near:
            found.append((item_id, 0, None, None, None, None, None, *total))
    return sorted(found, key=str)


def check(spark, items, lines):
    got = B.digest(spark.createDataFrame(items, ITEMS), spark.createDataFrame(lines, LINES).repartition(3))
    assert got.columns == ["item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(items, lines)


def made(seed, n_items, n_lines, prices):
    rng = random.Random(seed)
    items = [(i, f"x{i}", round(rng.choice(prices) * rng.choice([1, 1, 1.0005, 1.2]), 2)) for i in range(n_items)]
    lines = []
    for k in range(n_lines):
        i, q = rng.randrange(max(1, n_items // 2)), rng.randint(1, 9)
        lines.append((k // 3, rng.randint(1, 3), i, q, round(items[i][2] * q * rng.choice([1, 1, 0.9, 1.001, 1.01]) + rng.choice([0, 0, 0.5]), 2)))
    return items, lines + lines[: n_lines // 10]


def test_cheap_items(spark):
    check(spark, *made(1, 40, 300, [2.72, 3.0, 3.5, 9.99, 25.0]))


def test_wide_bands(spark):
    """Relative bands of many levels, so that nodes are merged in several steps."""
    check(spark, *made(2, 30, 200, [0.5, 150.0, 4000.0, 250000.0, 10_000_000.0]))


def test_own_lines_stand_before_others(spark):
    items = [(1, "a", 5.0), (2, "b", 5.0), (3, "c", 5.0)]
    lines = [(s, k, 1, 1, 5.0) for s in range(20) for k in (1, 2)] + [(50, 1, 2, 1, 5.0), (51, 1, 2, 1, 5.01)] + [(60, 1, 3, 1, 4.99)]
    check(spark, items, lines)
    check(spark, items, [(9, 1, 1, 1, 5.0)] * 7)


def test_odd_rows(spark):
    items = [(1, None, 10.0), (1, None, 10.0), (2, "x" * 10000, None), (3, "", 0.0), (4, "n", -2.0), (None, "o", 10.0), (5, "p", 1000.0)]
    lines = [
        (1, 1, 2, 1, 10.0), (1, 1, 2, 1, 10.0), (None, 1, 2, 1, 10.0), (1, None, 2, 1, 10.0), (2, 1, None, 1, 10.0), (3, 1, 2, None, 10.0), (4, 1, 2, 1, None),
        (5, 1, 3, 2, 0.0), (6, 1, 2, 1, -2.0), (7, 2, 2, 3, -6.01), (8, 1, 2, 1, 999.0), (9, 1, 2, 1, 998.99), (10, 1, 2, 1, 1001.0), (11, 1, 2, 1, 1001.01),
    ]
    check(spark, items, lines)
    check(spark, items, [])
    assert B.digest(spark.createDataFrame([], ITEMS), spark.createDataFrame(lines, LINES)).count() == 0
    odd = [(1, 1, 2, 0, 10.0), (2, 1, 2, 1, float("nan")), (3, 1, 2, 1, float("inf")), (4, 1, 2, 1, 1e300)]
    got = B.digest(spark.createDataFrame([(9, "a", 10.0), (8, "b", float("nan")), (7, "c", 1e300)], ITEMS), spark.createDataFrame(odd, LINES)).collect()
    assert sorted((r.item_id, r.rank, r.n_pairs) for r in got) == [(7, 0, 0), (8, 0, 0), (9, 0, 0)]
    clash = spark.createDataFrame([(1, 10.0, "a", 1, 2)], "item_id long, price double, p string, lo int, n_pairs int")
    more = spark.createDataFrame([(1, 1, 2, 1, 10.0, 3, "x")], LINES + ", u int, crc string")
    assert B.digest(clash, more).first().n_pairs == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_cover_is_disjoint_and_whole(spark, seed):
    rng = random.Random(seed)
    rows = [(i, lo := rng.randint(-3000, 3000), lo + rng.randint(-2, 900)) for i in range(200)]
    top = B.levels(902)
    df = spark.createDataFrame(rows, "i int, lo long, hi long")
    from pyspark.sql import functions as F

    for i, lo, hi, nodes in df.select("i", "lo", "hi", B.cover(F.col("lo"), F.col("hi"), top)).collect():
        values = [v for x in nodes for v in range(x.node << x.level, (x.node + 1) << x.level)]
        assert sorted(values) == list(range(lo, hi + 1))
        assert max([0, *(sum(x.level == k for x in nodes) for k in range(top + 1))]) <= 2


def test_pairs_once_each(spark):
    rng = random.Random(3)
    intervals = [(i, lo := rng.randint(-50, 50), lo + rng.randint(-3, 60)) for i in range(40)] + [(90, None, 3), (91, 4, None)]
    points = [(k, rng.randint(-60, 120)) for k in range(150)] + [(k, 7) for k in range(200, 220)] + [(300, None)]
    got = defaultdict(int)
    for r in B.pairs(spark.createDataFrame(intervals, "i long, lo long, hi long"), spark.createDataFrame(points, "k long, value long")).collect():
        got[r.i, r.k] += 1
    assert got == {(i, k): 1 for i, lo, hi in intervals if None not in (lo, hi) for k, v in points if v is not None and lo <= v <= hi}
