"""Draws within bounds against plain rejection."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rippleflow.functions.random import u01
from rippleflow.plans import scenario

VALUES = [1, 1, 1, 2, 2, 3, 5, 8, 8, 13]


def bandwidth(values):
    m = sum(values) / len(values)
    return math.sqrt(sum((v - m) ** 2 for v in values) / (len(values) - 1)) * len(values) ** -0.2


def rejected(values, most, n, seed):
    """Drawn anew until the rounded number fits."""
    rng, h, out = random.Random(seed), bandwidth(values), []
    while len(out) < n:
        x = round(rng.choice(values) + rng.gauss(0, h))
        if 1 <= x <= most:
            out.append(x)
    return out


def close(got, want):
    """Shares of all numbers within sampling error."""
    for k in set(got) | set(want):
        a, b = sum(x == k for x in got) / len(got), sum(x == k for x in want) / len(want)
        assert abs(a - b) < 4.5 * math.sqrt(max(b, 1e-3) * (1 / len(got) + 1 / len(want)))


@pytest.mark.parametrize("most", [1, 2, 6, 40])
def test_numbers_have_the_law_of_rejection(spark, most):
    values = spark.createDataFrame([(v,) for v in VALUES], "n long")
    law = scenario.count_law(values, "n")
    row = law.first()["law"]
    assert row == sorted(row) and row[-1] == pytest.approx(1, abs=1e-6)
    k = scenario.draw_within(F.col("law"), u01([F.lit("test"), F.col("id")]), F.lit(most))
    got = [r.k for r in spark.range(6000).crossJoin(F.broadcast(law)).select(k.alias("k")).collect()]
    assert min(got) >= 1 and max(got) <= most
    close(got, rejected(VALUES, most, 20000, most))


def test_a_law_outside_the_bounds(spark):
    """One value only, above what fits, below, and within; no value at all."""
    u = u01([F.lit("test"), F.col("id")])
    for values, most, want in (([], 3, {1}), ([7, 7], 3, {3}), ([7, 7], 9, {7}), ([0, 0], 4, {1}), ([500, 501], 2, {2})):
        law = scenario.count_law(spark.createDataFrame([(v,) for v in values], "n long"), "n")
        assert {r.k for r in spark.range(50).crossJoin(F.broadcast(law)).select(scenario.draw_within(F.col("law"), u, F.lit(most)).alias("k")).collect()} == want


def test_amounts_have_the_law_of_rejection(spark):
    rows = [(1, 1, 7, v) for v in VALUES] + [(1, 1, 8, 4), (1, 1, 8, 4)]
    laws = scenario.amount_laws(spark.createDataFrame(rows, "src long, dst long, product long, amount long"))
    ids = spark.range(6000).crossJoin(spark.createDataFrame([(7,), (8,), (9,)], "product long"))
    x = scenario.draw_amount(F.col("parts"), u01([F.lit("a"), F.col("id"), F.col("product")]), u01([F.lit("b"), F.col("id"), F.col("product")]))
    got = ids.join(laws, "product", "left").select("product", x.alias("x")).collect()
    close([r.x for r in got if r.product == 7], rejected(VALUES, 10**6, 20000, 3))
    assert {r.x for r in got if r.product == 8} == {4} and {r.x for r in got if r.product == 9} == {1}
