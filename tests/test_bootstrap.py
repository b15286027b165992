"""Bootstrap by counts of values against draws one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rippleflow.functions import bootstrap as B


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "y double")


@pytest.mark.parametrize("ranges", [1, 5])
def test_law_is_that_of_draws_one_by_one(spark, monkeypatch, ranges):
    rng = np.random.default_rng(3)
    values = np.round(rng.gamma(2.0, 10.0, 120)).tolist()
    monkeypatch.setattr(B, "VALUES", -(-len(set(values)) // ranges))
    got = B.resampled(table(spark, values), "y", 2000).toPandas()
    assert len(got) == 2000 and set(got["b"]) == set(range(2000))
    draws = rng.choice(values, size=(4000, len(values)))
    for name, want in (("mean", draws.mean(axis=1)), ("median", np.median(draws, axis=1))):
        x = got[name].to_numpy()
        assert abs(x.mean() - want.mean()) < 4 * want.std() / 2000**0.5 + 1e-9
        assert abs(x.std() / want.std() - 1) < 0.08
        for p in (2.5, 25, 50, 75, 97.5):
            assert abs(np.percentile(x, p) - np.percentile(want, p)) < 0.25 * want.std() + (1.0 if name == "median" else 0)


def test_every_resample_has_all_rows(spark, monkeypatch):
    """Of values 0 and 1 a resample's mean times n is a whole number, and its median follows from it."""
    monkeypatch.setattr(B, "VALUES", 1)
    got = B.resampled(table(spark, [0.0] * 31 + [1.0] * 20), "y", 500).collect()
    for r in got:
        ones = r.mean * 51
        assert abs(ones - round(ones)) < 1e-9 and r.median == (1.0 if round(ones) > 25 else 0.0)
    assert abs(np.mean([r.mean for r in got]) - 20 / 51) < 0.02


def test_partitioning_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(B, "VALUES", 20)
    values = [float(i % 90) for i in range(400)]
    one = sorted(map(tuple, B.resampled(table(spark, values).repartition(1), "y", 50).collect()))
    assert one == sorted(map(tuple, B.resampled(table(spark, values[::-1]).repartition(9), "y", 50).collect()))
    assert one != sorted(map(tuple, B.resampled(table(spark, values), "y", 50, seed=8).collect()))


def test_odd_tables(spark):
    assert B.resampled(table(spark, []), "y", 10).count() == 0
    r = B.interval(table(spark, []), "y", 10).first()
    assert r.low is None and r.high is None
    same = B.interval(table(spark, [4.0, None, 4.0, float("nan")]), "y", 30, "median").first()
    assert (same.low, same.high) == (4.0, 4.0)
    assert {x.mean for x in B.resampled(table(spark, [2.5]), "y", 5).collect()} == {2.5}
    clash = spark.createDataFrame([(1, 2, 3.0)], "r int, c int, b double").withColumn("n", F.lit(1))
    assert {x.mean for x in B.resampled(clash, "b", 3).collect()} == {3.0}
