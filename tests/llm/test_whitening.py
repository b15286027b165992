"""Whitening against integers and eigenvectors computed in one place."""

from fractions import Fraction

import numpy as np
import pytest

from rippleflow.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_hand(vectors):
    """n, S, exact deviations and the covariance as fractions."""
    x = [[int(np.floor(np.float64(np.float32(c)) * 1024)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    scatter = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    deviations = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    return x, n, s, scatter, deviations


def test_equals_hand_count(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(60, 12)) * np.linspace(1, 3, 12)).astype(np.float32).tolist()
    x, n, s, scatter, deviations = by_hand(vectors)
    assert W.scatter(table(spark, [(i, v, 0) for i, v in enumerate(vectors)])) == (n, s, scatter)
    got = W.whiten(table(spark, [(i, v, 0) for i, v in enumerate(vectors)])).collect()
    assert len(got) == 60 * 8 and {(r.vec_id, r.component) for r in got} == {(i, k) for i in range(60) for k in range(1, 9)}
    cov = np.array([[float(Fraction(v, n * n)) for v in row] for row in scatter])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    mean = np.array([[float(Fraction(n * v - t, n)) for v, t in zip(r, s, strict=True)] for r in x])
    want = mean @ u[:, :8] / np.sqrt(e[:8])
    w = np.zeros((60, 8))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 60 and r.deviation == deviations[r.vec_id] and abs(r.explained - e[r.component - 1] / np.trace(cov)) < 1e-9 and r.identity_error < 1e-6
    signs = np.sign((w * want).sum(axis=0))
    assert np.allclose(w * signs, want, atol=1e-8)
    assert len({r.identity_error for r in got}) == 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.25, 1.0], 1), (1, [0.5, -0.25, 1.0], 1), (None, [-1.5, 0.0, 2.0], None), (2, [0.1, 0.2, 0.3], 1), (3, [5.0, 1.0, 0.0], 2)]
    bad = [(4, None, 1), (5, [0.1, None, 0.3], 1), (6, [nan, 0.0, 0.0], 1), (7, [inf, 0.0, 0.0], 1), (8, [1.0], 1), (9, [], 1)]
    got = W.whiten(table(spark, good + bad)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i or 0, k) for i, _, _ in good for k in (1, 2, 3))
    assert {r.n for r in got} == {5} and max(r.identity_error for r in got) < 1e-9
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(table(spark, [(4, None, 1), (9, [], 1)])).count() == 0
    assert W.whiten(table(spark, [(1, [1.0, 2.0], 1)] * 3)).count() == 0  # no variance
    flat = W.whiten(table(spark, [(i, [float(i), 2.0 * i, 7.0], 1) for i in range(5)])).collect()  # variance in one direction
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    named = spark.createDataFrame([(1, [1.0, 0.0], 5, "x"), (2, [0.0, 2.0], 6, "y"), (3, [1.0, 1.0], 7, "z")], "vec_id long, embedding array<double>, component int, v string")
    assert W.whiten(named).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and W.whiten(named).count() == 6


def test_huge_entries_stay_exact(spark):
    vectors = [[3e30, 1.0], [-3e30, 2.0], [1e10, 4.0], [0.0, -1.0]]
    _, n, s, scatter, _ = by_hand([[float(np.float32(c)) for c in v] for v in vectors])
    assert W.scatter(table(spark, [(i, v, 0) for i, v in enumerate(vectors)])) == (n, s, scatter)
    got = W.whiten(table(spark, [(i, v, 0) for i, v in enumerate(vectors)])).collect()
    assert all(r.deviation is None for r in got) and {r.component for r in got} == {1}


@pytest.mark.parametrize("scale", [1, 1 << 24, 1 << 31, 1 << 40])
def test_products_are_exact_at_every_size(scale):
    rng = np.random.default_rng(scale)
    y = rng.integers(-scale, scale + 1, size=(70, 5))
    want = y.astype(object).T @ y.astype(object)
    assert (W.cross_products(y).astype(object) == want).all()
    totals = W.Totals(5)
    totals.add(y)
    assert (totals.products == want).all() and totals.n == 70


def test_limbs():
    for v in (0, 1, -1, 2**40, -(2**40), 3**90, -(3**90)):
        assert sum(digit << (W.LIMB * k) for k, digit in W.limbs(v)) == v


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=9).astype(np.float32).tolist(), 0) for i in range(200)]
    assert W.scatter(spark.createDataFrame(rows, SCHEMA).repartition(1)) == W.scatter(spark.createDataFrame(rows, SCHEMA).repartition(7))
