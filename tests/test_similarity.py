"""The pruned similarity join against one matrix product."""

import numpy as np
import pytest

from rippleflow.operators import similarity


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def bunches(seed, groups, size, spread, d=8):
    rng = np.random.default_rng(seed)
    centres = unit(rng.normal(size=(groups, d)))
    return unit(np.repeat(centres, size, axis=0) + spread * rng.normal(size=(groups * size, d)))


CASES = {
    "bunches": (bunches(1, 12, 25, 0.03), 0.9),
    "even": (unit(np.random.default_rng(2).normal(size=(250, 4))), 0.8),
    "copies": (np.repeat(unit(np.random.default_rng(3).normal(size=(5, 6))), 40, axis=0), 0.99),
    "low": (unit(np.random.default_rng(4).normal(size=(120, 3))), -0.5),
    "one": (unit(np.ones((1, 3))), 0.5),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_pairs(spark, name):
    v, floor = CASES[name]
    got = {(r.a, r.b): r.score for r in similarity.all_pairs(table(spark, v), floor, block=20).collect()}
    dot = np.round(v @ v.T, 6)
    want = {(i, j): dot[i, j] for i, j in zip(*np.nonzero(dot > floor))}
    # A product in other blocks can differ in its last digit, which may move a rounded score.
    assert all(abs(got.get(k, floor) - want.get(k, floor)) <= 2e-6 for k in set(got) | set(want))
    assert len(set(got) ^ set(want)) <= 2


def test_far_block_pairs_are_not_formed(spark):
    v, floor = CASES["bunches"]
    _, pairs, blocks = similarity.plan_blocks(table(spark, v), floor, block=20)
    assert blocks > 12 and len(pairs) < 0.35 * blocks * (blocks + 1) / 2
    dealt, _, _ = similarity.plan_blocks(table(spark, v), floor, block=20)
    sizes = [r["count"] for r in dealt.groupBy("m").count().collect()]
    assert sum(sizes) == len(v) and max(sizes) <= 40  # a ring that is split by hash is split about evenly
    _, all_, n = similarity.plan_blocks(table(spark, v), -1.0, block=20)
    assert len(all_) == n * (n + 1) // 2


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert similarity.all_pairs(none, 0.5).count() == 0


def test_counts_are_those_of_the_pairs_and_no_pair_is_written(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True)] * 2)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    score, floors = np.round(v @ v.T, 6), [0.2, 0.5, 0.999, 1.5]
    want = {f: int((score > f).sum()) for f in floors[:3]}
    monkeypatch.setattr(similarity, "all_pairs", None)
    assert {r["floor"]: r["pairs"] for r in similarity.pair_counts(df, floors, block=64).collect()} == want
    assert similarity.pair_counts(df.limit(0), floors).count() == 0


def test_sweep_forms_no_pairs(spark, monkeypatch):
    from rippleflow.plans import graphs
    from rippleflow.sources.adapter import Network

    monkeypatch.setattr(similarity, "all_pairs", None)
    assert [c for c, _ in graphs.tau_sweep(Network(spark, "/root/testdata/sf0.001")).dtypes] == ["tau", "pairs"]
