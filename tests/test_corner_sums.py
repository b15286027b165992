"""Triangles by bits against enumeration, for several blocks, strips and chunks."""

import random
from collections import Counter
from itertools import combinations

import pytest

from rippleflow.operators import null_models


@pytest.mark.parametrize(("most", "words"), [(1 << 22, 1 << 22), (40, 1 << 22), (60, 40)])
def test_corner_sums(spark, monkeypatch, most, words):
    monkeypatch.setattr(null_models, "WORDS", words)
    rng, rows, want = random.Random(3), [], Counter()
    for copy, n, m in ((0, 12, 40), (1, 150, 900), (2, 5, 3)):
        w = {(a, b): rng.choice([1, 2]) for a, b in {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}}
        rows += [(copy, a, b, x) for (a, b), x in w.items()]
        for t in combinations(range(n), 3):
            if all(p in w for p in combinations(t, 2)):
                for i in t:
                    want[copy, i] += w[t[0], t[1]] * w[t[0], t[2]] * w[t[1], t[2]]
    got = null_models.corner_sums(spark.createDataFrame(rows, "copy int, u long, v long, w long"), most)
    assert {(r["copy"], r.node): r.x for r in got.collect() if r.x} == want


def test_no_row_for_links_that_meet(spark):
    """A star has no triangle, however many of its links meet."""
    links = spark.range(1, 3000).selectExpr("0 AS copy", "0L AS u", "id AS v", "1L AS w")
    plan = null_models.corner_sums(links)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and null_models.corner_sums(links).count() == 0
