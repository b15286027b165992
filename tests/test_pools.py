"""Pools of firms that offer something alike, against brute force."""

import hashlib
import math
import random

import pytest

from rippleflow.operators.pools import best_of, united
from rippleflow.plans import substitutes
from rippleflow.plans.network import best_alternatives


def made(seed):
    rng = random.Random(seed)
    like = [(rng.randrange(40), rng.randrange(60)) for _ in range(300)] + [(99, 0), (98, 77)]
    offers = [(10**12 + rng.randrange(500), rng.randrange(60)) for _ in range(1500)] + [(-(1 << 63), 3)]
    return like + like[:9], offers + offers[:9]


@pytest.mark.parametrize("cells", [(10**6, 10**6), (300, 70)])
def test_pools_and_members(spark, cells, monkeypatch):
    like, offers = made(cells[1])
    monkeypatch.setattr("rippleflow.operators.pools.UNFOLDED", 64 * 70)  # several chunks of firms
    want = {}
    for a, b in like:
        want.setdefault(a, set()).update(f for f, x in offers if x == b)
    want = {a: fs for a, fs in want.items() if fs}
    asked = [(a, f) for a in (0, 1, 2, 98, 99, 12345) for f in [*range(10**12, 10**12 + 500, 7), -5]]
    table = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{x} long" for x in names))
    pool, held = united(table(like, "ab"), table(offers, ("firm", "b")), table(asked, ("a", "firm")), *cells)
    assert {(r.a, r["pool"]) for r in pool.collect()} == {(a, len(fs)) for a, fs in want.items()}
    assert sorted(map(tuple, held.collect())) == sorted((a, f) for a, f in asked if f in want.get(a, ()))


def test_empty(spark):
    none = lambda names: spark.createDataFrame([], names)
    pool, held = united(none("a long, b long"), none("firm long, b long"), none("a long, firm long"))
    assert pool.count() == held.count() == 0


@pytest.mark.parametrize("cells", [(10**6, 10**6), (300, 70)])
def test_best_alike(spark, cells, monkeypatch):
    monkeypatch.setattr("rippleflow.operators.pools.UNFOLDED", 64 * 70)
    like, offers = made(cells[1])
    like = [(a, b, (a * 7 + b * 3) % 5 / 10) for a, b in like]
    want = {}
    for a, b, s in like:
        for f, x in offers:
            if x == b:
                want[a, f] = min(want.get((a, f), (1.0, 0)), (-s, b))
    found = best_of(spark.createDataFrame(like, "a long, b long, score double"), spark.createDataFrame(offers, "firm long, b long"), *cells).collect()
    got = [((r.a, f), (-r.score, r.b)) for r in found for f in r.firms]
    assert len(got) == len(want) and dict(got) == want
    none = best_of(spark.createDataFrame([], "a long, b long, score double"), spark.createDataFrame(offers, "firm long, b long"))
    assert none.count() == 0


def test_alternatives_meet_in_lists_of_firms(spark):
    """Best alternatives aren't formed as a row a search and firm before they are chosen."""
    lost = spark.createDataFrame([(s, s % 3) for s in range(30)], "search long, product long")
    sigma = spark.createDataFrame([(a, b, (a + b) % 4 / 4) for a in range(3) for b in range(6)], "product long, alt long, score double")
    index = spark.createDataFrame([(f % 6, None if f == 50 else f) for f in range(60)] + [(1, 7), (None, 9)], "product long, firm_id long")
    out = best_alternatives(lost, sigma, index)
    want = {}
    for s, p in map(tuple, lost.collect()):
        for q, alt, score in map(tuple, sigma.collect()):
            for x, f in map(tuple, index.collect()):
                if p == q and x == alt:
                    want[s, f] = min(want.get((s, f), (1.0, 0)), (-score, alt))
    got = [((r.search, r.firm_id), (-r.score, r["alt"])) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("share", [1, 3, 10**6])
def test_candidates_are_those_of_the_whole_race(spark, monkeypatch, share):
    """The limit of the first race leaves all three out of any share of the firms; no window sees all options."""
    lost = spark.createDataFrame([(s, 100 + s, p, 1, p % 2) for s in range(6) for p in range(4)], "src long, dst long, product long, amount long, a long")
    like = spark.createDataFrame([(a, b, 0.3 + (a + b) / 9) for a in range(2) for b in range(4)], "a long, b long, score double")
    offers = spark.createDataFrame([(f, f % 4) for f in range(200)] + [(None, 1)], "firm long, b long")
    monkeypatch.setattr(substitutes, "_parts", lambda n: (lost, like, offers))
    got = {}
    for r in substitutes.specific_candidates(None, share).collect():
        got.setdefault((r.firm, r.customer, r["product"]), set()).add(r["alt"])
    u = lambda *k: (int(hashlib.md5("|".join(map(str, k)).encode()).hexdigest()[:13], 16) + 0.5) / 4503599627370496
    for src, dst, p, _, a in map(tuple, lost.collect()):
        race = sorted((-math.log(u("score", dst * 100000 + src, p * 100000 + f)) / (0.3 + (a + f % 4) / 9), f) for f in range(200) if f not in (src, dst))
        assert got[src, dst, p] == {f for _, f in race[:3]}
