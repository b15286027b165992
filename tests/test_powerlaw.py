"""Power-law tails against a plain restatement, sums and numeric integration."""

import math
import random

import numpy as np
import pytest

from rippleflow.functions import powerlaw as P


def drawn(n, alpha, xmin, seed):
    """Rounded continuous power law, with a flat start below xmin."""
    rng = random.Random(seed)
    return [rng.randint(1, xmin - 1) if xmin > 1 and rng.random() < 0.3 else int((xmin - 0.5) * (1 - rng.random()) ** (-1 / (alpha - 1)) + 0.5) for _ in range(n)]


def plain(values):
    """xmin, alpha, sigma, distance, by trying every start over all values."""
    best = None
    for xmin in sorted(set(values))[:-1]:
        tail = [v for v in values if v >= xmin]
        alpha = 1 + len(tail) / sum(math.log(v / (xmin - 0.5)) for v in tail)
        far = lambda a: sum((a + i) ** -alpha for i in range(3000)) + (a + 3000) ** (1 - alpha) / (alpha - 1) + (a + 3000) ** -alpha / 2  # noqa: E731, B023
        z = far(xmin)
        d = max(abs(sum(v >= k for v in tail) / len(tail) - far(k) / z) for k in sorted(set(tail)))
        if best is None or d < best[3] - 1e-12:
            best = (xmin, alpha, (alpha - 1) / math.sqrt(len(tail)), d, len(tail))
    return best


def test_equals_plain_restatement(spark):
    series = {"a": drawn(300, 2.5, 4, 1), "b": drawn(200, 3.2, 1, 2), "c": [5, 5, 5], "d": [1, 2, 0, -3]}
    rows = spark.createDataFrame([(s, v) for s, x in series.items() for v in x], "s string, v int").repartition(5)
    got = {r.series: r for r in P.fit_tails(P.histogram(rows, "s", "v")).collect()}
    assert set(got) == {"a", "b", "d"}  # c has one value
    for s in ("a", "b"):
        xmin, alpha, sigma, d, n = plain(series[s])
        r = got[s]
        assert (r.xmin, r.tail) == (xmin, n) and abs(r.alpha - alpha) < 1e-9 and abs(r.sigma - sigma) < 1e-9 and abs(r.ks - d) < 1e-7
    assert abs(got["a"].alpha - 2.5) < 4 * got["a"].sigma + 0.1
    assert P.fit_tails(P.histogram(rows.where("v > 100000"), "s", "v")).count() == 0


@pytest.mark.parametrize("s", [1.05, 2.0, 3.7])
def test_hurwitz(s):
    for a in (1.0, 2.5, 40.0):
        whole = sum((a + k) ** -s for k in range(20000)) + (a + 20000) ** (1 - s) / (s - 1) + (a + 20000) ** -s / 2
        assert abs(P.hurwitz(s, np.array([a]))[0] / whole - 1) < 1e-9
    assert abs(P.hurwitz(2.0, np.array([1.0]))[0] - math.pi**2 / 6) < 1e-10


def test_laws_sum_to_one_and_fit_best():
    k = np.arange(3, 400).astype(float)
    c = np.round(1e6 * np.exp(-0.1 * (k - 3))) + 1
    logs = P.exponential_logs(k, c)
    far = np.arange(3, 4000).astype(float)
    rate = logs[0] - logs[1]
    assert abs(np.exp(logs[0] - rate * (far - 3)).sum() - 1) < 1e-9
    for other in (rate * 0.98, rate * 1.02):
        assert (c * (math.log(-math.expm1(-other)) - other * (k - 3))).sum() < (c * logs).sum()
    mu, sigma = 2.0, 0.8
    # Numeric integration of the density between k - 1/2 and k + 1/2.
    density = lambda x: np.exp(-((np.log(x) - mu) ** 2) / (2 * sigma**2)) / (x * sigma * math.sqrt(2 * math.pi))
    steps = (np.arange(200) + 0.5) / 200
    mass = np.array([density(v - 0.5 + steps).mean() for v in range(3, 3000)])
    got = np.exp(P._lognormal(np.arange(3, 60).astype(float), mu, sigma))
    assert np.allclose(got, mass[:57] / mass.sum(), rtol=1e-4)


def test_lognormal_search_finds_the_parameters():
    k = np.arange(2, 2000).astype(float)
    c = np.round(1e7 * np.exp(P._lognormal(k, 2.5, 0.7)))
    k, c = k[c > 0], c[c > 0]
    logs, mu, sigma = P.lognormal_logs(k, c)
    assert abs(mu - 2.5) < 0.01 and abs(sigma - 0.7) < 0.01
    for dm, ds in ((0.05, 0), (-0.05, 0), (0, 0.03), (0, -0.03)):
        assert (c * P._lognormal(k, mu + dm, sigma + ds)).sum() < (c * logs).sum()


def test_ratio_tells_the_laws_apart(spark):
    power = drawn(4000, 2.2, 1, 7)
    rng = random.Random(8)
    exponential = [1 + int(rng.expovariate(0.2)) for _ in range(4000)]
    lognormal = [max(1, round(rng.lognormvariate(3.0, 0.5))) for _ in range(4000)]
    rows = spark.createDataFrame([(s, v) for s, x in (("p", power), ("e", exponential), ("l", lognormal)) for v in x], "s string, v int")
    counts = P.histogram(rows, "s", "v")
    whole = spark.createDataFrame([(s, 1, 2.2) for s in "pel"], "series string, xmin long, alpha double")
    got = {r.series: r for r in P.rivals(counts, whole).collect()}
    assert got["p"].r_exponential > 2 and got["p"].p_exponential < 0.05
    assert got["e"].r_exponential < -2 and got["l"].r_lognormal < -2 and got["l"].p_lognormal < 0.05
    r, p = P.likelihood_ratio(np.array([-1.0, -2.0]), np.array([-1.5, -1.0]), np.array([30.0, 10.0]))
    d = [0.5] * 30 + [-1.0] * 10
    assert abs(r - sum(d) / (math.sqrt(40) * np.std(d))) < 1e-12 and abs(p - math.erfc(abs(r) / math.sqrt(2))) < 1e-12
