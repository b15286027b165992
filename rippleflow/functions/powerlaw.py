"""Discrete power laws: exponent, start of the tail, and comparison with an exponential and a log-normal tail.

All depends on the histogram of values alone, an aggregate over the rows. Of whole numbers above 0 that sum to S there are
at most sqrt(2 S) different ones, so the histogram of a graph's degrees is small (some 450,000 rows for 10^11 links); it is
broadcast, tasks try the starts of the tail, one after the other, over suffix sums, and the driver fits the rivals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TERMS = 10
_erfc = np.frompyfunc(math.erfc, 1, 1)


def hurwitz(s: float, a: np.ndarray) -> np.ndarray:
    """Sum of (a + k)^-s over k = 0, 1, ...; s > 1: ten terms, then the Euler-Maclaurin rest."""
    a = np.asarray(a, np.float64)
    total = np.zeros_like(a)
    for k in range(_TERMS):
        total += (a + k) ** -s
    b = a + _TERMS
    return total + b ** (1 - s) / (s - 1) + b**-s / 2 + s * b ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * b ** (-s - 3) / 720 + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) * b ** (-s - 5) / 30240


def histogram(rows: DataFrame, series: str, value: str) -> DataFrame:
    """series, k, c of the values above 0."""
    return rows.where(F.col(value) > 0).groupBy(F.col(series).alias("series"), F.col(value).cast("long").alias("k")).agg(F.count("*").alias("c"))


class Tail:
    """A histogram (k rising, counts) with suffix sums: sizes and sums of logarithms of every tail."""

    def __init__(self, k: np.ndarray, c: np.ndarray) -> None:
        back = lambda x: np.cumsum(x[::-1])[::-1]
        self.k, self.c = k.astype(np.float64), c.astype(np.float64)
        self.size, self.logs = back(self.c), back(self.c * np.log(self.k))

    def exponent(self, i: int) -> float:
        """Estimate for the tail from the i-th value: 1 + n / sum of ln(k / (xmin - 1/2))."""
        n = self.size[i]
        return 1 + n / (self.logs[i] - n * math.log(self.k[i] - 0.5))

    def distance(self, i: int, alpha: float) -> float:
        """Kolmogorov-Smirnov: largest difference of the shares at or above a value, over the tail's values."""
        z = hurwitz(alpha, self.k[i:])
        return float(np.abs(self.size[i:] / self.size[i] - z / z[0]).max())


def fit_tails(counts: DataFrame) -> DataFrame:
    """Per series: tail (rows), xmin, alpha, sigma, ks, of the start with the least distance (the first of equals).

    Every value but the largest can be the start. A series with one value has no fit.
    """
    spark, held = counts.sparkSession, {}
    for r in counts.orderBy("series", "k").collect():
        held.setdefault(r.series, []).append((r.k, r.c))
    shared = spark.sparkContext.broadcast({s: np.array(x, np.int64).T for s, x in held.items()})
    kind = counts.schema["series"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tails = {}
        for frame in frames:
            out = []
            for s, k in zip(frame["series"], frame["k"], strict=True):
                if s not in tails:
                    tails[s] = Tail(*shared.value[s])
                t = tails[s]
                i = int(np.searchsorted(t.k, k))
                if i + 1 < len(t.k):
                    alpha = t.exponent(i)
                    out.append((s, int(t.size[i]), int(k), alpha, (alpha - 1) / math.sqrt(t.size[i]), t.distance(i, alpha)))
            yield pd.DataFrame(out, columns=["series", "tail", "xmin", "alpha", "sigma", "ks"])

    starts = counts.select("series", "k").repartition(F.col("series"), F.col("k"))
    tried = starts.mapInPandas(run, f"series {kind}, tail long, xmin long, alpha double, sigma double, ks double")
    best = tried.groupBy("series").agg(F.min(F.struct("ks", "xmin", "tail", "alpha", "sigma")).alias("b"))
    return best.select("series", "b.tail", "b.xmin", "b.alpha", "b.sigma", "b.ks")


def exponential_logs(k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Logarithms of the geometric law on k >= k[0] that fits best."""
    n, above = c.sum(), float((c * (k - k[0])).sum())
    rate = math.log1p(n / above)
    return math.log(-math.expm1(-rate)) - rate * (k - k[0])


def _upper(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(z / math.sqrt(2)).astype(np.float64)


def _lognormal(k: np.ndarray, mu: float, sigma: float) -> np.ndarray:
    """Logarithms of the rounded log-normal law on whole numbers k >= k[0], as differences of its smaller tail."""
    low, high = (np.log(k - 0.5) - mu) / sigma, (np.log(k + 0.5) - mu) / sigma
    p = np.where(low > 0, _upper(low) - _upper(high), _upper(-high) - _upper(-low))
    total = _upper(low[:1])[0]
    if total <= 0:
        return np.full(len(k), -math.inf)
    with np.errstate(divide="ignore"):
        return np.log(p) - math.log(total)


def lognormal_logs(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The same of the rounded log-normal that fits best, with its mu and sigma: a simplex search on (mu, ln sigma)."""

    def loss(x: np.ndarray) -> float:
        if not -20 < x[1] < 5:
            return math.inf
        value = -float((c * _lognormal(k, x[0], math.exp(x[1]))).sum())
        return value if math.isfinite(value) else math.inf

    mean = float((c * np.log(k)).sum() / c.sum())
    spread = math.sqrt(max(float((c * (np.log(k) - mean) ** 2).sum() / c.sum()), 1e-4))
    best = None
    for mu in (mean, mean - 2 * spread, mean - 8 * spread):  # tails often fit a log-normal whose centre lies below them
        x = _simplex(loss, np.array([mu, math.log(spread)]), 0.5)
        best = x if best is None or loss(x) < loss(best) else best
    return _lognormal(k, best[0], math.exp(best[1])), float(best[0]), float(math.exp(best[1]))


def _simplex(f, start: np.ndarray, step: float, rounds: int = 600, tolerance: float = 1e-10) -> np.ndarray:
    """Downhill search with a simplex of n + 1 points: reflect, expand, contract or shrink."""
    points = [start, *(start + step * np.eye(len(start))[i] for i in range(len(start)))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if max(np.abs(p - points[0]).max() for p in points[1:]) < tolerance:
            break
        centre = np.mean(points[:-1], axis=0)
        try_ = lambda t: (x := centre + t * (centre - points[-1]), f(x))  # noqa: B023, E731
        x, v = try_(1.0)
        if v < values[0]:
            y, w = try_(2.0)
            x, v = (y, w) if w < v else (x, v)
        elif v >= values[-2]:
            y, w = try_(0.5 if v < values[-1] else -0.5)
            if w >= min(v, values[-1]):
                points = [points[0], *(points[0] + (p - points[0]) / 2 for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
                continue
            x, v = y, w
        points[-1], values[-1] = x, v
    return points[int(np.argmin(values))]


def likelihood_ratio(first: np.ndarray, second: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Normalised R (above 0: the first law fits better) and its two-sided p, from logarithms a value and counts."""
    n, d = c.sum(), first - second
    mean = float((c * d).sum() / n)
    spread = math.sqrt(max(float((c * (d - mean) ** 2).sum() / n), 0.0))
    if spread == 0:
        return 0.0, 1.0
    r = math.sqrt(n) * mean / spread
    return r, math.erfc(abs(r) / math.sqrt(2))


def rivals(counts: DataFrame, fits: DataFrame) -> DataFrame:
    """Per series: r_exponential, p_exponential, r_lognormal, p_lognormal, mu and sigma of the log-normal, over the fitted tail."""
    spark, rows = counts.sparkSession, []
    tails = counts.join(fits.select("series", "xmin"), "series").where(F.col("k") >= F.col("xmin")).select("series", "k", "c")
    held: dict[object, list[tuple[int, int]]] = {}
    for r in tails.orderBy("series", "k").collect():  # a row a distinct value
        held.setdefault(r.series, []).append((r.k, r.c))
    alpha = {r.series: r.alpha for r in fits.collect()}
    for s, pairs in held.items():
        k, c = np.array(pairs, np.float64).T
        own = -alpha[s] * np.log(k) - math.log(float(hurwitz(alpha[s], k[:1])[0]))
        logs, mu, sigma = lognormal_logs(k, c)
        rows.append((s, *likelihood_ratio(own, exponential_logs(k, c), c), *likelihood_ratio(own, logs, c), mu, sigma))
    kind = counts.schema["series"].dataType.simpleString()
    return spark.createDataFrame(rows, f"series {kind}, r_exponential double, p_exponential double, r_lognormal double, p_lognormal double, mu double, sigma double")
