"""Statistics whose heavy part is one aggregate; the driver solves systems of a few unknowns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import before


def logistic(rows: DataFrame, features: list[str], successes: str, trials: str, rounds: int = 25, tolerance: float = 1e-9) -> list[float]:
    """Weights (constant first) of a binomial logistic model, by Newton steps: one aggregate over all rows each."""
    w = np.zeros(len(features) + 1)
    xs: list[Column] = [F.lit(1.0), *map(F.col, features)]
    for _ in range(rounds):
        eta = sum((x * float(v) for x, v in zip(xs, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        slope = [F.sum(x * (F.col(successes) - F.col(trials) * p)).alias(f"g{i}") for i, x in enumerate(xs)]
        curve = [F.sum(x * y * F.col(trials) * p * (1 - p)).alias(f"h{i}_{j}") for i, x in enumerate(xs) for j, y in enumerate(xs) if j >= i]
        r = rows.agg(*slope, *curve).first()
        if r["g0"] is None:
            break
        g = np.array([r[f"g{i}"] for i in range(len(xs))])
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(len(xs))] for i in range(len(xs))])
        step = np.linalg.solve(h + 1e-9 * np.eye(len(xs)), g)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    return w.tolist()


def logistic_fits(rows: DataFrame, features: list[str], successes: str, trials: str, fold: str, fits: list[tuple[list[str], int | None]], rounds: int = 25, tolerance: float = 1e-9) -> list[list[float]]:
    """Weights (constant, then all features, 0 where unused) of many binomial logistic models at once.

    A fit is the features that it uses and the fold that it leaves out (None: no fold). A Newton step of all fits is one
    aggregate: every row meets the fits as an array of a few literals, and the driver gets a row a fit.
    """
    d, xs = len(features) + 1, [F.lit(1.0), *map(F.col, features)]
    used = [[0, *(1 + features.index(f) for f in names)] for names, _ in fits]
    w, open_ = np.zeros((len(fits), d)), set(range(len(fits)))
    for _ in range(rounds):
        if not open_:
            break
        now = [F.struct(F.lit(i).alias("id"), F.lit(-1 if fits[i][1] is None else fits[i][1]).alias("out"), F.array(*[F.lit(float(v)) for v in w[i]]).alias("w")) for i in sorted(open_)]
        met = rows.withColumn("fit", F.explode(F.array(*now))).where(F.col("fit.out") != F.col(fold))
        eta = sum((x * F.col("fit.w")[j] for j, x in enumerate(xs)), F.lit(0.0))
        met = met.withColumn("p", 1 / (1 + F.exp(-eta)))
        slope = [F.sum(x * (F.col(successes) - F.col(trials) * F.col("p"))).alias(f"g{i}") for i, x in enumerate(xs)]
        curve = [F.sum(x * y * F.col(trials) * F.col("p") * (1 - F.col("p"))).alias(f"h{i}_{j}") for i, x in enumerate(xs) for j, y in enumerate(xs) if j >= i]
        got = {r["id"]: r for r in met.groupBy("fit.id").agg(*slope, *curve).collect()}
        for i in sorted(open_):
            r, u = got.get(i), used[i]
            if r is None:
                open_.discard(i)
                continue
            g = np.array([r[f"g{a}"] for a in u])
            h = np.array([[r[f"h{min(a, b)}_{max(a, b)}"] for b in u] for a in u])
            step = np.linalg.solve(h + 1e-9 * np.eye(len(u)), g)
            w[i, u] += step
            if np.abs(step).max() < tolerance:
                open_.discard(i)
    return w.tolist()


def auc_by(rows: DataFrame, score: str, successes: str, trials: str, groups: list[str]) -> DataFrame:
    """groups (few), auc: weighted area under the curve, ties half: an aggregate by score, then a sum over lower scores."""
    by = rows.groupBy(*groups, F.col(score).alias("s")).agg(F.sum(successes).alias("p"), F.sum(F.col(trials) - F.col(successes)).alias("q"))
    lower = before(by, ["s"], F.col("q"), "below", tuple(groups))
    area = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / F.when((F.sum("p") > 0) & (F.sum("q") > 0), F.sum("p") * F.sum("q"))
    return lower.groupBy(*groups).agg(area.alias("auc"))


def auc(rows: DataFrame, score: str, successes: str, trials: str) -> float:
    """Weighted area under the curve of all rows."""
    r = auc_by(rows.withColumn("group", F.lit(0)), score, successes, trials, ["group"]).first()
    return math.nan if r is None or r["auc"] is None else float(r["auc"])


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation, by Student's t with n - 2 degrees of freedom (continued fraction)."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 and n >= 3 else math.nan
    x = 1 - r * r  # = df / (df + t^2)
    return _beta(x, (n - 2) / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or 1e-30)
        c = 1 + k / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)
