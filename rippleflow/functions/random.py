"""Counter-based random numbers as Column expressions: the same for any partitioning, and in other engines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(keys: list[Column]) -> Column:
    """A uniform number in (0, 1) from the keys."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(4503599627370496.0)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def normal_cdf(x: Column) -> Column:
    """By the complementary error function's Chebyshev fit; absolute error below 1.2e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    # Coefficients of the fit, from the constant term up.
    poly = F.lit(0.0)
    for c in reversed([-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]):
        poly = poly * t + c
    erfc = t * F.exp(-z * z + poly)
    return F.when(x >= 0, 1 - erfc / 2).otherwise(erfc / 2)


def normal_quantile(p: Column) -> Column:
    """Rational approximation in three regions; relative error below 1.2e-9."""
    # Numerator and denominator of the centre, then of the tails, highest power first.
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]

    def horner(coefficients: list[float], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out

    def of(u: Column) -> Column:
        tail = lambda x: horner(c, x) / horner(d, x)
        centre = _let((u - 0.5) * (u - 0.5), lambda r: horner(a, r) / horner(b, r)) * (u - 0.5)
        return F.when(u < 0.02425, _let(F.sqrt(-2 * F.log(u)), tail)).when(u > 1 - 0.02425, -_let(F.sqrt(-2 * F.log(1 - u)), tail)).otherwise(centre)

    return _let(p, of)


def truncated_normal(u: Column, mu: float, sigma: float, low: float, high: float) -> Column:
    """Inverse of the distribution function between the bounds."""
    phi = lambda x: 0.5 * math.erfc(-(x - mu) / sigma / math.sqrt(2))
    a, b = phi(low), phi(high)
    value = mu + sigma * normal_quantile(F.greatest(F.lit(1e-300), a + u * (b - a)))
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def race(u: Column, weight: Column) -> Column:
    """Exponential arrival times: the k earliest are a weighted sample of k without replacement."""
    return F.when(weight > 0, -F.log(u) / weight)
