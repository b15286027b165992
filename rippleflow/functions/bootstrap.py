"""Percentile bootstrap of mean and median over distinct values; no row a draw is ever made.

A resample of n rows with replacement is a multinomial count for each distinct value. The order of values is cut into
ranges; the driver draws how many of each resample's rows fall in each range (a multinomial over few ranges), and a task
walks its range in order and splits that number value by value, by conditional binomials, for all resamples at once: its
state is a number a resample, whatever the rows. Sums give the means; as the walk goes by rank, it also meets each median.

Draws depend on the seed, the range and the values' order only, so results don't depend on partitioning or retries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import before

#: Distinct values that a range aims at, and ranges at most.
VALUES, RANGES = 1 << 16, 256


def _walk(shared, seed: int):
    """Per range of (r, y, c) in order: what it adds to every resample (b, sum, low, high median)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, now = shared.value, None
        inside, earlier, mass = x["inside"], x["earlier"], x["mass"]
        n, resamples = x["n"], inside.shape[1]
        ranks = (n - 1) // 2, n // 2
        sums = low = high = left = gone = rest = rng = None

        def done() -> pd.DataFrame:
            return pd.DataFrame({"b": np.arange(resamples), "sum": sums, "low": low, "high": high})

        for frame in frames:
            for r, y, c in zip(frame["r"].tolist(), frame["y"].tolist(), frame["c"].tolist(), strict=True):
                if r != now:
                    if now is not None:
                        yield done()
                    now, rng = r, np.random.Generator(np.random.Philox(key=[seed, r]))
                    sums, low, high = np.zeros(resamples), np.full(resamples, np.nan), np.full(resamples, np.nan)
                    left, gone, rest = inside[r].copy(), earlier[r].copy(), int(mass[r])
                took = left if c >= rest else rng.binomial(left, c / rest)
                sums += y * took
                for out, rank in ((low, ranks[0]), (high, ranks[1])):
                    out[(gone <= rank) & (rank < gone + took)] = y
                gone, left, rest = gone + took, left - took, rest - c
        if now is not None:
            yield done()

    return run


def resampled(rows: DataFrame, value: str, resamples: int, seed: int = 7) -> DataFrame:
    """b, mean, median of every resample of the rows whose value isn't null or NaN; none without such rows."""
    spark = rows.sparkSession
    y = F.col(value).cast("double")
    counts = rows.select(y.alias("y")).where("y IS NOT NULL AND NOT isnan(y)").groupBy("y").agg(F.count("*").alias("c"))
    placed = before(counts, ["y"], F.lit(1).cast("long"), "place")
    size = placed.count()
    schema = "b long, mean double, median double"
    if not size:
        return spark.createDataFrame([], schema)
    ranges = int(min(RANGES, -(-size // VALUES)))
    dealt = placed.select(F.floor(F.col("place") * ranges / size).cast("int").alias("r"), "y", "c")
    held = dict(dealt.groupBy("r").agg(F.sum("c")).collect())  # a row a range
    mass = np.array([held.get(r, 0) for r in range(ranges)], np.int64)
    n = int(mass.sum())
    draws = np.random.Generator(np.random.Philox(key=[seed, 1 << 32])).multinomial(n, mass / n, size=resamples).T if ranges > 1 else np.full((1, resamples), n)
    shared = spark.sparkContext.broadcast({"inside": draws, "earlier": np.cumsum(draws, axis=0) - draws, "mass": mass, "n": n})
    parts = dealt.repartition(F.col("r")).sortWithinPartitions("r", "y").mapInPandas(_walk(shared, seed), "b long, sum double, low double, high double")
    real = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    return parts.groupBy("b").agg((F.sum("sum") / n).alias("mean"), ((real("low") + real("high")) / 2).alias("median"))


def interval(rows: DataFrame, value: str, resamples: int = 2000, statistic: str = "mean", low: float = 0.025, high: float = 0.975, seed: int = 7) -> DataFrame:
    """low, high: percentile interval of the mean or the median."""
    found = resampled(rows, value, resamples, seed)
    return found.agg(F.expr(f"percentile({statistic}, {low}D)").alias("low"), F.expr(f"percentile({statistic}, {high}D)").alias("high"))
