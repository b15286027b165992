"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def _least(pairs: DataFrame) -> DataFrame:
    """u, v and m, the least of u and its neighbours. The aggregate is partial, so a hub costs a row a task; it is a
    table, so that the join can split a hub's edges."""
    least = table(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    found = _least(down)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of one orderable type. Returns node, root: the least node of its component; roots themselves not.

    Loops and repeated edges are allowed; an empty table gives an empty result.
    """
    state, last = table(edges.select("u", "v").where("u <> v").distinct(), "cc"), None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark
        state = table(_small_star(_large_star(state)), "cc")

