"""Louvain communities with levels: local moves on a weighted graph, contraction, composition.

A level's graph is a table (src, dst, w) that holds each link both ways, and a community's inner weight as a loop. Nodes
move at once, a random half of them a turn, so that neighbours don't swap for ever; gains are compared in whole numbers, so
a result doesn't depend on partitioning, retries or the order of sums. State is a row a node; a turn is two joins and two
aggregates that combine before their shuffle. Levels shrink, so the first one is nearly all of the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import u01
from .graph import undirected
from .iterate import cut

#: Turns a level, and levels, at most.
TURNS, LEVELS = 12, 5
_WIDE = "decimal(19,0)"


def _moves(links: DataFrame, m2: int, level: int, turns: int) -> DataFrame:
    """node, c: communities after local moves; ends when no node would move."""
    degree = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    state = cut(degree.select("node", "k", F.col("node").alias("c"), F.lit(True).alias("open")))
    outer = links.where("src <> dst")
    for turn in range(turns):
        total = state.groupBy("c").agg(F.sum("k").alias("tot"))
        near = outer.join(state.select(F.col("node").alias("dst"), "c"), "dst").select(F.col("src").alias("node"), "c", "w")
        near = near.union(state.select("node", "c", F.lit(0).cast("long"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
        here = state.select("node", "k", F.col("c").alias("own"))
        option = near.join(here, "node").join(total, "c")
        rest = F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)
        gain = F.lit(m2).cast(_WIDE) * F.col("w").cast(_WIDE) - F.col("k").cast(_WIDE) * rest.cast(_WIDE)
        best = option.groupBy("node").agg(F.max(F.struct(gain.alias("gain"), (F.col("c") == F.col("own")).alias("stay"), (-F.col("c")).alias("low"))).alias("b"))
        to, free = -F.col("b.low"), u01([F.lit("louvain"), F.lit(level), F.lit(turn), F.col("node")]) < 0.5
        state = cut(state.join(best, "node").select("node", "k", F.when(free, to).otherwise(F.col("c")).alias("c"), (to != F.col("c")).alias("open")))
        if state.where("open").isEmpty():
            break
    return state.select("node", "c")


def contract(links: DataFrame, membership: DataFrame) -> DataFrame:
    """The graph of communities: weights between them, and within them as loops."""
    side = lambda x: membership.select(F.col("node").alias(x), F.col("community").alias(f"c_{x}"))
    return links.join(side("src"), "src").join(side("dst"), "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w"))


def quality(contracted: DataFrame, m2: int) -> int:
    """Modularity times m2², a whole number, from a graph of communities."""
    inner = contracted.agg(F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("w"))), F.lit(0))).first()[0]
    total = F.sum("w").cast(_WIDE)
    squares = contracted.groupBy("src").agg((total * total).alias("s")).agg(F.sum("s")).first()[0]
    return m2 * int(inner) - int(squares or 0)


def weighted(edges: DataFrame) -> DataFrame:
    """edges (src, dst, perhaps w) as links both ways; without w, distinct pairs weigh 1. Weights are whole numbers."""
    if "w" not in edges.columns:
        return undirected(edges).withColumn("w", F.lit(1).cast("long"))
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("long").alias("w"))
    loops, others = e.where("src = dst").withColumn("w", 2 * F.col("w")), e.where("src <> dst")
    return others.unionByName(others.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).unionByName(loops).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def louvain_levels(edges: DataFrame, turns: int = TURNS, levels: int = LEVELS) -> list[tuple[DataFrame, float]]:
    """(node, community) and modularity of each level, coarser ones last; a community is named by its least node.

    An edge table without rows gives one level without rows. Nodes without links are in no community.
    """
    links = cut(weighted(edges))
    m2 = int(links.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
    whole, out = None, []
    for level in range(levels):
        found = _moves(links, m2, level, turns)
        low = found.groupBy("c").agg(F.min("node").alias("community"))
        labels = cut(found.join(low, "c").select("node", "community"))
        merged = not labels.where("node <> community").isEmpty()
        if out and not merged:
            break
        whole = labels if whole is None else cut(whole.withColumnRenamed("community", "mid").join(labels.withColumnRenamed("node", "mid"), "mid").select("node", "community"))
        links = cut(contract(links, labels))
        out.append((whole, quality(links, m2) / (m2 * m2) if m2 else 0.0))
        if not merged:
            break
    return out


def louvain(edges: DataFrame, turns: int = TURNS, levels: int = LEVELS) -> DataFrame:
    """node, community of the level with the greatest modularity (the first of equals)."""
    return max(louvain_levels(edges, turns, levels), key=lambda x: x[1])[0]
