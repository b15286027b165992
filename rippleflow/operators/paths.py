"""Path measures without a row for every reachable pair: bounded searches, sketches and batches of sources."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import table_or
from .graph import _union, nodes_of, plain, undirected, weak_components
from .iterate import cut
from .order import numbered
from .searches import in_tasks

#: Groups of sources a core; pairs of a source with a node or link that a task holds at a time.
GROUPS, CELLS = 6, 1 << 22


def levels(both: DataFrame, start: int) -> DataFrame:
    """node, d: distances from one node over links held both ways; a row a node."""
    spark = both.sparkSession
    level = cut(spark.createDataFrame([(start, 0)], "node long, d int"))
    parts, known, d = [level], level, 0
    while True:
        d += 1
        ahead = level.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        level = cut(ahead.join(known.select("node"), "node", "left_anti").withColumn("d", F.lit(d)))
        if level.isEmpty():
            return _union(parts)
        # Over links held both ways, a node ahead is known only from this level or the last one.
        known = parts[-1].union(level)
        parts.append(level)


def eccentricities(both: DataFrame, sources: DataFrame) -> DataFrame:
    """node, ecc: the greatest distance from each of the sources, in a connected graph whose links are held both ways.

    Sources are searched in tasks that hold the links (`searches`), by bits: no row stands for a source and node.
    """
    label = nodes_of(both).select("node", F.lit(0).cast("long").alias("component"))
    found = in_tasks(both, label, sources, False)
    return sources.select("node").join(found, "node", "left").select("node", F.coalesce("ecc", F.lit(0)).alias("ecc"))


def diameter(edges: DataFrame, batch: int = 1 << 16, least: int = 1024) -> int:
    """Exact diameter of a connected undirected graph: a double sweep, a search from a central node, then from all nodes
    whose eccentricity may still be greater than the greatest found.

    A node's eccentricity is at most a partner's plus one, and the centre's plus the distance to it. Nodes with the most
    open partners are searched first, an eighth as many as are open at a time (`least` and `batch` bound it): a hub that
    reaches all soon settles its partners, so most nodes of a network with hubs are never searched. At most a bit for each node of
    a batch is held a node. A graph without edges has 0. Of a graph of several components it would be the centre's only.
    """
    both = cut(undirected(edges))
    first = both.groupBy("src").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "src").first()
    if first is None:
        return 0
    far = lambda df: df.orderBy(F.desc("d"), "node").first()
    a = far(levels(both, first["src"]))
    from_a = cut(levels(both, a["node"]))
    b = far(from_a)
    low, half = b["d"], b["d"] // 2
    from_b = levels(both, b["node"]).withColumnRenamed("d", "e")
    middle = from_a.where(F.col("d") == half).join(from_b.where(F.col("e") == low - half), "node").orderBy("node").first()
    around = cut(levels(both, middle["node"]))
    i = far(around)["d"]
    low = max(low, i)
    # The component's nodes with an upper bound of their eccentricity, exact where the node was searched.
    state = around.select("node", (F.col("d") + i).alias("most"), F.lit(False).alias("known"))
    both = cut(both.join(state.select(F.col("node").alias("src")), "src", "left_semi"))
    while True:
        best = both.join(state.select(F.col("node").alias("dst"), "most"), "dst").groupBy(F.col("src").alias("node"))
        near = best.agg((F.min("most") + 1).alias("m"), F.sum((F.col("most") > low).cast("long")).alias("waiting"))
        open_ = F.col("most") > low
        state = cut(state.join(near, "node", "left").select("node", F.when(F.col("known"), F.col("most")).otherwise(F.least("most", F.coalesce("m", "most"))).alias("most"), "known", "waiting"))
        n = state.where(open_ & ~F.col("known")).count()
        if not n:
            return low
        # `waiting` may count partners that this round has settled; an open node counts itself.
        gain = F.coalesce("waiting", F.lit(0)) + open_.cast("long")
        asked = state.where(~F.col("known") & (gain > 0)).orderBy(F.desc(gain), "node").limit(min(batch, max(least, -(-n // 8))))
        found = cut(eccentricities(both, asked.select("node")))
        low = max(low, found.agg(F.max("ecc")).first()[0])
        state = cut(state.join(found, "node", "left").select("node", F.coalesce("ecc", "most").alias("most"), F.coalesce(F.col("ecc").isNotNull() | F.col("known"), F.lit(False)).alias("known")))


def reach_sketches(edges: DataFrame, lg_k: int = 12, limit: int = 10**6) -> DataFrame:
    """node, reached, total: estimates of how many other nodes paths lead to, and of the sum of their distances.

    A node's sketch of the nodes within t steps is the union of its successors' sketches within t - 1 and itself: a row of
    at most some 2^lg_k bytes a node. Relative standard error of `reached` is about 1.04 / sqrt(2^lg_k) (1.6 % for 12), and
    far less while a node reaches fewer than 2^lg_k / 10 others; `total` adds t times what is new at t, so its error is at
    most that of its terms. Reverse the edges for the nodes that lead here. Ends when no estimate changes.
    """
    e = cut(plain(edges))
    state = cut(nodes_of(e).groupBy("node").agg(F.hll_sketch_agg("node", F.lit(lg_k)).alias("sketch")).select("node", "sketch", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("total")))
    for t in range(1, limit + 1):
        near = e.join(state.select(F.col("node").alias("dst"), "sketch"), "dst").select(F.col("src").alias("node"), "sketch")
        near = near.union(state.select("node", "sketch")).groupBy("node").agg(F.hll_union_agg("sketch").alias("sketch"))
        old = state.select("node", F.col("n").alias("was"), "total")
        n = F.greatest(F.hll_sketch_estimate("sketch"), F.col("was"))
        state = cut(near.join(old, "node").select("node", "sketch", n.alias("n"), (F.col("total") + t * (n - F.col("was"))).alias("total"), (n > F.col("was")).alias("grew")))
        if state.where("grew").isEmpty():
            break
        state = state.drop("grew")
    return state.select("node", (F.col("n") - 1).alias("reached"), "total")


def closeness_sketch(edges: DataFrame, nodes: DataFrame, lg_k: int = 12) -> DataFrame:
    """node, closeness: as graph.closeness, from sketches of the nodes that lead to it."""
    n = nodes.count()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach_sketches(back, lg_k)
    value = F.when(F.col("total") > 0, F.col("reached") / F.col("total") * F.least(F.col("reached") / max(n - 1, 1), F.lit(1.0)))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def _shares() -> Callable:
    """A function that travels to tasks by itself: links' sums of shares of shortest paths from sources, and nodes' of their links ahead.

    Nodes are numbers below `nodes`, links (src, dst) sorted by src. Some sources go at once, so that a place for each of
    their pairs with nodes, and a row for each pair with links, stays within `cells`. A round takes all links that leave a
    level; the way back takes the same links from the last level to the first.
    """

    def shares(sources: np.ndarray, src: np.ndarray, dst: np.ndarray, nodes: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.searchsorted(src, np.arange(nodes + 1))
        degree = np.diff(start)
        of_link, of_node = np.zeros(len(src)), np.zeros(nodes)
        wide = max(1, cells // max(nodes, len(src), 1))
        for low in range(0, len(sources), wide):
            mine = sources[low : low + wide]
            b = len(mine)
            ahead, paths, last = np.arange(b) + mine * b, np.zeros(nodes * b), np.zeros(nodes * b, np.int32)
            seen, levels = np.zeros(nodes * b, bool), []
            paths[ahead], seen[ahead] = 1.0, True
            while len(ahead):
                node, column = np.divmod(ahead, b)
                k = degree[node]
                link = np.repeat(start[node] - np.cumsum(k) + k, k) + np.arange(k.sum())
                to, back = dst[link] * b + np.repeat(column, k), np.repeat(ahead, k)
                new = ~seen[to]
                to, back, link = to[new], back[new], link[new]
                np.add.at(paths, to, paths[back])
                seen[to] = True
                order = np.arange(len(to), dtype=np.int32)
                last[to] = order
                ahead = to[last[to] == order]  # each pair once
                levels.append((to.astype(np.int32), back.astype(np.int32), link.astype(np.int32)))
            delta = np.zeros(nodes * b)
            for to, back, link in reversed(levels):
                share = paths[back] / paths[to] * (1 + delta[to])
                np.add.at(delta, back, share)
                np.add.at(of_link, link, share)
            delta[mine * b + np.arange(b)] = 0.0  # a source is no node between
            of_node += delta.reshape(nodes, b).sum(axis=1)
        return of_link, of_node

    return shares


def _parts(e: DataFrame, labels: DataFrame, sources: DataFrame, links: bool) -> DataFrame:
    """src, dst, t of links, or node, t: sums of shares of shortest paths from sources. Sources are dealt to groups in the order of
    components, and a group gets the links of its components only, 16 bytes each; labels: node, component."""
    begun = sources.select("node").join(e.select(F.col("src").alias("node")).distinct(), "node", "left_semi").join(labels, "node")
    placed = cut(numbered(begun, ["component", "node"], "k"))
    per = max(16, -(-placed.count() // (GROUPS * e.sparkSession.sparkContext.defaultParallelism)))
    placed = placed.withColumn("g", F.floor(F.col("k") / per))
    held = e.join(labels.withColumnRenamed("node", "src"), "src").join(placed.select("component", F.col("g").alias("h")).distinct(), "component").select("h", "src", "dst")
    schema, shares, cells = "src long, dst long, t double" if links else "node long, t double", _shares(), CELLS

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, src, dst = left.column("node").to_numpy(), right.column("src").to_numpy(), right.column("dst").to_numpy()
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        names = np.union1d(src, dst)
        of_link, of_node = shares(np.searchsorted(names, mine), np.searchsorted(names, src), np.searchsorted(names, dst), len(names), cells)
        if not links:
            some = of_node > 0
            return pa.table({"node": pa.array(names[some], pa.int64()), "t": pa.array(of_node[some])})
        some = of_link > 0
        return pa.table({"src": pa.array(src[some], pa.int64()), "dst": pa.array(dst[some], pa.int64()), "t": pa.array(of_link[some])})

    found = placed.select("g", "node").groupBy("g").cogroup(held.groupBy("h")).applyInArrow(group, schema)
    return found.groupBy(*(["src", "dst"] if links else ["node"])).agg(F.sum("t").alias("t"))


def _batched(edges: DataFrame, sources: DataFrame, batch: int, folder: str | None, links: bool) -> list[DataFrame]:
    """The sums of each batch of sources; with a folder, a batch that is whole there is read, not made again."""
    e = cut(plain(edges))
    labels = cut(weak_components(e))
    placed = cut(numbered(sources.select("node"), ["node"], "k").select("node", F.floor(F.col("k") / batch).cast("int").alias("batch")))
    last = placed.agg(F.max("batch")).first()[0]
    parts = []
    for i in range(0 if last is None else last + 1):
        make = lambda: _parts(e, labels, placed.where(F.col("batch") == i).select("node"), links)  # noqa: B023, E731
        parts.append(cut(make()) if folder is None else table_or(e.sparkSession, f"{folder.rstrip('/')}/batch-{batch}-{i:08d}", make))
    return parts


def betweenness(edges: DataFrame, nodes: DataFrame, batch: int = 1 << 20, folder: str | None = None, sample: DataFrame | None = None) -> DataFrame:
    """node, betweenness over (n - 1)(n - 2), added up over batches of sources.

    A batch's sources are searched in tasks, no row stands for a source and node. folder: where the batches' sums are kept, so that a job that was stopped goes on
    with the batch that is missing; it belongs to one edge table. sample: sources (node) that stand for all; the result is
    then off by at most `sample_bound` with the chance given there.
    """
    n = nodes.count()
    parts = _batched(edges, nodes if sample is None else sample, batch, folder, False)
    scale = 1.0 if sample is None else n / max(sample.count(), 1)
    if not parts:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    total = _union(parts).groupBy("node").agg(F.sum("t").alias("t"))
    return nodes.select("node").join(total, "node", "left").select("node", (F.coalesce("t", F.lit(0.0)) * (scale / max(1, (n - 1) * (n - 2)))).alias("betweenness"))


def edge_betweenness(edges: DataFrame, nodes: DataFrame, batch: int = 1 << 20, folder: str | None = None) -> DataFrame:
    """src, dst, betweenness over n (n - 1), by the same batches."""
    n = nodes.count()
    parts = _batched(edges, nodes, batch, folder, True)
    e = plain(edges)
    if not parts:
        return e.select("src", "dst", F.lit(0.0).alias("betweenness"))
    total = _union(parts).groupBy("src", "dst").agg(F.sum("t").alias("t"))
    return e.join(total, ["src", "dst"], "left").select("src", "dst", (F.coalesce("t", F.lit(0.0)) / max(1, n * (n - 1))).alias("betweenness"))


def sample_bound(nodes: int, sources: int, chance: float = 0.05) -> float:
    """By Hoeffding and a union over nodes: with probability 1 - chance no node's sampled betweenness is off by more.

    A source adds at most n - 2 to a node, so normalised values are means of numbers in [0, n / (n - 1)].
    """
    return nodes / max(nodes - 1, 1) * math.sqrt(math.log(2 * nodes / chance) / (2 * sources))
