"""Null models with the degrees of a network, and clustering of many graphs at once.

Copies are rows of one table, told apart by `copy`. Stubs get places in a random order by ranges (`operators.order`), not in
a window a copy; triangles are counted by bits in tasks that hold the links between some blocks of a copy's nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import nodes_of, plain, undirected
from .iterate import cut
from .order import before

#: Links of a cell; words of 64 columns that a task holds for its rows, and for pairs, at a time.
LINKS, WORDS = 1 << 22, 1 << 22


def _shuffled(stubs: DataFrame, copies: int, uniform, purpose: str, keys: list[str]) -> DataFrame:
    """copy, the stubs' columns, and k, the stub's place in a random order of its copy, from 0."""
    each = stubs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    each = each.withColumn("__draw", uniform([F.lit(purpose), F.col("copy"), *map(F.col, keys)]))
    return before(each, ["__draw", *keys], F.lit(1).cast("long"), "k", within=("copy",)).drop("__draw")


def directed_copies(edges: DataFrame, uniform, copies: int) -> DataFrame:
    """copy, src, dst: every copy has the in- and out-degrees of edges up to loops and repeats, which are dropped."""
    e = cut(plain(edges))
    tails = before(e, ["src", "dst"], F.lit(1).cast("long"), "k").select("src", "k")
    heads = _shuffled(e, copies, uniform, "stub", ["src", "dst"]).select("copy", "dst", "k")
    return heads.join(tails, "k").where("src <> dst").select("copy", "src", "dst").distinct()


def undirected_copies(edges: DataFrame, uniform, copies: int) -> DataFrame:
    """copy, src, dst with src < dst: stubs of the undirected graph in a random order are paired; loops and repeats go."""
    stubs = cut(undirected(edges))
    placed = _shuffled(stubs, copies, uniform, "end", ["src", "dst"])
    pairs = placed.groupBy("copy", F.floor(F.col("k") / 2).alias("pair")).agg(F.min("src").alias("src"), F.max("src").alias("dst"))
    return pairs.where("src <> dst").select("copy", "src", "dst").distinct()


def _links(graphs: DataFrame) -> DataFrame:
    """copy, u, v (u < v), w: one row a linked pair, w its number of directions."""
    pairs = graphs.where("src <> dst").select("copy", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "src").distinct()
    return pairs.groupBy("copy", "u", "v").agg(F.count("*").alias("w"))


def _corners() -> Callable:
    """A function that travels to tasks by itself: for each pair (u, v), the sum of w(u, c) w(v, c) over columns c that both are linked to.

    Nodes are numbers below `nodes`; row, col, w: links, w 1 or 2, sorted by col. Columns go in strips of 64 to 4,096, each a bit: a pair's
    shared columns are those of its rows' bits, and the bits of links with w = 2 are added once more for each end.
    """

    def corners(u: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray, w: np.ndarray, nodes: int, words: int) -> np.ndarray:
        total, place = np.zeros(len(u), np.int64), np.full(nodes, -1, np.int32)
        names, start = np.unique(col, return_index=True)
        start, low = np.append(start, len(col)), 0
        while low < len(names):
            wide = 64
            high = min(low + 64 * wide, len(names))
            while wide > 1 and len(np.unique(row[start[low] : start[high]])) * wide > words:
                wide //= 2
                high = min(low + 64 * wide, len(names))
            some = slice(start[low], start[high])
            rows, at = np.unique(row[some], return_inverse=True)
            c = np.searchsorted(names[low:high], col[some])
            place[rows] = np.arange(len(rows))
            pairs = np.flatnonzero((place[u] >= 0) & (place[v] >= 0))
            bits = []
            for held in (np.ones(len(at), bool), w[some] > 1):
                if held.any():
                    bits.append(np.zeros((len(rows), wide), np.uint64))
                    np.bitwise_or.at(bits[-1], (at[held], c[held] >> 6), np.uint64(1) << (c[held] & 63).astype(np.uint64))
            step = max(1, words // wide)
            for k in range(0, len(pairs), step):
                mine = pairs[k : k + step]
                a, b = place[u[mine]], place[v[mine]]
                for x in bits:
                    left = x[a]
                    for y in bits:
                        total[mine] += np.bitwise_count(left & y[b]).sum(axis=1, dtype=np.int64)
            place[rows] = -1
            low = high
        return total

    return corners


def corner_sums(links: DataFrame, most: int = LINKS) -> DataFrame:
    """copy, node, x: the sum over a node's triangles of the product of their links' w (1 or 2); nodes without triangles may be left out.

    Nodes are dealt to blocks, as many as keep a cell's links at some `most`; a cell takes the pairs between two blocks and their links
    to a third one, so a link travels to at most three cells a block and no row stands for two links that meet.
    """
    top = links.groupBy("copy").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, math.ceil(math.sqrt(top / most)))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    each, cell = F.sequence(F.lit(0), F.lit(blocks - 1)), lambda p, q, k: F.struct(F.least(p, q).alias("i"), F.greatest(p, q).alias("j"), k.alias("k"))
    p, q = F.col("p"), F.col("q")
    cells = F.array_distinct(F.concat(F.transform(each, lambda k: cell(p, q, k)), F.transform(each, lambda j: cell(p, j, q)), F.transform(each, lambda j: cell(q, j, p))))
    dealt = links.withColumn("p", of("u")).withColumn("q", of("v")).withColumn("cell", F.explode(cells)).select("copy", "cell.i", "cell.j", "cell.k", "u", "v", F.col("w").cast("byte").alias("w"), "p", "q")
    corners, words = _corners(), WORDS

    def count(rows: pa.Table) -> pa.Table:
        names = np.unique(np.concatenate([rows.column("u").to_numpy(), rows.column("v").to_numpy()]))
        u, v = (np.searchsorted(names, rows.column(x).to_numpy()).astype(np.int32) for x in ("u", "v"))
        w, p, q = (rows.column(x).to_numpy() for x in ("w", "p", "q"))
        i, j, k = (rows.column(x)[0].as_py() for x in ("i", "j", "k"))
        pair = ((p == i) & (q == j)) | ((p == j) & (q == i))
        there, back = ((p == i) | (p == j)) & (q == k), ((q == i) | (q == j)) & (p == k)
        row, col, of_row = np.concatenate([u[there], v[back]]), np.concatenate([v[there], u[back]]), np.concatenate([w[there], w[back]])
        order = np.argsort(col, kind="stable")
        u, v, w = u[pair], v[pair], w[pair].astype(np.int64)
        s = w * corners(u, v, row[order], col[order], of_row[order], len(names), words)
        x = np.zeros(len(names), np.int64)
        np.add.at(x, u, s)
        np.add.at(x, v, s)
        some = np.flatnonzero(x)
        return pa.table({"copy": pa.array(np.full(len(some), rows.column("copy")[0].as_py()), pa.int32()), "node": pa.array(names[some], pa.int64()), "x": pa.array(x[some], pa.int64())})

    # A triangle was counted by both of a node's links.
    return dealt.groupBy("copy", "i", "j", "k").applyInArrow(count, "copy int, node long, x long").groupBy("copy", "node").agg((F.sum("x") / 2).cast("long").alias("x"))


def directed_clustering(graphs: DataFrame, nodes: int) -> DataFrame:
    """copy, clustering: mean of all nodes' directed clustering (0 where no triangle); nodes: their number in every copy.

    A node's directed triangles are counted in all their directions, over tot (tot - 1) - 2 mutual, where tot is its number
    of directed links and mutual that of partners linked both ways. A copy without a triangle has 0.
    """
    links = cut(_links(graphs))
    ends = links.select("copy", F.col("u").alias("node"), "w").union(links.select("copy", "v", "w"))
    degree = ends.groupBy("copy", "node").agg(F.sum("w").alias("tot"), F.sum((F.col("w") == 2).cast("long")).alias("mutual"))
    part = corner_sums(links).join(degree, ["copy", "node"])
    share = F.col("x") / (F.col("tot") * (F.col("tot") - 1) - 2 * F.col("mutual"))
    found = part.groupBy("copy").agg((F.sum(share) / nodes).alias("clustering"))
    return _all_copies(graphs, found, ["clustering"])


def undirected_clustering(graphs: DataFrame, nodes: int) -> DataFrame:
    """copy, clustering (mean of local ones, 0 below two partners), transitivity (closed share of wedges)."""
    links = cut(_links(graphs).withColumn("w", F.lit(1).cast("long")))
    ends = links.select("copy", F.col("u").alias("node")).union(links.select("copy", "v"))
    degree = cut(ends.groupBy("copy", "node").agg(F.count("*").alias("k")))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    part = corner_sums(links).join(degree, ["copy", "node"]).groupBy("copy").agg((F.sum(F.col("x") / pairs) / nodes).alias("clustering"), F.sum("x").alias("closed"))
    wedges = degree.groupBy("copy").agg(F.sum(pairs).alias("wedges"))
    found = wedges.join(part, "copy", "left").select("copy", "clustering", F.when(F.col("wedges") > 0, F.coalesce("closed", F.lit(0)) / F.col("wedges")).alias("transitivity"))
    return _all_copies(graphs, found, ["clustering", "transitivity"])


def _all_copies(graphs: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    return graphs.select("copy").distinct().join(found, "copy", "left").select("copy", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def clustering_against_chance(edges: DataFrame, uniform, directed: int = 50, both_ways: int = 30) -> DataFrame:
    """measure, observed, null_mean, null_sd, ratio, z, copies: C directed, C undirected, and transitivity.

    edges: of one component, as a rule. Mean and deviation (divisor: the copies) are of as many null graphs as asked for.
    """
    e = cut(plain(edges))
    n = nodes_of(e).count()
    if not n:
        return e.sparkSession.createDataFrame([], "measure string, observed double, null_mean double, null_sd double, ratio double, z double, copies long")
    own = e.withColumn("copy", F.lit(0))
    melt = lambda df, kinds: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).alias("x")) for m, c in kinds])).alias("m")).select("m.*")
    one, two = [("directed", "clustering")], [("undirected", "clustering"), ("transitivity", "transitivity")]
    seen = melt(directed_clustering(own, n), one).union(melt(undirected_clustering(own, n), two)).withColumnRenamed("x", "observed")
    null = melt(directed_clustering(cut(directed_copies(e, uniform, directed)), n), one).union(melt(undirected_clustering(cut(undirected_copies(e, uniform, both_ways)), n), two))
    law = null.groupBy("measure").agg(F.avg("x").alias("null_mean"), F.stddev_pop("x").alias("null_sd"), F.count("*").alias("copies"))
    over = lambda a, b: F.when(b != 0, a / b)
    return seen.join(law, "measure").select("measure", "observed", "null_mean", "null_sd", over(F.col("observed"), F.col("null_mean")).alias("ratio"), over(F.col("observed") - F.col("null_mean"), F.col("null_sd")).alias("z"), "copies")
