"""Searches from many nodes at once, by bits, in tasks that hold the links of their sources' components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut
from .order import numbered

#: Groups of sources a core; words of 64 sources that a task holds at a time for its nodes, or for links.
GROUPS, WORDS = 2, 1 << 23


def _searcher() -> Callable:
    """A function that travels to tasks by itself: breadth-first searches from sources, told level by level.

    Nodes are numbers below `nodes`, links (src, dst) sorted by dst. Some 64 to 1,024 sources go at once, a bit each; a level ORs
    what its links' ends reached last. visit(d, heads, bits) gets the nodes that level d reaches anew and from which sources.
    """

    def search(sources: np.ndarray, src: np.ndarray, dst: np.ndarray, nodes: int, words: int, visit: Callable) -> None:
        wide = 64 * max(1, min(16, words // max(nodes, 1)))
        for low in range(0, len(sources), wide):
            mine = sources[low : low + wide]
            w = -(-len(mine) // 64)
            k = np.arange(len(mine))
            fresh = np.zeros((nodes, w), np.uint64)
            np.bitwise_or.at(fresh, (mine, k >> 6), np.uint64(1) << (k & 63).astype(np.uint64))
            seen, d = fresh.copy(), 0
            while True:
                d += 1
                live = np.flatnonzero(fresh.any(axis=1)[src])
                if not len(live):
                    break
                to = dst[live]
                first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                heads, ends = to[first], np.append(first[1:], len(live))
                bits, at = np.empty((len(heads), w), np.uint64), 0
                while at < len(heads):  # as many heads at a time as their links allow, one at least
                    upto = max(at + 1, int(np.searchsorted(ends, first[at] + words // w, "right")))
                    a, b = first[at], ends[upto - 1]
                    bits[at:upto] = np.bitwise_or.reduceat(fresh[src[live[a:b]]], first[at:upto] - a, axis=0)
                    at = upto
                bits &= ~seen[heads]
                some = bits.any(axis=1)
                heads, bits = heads[some], bits[some]
                seen[heads] |= bits
                fresh = np.zeros((nodes, w), np.uint64)
                fresh[heads] = bits
                visit(d, heads, bits, mine)

    return search


def in_tasks(e: DataFrame, labels: DataFrame, sources: DataFrame, counts: bool) -> DataFrame:
    """node, d, n: from how many sources a node has distance d > 0 (counts); or node, ecc: the greatest distance that a source has.

    e: distinct links (src, dst) without loops, labels: node, component; sources (node) that have links ahead. Sources are dealt to
    groups in the order of components; a group gets the links of its components only, in lists by head, and searches one component
    after the other.
    """
    placed = cut(numbered(sources.select("node").join(labels, "node"), ["component", "node"], "k"))
    per = max(64, -(-placed.count() // (GROUPS * e.sparkSession.sparkContext.defaultParallelism)))
    placed = cut(placed.withColumn("g", F.floor(F.col("k") / per)))
    # A head's list is cut in shares, so that no row of its own grows with the input.
    lists = e.groupBy("dst", F.pmod(F.xxhash64("src"), F.lit(64))).agg(F.collect_list("src").alias("srcs")).select("dst", "srcs")
    held = lists.join(labels.withColumnRenamed("node", "dst"), "dst").join(placed.select("component", F.col("g").alias("h")).distinct(), "component").select("h", "component", "dst", "srcs")
    schema, search, words = "node long, d int, n long" if counts else "node long, ecc int", _searcher(), WORDS

    def one(mine: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pa.Table:
        """A component's sources and links."""
        order = np.argsort(dst, kind="stable")
        names = np.union1d(src, dst)
        src, dst = np.searchsorted(names, src[order]).astype(np.int32), np.searchsorted(names, dst[order]).astype(np.int32)
        n, keys, sums, waiting, far = len(names), [], [], [0], {}

        def added() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, np.concatenate(sums))
            return key, total

        def count(d: int, heads: np.ndarray, bits: np.ndarray, _: np.ndarray) -> None:
            keys.append(d * n + heads.astype(np.int64))
            sums.append(np.bitwise_count(bits).sum(axis=1, dtype=np.int64))
            waiting[0] += len(heads)
            if waiting[0] > 4 * n + (1 << 20):
                keys[:], sums[:] = ([x] for x in added())
                waiting[0] = 0

        def reach(d: int, heads: np.ndarray, bits: np.ndarray, of: np.ndarray) -> None:
            got = np.unpackbits(np.bitwise_or.reduce(bits, axis=0).view(np.uint8), bitorder="little")[: len(of)]
            far.update((int(x), d) for x in of[got == 1])

        search(np.searchsorted(names, mine), src, dst, n, words, count if counts else reach)
        if not counts:
            return pa.table({"node": pa.array(names[list(far)], pa.int64()), "ecc": pa.array(list(far.values()), pa.int32())})
        key, total = added() if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"node": pa.array(names[key % n], pa.int64()), "d": pa.array(key // n, pa.int32()), "n": pa.array(total, pa.int64())})

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        srcs = right.column("srcs").combine_chunks()
        long = np.diff(srcs.offsets.to_numpy())
        src, dst = srcs.flatten().to_numpy(zero_copy_only=False), np.repeat(right.column("dst").to_numpy(), long)
        part, mine, whose = np.repeat(right.column("component").to_numpy(), long), left.column("node").to_numpy(), left.column("component").to_numpy()
        order, own = np.argsort(part, kind="stable"), np.argsort(whose, kind="stable")
        for c in np.unique(whose):
            lo, hi = np.searchsorted(part, [c, c + 1], sorter=order)
            a, b = np.searchsorted(whose, [c, c + 1], sorter=own)
            out.append(one(mine[own[a:b]], src[order[lo:hi]], dst[order[lo:hi]]))
        return pa.concat_tables(out)

    found = placed.select("g", "component", "node").groupBy("g").cogroup(held.groupBy("h")).applyInArrow(group, schema)
    return cut(found.groupBy("node", "d").agg(F.sum("n").alias("n"))) if counts else found
