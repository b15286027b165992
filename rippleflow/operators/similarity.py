"""Exact similarity join of vectors: blocks of the matrix product, each a task."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut

BLOCK = 2048
#: Pivots at most; vectors sampled for them; smallest cosine that still counts as a gain of precision for angles.
PIVOTS, SAMPLE, SLACK = 64, 4096, 1e-5


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """Up to PIVOTS vectors far from one another, of a sample of known size that depends on the keys only."""
    most = 4 * SAMPLE
    share = min(1.0, SAMPLE / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "v").limit(most).collect()
    v = np.array([r["v"] for r in sorted(picked, key=lambda r: r["id"])])
    if not len(v):
        return v
    at, near = [0], v @ v[0]
    while len(at) < min(PIVOTS, max(1, int(np.sqrt(n))), len(v)):
        i = int(near.argmin())
        if near[i] > 1 - 1e-9:
            break
        at.append(i)
        near = np.maximum(near, v @ v[i])
    return v[at]


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, v, p (the nearest pivot), r (angle to it)."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack(batch.column("v").to_numpy(zero_copy_only=False))
            cos = v @ shared.value.T
            p = cos.argmax(axis=1)
            r = np.arccos(np.clip(cos[np.arange(len(p)), p], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(p.astype(np.int32)), pa.array(r)], names=["id", "v", "p", "r"])

    return rows.mapInArrow(run, "id bigint, v array<double>, p int, r double")


def plan_blocks(vectors: DataFrame, floor: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """Vectors dealt to blocks around pivots, the block pairs (x <= y) that may hold a score above floor, and the number of blocks.

    A block is a ring of angles around one pivot, or a share of it by hash where equal angles are too many. If pivots lie an
    angle g apart, vectors of rings [a, b] and [c, d] lie at least max(g - b - d, a - g - d, c - g - b) apart (0 if that is
    less), and around one pivot at least the gap between the rings. Block pairs beyond the angle of floor are never formed.
    """
    n = vectors.count()
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    pivots = _pivots(rows, n)
    if not len(pivots):
        return rows.select("id", "v", F.lit(0).alias("m")), [], 0
    placed = cut(_placed(rows, pivots))
    step = 512  # rings of a histogram, by which blocks are cut
    counted = placed.groupBy("p", F.least(F.floor(F.col("r") / math.pi * step), F.lit(step - 1)).cast("int").alias("s")).agg(F.count("*").alias("n"), F.min("r").alias("a"), F.max("r").alias("b")).collect()
    held = [[] for _ in pivots]
    for x in sorted(counted, key=lambda x: (x["p"], x["s"])):
        held[x["p"]].append(x)
    first, parts, blocks = {}, {}, []
    for p, rings in enumerate(held):  # neighbouring rings share a block up to its size; a ring above it is split by hash
        open_, size = None, 0
        for x in rings:
            many = max(1, -(-x["n"] // block))
            if open_ is None or many > 1 or size + x["n"] > block:
                open_, size = len(blocks), 0
                blocks += [[p, x["a"], x["b"]] for _ in range(many)]
            else:
                blocks[open_][2] = x["b"]
            first[p * step + x["s"]], parts[p * step + x["s"]] = open_, many
            size = size + x["n"] if many == 1 else block
    table = rows.sparkSession.createDataFrame([(k, first[k], parts[k]) for k in first], "ring int, first int, parts int")  # PIVOTS x 512 rows at most
    ring = (F.col("p") * step + F.least(F.floor(F.col("r") / math.pi * step), F.lit(step - 1))).cast("int")
    dealt = placed.withColumn("ring", ring).join(F.broadcast(table), "ring").select("id", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("m"))
    own, a, b = (np.array([x[i] for x in blocks]) for i in range(3))
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    limit, pairs = math.acos(max(-1.0, min(1.0, floor))) + SLACK, []
    for x in range(len(blocks)):
        g = apart[own[x], own[x:]]
        g[own[x:] == own[x]] = 0.0
        least = np.maximum(np.maximum(g - b[x] - b[x:], a[x] - g - b[x:]), a[x:] - g - b[x])
        pairs += [(x, x + int(y)) for y in np.flatnonzero(least <= limit)]
    return dealt, pairs, len(blocks)


def _met(vectors: DataFrame, floor: float, key: str, vector: str, block: int) -> tuple[DataFrame | None, Callable]:
    """id, v, m, x, y: vectors of block m once for each block pair (x, y) of theirs that may hold a score above floor; and
    a function of a block pair's rows: the ids of both blocks, the rounded scores between them, and whether they are one."""
    dealt, pairs, _ = plan_blocks(vectors, floor, key, vector, block)

    def scores(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        ids, m, (x, y) = part.column("id").to_numpy(), part.column("m").to_numpy(), (part.column(c)[0].as_py() for c in "xy")
        v = np.stack(part.column("v").to_numpy())
        left, right = m == x, m == y
        return ids[left], ids[right], np.round(v[left] @ v[right].T, 6), x == y

    if not pairs:
        return None, scores
    both = vectors.sparkSession.createDataFrame(pd.DataFrame({"x": [x for x, _ in pairs], "y": [y for _, y in pairs]}).astype("int32"))
    goes = both.select(F.col("x").alias("m"), "x", "y").union(both.where("x <> y").select(F.col("y").alias("m"), "x", "y"))
    return dealt.join(goes, "m"), scores


def all_pairs(vectors: DataFrame, floor: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """a, b, score (6 digits) of all pairs with score > floor, both ways and with themselves; vectors have unit norm.

    A block pair's product is one dense multiplication, so no task holds more than 2 x block vectors, and only the pairs
    above floor leave it. Block pairs that can't reach floor by their angles (`plan_blocks`) are not formed, and a vector
    travels once for each block pair that is.
    """
    none = "a bigint, b bigint, score double"
    met, scores = _met(vectors, floor, key, vector, block)
    if met is None:
        return vectors.sparkSession.createDataFrame([], none)

    def multiply(part: pa.Table) -> pa.Table:
        left, right, score, same = scores(part)
        i, j = np.nonzero(score > floor)
        a, b, s = left[i], right[j], score[i, j]
        if not same:
            a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    return met.groupBy("x", "y").applyInArrow(multiply, none)


def pair_counts(vectors: DataFrame, floors: list[float], key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """floor, pairs: how many rows all_pairs() gives for each floor (floors without any are left out).

    A block pair's task counts its product for all floors, so a row a floor leaves it and no pair is written.
    """
    none = "floor double, pairs bigint"
    met, scores = _met(vectors, min(floors), key, vector, block)
    if met is None:
        return vectors.sparkSession.createDataFrame([], none)

    def count(part: pa.Table) -> pa.Table:
        _, _, score, same = scores(part)
        return pa.table({"floor": pa.array(floors, pa.float64()), "pairs": pa.array([int((score > f).sum()) * (1 if same else 2) for f in floors], pa.int64())})

    return met.groupBy("x", "y").applyInArrow(count, none).groupBy("floor").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def best_match(left: DataFrame, right: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """a, b, score: for every vector of left the most similar one of right (6 digits; of equal scores the least key).

    Each block pair's task gives one row a vector of its left block, so what is shuffled grows with left times the
    number of right blocks, not with the pairs.
    """
    sides = []
    for side, df in enumerate((left, right)):
        blocks = max(1, -(-df.count() // block))
        sides.append((df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(side).alias("side")), blocks))
    mine = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    (a, na), (b, nb) = sides
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = a.select("id", "v", "side", mine(na).alias("x"), every(nb).alias("y")).union(b.select("id", "v", "side", every(na).alias("x"), mine(nb).alias("y")).select("id", "v", "side", "x", "y"))

    def best(part: pa.Table) -> pa.Table:
        ids, side = part.column("id").to_numpy(), part.column("side").to_numpy()
        v = np.stack(part.column("v").to_numpy())
        rows, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        others = others[np.argsort(ids[others], kind="stable")]
        if not len(rows) or not len(others):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        score = np.round(v[rows] @ v[others].T, 6)
        at = score.argmax(axis=1)
        return pa.table({"a": ids[rows], "b": ids[others][at], "score": score[np.arange(len(rows)), at]})

    found = dealt.groupBy("x", "y").applyInArrow(best, "a bigint, b bigint, score double")
    return found.groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("n"))).alias("m")).select("a", (-F.col("m.n")).alias("b"), F.col("m.score").alias("score"))
