"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows get a seeded hash of all their columns and fall into source blocks by it (the "partitions" of the
   matrix: a function of the row alone, so a recomputed task deals the same rows).
2. The driver counts the blocks and draws, from the multivariate hypergeometric law, how many rows of each
   block go to each target piece. A shard is cut into pieces of known size, so that no task sorts a whole shard.
3. Rows are ranked in random order inside their block and dealt by the drawn counts (local permutation),
   exchanged by piece, and ranked in a second random order there; piece offset plus rank is the slot.

The result has the law of a uniform permutation cut into shards whose row counts differ by at most one.
Both exchanges carry the kept columns once. The matrix has at most 2048 x 2048 cells.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, quoted, row_hash

BINS, MOST_BLOCKS = 4096, 2048


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact draw; beyond numpy's limit of 1e9 by ratio-of-uniforms rejection on log-gamma."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    lg, total = math.lgamma, good + bad
    mean = draws * good / total
    sd = math.sqrt(mean * (bad / total) * (total - draws) / (total - 1)) + 0.5
    log_p = lambda k: -(lg(k + 1) + lg(good - k + 1) + lg(draws - k + 1) + lg(bad - draws + k + 1))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    top, width = log_p(mode), 1.7156 * sd + 1.0
    while True:
        u = rng.random()
        x = mean + 0.5 + width * (rng.random() - 0.5) * 2 / max(u, 1e-300)
        k = math.floor(x)
        if low <= k <= high and 2 * math.log(max(u, 1e-300)) <= log_p(k) - top:
            return k


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> np.ndarray:
    """cells[i, j] rows go from source i to target j; rows sum to sources, columns to targets."""
    if sum(sources) != sum(targets):
        raise ValueError("sources and targets must have equal sums")
    rng = np.random.default_rng(seed)
    cells, left = np.zeros((len(sources), len(targets)), np.int64), np.array(targets, np.int64)
    for i, n in enumerate(sources):
        if left.sum() < 1_000_000_000:
            cells[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            rest, draws = int(left.sum()), n
            for j, here in enumerate(left.tolist()):
                rest -= here
                cells[i, j] = _hypergeometric(rng, here, rest, draws)
                draws -= int(cells[i, j])
        left -= cells[i]
    return cells


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, rows_per_block: int = 1 << 16) -> DataFrame:
    """docs with two more columns, shard (0 .. shards - 1) and slot (gapless from 0 in each shard).

    Shard sizes differ by one row at most. Nulls in any column count as values; equal rows are
    interchangeable and each gets its own slot; an empty table gives an empty result. Columns named
    shard, slot or like the helpers are kept: new columns then get underscores before their names.
    """
    spark, kept = docs.sparkSession, docs.columns
    h, block, rank, piece, cuts = (free_name(kept, f"__{x}") for x in ("h", "block", "rank", "piece", "cuts"))
    to, slot = free_name(kept, "shard"), free_name(kept, "slot")
    hashed = docs.withColumn(h, row_hash(docs, seed))
    bins = dict(hashed.groupBy(F.pmod(F.col(h), F.lit(BINS)).alias("bin")).count().collect())  # 4096 rows at most
    rows = sum(bins.values())
    n_blocks = max(shards, min(MOST_BLOCKS, -(-rows // rows_per_block)))
    sizes = [0] * n_blocks
    for b, n in bins.items():
        sizes[b * n_blocks // BINS] += n
    per_shard = min(max(1, -(-rows // (rows_per_block * shards))), max(1, MOST_BLOCKS // shards))
    shard_sizes = _even(rows, shards)
    pieces = [x for n in shard_sizes for x in _even(n, per_shard)]
    cells = communication_matrix(sizes, pieces, seed)
    steps = [1 << i for i in reversed(range((len(pieces)).bit_length()))]
    edges = np.full((n_blocks, 2 * steps[0]), np.iinfo(np.int64).max)
    edges[:, : len(pieces)] = np.cumsum(cells, axis=1)
    deal = spark.createDataFrame([(i, row) for i, row in enumerate(edges.tolist())], T.StructType([T.StructField(block, T.LongType()), T.StructField(cuts, T.ArrayType(T.LongType()))]))

    def search(rank_: Column, cuts_: Column) -> Column:
        """How many cuts are <= rank: a binary search over the padded cumulated row."""
        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.element_at(cuts_, at + s) <= rank_, at + s).otherwise(at))

    # A random order of blocks' rows; columns settle ties between hashes, equal rows are interchangeable.
    order = lambda salt: [F.xxhash64(F.lit(salt), F.col(h)), F.col(h)]
    dealt = (
        hashed.withColumn(block, F.floor(F.pmod(F.col(h), F.lit(BINS)) * n_blocks / BINS).cast("long"))
        .withColumn(rank, F.row_number().over(Window.partitionBy(block).orderBy(*order(seed + 1))).cast("long") - 1)
        .join(deal, block)
        .withColumn(piece, search(F.col(rank), F.col(cuts)))
        .drop(cuts, rank, block)
    )
    last = F.row_number().over(Window.partitionBy(piece).orderBy(*order(seed + 2))).cast("long") - 1
    in_shard = F.pmod(F.col(piece), F.lit(per_shard))
    n_shard = F.lit(rows // shards) + F.when(F.floor(F.col(piece) / per_shard) < rows % shards, 1).otherwise(0)
    start = in_shard * F.floor(n_shard / per_shard) + F.least(in_shard.cast("long"), F.pmod(n_shard, F.lit(per_shard)).cast("long"))
    return dealt.select(*[quoted(c) for c in kept], F.floor(F.col(piece) / per_shard).cast("int").alias(to), (start + last).cast("long").alias(slot))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, files in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard; texts go through both exchanges."""
    to, slot = free_name(docs.columns, "shard"), free_name(docs.columns, "slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + F.lit(8)).cast("long")
    return shard(docs, shards).select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), F.col(to).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
