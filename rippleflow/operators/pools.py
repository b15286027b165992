"""How many firms offer something like a thing, without a row for every thing and firm."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut

#: Offers and alike pairs that one cell holds on average; cells of a table of firms by class that a task unfolds at a time.
OFFERS, PAIRS, UNFOLDED = 1 << 22, 1 << 22, 1 << 25
#: Offers of a group of firms that are counted together; counters of a task at a time.
GROUPED, COUNTERS = 20_000, 1 << 22


def _flattener() -> Callable[[pa.ChunkedArray], tuple[np.ndarray, np.ndarray]]:
    """A function that travels to tasks by itself: a list column's values, and for each its row."""

    def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        one = column.combine_chunks()
        return one.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(one)), np.diff(one.offsets.to_numpy()))

    return flat


def united(like: DataFrame, offers: DataFrame, asked: DataFrame | None = None, offers_a_cell: int = OFFERS, pairs_a_cell: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(a, pool) and (a, firm): the number of firms that offer any b alike to a, and the asked pairs that are among them.

    like (a, b), offers (firm, b), asked (a, firm), rows without nulls, repeated ones allowed; all longs. An a without firms
    is left out. Classes a are dealt to groups and firms to blocks by hash; a cell of group and block is a task's work and
    ORs its firms' bits, so offers travel once a group and pairs once a block, and no row stands for a class and firm.
    """
    # Lists of a firm or class are cut in shares, so that no row of its own grows with the input.
    share = lambda key: F.pmod(F.xxhash64(key), F.lit(64))
    offers, like = cut(offers.distinct()), cut(like.distinct())
    blocks, groups = max(1, -(-offers.count() // offers_a_cell)), max(1, -(-like.count() // pairs_a_cell))
    of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    no = F.lit(None).cast("array<long>")
    ones = like.groupBy("a", share("b")).agg(F.collect_list("b").alias("bs")).select("a", "bs", no.alias("firms"), of("a", groups).alias("g"), every(blocks).alias("f"))
    if asked is not None:
        held = asked.distinct().groupBy("a", of("firm", blocks).alias("f"), share("firm")).agg(F.collect_list("firm").alias("firms"))
        ones = ones.union(held.select("a", no, "firms", of("a", groups), "f"))
    others = offers.groupBy("firm", share("b")).agg(F.collect_list("b").alias("bs")).select("firm", "bs", every(groups).alias("g"), of("firm", blocks).alias("f"))
    schema, flat = "a long, firm long, n long", _flattener()

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "firm", "n")})
        here, row = flat(right.column("bs"))
        names, at = np.unique(right.column("firm").to_numpy(), return_inverse=True)
        firm = at[row].astype(np.int32)
        classes, b = np.unique(here, return_inverse=True)
        b = b.astype(np.int32)
        asks = left.filter(pc.is_valid(left.column("firms")))
        left = left.filter(pc.is_valid(left.column("bs")))
        bs, row = flat(left.column("bs"))
        known = np.minimum(np.searchsorted(classes, bs), len(classes) - 1)
        met = classes[known] == bs
        mine, known = left.column("a").to_numpy()[row[met]], known[met].astype(np.int32)
        order = np.argsort(mine, kind="stable")
        mine, known = mine[order], known[order]
        a, start = np.unique(mine, return_index=True)
        if not len(a):
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "firm", "n")})
        end = np.append(start[1:], len(mine))
        who, row = flat(asks.column("firms"))
        whose = asks.column("a").to_numpy()[row] if asks.num_rows else np.zeros(0, np.int64)
        i, j = np.minimum(np.searchsorted(a, whose), len(a) - 1), np.minimum(np.searchsorted(names, who), len(names) - 1)
        fits = (a[i] == whose) & (names[j] == who)
        i, j = i[fits], j[fits]
        order = np.argsort(firm, kind="stable")
        firm, b = firm[order], b[order]
        pool, found = np.zeros(len(a), np.int64), np.zeros(len(i), bool)
        wide = max(64, UNFOLDED // max(len(classes), len(a)) // 64 * 64)
        for low in range(0, len(names), wide):
            size = min(wide, len(names) - low)
            lo, hi = np.searchsorted(firm, [low, low + size])
            flags = np.zeros((len(classes), -(-size // 64) * 64), bool)
            flags[b[lo:hi], firm[lo:hi] - low] = True
            bits = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
            del flags
            full = np.empty((len(a), bits.shape[1]), np.uint64)
            for k in range(len(a)):
                np.bitwise_or.reduce(bits[known[start[k] : end[k]]], axis=0, out=full[k])
            pool += np.bitwise_count(full).sum(axis=1, dtype=np.int64)
            ours = np.flatnonzero((j >= low) & (j < low + size))
            at = j[ours] - low
            found[ours] = (full[i[ours], at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        some = pool > 0
        a_out, firms = np.concatenate([a[some], a[i[found]]]), names[j[found]]
        firm_out = pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(firms, pa.int64())])
        return pa.table({"a": pa.array(a_out, pa.int64()), "firm": firm_out, "n": pa.array(np.concatenate([pool[some], np.ones(len(firms), np.int64)]), pa.int64())})

    cells = cut(ones.groupBy("g", "f").cogroup(others.groupBy("g", "f")).applyInArrow(cell, schema))
    return cells.where("firm IS NULL").groupBy("a").agg(F.sum("n").alias("pool")), cells.where("firm IS NOT NULL").select("a", "firm")


def best_of(like: DataFrame, offers: DataFrame, offers_a_cell: int = OFFERS >> 2, pairs_a_cell: int = PAIRS >> 4) -> DataFrame:
    """a, b, score, firms: the firms that offer b and nothing alike to a of a higher score (of equal scores, of a lesser b).

    like (a, b, score), offers (firm, b), rows without nulls, repeated ones allowed; all but score longs. Every firm of an a is in
    one of its lists, and a list holds firms of one cell. Cells are those of united(): a class's bits of firms are taken in
    the order of scores, and each takes away the firms that are left, so no row stands for an alike pair and firm.
    """
    share = lambda key: F.pmod(F.xxhash64(key), F.lit(64))
    offers, like = cut(offers.distinct()), cut(like.distinct())
    blocks, groups = max(1, -(-offers.count() // offers_a_cell)), max(1, -(-like.count() // pairs_a_cell))
    of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ones = like.groupBy("a", share("b")).agg(F.collect_list(F.struct("b", "score")).alias("p")).select("a", F.col("p.b").alias("bs"), F.col("p.score").alias("scores"), of("a", groups).alias("g"), every(blocks).alias("f"))
    others = offers.groupBy("firm", share("b")).agg(F.collect_list("b").alias("bs")).select("firm", "bs", every(groups).alias("g"), of("firm", blocks).alias("f"))
    schema, flat = "a long, b long, score double, firms array<long>", _flattener()

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out, lists = [], []
        if left.num_rows and right.num_rows:
            here, row = flat(right.column("bs"))
            names, at = np.unique(right.column("firm").to_numpy(), return_inverse=True)
            firm = at[row].astype(np.int32)
            classes, b = np.unique(here, return_inverse=True)
            b = b.astype(np.int32)
            (bs, row), (scores, _) = flat(left.column("bs")), flat(left.column("scores"))
            known = np.minimum(np.searchsorted(classes, bs), len(classes) - 1)
            met = classes[known] == bs
            mine, known, scores = left.column("a").to_numpy()[row[met]], known[met], scores[met]
            order = np.lexsort((known, -scores, mine))
            mine, known, scores = mine[order], known[order], scores[order]
            a, start = np.unique(mine, return_index=True)
            end = np.append(start[1:], len(mine))
            order = np.argsort(firm, kind="stable")
            firm, b = firm[order], b[order]
            wide = max(64, UNFOLDED // len(classes) // 64 * 64)
            for low in range(0, len(names), wide):
                size = min(wide, len(names) - low)
                lo, hi = np.searchsorted(firm, [low, low + size])
                flags = np.zeros((len(classes), -(-size // 64) * 64), bool)
                flags[b[lo:hi], firm[lo:hi] - low] = True
                bits = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
                del flags
                for k in range(len(a)):
                    rest = np.bitwise_or.reduce(bits[known[start[k] : end[k]]], axis=0)
                    for i in range(start[k], end[k]):
                        if not rest.any():
                            break
                        new = bits[known[i]] & rest
                        found = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
                        if len(found):
                            rest ^= new
                            out.append((a[k], classes[known[i]], scores[i]))
                            lists.append(names[low + found])
        a, b, score = (np.array([x[i] for x in out]) for i in range(3))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        firms = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else [], pa.int64()))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "score": pa.array(score, pa.float64()), "firms": firms})

    return cut(ones.groupBy("g", "f").cogroup(others.groupBy("g", "f")).applyInArrow(cell, schema))


def sharing(offers: DataFrame, pairs: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """firm, other, shared, own: how many things a firm and another one both offer, and the firm's own number of them; or, without
    pairs, firm, others: the number of such others. Firms that share nothing are left out.

    offers (firm, b) and asked (firm, all if None): distinct rows of longs without nulls. A thing's firms travel in lists to each firm
    that offers it, and a group of firms is counted in its task, so no row stands for a thing and two firms and pairs, where they
    are wanted, are made last and not shuffled. What travels is the sum of squares of things' numbers of firms.
    """
    groups = max(1, -(-offers.count() // GROUPED))
    near = offers.groupBy("b").agg(F.collect_list("firm").alias("firms")).select(F.explode("firms").alias("firm"), "firms")
    near = near if asked is None else near.join(asked, "firm", "left_semi")
    near = near.select("firm", "firms", F.pmod(F.xxhash64("firm"), F.lit(groups)).alias("g"))
    flat, counters, schema = _flattener(), COUNTERS, "firm long, other long, shared long, own long" if pairs else "firm long, others long"

    def tally(rows: pa.Table) -> pa.Table:
        who, mine = np.unique(rows.column("firm").to_numpy(), return_inverse=True)
        order = np.argsort(mine, kind="stable")
        firms, row = flat(rows.column("firms").take(pa.array(order)))
        mine, (at, names) = mine[order][row], pd.factorize(firms)
        wide, out = max(1, counters // len(names)), []
        for low in range(0, len(who), wide):
            some = who[low : low + wide]
            lo, hi = np.searchsorted(mine, [low, low + len(some)])
            k = np.bincount((mine[lo:hi] - low) * len(names) + at[lo:hi], minlength=len(some) * len(names)).reshape(len(some), len(names))
            self = np.arange(len(some)), pd.Index(names).get_indexer(some)  # a firm is in the lists of all that it offers
            own = k[self]
            k[self] = 0
            if pairs:
                i, j = k.nonzero()
                out.append((some[i], names[j], k[i, j], own[i]))
            else:
                n = np.count_nonzero(k, axis=1)
                out.append((some[n > 0], n[n > 0]))
        columns = ["firm", "other", "shared", "own"] if pairs else ["firm", "others"]
        return pa.table({c: pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i, c in enumerate(columns)})

    return near.groupBy("g").applyInArrow(tally, schema)
