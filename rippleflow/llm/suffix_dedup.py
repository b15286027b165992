"""Removal of repeated substrings by common-prefix intervals of sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else in the corpus (matches stay inside
texts). Every window of LENGTH bytes names one anchor, the leftmost least hash among its GRAM-byte strings, so
equal windows name equal anchors at equal places, and only suffixes at anchors (one in 80 bytes) are compared:

1. One pass writes per anchor and run of windows that name it: hash of the anchor, hash of the bytes that the
   run's windows cover (the context), and where. Anchors that occur once are dropped.
2. Equal contexts are counted, map-side first: every window of a context that occurs twice is repeated.
3. Of anchors with different contexts one copy of each context is fetched. Their suffixes at the anchor, sorted,
   with common-prefix lengths, form an enhanced suffix array; a stack scan lists its intervals. In each, the
   suffixes' left contexts, sorted too, tell how far repeats extend to the left (diversity of left extensions),
   which gives maximal repeats with all occurrences: prefix length + left extension >= LENGTH.
   A group of more than MOST contexts is cut in halves of its window offsets, whose keys are the bytes that all
   windows of a half hold; equal halves are counted like contexts, so a very common passage costs its distinct
   borders only. At a single offset a group has one member left, so every group gets small, and none is dropped.
4. Spans are gathered by text, merged and cut.

Hashes only group: compared are bytes, but for contexts, equal in two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, free_name, joined, quoted, row_hash, slices, table

LENGTH, GRAM = 200, 40
REACH = LENGTH - GRAM  # an anchor lies 0 .. REACH bytes after its window's start
MOST = 2048
_BASE = 0xD6E8FEB86659FD93
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_kept: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; kept by the worker up to the usual batch."""
    if len(_kept.get("up", ())) < n:
        size = max(n, BATCH_BYTES + LENGTH + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _kept[name] = np.multiply.accumulate(steps, dtype=np.uint64)
    return _kept["up"][:n], _kept["down"][:n]


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows inside the texts that end at ends: (anchor, first window, last window, anchor hash, context hash)."""
    n, none = len(raw), np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=total[1:])
    gram = _mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    least = (gram >> np.uint64(32)).astype(np.uint32)
    place, width = np.arange(len(least), dtype=np.int32), 1

    def pair(step: int) -> None:
        nonlocal least, place
        left = least[:-step] <= least[step:]
        place = np.where(left, place[:-step], place[step:])
        least = np.where(left, least[:-step], least[step:])

    while 2 * width <= REACH + 1:
        pair(width)
        width *= 2
    if width <= REACH:
        pair(REACH + 1 - width)
    whole = np.ones(len(place), bool)
    for e in ends[:-1].tolist():  # windows over the border of two texts
        whole[max(0, e - LENGTH + 1) : e] = False
    start = np.flatnonzero(whole)
    if not len(start):
        return none, none, none, none, none
    at = place[start].astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    first, last, at = start[head], start[np.concatenate([head[1:], [len(start)]]) - 1], at[head]
    context = _mix((total[last + LENGTH] - total[first]) * down[first]) + _mix(((at - first) * 1024 + (last - first)).astype(np.uint64))
    return at, first, last, gram[at], context


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, ends of texts, place of the bytes in a long text); a long text comes in overlapping parts."""
    if len(offsets) == 2 and len(raw) > 2 * BATCH_BYTES:
        for a in range(0, len(raw) - LENGTH + 1, BATCH_BYTES):
            part = raw[a : a + BATCH_BYTES + LENGTH - 1]
            yield part, np.array([len(part)]), a
    else:
        yield raw, offsets[1:], 0


def anchor_table(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, a (anchor hash), c (context hash), at (anchor's place), lo and hi (its distance from the windows' starts)."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*map(quoted, keys)).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                raw, offsets = joined(part.column(text))
                for data, ends, shift in _pieces(raw, offsets):
                    at, first, last, a, c = anchors(data, ends)
                    if len(at):
                        owner = np.searchsorted(ends, at, side="right")
                        base = np.concatenate([[0], ends])[owner] - shift
                        rows = pa.array(owner)
                        cols = [part.column(k).take(rows) for k in keys]
                        new = [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(at - base), pa.array((at - last).astype(np.int16)), pa.array((at - first).astype(np.int16))]
                        yield pa.RecordBatch.from_arrays([*cols, *new], names=[*keys, "a", "c", "at", "lo", "hi"])

    return docs.select(*map(quoted, dict.fromkeys([*keys, text]))).mapInArrow(run, f"{kind}, a bigint, c bigint, at bigint, lo smallint, hi smallint")


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low = 0  # x[:low] == y[:low], x[:n] != y[:n]
    while n - low > 1:
        mid = (low + n) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            n = mid
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of a sorted list; lcp[i] is that of its items i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack and now < stack[-1][0]:
            length, first = stack.pop()
            yield length, first, i - 1
        if not stack or now > stack[-1][0]:
            stack.append((now, first))
    while stack:
        length, first = stack.pop()
        if length:
            yield length, first, len(lcp) - 1


class _LeastOf:
    """Minima over ranges of a list: a sparse table."""

    def __init__(self, values: list[int]):
        self.rows = [np.array(values, np.int64)]
        while 2 ** len(self.rows) <= len(values):
            half, row = 2 ** (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(row[:-half], row[half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first .. last], both included."""
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.rows[k][first[m]], self.rows[k][last[m] - 2**k + 1])
        return out


def repeats(contexts: list[tuple[bytes, int, int]]) -> list[list[tuple[int, int]]]:
    """contexts: (bytes, lo, hi) around one anchor, which is hi bytes in; windows start lo .. hi bytes before it.

    Per context the repeated stretches relative to the anchor, from the maximal repeats that it takes part in.
    """
    n = len(contexts)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    right = [c[hi:] for c, _, hi in contexts]
    left = [c[:hi][::-1] for c, _, hi in contexts]

    def found(i: int, length: int, extension: int) -> None:
        _, lo, hi = contexts[i]
        nearest, furthest = max(lo, LENGTH - length), min(hi, extension)
        if nearest <= furthest:
            out[i].append((-furthest, LENGTH - nearest))

    if n == 2:
        length, extension = common_prefix(right[0], right[1]), common_prefix(left[0], left[1])
        found(0, length, extension)
        found(1, length, extension)
        return out
    order = sorted(range(n), key=right.__getitem__)
    lcp = [0] + [common_prefix(right[x], right[y]) for x, y in zip(order, order[1:], strict=False)]
    by_left = sorted(range(n), key=left.__getitem__)
    left_lcp = [0] + [common_prefix(left[x], left[y]) for x, y in zip(by_left, by_left[1:], strict=False)]
    rank, suffix, least = np.empty(n, np.int64), np.array(order), _LeastOf(left_lcp)
    rank[by_left] = np.arange(n)
    members = np.array(by_left)
    for length, first, last in intervals(lcp):
        if last == first or length < GRAM:
            continue
        ranks = np.sort(rank[suffix[first : last + 1]])
        shared = least(ranks[:-1] + 1, ranks[1:])  # left extensions that neighbours share
        if length + int(shared.max()) < LENGTH:
            continue
        best = np.maximum(np.concatenate([[0], shared]), np.concatenate([shared, [0]]))
        for r, e in zip(ranks.tolist(), best.tolist(), strict=True):
            if length + e >= LENGTH:
                found(int(members[r]), length, e)
    return out


def _solve(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by g: groups of contexts; yields keys, s, e of repeated stretches of contexts with n = 1."""
    held: list[dict] = []

    def close(rows: list[dict]) -> list[dict]:
        if len(rows) < 2:
            return []
        spans = repeats([(r["text"], r["lo"], r["hi"]) for r in rows])
        return [{**{k: r[k] for k in keys}, "s": r["at"] + s, "e": r["at"] + e} for r, found in zip(rows, spans, strict=True) if r["n"] == 1 for s, e in found]

    schema = None
    for batch in batches:
        schema = schema or pa.schema([*[batch.schema.field(k) for k in keys], pa.field("s", pa.int64()), pa.field("e", pa.int64())])
        out = []
        for row in batch.to_pylist():
            if held and held[0]["g"] != row["g"]:
                out += close(held)
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held and (out := close(held)):
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _halved(big: DataFrame, keys: list[str]) -> DataFrame:
    """Contexts (g, d0, d1, keys, at, lo, hi, n, text) in halves of the offsets d0 .. d1, with new keys g."""
    mid = F.floor((F.col("d0") + F.col("d1")) / 2).cast("int")
    halves = F.array(F.struct(F.col("d0").alias("x"), mid.alias("y")), F.struct((mid + 1).alias("x"), F.col("d1").alias("y")))
    cut = big.select("*", F.explode(halves).alias("h")).withColumn("l2", F.greatest("lo", "h.x").cast("smallint")).withColumn("h2", F.least("hi", "h.y").cast("smallint")).where("l2 <= h2")
    # Bytes i - h2 .. i - l2 + LENGTH; all windows of the half hold i - x .. i - y + LENGTH.
    sub = F.substring("text", F.col("hi") - F.col("h2") + 1, F.col("h2") - F.col("l2") + LENGTH)
    held = F.substring("text", F.col("hi") - F.col("h.x") + 1, F.col("h.x") - F.col("h.y") + LENGTH)
    return cut.select(F.xxhash64("g", "h.x", "h.y", held).alias("g"), F.col("h.x").alias("d0"), F.col("h.y").alias("d1"), *map(quoted, keys), "at", F.col("l2").alias("lo"), F.col("h2").alias("hi"), "n", sub.alias("text"))


def spans(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, s, e: repeated stretches (in bytes, overlapping) of the texts; rows of equal keys must be equal."""
    every = table(anchor_table(docs, keys, text), "anchors")
    often = table(every.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "often")  # a table: so the join can split a hot key
    shared = table(every.join(often, "a", "left_semi"), "shared")
    where = F.struct(*map(quoted, keys), "at", "lo", "hi")
    distinct = table(shared.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(where).alias("w")), "contexts")
    copied = shared.join(distinct.where("n > 1").select("a", "c"), ["a", "c"], "left_semi")
    parts = [copied.select(*map(quoted, keys), (F.col("at") - F.col("hi")).alias("s"), (F.col("at") - F.col("lo") + LENGTH).alias("e"))]
    mixed = table(distinct.groupBy("a").agg(F.count("*").alias("d"), F.min("n").alias("least")).where("d > 1 and least = 1").select("a"), "mixed")
    wanted = distinct.join(mixed, "a", "left_semi").select("a", "n", "w.*")
    todo = table(_contexts(docs, wanted, keys, text), "groups")
    while True:
        sizes = table(todo.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1"), "sizes")
        sized = todo.join(sizes.select("g", "m"), "g")
        small = sized.where(F.col("m") <= MOST).drop("m")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*map(quoted, keys)).schema.fields)
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts.append(table(small.repartition(n, "g").sortWithinPartitions("g").mapInArrow(lambda b: _solve(b, keys), f"{schema}, s bigint, e bigint"), "solved"))
        big = table(sized.where(F.col("m") > MOST).drop("m"), "big")
        if big.isEmpty():
            break
        halves = table(_halved(big, keys), "halves")
        sub = halves.withColumn("x", F.xxhash64("text", "lo", "hi"))
        cols = F.struct(*map(quoted, keys), "at", "lo", "hi", "d0", "d1", "text")
        merged = table(sub.groupBy("g", "x").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min(cols).alias("w")), "merged")
        twice = sub.where("n = 1").join(merged.where("k > 1").select("g", "x"), ["g", "x"], "left_semi")
        parts.append(twice.select(*map(quoted, keys), (F.col("at") - F.col("hi")).alias("s"), (F.col("at") - F.col("lo") + LENGTH).alias("e")))
        todo = merged.select("g", "w.d0", "w.d1", *[F.col("w")[k].alias(k) for k in keys], "w.at", "w.lo", "w.hi", "n", "w.text")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _contexts(docs: DataFrame, wanted: DataFrame, keys: list[str], text: str) -> DataFrame:
    """wanted (a, n, keys, at, lo, hi) with the context's bytes, as groups g with offsets d0 .. d1."""
    t, w = free_name(keys, "__t"), free_name(keys, "__w")
    lists = wanted.groupBy(*map(quoted, keys)).agg(F.collect_list(F.struct("a", "n", "at", "lo", "hi")).alias(w))
    right = lists.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)], w)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & quoted(k).eqNullSafe(F.col(f"__k{i}"))
    rows = docs.select(*map(quoted, keys), quoted(text).alias(t)).join(right, on).select(*map(quoted, keys), t, w)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*map(quoted, keys)).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, t):
                data = pc.cast(part.column(t), pa.binary()).to_pylist()
                lists_ = part.column(w).to_pylist()
                owner = [i for i, x in enumerate(lists_) for _ in x]
                flat = [y for x in lists_ for y in x]
                bytes_ = [data[i][y["at"] - y["hi"] : y["at"] - y["lo"] + LENGTH] for i, y in zip(owner, flat, strict=True)]
                col = lambda name, kind: pa.array([y[name] for y in flat], kind)
                own = pa.array(owner, pa.int64())
                zero = np.zeros(len(flat), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [col("a", pa.int64()), pa.array(zero), pa.array(zero + REACH), *[part.column(k).take(own) for k in keys], col("at", pa.int64()), col("lo", pa.int16()), col("hi", pa.int16()), col("n", pa.int64()), pa.array(bytes_, pa.binary())],
                    names=["g", "d0", "d1", *keys, "at", "lo", "hi", "n", "text"],
                )

    return rows.mapInArrow(run, f"g bigint, d0 int, d1 int, {schema}, at bigint, lo smallint, hi smallint, n bigint, text binary").dropDuplicates(["g", "at", "lo", "hi", *keys])


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes), one row a row of docs.

    A null text counts as empty. Equal rows are copies of each other.
    """
    row, s = "__row", "__spans"
    base = docs.select(quoted(doc_id).alias("id"), row_hash(docs, 31).alias(row), quoted(text).alias("text"))
    keys = ["id", row]
    found = spans(base, keys).groupBy(*keys).agg(F.collect_set(F.struct("s", "e")).alias(s)).select(F.col("id").alias("__i"), F.col(row).alias("__r"), s)
    both = base.join(found, base["id"].eqNullSafe(F.col("__i")) & (F.col(row) == F.col("__r")), "left").select("id", "text", s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
                for t, cuts in zip(pc.cast(part.column("text"), pa.binary()).to_pylist(), part.column(s).to_pylist(), strict=True):
                    t, keep, at, removed, n = t or b"", [], 0, 0, 0
                    end = -1
                    for a, b in sorted((x["s"], x["e"]) for x in cuts or ()):
                        if a > end:  # stretches that touch are one run
                            n += 1
                            keep.append(t[at:a])
                            end, at, removed = b, b, removed + b - a
                        elif b > end:
                            removed, end, at = removed + b - end, b, b
                    keep.append(t[at:])
                    for name, v in zip(rows, (len(t), removed, n, b"".join(keep)), strict=True):
                        rows[name].append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)]], names=["id", *rows])

    kind = dict(base.dtypes)["id"]
    return both.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", doc_id)


def digest(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
