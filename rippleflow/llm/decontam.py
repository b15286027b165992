"""Benchmark decontamination under edit distance: CGK embedding, bit-sampling LSH, exact verification.

A window of a text matches an item of m bytes if their edit distance is at most k = floor(rate * m).

1. Regions. k edits leave at least m - Q + 1 - k * Q of an item's Q-byte strings whole (the q-gram lemma). Stretches of a
   text that hold fewer strings of any item of a size can hold no match of that size, and are skipped; that finds no
   candidate and loses none. Items are banded by size, BANDS at most.
2. Candidates. The CGK random walk (at each step it outputs the byte at hand, and goes on or waits by a bit that step and
   byte choose) maps few edits to a few differing outputs. A walk loses step for good after many edits, so a window as
   long as an item is embedded in walks of STEPS steps that start every SEGMENT bytes of the item, and at every byte of a
   region. WALKS walks with SETS samples of BITS steps each give REPETITIONS keys; a text's window goes on to step 3 with
   an item where any key agrees. Sampled steps lie inside the item whatever its length, and the walks' bits are the same
   for all, so nothing but the keys grows with the items.
3. The exact edit distance of the item to the best substring there decides (bit-parallel, free ends).

Items below SHORT bytes have too few strings for 1 and too short walks for 2: k edits leave one of k + 1 parts of the item
whole, so an Aho-Corasick automaton over the parts finds all candidates (no loss).

Each task works on byte-bounded slices of whole texts. The items come in blocks of bounded bytes, at most AT_ONCE a
pass over the texts; a task holds one block's tables at a time; nothing is shuffled. Equal rows give equal rows; null and empty texts and items match nothing; texts and
items of any length are searched whole; of equally near matches the first is reported; an empty table of texts or items
gives no match; other columns, also of names used here, stay.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, quoted, slices, table

Q, TABLE_BITS, BANDS = 8, 20, 32
SHORT, SEGMENT, STEPS = 64, 16, 40
WALKS, SETS, BITS = 4, 5, 7
REPETITIONS = WALKS * SETS
BLOCK_BYTES, CHUNK = 1 << 20, 1 << 15
GROUP_BYTES, AT_ONCE = 1 << 25, 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def edit_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of item to any substring of text, and the first end where it is reached (Myers/Hyyro)."""
    m = len(item)
    if not m:
        return 0, 0
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = ((((eq & plus) + plus) ^ plus) | eq) & full
        up, down = minus | (full & ~(across | plus)), plus & across
        now += bool(up & high) - bool(down & high)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if now < best:
            best, at = now, j
    return best, at


class Cgk:
    """The walks' bits and the sampled steps: the same for all items and texts."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.go = rng.integers(0, 2, (WALKS, STEPS, 256)).astype(np.int64)
        self.marks = [[frozenset(rng.choice(STEPS, BITS, replace=False).tolist()) for _ in range(SETS)] for _ in range(WALKS)]

    def keys(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """REPETITIONS keys of the walks from every start; data goes on for STEPS bytes behind the last."""
        out = np.zeros((REPETITIONS, len(starts)), np.uint64)
        for a in range(0, len(starts), CHUNK):
            part = starts[a : a + CHUNK]
            for w in range(WALKS):
                place, mine = part.copy(), out[w * SETS : (w + 1) * SETS, a : a + CHUNK]
                for t in range(STEPS):
                    c = data[place]
                    for s, marks in enumerate(self.marks[w]):
                        if t in marks:
                            mine[s] = (mine[s] + c + np.uint64(1)) * _ODD
                    place += self.go[w, t][c]
        out ^= out >> np.uint64(31)
        return (out + np.arange(REPETITIONS, dtype=np.uint64)[:, None]) * _ODD


class Band:
    """Items of about one size: what a region of their matches holds, and their walks' keys."""

    def __init__(self, items: list[int], texts: list[bytes], edits: np.ndarray, walk: Cgk):
        self.need = min(len(texts[j]) - Q + 1 - int(edits[j]) * Q for j in items)
        self.width = max(len(texts[j]) + int(edits[j]) for j in items)
        data, starts, owner, offset, at = [], [], [], [], 0
        for j in items:
            data += [texts[j], bytes(STEPS)]
            offsets = range(0, len(texts[j]) - STEPS + 1, SEGMENT)
            starts += [at + o for o in offsets]
            owner += [j] * len(offsets)
            offset += offsets
            at += len(texts[j]) + STEPS
        keys = walk.keys(np.frombuffer(b"".join(data), np.uint8), np.array(starts, np.int64)).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owner, self.offset = np.tile(np.array(owner, np.int32), REPETITIONS)[order], np.tile(np.array(offset, np.int64), REPETITIONS)[order]


class Items:
    """The tables of one block of items."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.floor(self.size * rate + 1e-9).astype(np.int64)
        least = self.size - Q + 1 - self.edits * Q
        walks = (self.size >= max(SHORT, STEPS + SEGMENT)) & (least > 0)
        self.walk, self.bands, self.parts = Cgk(), [], defaultdict(list)
        long = sorted(np.flatnonzero(walks).tolist(), key=lambda j: (len(self.texts[j]), j))
        self.table = np.zeros(1 << TABLE_BITS, np.uint32)
        n = min(BANDS, len(long))
        for b in range(n):
            mine = long[b * len(long) // n : (b + 1) * len(long) // n]
            self.bands.append(Band(mine, self.texts, self.edits, self.walk))
            for j in mine:
                self.table[_slot(_grams(np.frombuffer(self.texts[j], np.uint8)))] |= np.uint32(1 << b)
        for j in np.flatnonzero(~walks).tolist():
            t, k = self.texts[j], min(int(self.edits[j]) + 1, len(self.texts[j]))
            for i in range(k):
                a, b = len(t) * i // k, len(t) * (i + 1) // k
                self.parts[t[a:b]].append((j, a))
        self._automaton = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for part, where in self.parts.items():
                self._automaton.add_word(part.decode("latin-1"), (len(part), where))
            self._automaton.make_automaton()
        return self._automaton


def _grams(raw: np.ndarray) -> np.ndarray:
    """The q-gram at each place as one little-endian number."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    data = raw.tobytes()
    for k in range(min(Q, n)):
        part = np.frombuffer(data, "<u8", count=(len(raw) - k) // 8, offset=k)
        out[k::8] = part[: len(out[k::8])]
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * _ODD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def regions(raw: np.ndarray, items: Items) -> Iterator[tuple[Band, np.ndarray]]:
    """Per band the places that a match of one of its items may cover."""
    mask = items.table[_slot(_grams(raw))]
    at = np.flatnonzero(mask)
    held = mask[at]
    for b, band in enumerate(items.bands):
        pos = at[(held >> np.uint32(b)) & np.uint32(1) == 1]
        if len(pos) < band.need:
            continue
        first, last = pos[: len(pos) - band.need + 1], pos[band.need - 1 :]
        close = last + Q - first <= band.width
        if close.any():
            lo, hi = np.maximum(last[close] + Q - band.width, 0), np.minimum(first[close] + band.width, len(raw))
            new = np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1]])
            head = np.flatnonzero(new)
            size = np.maximum.reduceat(hi, head) - lo[head]
            yield band, np.repeat(lo[head] - np.cumsum(size) + size, size) + np.arange(size.sum())


def candidates(raw: np.ndarray, offsets: np.ndarray, items: Items) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Per text and item the stretches (in bytes of the text) that its match may cover."""
    found, data = [], np.concatenate([raw, np.zeros(STEPS, np.uint8)])
    for band, starts in regions(raw, items):
        keys = items.walk.keys(data, starts)
        first = np.searchsorted(band.keys, keys.ravel())
        first[first == len(band.keys)] = 0
        hit = np.flatnonzero(band.keys[first] == keys.ravel())
        if len(hit):
            entry, start, last = first[hit], np.tile(starts, REPETITIONS)[hit], np.searchsorted(band.keys, keys.ravel()[hit], side="right")
            each = np.repeat(np.arange(len(hit)), last - entry)
            entry = entry[each] + np.arange(len(each)) - np.repeat(np.cumsum(last - entry) - (last - entry), last - entry)
            found.append(np.stack([np.searchsorted(offsets, start[each], side="right") - 1, band.owner[entry], start[each] - band.offset[entry]], axis=1))
    if items.parts:
        near = []
        for end, (size, where) in items.automaton().iter(raw.tobytes().decode("latin-1")):
            text = int(np.searchsorted(offsets, end - size + 1, side="right") - 1)
            if end < offsets[text + 1]:
                near += [(text, j, end - size + 1 - a) for j, a in where]
        found.append(np.array(near, np.int64).reshape(-1, 3))
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for t, j, s in np.unique(np.concatenate(found), axis=0).tolist() if found else ():
        k, m, size = int(items.edits[j]), int(items.size[j]), int(offsets[t + 1] - offsets[t])
        a, b = max(s - int(offsets[t]) - k, 0), min(s - int(offsets[t]) + m + k, size)
        spans = out[t, j]
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return out


def matches(raw: np.ndarray, offsets: np.ndarray, items: Items) -> dict[int, dict[int, tuple[int, int]]]:
    """Per text and item: (least distance, the end of that match in bytes)."""
    out: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
    if not len(raw):
        return out
    for (t, j), spans in candidates(raw, offsets, items).items():
        for a, b in spans:
            text = raw[offsets[t] + a : offsets[t] + b].tobytes()
            exact = text.find(items.texts[j])
            d, e = (0, exact + len(items.texts[j])) if exact >= 0 else edit_distance(items.texts[j], text)
            if d <= items.edits[j]:
                out[t][j] = min(out[t].get(j, (d, a + e)), (d, a + e))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items with text, in blocks of at most about BLOCK_BYTES."""
    rows = benchmark.where(quoted(item_id).isNotNull() & (F.length(quoted(text)) > 0)).select(quoted(item_id).cast("long").alias("i"), quoted(text).alias("t")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-total // BLOCK_BYTES)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else rows
        yield sorted((r["i"], r["t"].encode()) for r in part.toLocalIterator())


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.1, out: str = "leaks") -> DataFrame:
    """docs with column out: array<struct<item, distance, end>> by item, end in bytes of the text's UTF-8.

    An existing column of that name is replaced.
    """
    kept, spark = [c for c in docs.columns if c.lower() != out.lower()], docs.sparkSession
    result = docs.select(*map(quoted, kept)).withColumn(out, F.array().cast("array<struct<item:bigint,distance:int,end:bigint>>"))
    value = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())]))
    blocks, passes = _blocks(benchmark, item_id, item_text), 0
    while some := list(islice(blocks, AT_ONCE)):
        # A block's tables take many times its bytes: one block's are sent whole, of more each task makes one's at a time.
        shared = spark.sparkContext.broadcast([Items(some[0], rate)] if len(some) == 1 else some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for parts in _groups((part for batch in batches for part in slices(batch, text)), text, GROUP_BYTES if len(shared.value) > 1 else 0):
                new = [part.column(out).to_pylist() for part in parts]
                for block in shared.value:
                    items = block if isinstance(block, Items) else Items(block, rate)
                    for part, leaks in zip(parts, new, strict=True):
                        for t, found in matches(*joined(part.column(text)), items).items():
                            leaks[t] = leaks[t] + [{"item": items.ids[j], "distance": d, "end": e} for j, (d, e) in found.items()]
                for part, leaks in zip(parts, new, strict=True):
                    leaks = [sorted(x, key=lambda x: (x["item"], x["distance"], x["end"])) for x in leaks]
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(leaks, value)], names=[*kept, out])

        # A further pass starts from a written table, so that no task runs more than one worker.
        result = (table(result, "scanned") if passes else result).mapInArrow(run, result.schema)
        passes += 1
    return result


def _groups(parts: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Parts in lists of at least limit bytes of text (the last one aside)."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += pc.sum(pc.fill_null(pc.binary_length(part.column(text)), 0)).as_py()
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document and item that it holds: doc_id, item_id, distance."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("x")).groupBy("doc_id", F.col("x.item").alias("item_id")).agg(F.min("x.distance").cast("long").alias("distance"))
