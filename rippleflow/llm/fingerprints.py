"""Document fingerprints: threshold-scaled sketches of shingle hashes.

Every shingle of five words has a 64-bit hash; a fingerprint keeps each hash below 2^64 / SCALE, the same fraction of any
document, so sketches of very unequal documents compare without a common size, and the sketch of a union is the union of
sketches. A short document has few such hashes, so its FLOOR least hashes are kept too (all, if it has no more): a sketch
is then complete below its own limit, and two sketches compare below the lesser of theirs, which leaves estimates unbiased
and short texts exact. The limit follows from the hashes alone (`limit`), so a fingerprint is nothing but its hashes.

`digest` compares each document with its neighbour in descending doc_id. Rows are dealt to ranges of the order by bounds
from a sample; each range also gets the first row of the next, so that one exchange of the texts is enough and a task
reads its range as a stream, holding two texts at a time beside a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, quoted, slices
from .minhash import _mix, words

WORDS, SCALE, FLOOR = 5, 8, 64
THRESHOLD = np.uint64((1 << 64) // SCALE)
#: Bytes of text that a range aims at, the most ranges, and sampled keys a range.
RANGE_BYTES, MOST_RANGES, KEYS_A_RANGE = 16 << 20, 4096, 16


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle, repeats included; a text of one to four words has one, of all its words."""
    h, text = words(raw, offsets)
    m = max(len(h) - WORDS + 1, 0)
    code = np.zeros(m, np.uint64)
    for k in range(WORDS if m else 0):
        code = _mix(code + h[k : k + m])
    whole = text[:m] == text[WORDS - 1 :] if m else np.zeros(0, bool)
    code, owner = code[whole], text[:m][whole]
    count = np.bincount(text, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        at, one = (np.cumsum(count) - count)[short], np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            more = count[short] > k
            one[more] = _mix(one[more] + h[at[more] + k])
        code, owner = np.concatenate([code, one]), np.concatenate([owner, short])
    return owner, code


def sketches(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted hashes that each text keeps."""
    n = len(offsets) - 1
    owner, code = shingle_hashes(raw, offsets)
    few = np.bincount(owner[code < THRESHOLD], minlength=n) < FLOOR
    wanted = (code < THRESHOLD) | few[owner]
    owner, code = owner[wanted], code[wanted]
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    owner, code = owner[new], code[new]
    ends = np.cumsum(np.bincount(owner, minlength=n))
    out = []
    for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        below = int(np.searchsorted(code[a:b], THRESHOLD))
        if below < FLOOR and not few[i]:  # few distinct hashes that repeat often: look at all of the text's
            one = shingle_hashes(raw[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[1]
            out.append(np.unique(one)[:FLOOR])
        else:
            out.append(code[a : min(b, a + max(below, FLOOR))])
    return out


def limit(sketch: np.ndarray) -> int:
    """All the document's hashes below this are in the sketch (2^64: all)."""
    if len(sketch) < FLOOR:
        return 1 << 64
    return max(int(THRESHOLD), int(sketch[FLOOR - 1]) + 1)


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Sizes of a and b below their common limit, and of what they share there."""
    low = min(limit(a), limit(b))
    if low < 1 << 64:
        a, b = a[: np.searchsorted(a, np.uint64(low))], b[: np.searchsorted(b, np.uint64(low))]
    both = np.sort(np.concatenate([a, b]))
    return len(a), len(b), int((both[1:] == both[:-1]).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the Jaccard similarity of two documents' shingles; 1 if neither has any."""
    x, y, s = _shared(a, b)
    return s / (x + y - s) if x + y else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the share of a's shingles that b has; 1 if a has none."""
    x, _, s = _shared(a, b)
    return s / x if x else 1.0 if not len(a) else 0.0


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    both = np.union1d(a, b)
    return both[: max(FLOOR, int(np.searchsorted(both, THRESHOLD)))]


def to_text(sketch: np.ndarray) -> str:
    """Sixteen hex digits a hash, least first."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with one more column, the text's fingerprint; a null or blank text has an empty one."""
    out = docs.withColumn(name, F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = [to_text(s) for s in sketches(*joined(part.column(text)))]
                at = part.schema.get_field_index(name)
                yield part.set_column(at, part.schema.field(at), pa.array(found, part.schema.field(at).type))

    return out.mapInArrow(run, out.schema)


def collection_hashes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct (key, hash) below the threshold: merged sketches of any collections, as rows, so that none has to fit a task."""
    named = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    kind = named.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                kept = [s[s < THRESHOLD] for s in sketches(*joined(part.column("text")))]
                owners = pa.array(np.repeat(np.arange(len(kept)), [len(s) for s in kept]))
                values = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("key").take(owners), pa.array(values.astype(np.int64))], names=["key", "hash"])

    return named.mapInArrow(run, f"key {kind}, hash bigint").distinct()


def _bounds(keyed: DataFrame) -> list[tuple[int, int, int]]:
    """Keys that cut the order into ranges of like row counts; at most MOST_RANGES - 1, from a sample of known size."""
    rows, size = keyed.agg(F.count("*"), F.sum(F.octet_length("text").cast("double"))).first()
    n = int(min(MOST_RANGES, max(1, (size or 0) // RANGE_BYTES)))
    if n == 1:
        return []
    share = min(1.0, KEYS_A_RANGE * n / rows)
    sample = sorted((r.k0, r.k1, r.h) for r in keyed.where(F.pmod(F.xxhash64("k1", "h"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("k0", "k1", "h").limit(4 * KEYS_A_RANGE * MOST_RANGES).collect())
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []


def _range(bounds: list[tuple[int, int, int]]) -> Column:
    """How many bounds are at most the row's key."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    top = (2, 0, 0)  # above all keys
    padded = [*bounds, *[top] * (2 * steps[0] - len(bounds))]
    table = F.expr("array(" + ",".join(f"named_struct('k0', {a}, 'k1', {_long(b)}, 'h', {_long(c)})" for a, b, c in padded) + ")")
    key = F.struct("k0", "k1", "h")
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.element_at(table, at + s) <= key, at + s).otherwise(at))


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, bucket, ghost) in order inside each bucket of the descending order of doc_id.

    A bucket's rows end with a ghost, the row that follows its last one (after the last row: the first).
    """
    spark = docs.sparkSession
    keyed = docs.select(
        "doc_id", "text", F.col("doc_id").isNull().cast("int").alias("k0"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(0)).cast("long").alias("k1"), F.xxhash64("text", F.lit(29)).alias("h")
    )
    dealt = keyed.withColumn("bucket", _range(_bounds(keyed)).cast("int"))
    heads = sorted((r.head.k0, r.head.k1, r.head.h, r.bucket) for r in dealt.groupBy("bucket").agg(F.min(F.struct("k0", "k1", "h")).alias("head")).collect())  # one a range
    if not heads:
        return dealt.withColumn("ghost", F.lit(False))
    before = [(*h[:3], heads[i - 1][3]) for i, h in enumerate(heads)]
    first = spark.createDataFrame(before, "k0 int, k1 long, h long, to int")
    ghosts = keyed.join(F.broadcast(first), ["k0", "k1", "h"]).dropDuplicates(["to"]).withColumn("bucket", F.col("to")).drop("to").withColumn("ghost", F.lit(True))
    both = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts.select(*dealt.columns, "ghost"))
    return both.repartition("bucket").sortWithinPartitions("bucket", "ghost", "k0", "k1", "h").select("doc_id", "text", "bucket", "ghost")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the last row so far: (doc_id, text, bucket, ghost, sketch)
    for batch in batches:
        for part in slices(batch, "text"):
            own = sketches(*joined(part.column("text")))
            texts = [x or "" for x in part.column("text").to_pylist()]
            rows = list(zip(part.column("doc_id").to_pylist(), texts, part.column("bucket").to_pylist(), part.column("ghost").to_pylist(), own, strict=True))
            rows = [held, *rows] if held is not None else rows
            pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[3] and a[2] == b[2]]
            held = rows[-1]
            new = [edited(a[1], b[1]) for a, b in pairs]
            changed = _sketches_of(new)
            columns = [
                [a[0] for a, _ in pairs],
                [len(a[1]) for a, _ in pairs],
                [hashlib.sha256(x.encode()).hexdigest() for x in new],
                [to_text(a[4]) for a, _ in pairs],
                [to_text(s) for s in changed],
                [likeness(a[4], s) for (a, _), s in zip(pairs, changed, strict=True)],
                [likeness(a[4], b[4]) for a, b in pairs],
                [containment(a[4], b[4]) for a, b in pairs],
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _RESULT.split(", ")])


def _sketches_of(texts: list[str]) -> list[np.ndarray]:
    return sketches(*joined(pa.array(texts, pa.large_string())))


def digest(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next and contained_next.

    A null text counts as empty; a text without words has an empty fingerprint, and two such texts are alike (1). Null
    doc_ids come last in the order; rows of equal doc_id follow by a hash of their text, and equal rows stand side by side,
    each with a row of its own. The last row's next is the first; a table of one row is its own next. Texts of any length
    are read whole. An empty table gives an empty result; other columns, of any names, are left out.
    """
    return with_next(docs.select("doc_id", "text")).mapInArrow(_compare, _RESULT)
