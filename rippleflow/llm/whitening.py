"""Whitening of embeddings from an exact integer scatter.

1. Every entry c becomes the integer x = floor(1024 c) + 100000, for all vectors whose entries are finite.
2. A task subtracts the shift and adds up, block by block, its vectors' sums and cross-products: in doubles where a
   block's products stay below 2^53, in 64-bit integers below 2^62, else in integers of any size. It yields its totals
   in limbs of 40 bits, which Spark sums as longs, so that the totals are exact for any number of rows and any entries.
3. The driver, which gets d(d+1)/2 totals of d dimensions, forms n·XᵀX - SSᵀ in integers, and only then divides by n²
   in doubles and decomposes by eigh. (The scatter doesn't depend on the shift, which keeps the products small.)
4. One pass measures the covariance of the whitened values, another yields them.

Nothing but these totals leaves the tasks: the driver's share and the broadcast depend on d alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LIMB = 40
#: A component whose variance is below this share of the trace has no direction of its own.
LEAST_SHARE = 1e-14
_ROWS = 4096
_LONG = (1 << 63) - 1


def quantize(vectors: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Places of the rows to keep, in order, and by dimension their places and integers floor(1024 c) + 100000.

    Null vectors, and those with null or non-finite entries, are left out. Integers are int64, or Python's own where an
    entry is too large for them.
    """
    lengths = np.where(np.asarray(vectors.is_valid()), np.diff(np.asarray(vectors.offsets)), -1)
    values = vectors.values.cast(pa.float64())
    flat = np.asarray(values.fill_null(np.nan)) if values.null_count else np.asarray(values)
    starts, out, kept = np.asarray(vectors.offsets)[:-1], {}, []
    for d in sorted(set(lengths.tolist()) - {-1}):
        at = np.flatnonzero(lengths == d)
        x = flat[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        good = np.isfinite(x).all(axis=1)
        at, x = at[good], x[good]
        if not len(at):
            continue
        kept.append(at)
        with np.errstate(over="ignore"):
            scaled = np.floor(x * SCALE)
        if scaled.size and not np.abs(scaled).max() < 2.0**61:
            big = [[int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()]
            out[d] = at, np.array(big, dtype=object).reshape(len(at), d) + OFFSET
        else:
            out[d] = at, scaled.astype(np.int64) + OFFSET
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64), out


def cross_products(y: np.ndarray) -> np.ndarray:
    """yᵀy in exact integers; y holds at most some thousand rows."""
    most = max((abs(int(v)) for v in (y.min(), y.max())), default=0) if y.size else 0
    bound = len(y) * most * most
    if bound < 1 << 53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64)
    return y.T @ y if bound < 1 << 62 and y.dtype != object else y.astype(object).T @ y.astype(object)


class Totals:
    """Exact sums of one dimension's vectors: n, sums, cross-products (as Python's integers)."""

    def __init__(self, d: int) -> None:
        self.n, self.sums, self.products = 0, np.zeros(d, object), np.zeros((d, d), object)

    def add(self, y: np.ndarray) -> None:
        for a in range(0, len(y), _ROWS):
            part = y[a : a + _ROWS]
            self.n += len(part)
            self.sums = self.sums + (part.sum(axis=0) if part.dtype == object or not part.size or max(abs(int(part.min())), abs(int(part.max()))) < 1 << 50 else part.astype(object).sum(axis=0)).astype(object)
            self.products = self.products + cross_products(part).astype(object)

    def entries(self) -> Iterator[tuple[int, int, int]]:
        """(i, j, value); i = -1 and j = -1 for n, i = -1 for sums."""
        d = len(self.sums)
        yield -1, -1, self.n
        for j in range(d):
            yield -1, j, int(self.sums[j])
        for i in range(d):
            for j in range(i, d):
                yield i, j, int(self.products[i, j])


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) with value = sum of digit * 2^(40 place); digits have the value's sign."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield k, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        k += 1


_PARTIAL = "d int, i int, j int, k int, digit long"


def _partials(vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Totals] = {}
        for batch in batches:
            for d, (_, x) in quantize(batch.column(vector))[1].items():
                totals.setdefault(d, Totals(d)).add(x - OFFSET)
        rows = [(d, i, j, k, digit) for d, t in totals.items() for i, j, v in t.entries() for k, digit in limbs(v)]
        for a in range(0, len(rows), 10_000):
            columns = list(zip(*rows[a : a + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == 4 else pa.int32()) for n, c in enumerate(columns)], names=["d", "i", "j", "k", "digit"])

    return run


@dataclass(frozen=True)
class Model:
    """n, per-dimension sums of x, eigenvalues (falling), components as columns and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def scatter(embeddings: DataFrame, vector: str = "embedding") -> tuple[int, list[int], list[list[int]]]:
    """n, S and n·XᵀX - SSᵀ of the x-vectors, exact. Of vectors of unlike lengths the commonest length counts (the longest of equals)."""
    rows = embeddings.select(quoted(vector).alias("v")).mapInArrow(_partials("v"), _PARTIAL).groupBy("d", "i", "j", "k").agg(F.sum("digit").alias("digit"))
    sums: dict[int, dict[tuple[int, int], int]] = defaultdict(lambda: defaultdict(int))
    for r in rows.collect():
        sums[r.d][r.i, r.j] += r.digit << (LIMB * r.k)
    if not sums:
        return 0, [], []
    d = max(sums, key=lambda x: (sums[x][-1, -1], x))
    t = sums[d]
    n, shifted = t[-1, -1], [t[-1, j] for j in range(d)]
    matrix = [[n * t[min(i, j), max(i, j)] - shifted[i] * shifted[j] for j in range(d)] for i in range(d)]
    return n, [s + n * OFFSET for s in shifted], matrix


def fit(embeddings: DataFrame, vector: str = "embedding") -> Model | None:
    """The decomposition of the covariance (divisor n); None where no vector has an entry."""
    n, sums, matrix = scatter(embeddings, vector)
    if not sums:
        return None
    v = np.array([[x / (n * n) for x in row] for row in matrix], dtype=np.float64)  # integers over integers: rounded once
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    trace = sum(matrix[i][i] for i in range(len(sums))) / (n * n)
    return Model(n, tuple(sums), values, vectors * signs, trace)


def usable(model: Model, components: int = COMPONENTS) -> int:
    """How many of the first components have a variance above rounding."""
    return int((model.values[:components] > LEAST_SHARE * max(model.trace, 0.0)).sum())


def centred(x: np.ndarray, model: Model) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n in doubles, and the exact sum of (n x - S)² of each row (None beyond a long)."""
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    wide = x.dtype == object or (model.n * top + max(map(abs, model.sums), default=0)) >= 1 << 62
    kind = object if wide else np.int64
    z = x.astype(kind) * model.n - np.array(model.sums, dtype=kind)
    most = max(abs(int(z.min())), abs(int(z.max()))) if z.size else 0
    squares = (z.astype(object) ** 2).sum(axis=1) if most * most * max(1, z.shape[1]) >= 1 << 62 else (z * z).sum(axis=1)
    mean = np.array([[int(v) / model.n for v in row] for row in z], np.float64).reshape(z.shape) if wide else z / model.n
    return mean, [int(s) if s <= _LONG else None for s in squares.tolist()]


def project(x: np.ndarray, model: Model, components: int) -> tuple[np.ndarray, list[int | None]]:
    """Whitened values (rows by components) and deviations."""
    mean, deviation = centred(x, model)
    return mean @ model.vectors[:, :components] / np.sqrt(model.values[:components]), deviation


def identity_error(embeddings: DataFrame, model: Model, vector: str = "embedding", components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened values' covariance, measured over all rows, minus the identity."""
    c = usable(model, components)
    if not c:
        return 0.0
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums, products = shared.value, np.zeros(c), np.zeros((c, c))
        for batch in batches:
            found = quantize(batch.column("v"))[1].get(m.dimensions)
            if found is not None:
                w = project(found[1], m, c)[0]
                sums += w.sum(axis=0)
                products += w.T @ w
        flat = [*sums.tolist(), *products.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["at", "value"])

    rows = embeddings.select(quoted(vector).alias("v")).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(c + c * c)
    for r in rows:
        total[r["at"]] = r["value"]
    mean = total[:c] / model.n
    return float(np.abs(total[c:].reshape(c, c) / model.n - np.outer(mean, mean) - np.eye(c)).max())


def whiten(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per kept vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry go, as do vectors whose length isn't the commonest one;
    an empty vector has no component. Equal rows, ids that repeat and null ids each keep their rows; other columns, of any
    names, are left out. Components whose variance is nothing but rounding (fewer distinct vectors than components, equal
    vectors, one row) are left out, as nothing can be divided by it. Entries may be of any finite size; a deviation beyond
    a long is null. An empty table gives an empty result.
    """
    spark, source = embeddings.sparkSession, embeddings.select(quoted(id_column).alias("id"), quoted(vector).alias("v"))
    kind = embeddings.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    model = fit(source, "v")
    c = usable(model, components) if model is not None else 0
    if not c:
        return spark.createDataFrame([], schema)
    error = identity_error(source, model, "v", components)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        share = m.values[:c] / m.trace
        for batch in batches:
            found = quantize(batch.column("v"))[1].get(m.dimensions)
            if found is None:
                continue
            at, x = found
            w, deviation = project(x, m, c)
            rows = len(at)
            take = pa.array(np.repeat(at, c))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(take),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * c, m.n, np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), c))),
                    pa.array(np.ascontiguousarray(w).ravel()),
                    pa.array(np.tile(share, rows)),
                    pa.array(np.full(rows * c, error)),
                ],
                names=[f.name for f in schema.fields],
            )

    return source.mapInArrow(run, schema)
