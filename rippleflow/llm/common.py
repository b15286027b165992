"""Helpers that the text operators share: shared-folder tables, byte-bounded batches, row hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker holds at once, expanded arrays aside; one longer text still goes whole.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashable(schema: T.StructType) -> list[str]:
    """Columns that xxhash64 takes: all but maps and variants."""

    def ok(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return ok(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(ok(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return [f.name for f in schema.fields if ok(f.dataType)]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(taken: Iterable[str], wanted: str) -> str:
    """wanted, or wanted with underscores before it where df already has such a column."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def row_hash(df: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[quoted(c) for c in hashable(df.schema)])


def let(value: Column, body) -> Column:
    """body(value) with value computed once; lambdas would compute an outer expression for every element."""
    return F.transform(F.array(value), body)[0]


FILTER_BITS = 24


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """2^24 bits (2 MB, whatever the input) of the hashes in a long column; more keys mean more false positives only."""
    place = F.pmod(F.xxhash64(F.lit(97), column), F.lit(1 << FILTER_BITS)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def probably_in(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """The rows whose key may be in the filter: a scan that spares a join the rows that can't match."""
    at, shared = free_name(df.columns, "__at"), df.sparkSession.sparkContext.broadcast(bits)
    placed = df.withColumn(at, F.pmod(F.xxhash64(F.lit(97), column), F.lit(1 << FILTER_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).to_numpy()
            good = (shared.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(good.astype(bool)))

    return placed.mapInArrow(run, placed.schema).drop(at)


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part's texts have at most limit bytes (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, and n + 1 offsets; a null text is empty."""
    column = pc.fill_null(column, "")
    texts = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]
