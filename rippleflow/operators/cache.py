"""Results kept as tables and read again while their inputs stay the same.

An entry's name holds a digest of the inputs (path, size and time of every file) and of the parameters. It counts only with
its marker, which is written after the table, so a half-written entry is not read. Two jobs may make the same entry at once:
each writes a table of its own, and the marker that comes last points to one of them.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from .iterate import shared_folder


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder, if it is there."""
    fs, at = _files(spark, path)
    return bool(fs.exists(at) and fs.delete(at, True))


def state_of(spark: SparkSession, paths: Iterable[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time) of every file below the paths, in order; a path that isn't there gives one entry of its own."""
    out = []
    for path in sorted(paths):
        fs, at = _files(spark, path)
        if not fs.exists(at):
            out.append((path, -1, -1))
            continue
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def key_of(spark: SparkSession, inputs: Iterable[str], parameters: dict) -> str:
    said = json.dumps([state_of(spark, inputs), sorted((k, repr(v)) for k, v in parameters.items())])
    return hashlib.sha256(said.encode()).hexdigest()[:24]


def _read(spark: SparkSession, marker: str) -> str | None:
    """The table that a marker points to, if both are there."""
    fs, at = _files(spark, marker)
    if not fs.exists(at):
        return None
    lines = spark.read.text(marker).collect()
    where = lines[0][0] if lines else ""
    fs, table = _files(spark, where + "/_SUCCESS")
    return where if where and fs.exists(table) else None


def cached(spark: SparkSession, name: str, inputs: Iterable[str], parameters: dict, make: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """make()'s rows, from an earlier call with equal inputs and parameters if there is one, else made and kept.

    parameters' values are told apart by repr. folder: by default `results` in the folder that executors share.
    """
    folder = (folder or f"{shared_folder(spark)}/results").rstrip("/")
    marker = f"{folder}/{name}/{key_of(spark, inputs, parameters)}"
    where = _read(spark, marker + "/done")
    if where is None:
        where = f"{marker}/{uuid.uuid4().hex}"
        make().write.parquet(where)
        fs, draft = _files(spark, f"{marker}/{uuid.uuid4().hex}.draft")
        out = fs.create(draft, True)
        try:
            out.write(bytearray((where + "\n").encode()))
        finally:
            out.close()
        done = _files(spark, marker + "/done")[1]
        if fs.exists(done) and _read(spark, marker + "/done") is None:  # it points to a table without an end
            fs.delete(done, False)
        if not fs.rename(draft, done):  # another job was first
            fs.delete(draft, False)
            where = _read(spark, marker + "/done") or where
    return spark.read.parquet(where)


def table_or(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made first unless it is there whole. A table without its end is written anew."""
    fs, end = _files(spark, path + "/_SUCCESS")
    if not fs.exists(end):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_older(spark: SparkSession, seconds: float, name: str | None = None, folder: str | None = None) -> int:
    """Removes entries (of one name, or all) whose folder hasn't changed for so many seconds; tells how many."""
    folder = (folder or f"{shared_folder(spark)}/results").rstrip("/")
    fs, top = _files(spark, f"{folder}/{name}" if name else folder)
    if not fs.exists(top):
        return 0
    groups = [top] if name else [x.getPath() for x in fs.listStatus(top) if x.isDirectory()]
    old = [e.getPath() for g in groups for e in fs.listStatus(g) if e.isDirectory() and e.getModificationTime() <= (time.time() - seconds) * 1000]
    for entry in old:
        fs.delete(entry, True)
    return len(old)
