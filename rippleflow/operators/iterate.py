"""Driver loops over DataFrames: lineage is cut in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode, where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: no lineage, known size, any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], mark: Callable[[DataFrame], object], limit: int = 200) -> DataFrame:
    """Applies step until mark(state), a small value, stays the same, at most limit times."""
    state = cut(state)
    last = mark(state)
    for _ in range(limit):
        state = cut(step(state))
        now = mark(state)
        if now == last:
            break
        last = now
    return state
