"""Places and running sums over a total order, without a window that sorts all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut


def before(df: DataFrame, order: list[str], value: Column, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """df with name: the sum of value over the earlier rows (of the same `within`, few groups without nulls).

    Rows are dealt by ranges of the order and written; each range adds the sum of the ranges before it, a table of
    a row a range and group, to a running sum of its own. Equal rows follow one another in any order and may lie in
    several ranges, so a frequent value fills no task of its own.

    Rows are written before they are dealt, and ties are settled by a row's position in what was written: a task that
    runs again after a loss reads the same file and deals its rows as before, in whatever order its own input came.
    """
    written = cut(df.withColumn("__value", value))
    ranges = written.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*within, *order, "__tie")
    placed, keys = cut(ranges.withColumn("__range", F.spark_partition_id())), [*within, "__range"]
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys).agg(F.sum("__value").alias("__sum"))
    start = sums.select(*keys, F.sum("__sum").over(earlier(Window.partitionBy(*within).orderBy("__range"))).alias("__start"))
    here = F.sum("__value").over(earlier(Window.partitionBy(*keys).orderBy(*order, "__tie")))
    zero = F.lit(0).cast(placed.schema["__value"].dataType)
    out = placed.withColumn("__here", here).join(F.broadcast(start), keys)
    return out.select(*df.columns, (F.coalesce("__here", zero) + F.coalesce("__start", zero)).alias(name))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: the row's place in the order, from 0."""
    return before(df, order, F.lit(1).cast("long"), name)
