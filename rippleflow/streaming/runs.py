"""Run records as they arrive: an extension of the batch readers, with the same results once all files are in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import RUNS


def cascade_sizes(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Streaming: per number of seeds the runs so far, the mean final cascade and its greatest."""
    records = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    cascade = F.element_at("num_removed", -1) - F.col("num_seeds")
    return records.where(F.col("error").isNull()).groupBy("num_seeds").agg(F.count("*").alias("runs"), F.avg(cascade).alias("mean"), F.max(cascade).alias("most"))


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of a stream of events (ts, event_type, value) by window; later events than `late` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def to_memory(stream: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Runs a stream to the end of what is there, into an in-memory table of that name; for small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
