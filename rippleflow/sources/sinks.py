"""Writers: partitioned run records with errors apart, JSON, CSV, node and edge sheets, GEXF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cache import remove
from ..operators.iterate import cut


def append_runs(records: DataFrame, path: str, *partitions: str) -> None:
    """Good records under runs/, failed ones (error set) under errors/."""
    good = records.where(F.col("error").isNull()).drop("error")
    writer = good.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).json(f"{path}/runs")
    records.where(F.col("error").isNotNull()).write.mode("append").json(f"{path}/errors")


def write_chunks(records: DataFrame, path: str, chunk: int) -> None:
    """Records by ranges of chunk tasks: runs/tasks=0-99/ and so on, and failed ones under errors/ alike.

    Writing a range again replaces what it had, so a job that is started anew leaves every task once; errors of a range that
    has none any more go. Records of a range are to be written together.
    """
    first = F.col("task_id") - F.pmod("task_id", F.lit(chunk))
    named = cut(records.withColumn("tasks", F.concat_ws("-", first.cast("string"), (first + chunk - 1).cast("string"))))
    ranges = {r[0]: r[1] for r in named.groupBy("tasks").agg(F.max(F.col("error").isNotNull())).collect()}  # a row a range
    for kind, rows in (("runs", named.where("error IS NULL").drop("error")), ("errors", named.where("error IS NOT NULL"))):
        rows.repartition("tasks").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tasks").json(f"{path}/{kind}")
    spark = records.sparkSession
    for tasks, failed in ranges.items():
        if not failed:
            remove(spark, f"{path}/errors/tasks={tasks}")


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def sheets(nodes: DataFrame, edges: DataFrame, path: str, node_keys: list[str], edge_keys: list[str]) -> None:
    """A folder with the sheets Nodes and Edges."""
    csv(nodes.select(node_keys), f"{path}/Nodes")
    csv(edges.select(edge_keys), f"{path}/Edges")


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GEXF file with their order: header, nodes (id, nation_id), edges, footer."""
    spark = nodes.sparkSession
    fixed = lambda at, text: spark.createDataFrame([(at, 0, text)], "part int, id bigint, line string")
    head = fixed(0, '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="nation_id" type="integer"/></attributes><nodes>')
    node = F.format_string('<node id="%d"><attvalues><attvalue for="0" value="%s"/></attvalues></node>', "firm_id", F.coalesce(F.col("nation_id").cast("string"), F.lit("")))
    edge = F.format_string('<edge source="%d" target="%d"/>', "src", "dst")
    rows = head.union(nodes.select(F.lit(1), F.col("firm_id").cast("long"), node)).union(fixed(2, "</nodes><edges>"))
    return rows.union(edges.select(F.lit(3), F.col("src").cast("long"), edge)).union(fixed(4, "</edges></graph></gexf>"))
