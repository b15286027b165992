"""Queries over the readers, writers and streams: tables go out to the shared folder and come back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.iterate import cut
from ..sources import sinks, tables
from ..sources.adapter import Network
from ..streaming import runs


def _folder(n: Network) -> str:
    """A new folder in the shared one."""
    cut(n.spark.range(1))  # sets the folder where the session names none
    return f"{n.spark.conf.get('spark.checkpoint.dir').rstrip('/')}/io-{uuid.uuid4().hex}"


def csv_scan(n: Network) -> DataFrame:
    where = _folder(n)
    sinks.csv(n["firms"].select("firm_id", "nation_id", "is_oem", F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), "firm_id", "capital").toDF("firm_id", "nation_id", "is_oem", "latitude", "longitude", "group_id", "capital").withColumns({"sales": F.lit(1.5), "employees": F.lit(None).cast("double")}), f"{where}/Firms.csv")
    firms = tables.csv_tables(n.spark, where, {"Firms": tables.SCHEMAS["Firms"]})["Firms"]
    return firms.select("firm_id", "nation_id", "is_oem", "capital", "sales")


def embedding_scan(n: Network) -> DataFrame:
    where = _folder(n)
    line = F.struct(F.struct(F.array(F.struct(F.col("embedding"))).alias("data")).alias("body"))
    sinks.json_lines(n["embeddings"].select(F.col("vec_id").cast("string").alias("custom_id"), line.alias("response")), where)
    return tables.embeddings(n.spark, where).select("product", F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def seed_lists(n: Network) -> DataFrame:
    where = _folder(n)
    lists = n["cascade"].where("is_seed").groupBy((F.col("run_id") % 5).cast("int").alias("num_seeds"), (F.col("run_id") % 10).cast("int").alias("sample_id")).agg(F.sort_array(F.collect_set("size")).alias("disruption_seeds"))
    whole = lists.agg(F.to_json(F.collect_list(F.struct("num_seeds", "sample_id", "disruption_seeds"))))  # one small list
    whole.coalesce(1).write.text(where)
    read = tables.json_list(n.spark, where, tables.DISRUPTION_SEEDS)
    return read.select("num_seeds", "sample_id", F.explode("disruption_seeds").alias("seed"))


def _records(n: Network) -> str:
    """Run records of the event-made runs, written as JSON lines."""
    where = _folder(n)
    weeks = n["capacity"].groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("week", F.col("removed").cast("double").alias("removed"), F.col("c").cast("double").alias("c")))).alias("w"))
    rows = weeks.join(n["runs"], "run_id").select(F.col("run_id").cast("long").alias("task_id"), F.col("num_seeds").cast("int").alias("num_seeds"), F.transform("w", lambda x: x["removed"]).alias("num_removed"), F.transform("w", lambda x: x["c"]).alias("edge_cap"), F.when(F.col("run_id") % 37 == 0, F.lit("failed")).alias("error"))
    sinks.append_runs(rows, where)
    return where


def run_scan(n: Network) -> DataFrame:
    records = tables.run_records(n.spark, f"{_records(n)}/runs")
    return tables.run_weeks(records).select("task_id", F.col("week").cast("long").alias("week"), F.col("num_removed").alias("removed"), F.round("edge_cap", 4).alias("c"))


def error_rows(n: Network) -> DataFrame:
    return n.spark.read.schema(tables.RUNS).json(f"{_records(n)}/errors").select("task_id", "error")


def stream_sizes(n: Network) -> DataFrame:
    name = f"sizes_{uuid.uuid4().hex[:8]}"
    runs.to_memory(runs.cascade_sizes(n.spark, f"{_records(n)}/runs"), name)
    return n.spark.table(name).select(F.col("num_seeds").cast("long").alias("num_seeds"), "runs", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"))


def regions(n: Network) -> DataFrame:
    """Firms at made-up points, assigned to made-up squares with a hole each."""
    where = _folder(n)
    square = "CAST(named_struct('type', 'Polygon', 'coordinates', array(array(array({0}, {1}), array({2}, {1}), array({2}, {3}), array({0}, {3}), array({0}, {1})), array(array({4}, {5}), array({6}, {5}), array({6}, {7}), array({4}, {7}), array({4}, {5})))) AS STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>)"
    shapes = [square.format(10 * i, 10 * j, 10 * i + 10, 10 * j + 10, 10 * i + 4, 10 * j + 4, 10 * i + 7, 10 * j + 7) for i in range(3) for j in range(3)]
    features = ", ".join(f"named_struct('properties', map('nam', 'square-{k}'), 'geometry', {s})" for k, s in enumerate(shapes))
    n.spark.sql(f"SELECT array({features}) AS features").coalesce(1).write.json(where)
    points = n["firms"].select("firm_id", ((F.col("firm_id") * 7) % 40 + 0.5).alias("longitude"), ((F.col("firm_id") * 11) % 35 + 0.5).alias("latitude"))
    return tables.locate(points, tables.polygons(n.spark, where, "nam"), size=3.0).select("firm_id", "name")


def gexf(n: Network) -> DataFrame:
    return sinks.gexf_lines(n["firms"], n["relations"]).select("line")


QUERIES: dict[str, Callable[[Network], DataFrame]] = {
    "S1_csv_scan": csv_scan,
    "S3_embedding_scan": embedding_scan,
    "S4_seed_lists": seed_lists,
    "S5_run_scan": run_scan,
    "S5_stream_sizes": stream_sizes,
    "S7_regions": regions,
    "C48_prefectures": lambda n: regions(n).groupBy("name").agg(F.count("*").alias("firms")),
    "K1_error_rows": error_rows,
    "K5_gexf": gexf,
}
_PLACE = "SELECT firm_id, (firm_id * 7) % 40 + 0.5 AS x, (firm_id * 11) % 35 + 0.5 AS y FROM {firms}"
_SQUARE = f"SELECT firm_id, CASE WHEN x < 30 AND y < 30 AND NOT (x % 10 > 4 AND x % 10 < 7 AND y % 10 > 4 AND y % 10 < 7) THEN 'square-' || CAST(floor(x / 10) * 3 + floor(y / 10) AS INTEGER) END AS name FROM ({_PLACE}) p"
ORACLES: dict[str, str] = {
    "S1_csv_scan": "SELECT firm_id, nation_id, is_oem, capital, 1.5 AS sales FROM {firms}",
    "S3_embedding_scan": "SELECT CAST(vec_id AS VARCHAR) AS product, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM {embeddings}",
    "S4_seed_lists": "SELECT DISTINCT CAST(run_id % 5 AS INTEGER) AS num_seeds, CAST(run_id % 10 AS INTEGER) AS sample_id, size AS seed FROM {cascade} WHERE is_seed",
    "S5_run_scan": "SELECT run_id AS task_id, week, CAST(removed AS DOUBLE) AS removed, round(c, 4) AS c FROM {capacity} WHERE run_id % 37 <> 0",
    "S5_stream_sizes": "SELECT r.num_seeds, count(*) AS runs, round(avg(z.n - r.num_seeds), 6) AS mean, round(CAST(max(z.n - r.num_seeds) AS DOUBLE), 6) AS most FROM (SELECT run_id, max(removed) AS n FROM {capacity} GROUP BY run_id) z JOIN {runs} r ON z.run_id = r.run_id WHERE r.run_id % 37 <> 0 GROUP BY r.num_seeds",
    "S7_regions": _SQUARE,
    "C48_prefectures": f"SELECT name, count(*) AS firms FROM ({_SQUARE}) s GROUP BY name",
    "K5_gexf": """SELECT '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="nation_id" type="integer"/></attributes><nodes>' AS line
        UNION ALL SELECT '<node id="' || firm_id || '"><attvalues><attvalue for="0" value="' || coalesce(CAST(nation_id AS VARCHAR), '') || '"/></attvalues></node>' FROM {firms} UNION ALL SELECT '</nodes><edges>'
        UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"/>' FROM {relations} UNION ALL SELECT '</edges></graph></gexf>'""",
    "K1_error_rows": "SELECT run_id AS task_id, 'failed' AS error FROM {runs} WHERE run_id % 37 = 0",
}
