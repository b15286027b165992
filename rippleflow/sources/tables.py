"""Readers of the engine's inputs, with explicit schemas so that no file is read twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the table set, by file stem.
SCHEMAS = {
    "Firms": "firm_id BIGINT, nation_id INT, is_oem BOOLEAN, latitude DOUBLE, longitude DOUBLE, group_id BIGINT, capital DOUBLE, sales DOUBLE, employees DOUBLE",
    "SupplyRelations": "relation_id BIGINT, source_firm_id BIGINT, target_firm_id BIGINT",
    "SupplyRelationDetails": "relation_id BIGINT, product_name STRING, model_name STRING, model_year INT",
    "Products": "product_id BIGINT, product_name STRING, group_id BIGINT, group_name STRING, family_id BIGINT, family_name STRING",
    "ProductionCapabilities": "firm_id BIGINT, product_id BIGINT",
    "SpecialProducts": "special_product_id BIGINT, special_product_name STRING",
    "SpecialProductionCapabilities": "firm_id BIGINT, special_product_id BIGINT",
    "GeoNations": "nation_id INT, nation_name STRING",
    "FirmNames": "firm_id BIGINT, firm_name STRING, name_type STRING",
}
EMBEDDINGS = "custom_id STRING, response STRUCT<body: STRUCT<data: ARRAY<STRUCT<embedding: ARRAY<FLOAT>>>>>"
_FIRM = "ARRAY<STRUCT<id: BIGINT, size: INT, tier: INT, k: DOUBLE, request_cap: DOUBLE, disruption_time: INT, removal_time: INT, disruption_origin: ARRAY<BIGINT>>>"
RUNS = f"task_id BIGINT, network_id INT, scenario_id INT, num_seeds INT, sample_id INT, rep_id INT, comp_time DOUBLE, num_removed ARRAY<DOUBLE>, num_disrupted ARRAY<DOUBLE>, edge_cap ARRAY<DOUBLE>, open_cap ARRAY<DOUBLE>, seeds {_FIRM}, removed {_FIRM}, disrupted {_FIRM}, error STRING"
DISRUPTION_SEEDS = "num_seeds INT, sample_id INT, disruption_seeds ARRAY<BIGINT>"


def csv_tables(spark: SparkSession, folder: str, schemas: dict[str, str] = SCHEMAS) -> dict[str, DataFrame]:
    """Every table of the set, by name; each is registered as a view too. Missing files fail when they are read."""
    out = {}
    for name, schema in schemas.items():
        out[name] = spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}.csv")
        out[name].createOrReplaceTempView(name)
    return out


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """product, embedding: one response a line."""
    raw = spark.read.schema(EMBEDDINGS).json(path)
    return raw.select(F.col("custom_id").alias("product"), F.col("response.body.data")[0]["embedding"].alias("embedding"))


def run_records(spark: SparkSession, pattern: str) -> DataFrame:
    """Run records of many JSON-lines files."""
    return spark.read.schema(RUNS).json(pattern)


def run_weeks(records: DataFrame) -> DataFrame:
    """task_id, week and the series' values, one row a week."""
    names = ["num_removed", "num_disrupted", "edge_cap", "open_cap"]
    zipped = F.arrays_zip(*[F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in names])
    return records.select("task_id", "num_seeds", F.posexplode(zipped).alias("week", "z")).select("task_id", "num_seeds", "week", "z.*")


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON list."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def config_slice(configs: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Tasks start .. end - 1; all from start without an end."""
    rest = configs.where(F.col("task_id") >= start)
    return rest if end is None else rest.where(F.col("task_id") < end)


def polygons(spark: SparkSession, path: str, name: str) -> DataFrame:
    """name, part, piece, rings: polygons and multipolygons of a feature collection; a piece's first ring is its outer one, others are holes."""
    point = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
    raw = spark.read.option("multiLine", True).schema("features ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>").json(path)
    f = raw.select(F.posexplode("features").alias("part", "f"))
    one = F.array(F.from_json("f.geometry.coordinates", point))
    many = F.from_json("f.geometry.coordinates", f"ARRAY<{point}>")
    shapes = F.when(F.col("f.geometry.type") == "Polygon", one).otherwise(many)
    return f.select(F.col("f.properties")[name].alias("name"), "part", F.posexplode(shapes).alias("piece", "rings"))


def inside(x: Column, y: Column, segments: Column) -> Column:
    """Whether a point lies within the area that segments (x1, y1, x2, y2) of all rings enclose, holes taken out; not on a segment.

    A ray from the point crosses an odd number of segments. Only those that span its height count, so a horizontal strip's will do.
    """
    spans = F.filter(segments, lambda s: (s["y1"] > y) != (s["y2"] > y))
    crossed = F.size(F.filter(spans, lambda s: x < (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]))
    on = F.exists(segments, lambda s: ((s["x2"] - s["x1"]) * (y - s["y1"]) == (s["y2"] - s["y1"]) * (x - s["x1"])) & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"])))
    return (crossed % 2 == 1) & ~on


def cells(shapes: DataFrame, size: float) -> DataFrame:
    """cx, cy, shapes: cells of a square grid with the shapes that reach into them, in file order.

    A cell that a ring passes through holds the ring's segments in its strip of the grid, for the exact test; one wholly
    inside holds none. Finer grids have more cells and shorter tests.
    """
    slot = lambda v: F.floor(v / size).cast("long")
    pairs = F.flatten(F.transform("rings", lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))))
    each = shapes.select("name", "part", "piece", F.explode(pairs).alias("s"))
    low, high = F.least("s.y1", "s.y2"), F.greatest("s.y1", "s.y2")
    rows = each.withColumn("cy", F.explode(F.sequence(slot(low), slot(high))))
    at = lambda y: F.when(F.col("s.y1") == F.col("s.y2"), F.col("s.x1")).otherwise(F.col("s.x1") + (F.col("s.x2") - F.col("s.x1")) * (y - F.col("s.y1")) / (F.col("s.y2") - F.col("s.y1")))
    bottom, top = at(F.greatest(low, F.col("cy") * size)), at(F.least(high, (F.col("cy") + 1) * size))
    flat, slack = F.col("s.y1") == F.col("s.y2"), 1e-9 * size
    left = F.when(flat, F.least("s.x1", "s.x2")).otherwise(F.least(bottom, top)) - slack
    right = F.when(flat, F.greatest("s.x1", "s.x2")).otherwise(F.greatest(bottom, top)) + slack
    rows = rows.withColumns({"c0": slot(left), "c1": slot(right)})
    border = rows.select("part", "piece", "cy", F.explode(F.sequence("c0", "c1")).alias("cx")).distinct().withColumn("border", F.lit(True))
    strips = rows.groupBy("name", "part", "piece", "cy").agg(F.collect_list("s").alias("segments"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    all_ = strips.withColumn("cx", F.explode(F.sequence("c0", "c1"))).join(border, ["part", "piece", "cy", "cx"], "left")
    centre = inside((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("segments"))
    kept = all_.where(F.col("border") | centre).withColumn("segments", F.when(F.col("border"), F.col("segments")))
    return kept.groupBy("cx", "cy").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "name", "segments"))).alias("shapes"))


def locate(points: DataFrame, shapes: DataFrame, x: str = "longitude", y: str = "latitude", size: float = 0.25) -> DataFrame:
    """points with name: the first shape, in file order, that holds the point (not on its border); null if none does.

    An equi-join on the cells of a grid, whose side is size; each point meets one row, so repeated points stay as they are.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    keyed = points.withColumns({c: F.when(~F.isnan(v), F.floor(v / size).cast("long")) for c, v in (("cx", px), ("cy", py))})
    met = keyed.join(cells(shapes, size), ["cx", "cy"], "left")
    holds = F.filter("shapes", lambda s: s["segments"].isNull() | inside(px, py, s["segments"]))
    return met.select(*points.columns, F.get(holds, 0)["name"].alias("name"))
