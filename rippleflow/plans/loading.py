"""Queries that load a network from the table set and use its indexes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import normal_quantile, truncated_normal, u01
from ..operators.iterate import cut
from ..operators.order import numbered
from ..sources.adapter import Network
from . import network, scenario, ticks


def table_set(n: Network) -> dict[str, DataFrame]:
    """The domain tables in the shape that the readers give. Firms in debt report no capabilities, so that some are pruned."""
    relations = cut(numbered(n["relations"].select("src", "dst", "annotated"), ["src", "dst"], "relation_id"))
    details = n["details"].join(relations.where("annotated"), ["src", "dst"]).select("relation_id", F.col("product").cast("string").alias("product_name"), F.col("model").alias("model_name"), "model_year")
    products = n["products"]
    can = n["capabilities"].join(n["firms"].where("capital >= 0").select("firm_id"), "firm_id").join(products.select("product", "special"), "product")
    return {
        "Firms": n["firms"].select(F.col("firm_id").cast("long").alias("firm_id"), "nation_id", "is_oem"),
        "SupplyRelations": relations.select("relation_id", F.col("src").alias("source_firm_id"), F.col("dst").cast("long").alias("target_firm_id")),
        "SupplyRelationDetails": details,
        "Products": products.where("NOT special").select(F.col("product").alias("product_id"), F.col("product").cast("string").alias("product_name")),
        "SpecialProducts": products.where("special").select(F.col("product").alias("special_product_id"), F.concat(F.lit("s"), F.col("product").cast("string")).alias("special_product_name")),
        "ProductionCapabilities": can.where("NOT special").select("firm_id", F.col("product").alias("product_id")),
        "SpecialProductionCapabilities": can.where("special").select("firm_id", F.col("product").alias("special_product_id")),
    }


def loaded_edges(n: Network) -> DataFrame:
    return network.load_network(table_set(n)).edges


def loaded_firms(n: Network) -> DataFrame:
    return network.load_network(table_set(n)).firms.select("firm_id", "is_oem", F.col("tier").cast("long").alias("tier"))


def suppliers(n: Network) -> DataFrame:
    """Firms with a link that leaves them: tasks keep distinct suppliers of lines, links aren't formed."""
    return n["firms"].join(n["all_details"].select(F.col("src").alias("firm_id")).distinct(), "firm_id", "left_semi").select("firm_id")


def rival_counts(n: Network) -> DataFrame:
    return network.rival_counts(n["capabilities"])


def overlap_weights(n: Network) -> DataFrame:
    return network.overlap_pool(n["capabilities"]).select("lost", F.col("rival").alias("alternative"), F.round("weight", 9).alias("weight"))


def two_hop(n: Network) -> DataFrame:
    """Best alternative suppliers of the products on annotated links."""
    size = n["sizes"].first()[0]
    lost = cut(n["edge_products"].select((F.col("src") * 100_000_000 + F.col("product")).alias("search"), F.pmod(F.col("product"), F.lit(size)).alias("product")).distinct())
    sigma = n["alike"].where("score > 0.3").select(F.col("a").alias("product"), F.col("b").alias("alt"), "score")
    index = n["capabilities"].select("firm_id", F.pmod(F.col("product"), F.lit(size)).alias("product")).distinct()
    return network.best_alternatives(lost, sigma, index)


def kde(n: Network) -> DataFrame:
    values = n["relations"].select(F.col("weight").cast("double").alias("v"))
    targets = n.spark.range(2000).select("id")
    out = scenario.kde_resample(values, targets, "v", ["id"], F.lit("kde"), "draw")
    return out.agg(F.round(F.avg("x"), 6).alias("mean"), F.count("*").alias("n"))


def truncated(n: Network) -> DataFrame:
    x = truncated_normal(u01([F.lit("tn"), F.col("firm_id")]), 1.5, 0.5, 1.0, 10_000.0)
    return n["firms"].select("firm_id", F.round(x, 6).alias("x"))


def standard_normal(n: Network) -> DataFrame:
    return n["firms"].select("firm_id", F.round(normal_quantile(u01([F.lit("z"), F.col("firm_id")])), 6).alias("z"))


_IDS = "r AS (SELECT src, dst, annotated FROM {relations}), can AS (SELECT DISTINCT c.firm_id FROM {capabilities} c JOIN {firms} f ON c.firm_id = f.firm_id AND f.capital >= 0), empty AS (SELECT DISTINCT src AS f FROM r ANTI JOIN can ON src = firm_id)"
_KEPT = f"{_IDS}, kept AS (SELECT r.src, r.dst, r.annotated FROM r ANTI JOIN empty a ON r.src = a.f ANTI JOIN empty b ON r.dst = b.f)"
QUERIES: dict[str, Callable[[Network], DataFrame]] = {
    "Z36_loaded_edges": loaded_edges,
    "Z36_loaded_firms": loaded_firms,
    "J7_semi_join": suppliers,
    "Z29_rivals": rival_counts,
    "J9_shared_product_pool": rival_counts,
    "C6_overlap_pool": overlap_weights,
    "J11_overlap_weights": overlap_weights,
    "J10_two_hop": two_hop,
    "N13_kde_resample": kde,
    "N14_truncated_normal": truncated,
    "N14_standard_normal": standard_normal,
}
def _bounds(mu: float, sigma: float, low: float, high: float) -> tuple[float, float]:
    phi = lambda x: 0.5 * math.erfc(-(x - mu) / sigma / math.sqrt(2))
    return phi(low), phi(high)


_LOW, _HIGH = _bounds(1.5, 0.5, 1.0, 10_000.0)


ORACLES: dict[str, str] = {
    "N13_kde_resample": f"WITH v AS (SELECT CAST(weight AS DOUBLE) AS v, row_number() OVER (ORDER BY weight) - 1 AS i FROM {{relations}}), s AS (SELECT count(*) AS n, stddev_samp(v) AS sd FROM v), t AS (SELECT unnest(range(2000)) AS id), d AS (SELECT id, CAST(floor(@u01(concat_ws('|', 'kde', 'draw', id)) * s.n) AS BIGINT) AS i, @u01(concat_ws('|', 'kde', 'draw-step', id)) AS u, s.n, s.sd FROM t CROSS JOIN s) SELECT round(avg(v.v + ({ticks.quantile('d.u')}) * d.sd * power(d.n, -0.2)), 6) AS mean, count(*) AS n FROM d JOIN v ON d.i = v.i",
    "N14_standard_normal": f"SELECT firm_id, round({ticks.quantile('u')}, 6) AS z FROM (SELECT firm_id, @u01(concat_ws('|', 'z', firm_id)) AS u FROM {{firms}}) x",
    "N14_truncated_normal": f"SELECT firm_id, round(least(10000.0, greatest(1.0, 1.5 + 0.5 * ({ticks.quantile('u')}))), 6) AS x FROM (SELECT firm_id, {_LOW!r} + @u01(concat_ws('|', 'tn', firm_id)) * {_HIGH - _LOW!r} AS u FROM {{firms}}) x",
    "Z36_loaded_edges": f"WITH {_KEPT}, w AS (SELECT src, dst, count(*) AS w FROM {{details}} GROUP BY src, dst) SELECT k.src, CAST(k.dst AS BIGINT) AS dst, CASE WHEN k.annotated THEN w.w ELSE 1 END AS weight, NOT k.annotated AS stochastic FROM kept k JOIN w ON k.src = w.src AND k.dst = w.dst",
    "Z36_loaded_firms": f"""WITH RECURSIVE {_KEPT}, nodes AS (SELECT src AS x FROM kept UNION SELECT dst FROM kept), sinks AS (SELECT x FROM nodes ANTI JOIN kept ON x = src),
        up AS (SELECT x, 0 AS d FROM sinks UNION SELECT k.src, u.d + 1 FROM up u JOIN kept k ON u.x = k.dst WHERE u.d < 14), t AS (SELECT x, min(d) AS d FROM up GROUP BY x)
        SELECT f.firm_id, f.is_oem, CAST(CASE WHEN n.x IS NULL THEN -1 ELSE t.d END AS BIGINT) AS tier FROM {{firms}} f ANTI JOIN empty e ON f.firm_id = e.f LEFT JOIN nodes n ON f.firm_id = n.x LEFT JOIN t ON f.firm_id = t.x WHERE n.x IS NOT NULL OR f.firm_id IN (SELECT firm_id FROM can)""",
    "Z29_rivals": "SELECT a.firm_id, count(DISTINCT b.firm_id) AS rivals FROM {capabilities} a JOIN {capabilities} b ON a.product = b.product AND a.firm_id <> b.firm_id GROUP BY a.firm_id",
    "J11_overlap_weights": "SELECT a.firm_id AS lost, b.firm_id AS alternative, round(count(*) / (1.0 * max(s.n)), 9) AS weight FROM {capabilities} a JOIN {capabilities} b ON a.product = b.product AND a.firm_id <> b.firm_id JOIN (SELECT firm_id, count(*) AS n FROM {capabilities} GROUP BY firm_id) s ON a.firm_id = s.firm_id GROUP BY a.firm_id, b.firm_id",
    "J9_shared_product_pool": "SELECT a.firm_id, count(DISTINCT b.firm_id) AS rivals FROM {capabilities} a JOIN {capabilities} b ON a.product = b.product AND a.firm_id <> b.firm_id GROUP BY a.firm_id",
    "C6_overlap_pool": "SELECT a.firm_id AS lost, b.firm_id AS alternative, round(count(*) / max(s.n), 9) AS weight FROM {capabilities} a JOIN {capabilities} b ON a.product = b.product AND a.firm_id <> b.firm_id JOIN (SELECT firm_id, count(*) AS n FROM {capabilities} GROUP BY firm_id) s ON a.firm_id = s.firm_id GROUP BY a.firm_id, b.firm_id",
    "J10_two_hop": """WITH lost AS (SELECT DISTINCT e.src * 100000000 + e.product AS search, e.product % s.vectors AS product FROM {edge_products} e CROSS JOIN {sizes} s), idx AS (SELECT DISTINCT c.firm_id, c.product % s.vectors AS product FROM {capabilities} c CROSS JOIN {sizes} s)
        SELECT search, firm_id, score, alt FROM (SELECT l.search, i.firm_id, p.score, p.b AS alt, row_number() OVER (PARTITION BY l.search, i.firm_id ORDER BY p.score DESC, p.b) AS k FROM lost l JOIN {alike} p ON l.product = p.a AND p.score > 0.3 JOIN idx i ON p.b = i.product) x WHERE k = 1""",
}
