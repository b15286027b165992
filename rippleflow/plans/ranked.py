"""Queries over a total order, as plans that put no window over all rows into one task, and their SQL for the other engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import statistics
from ..functions.random import race, u01
from ..operators.iterate import cut
from ..operators.order import before, numbered
from ..sources.adapter import Network

LABELS, SAMPLED = 40, 40


def _linked(n: Network) -> DataFrame:
    return n["degrees"].where("degree > 0")


def top_share(n: Network) -> DataFrame:
    """The tenth of firms with the most partners: places by ranges, as a tenth grows with the input."""
    d = cut(_linked(n).select("firm_id", "degree", (-F.col("degree")).alias("less")))
    size = d.count()
    return numbered(d, ["less", "firm_id"], "k").where((F.col("k") + 1) * 10 <= size).select("firm_id", "degree")


def labels(n: Network) -> DataFrame:
    """Firms to label: the most linked of every nation first, then others by degree, LABELS in all."""
    d = n["degrees"].select("firm_id", "degree", "nation_id")
    best = d.groupBy("nation_id").agg(F.max(F.struct("degree", (-F.col("firm_id")).alias("low")))["low"].alias("low")).select((-F.col("low")).alias("best"))
    flagged = d.join(best, F.col("firm_id") == F.col("best"), "left")
    return flagged.orderBy(F.col("best").isNull(), F.desc("degree"), "firm_id").limit(LABELS).select("firm_id", "degree")


def three_groups(n: Network) -> DataFrame:
    """Thirds by size; where three don't divide, the first ones have a firm more."""
    d = cut(_linked(n).select("firm_id", "degree"))
    short, over = divmod(d.count(), 3)
    k = F.col("k")
    third = F.when(k < (short + 1) * over, F.floor(k / (short + 1))).otherwise(over + F.floor((k - (short + 1) * over) / max(short, 1)))
    return numbered(d, ["degree", "firm_id"], "k").select("firm_id", (third + 1).cast("int").alias("third"))


def folds(n: Network) -> DataFrame:
    """Five folds in turn over a random order."""
    d = _linked(n).select("firm_id", u01([F.lit("fold"), F.col("firm_id")]).alias("u"))
    return numbered(d, ["u", "firm_id"], "k").select("firm_id", F.pmod("k", F.lit(5)).cast("int").alias("fold"))


def weighted_sample(n: Network) -> DataFrame:
    """SAMPLED firms without replacement, weighted by degree: the first of a race, so tasks keep their own first ones only."""
    return _linked(n).orderBy(race(u01([F.lit("race"), F.col("firm_id")]), F.col("degree")), "firm_id").limit(SAMPLED).select("firm_id")


def ks(n: Network) -> DataFrame:
    """Largest distance between two arms' shares of values up to each value."""
    v = n["run_series"].join(n["runs"].select("run_id", "arm"), "run_id")
    arm = lambda a: F.sum((F.col("arm") == a).cast("long"))
    g = cut(v.groupBy("value").agg(arm(0).alias("k0"), arm(1).alias("k1")))
    n0, n1 = g.agg(F.sum("k0"), F.sum("k1")).first()
    both = before(before(g, ["value"], F.col("k0"), "b0"), ["value"], F.col("k1"), "b1")
    return both.agg(F.round(F.max(F.abs((F.col("b0") + F.col("k0")) / n0 - (F.col("b1") + F.col("k1")) / n1)), 9).alias("d"))


def correlation_tests(n: Network) -> DataFrame:
    """Pearson and Spearman correlation of in- and out-degree, with two-sided p by Student's t."""
    rows = []
    for measure, r in (("pearson", "N1_pearson"), ("spearman", "N3_spearman")):
        from . import analytics  # the templates of both coefficients

        found = n.sql(analytics.SQL[r]).first()
        size = n["all_degrees"].where("degree > 0").count()  # both read the whole network
        rows.append((measure, float(found[0]), size, statistics.correlation_p_value(float(found[0]), size)))
    return n.spark.createDataFrame(rows, "measure string, r double, n long, p double")


QUERIES: dict[str, Callable[[Network], DataFrame]] = {
    "T2_top_share": top_share,
    "T6_labels": labels,
    "W11_three_groups": three_groups,
    "W12_folds": folds,
    "N16_weighted_sample": weighted_sample,
    "N6_ks": ks,
    "N1_correlation_tests": correlation_tests,
}
ORACLES: dict[str, str] = {
    "T2_top_share": "SELECT firm_id, degree FROM (SELECT firm_id, degree, row_number() OVER (ORDER BY degree DESC, firm_id) AS k, count(*) OVER () AS n FROM {degrees} WHERE degree > 0) x WHERE k <= n / 10",
    "T6_labels": f"""WITH ranked AS (SELECT d.firm_id, d.degree, row_number() OVER (PARTITION BY d.nation_id ORDER BY d.degree DESC, d.firm_id) AS k FROM {{degrees}} d)
        SELECT firm_id, degree FROM (SELECT firm_id, degree, row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, degree DESC, firm_id) AS place FROM ranked) x WHERE place <= {LABELS}""",
    "W11_three_groups": "SELECT firm_id, ntile(3) OVER (ORDER BY degree, firm_id) AS third FROM {degrees} WHERE degree > 0",
    "W12_folds": "SELECT firm_id, (row_number() OVER (ORDER BY @u01(concat_ws('|', 'fold', CAST(firm_id AS VARCHAR(20)))), firm_id) - 1) % 5 AS fold FROM {degrees} WHERE degree > 0",
    "N16_weighted_sample": f"SELECT firm_id FROM (SELECT firm_id, row_number() OVER (ORDER BY -ln(@u01(concat_ws('|', 'race', CAST(firm_id AS VARCHAR(20))))) / degree, firm_id) AS k FROM {{degrees}} WHERE degree > 0) x WHERE k <= {SAMPLED}",
    "N6_ks": "WITH v AS (SELECT s.value, r.arm FROM {run_series} s JOIN {runs} r ON s.run_id = r.run_id), t AS (SELECT sum(CASE WHEN arm = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN arm = 1 THEN 1 ELSE 0 END) AS n1 FROM v), g AS (SELECT value, sum(CASE WHEN arm = 0 THEN 1 ELSE 0 END) AS k0, sum(CASE WHEN arm = 1 THEN 1 ELSE 0 END) AS k1 FROM v GROUP BY value) SELECT round(max(abs(c0 / (1.0 * n0) - c1 / (1.0 * n1))), 9) AS d FROM (SELECT sum(k0) OVER (ORDER BY value) AS c0, sum(k1) OVER (ORDER BY value) AS c1 FROM g) c CROSS JOIN t",
}
