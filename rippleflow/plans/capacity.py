"""Fastest declines and turning points of runs' capacity, compared as exact decimals.

Equal losses of two weeks differ in their last digits when capacities are sums of doubles, so which week comes first hung on the
order of additions. Here losses, halves and least values are compared in decimals of 12 places; a value that none holds (not
finite, or of 10^18 and more) counts as none. The other engine's SQL lies with the templates and adds doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.adapter import Network

# Capacity is 1000 - s / 10.
_SPENT = """s AS (SELECT run_id, week, CAST(s AS DECIMAL(36, 12)) AS s, removed FROM (SELECT run_id, week, sum(try_cast(value AS DECIMAL(30, 12))) OVER (PARTITION BY run_id ORDER BY week) AS s,
        sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY week) AS removed FROM {run_series}) r),
    d AS (SELECT run_id, week, s, removed, s - lag(s) OVER (PARTITION BY run_id ORDER BY week) AS lost, first_value(s) OVER (PARTITION BY run_id ORDER BY week) AS x FROM s)"""


def fastest_decline(n: Network) -> DataFrame:
    """The first of the weeks that lose most, and the share of a run's whole loss by its end."""
    return n.sql(
        f"""WITH {_SPENT}, k AS (SELECT run_id, week, s, x, row_number() OVER (PARTITION BY run_id ORDER BY lost DESC, week) AS k FROM d WHERE lost IS NOT NULL),
            e AS (SELECT run_id, max(s) AS y FROM s GROUP BY run_id)
        SELECT k.run_id, k.week, round(CASE WHEN k.x = e.y THEN 0 ELSE CAST(k.s - k.x AS DOUBLE) / CAST(e.y - k.x AS DOUBLE) END, 6) AS progress FROM k JOIN e ON k.run_id = e.run_id WHERE k.k = 1"""
    )


def capacity_metrics(n: Network) -> DataFrame:
    return n.sql(
        f"""WITH {_SPENT}, e AS (SELECT run_id, max(removed) AS total, max(s) AS low, min(s) AS high, max(lost) AS most, sum(CASE WHEN lost < 0 THEN 1 ELSE 0 END) AS rises FROM d GROUP BY run_id)
        SELECT d.run_id, max(e.rises) AS rises, round(CAST(max(e.most) AS DOUBLE) / 10, 6) AS max_weekly, round(CAST(max(e.low - e.high) AS DOUBLE) / 10, 6) AS loss, min(CASE WHEN d.lost = e.most THEN d.week END) AS t_fast,
            coalesce(min(CASE WHEN d.removed >= 0.9 * e.total THEN d.week END), 0) AS t90, coalesce(min(CASE WHEN (d.s - e.high) + (d.s - e.high) >= e.low - e.high THEN d.week END), 0) AS t50c, min(CASE WHEN d.s = e.low THEN d.week END) AS t_min
        FROM d JOIN e ON d.run_id = e.run_id GROUP BY d.run_id"""
    )


QUERIES: dict[str, Callable[[Network], DataFrame]] = {"C21_fastest_decline": fastest_decline, "C23_capacity_metrics": capacity_metrics}
