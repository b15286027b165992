"""All registered queries and their SQL for the other engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapter import Network, duck
from . import analytics, campaign, capacity, graphs, inputs, loading, ranked, relational, substitutes, ticks

Query = Callable[[SparkSession, str], DataFrame]

#: Plans written in SQL, by module.
PLANS = [relational.SQL, analytics.SQL, ticks.SQL]
#: Plans written with the DataFrame API: (functions of a Network, their SQL). They take the place of a template of the same name.
MODULES: list[tuple[dict[str, Callable[[Network], DataFrame]], dict[str, str]]] = [(graphs.QUERIES, graphs.ORACLES), (campaign.QUERIES, campaign.ORACLES), (inputs.QUERIES, inputs.ORACLES), (loading.QUERIES, loading.ORACLES), (ranked.QUERIES, ranked.ORACLES), (substitutes.QUERIES, {}), (capacity.QUERIES, {})]


def _plan(template: str) -> Query:
    return lambda spark, sf_dir: Network(spark, sf_dir).sql(template)


def _function(f: Callable[[Network], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Network(spark, sf_dir))


def queries() -> dict[str, Query]:
    out = {name: _plan(sql) for plans in PLANS for name, sql in plans.items()}
    for functions, _ in MODULES:
        out |= {name: _function(f) for name, f in functions.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: duck(sql) for plans in PLANS for name, sql in plans.items()}
    for _, oracles in MODULES:
        out |= {name: duck(sql) for name, sql in oracles.items()}
    return {name: sql.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN") for name, sql in out.items()}
