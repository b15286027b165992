"""Supply-network tables from the order, part and event tables, as SQL that two engines read alike.

A template names the tables that it reads in braces and may use macros that differ between dialects:
@pct(x, p) a linear percentile, @u01(key) a uniform number in (0, 1) from a string key, @half(x, d) rounding
half to even.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.cache import cached
from ..operators.communities import LEVELS, TURNS, louvain
from ..operators.graph import largest_component
from ..operators.iterate import cut
from ..operators.similarity import all_pairs

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]

OEM = 10_000_000  # customers' firm ids start here

TABLES = {
    "nations": "SELECT n_nationkey AS nation_id, n_name AS nation_name, n_regionkey AS region_id FROM {nation}",
    "firms": f"""SELECT s_suppkey AS firm_id, s_nationkey AS nation_id, false AS is_oem, s_acctbal AS capital FROM {{supplier}}
        UNION ALL SELECT {OEM} + c_custkey, c_nationkey, true, c_acctbal FROM {{customer}}""",
    "details": f"""SELECT l_suppkey AS src, {OEM} + o_custkey AS dst, l_partkey AS product, l_returnflag AS model, year(l_shipdate) AS model_year
            FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_quantity >= 48 AND l_suppkey % 5 = 0
        UNION ALL SELECT a, b, product, model, model_year FROM (
            SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b,
                l_partkey AS product, l_returnflag AS model, year(l_shipdate) AS model_year, l_quantity AS q FROM {{lineitem}}) x
            WHERE b IS NOT NULL AND a <> b AND q >= 48 AND (a % 5 - b % 5 = 1 OR (a % 5 = 4 AND b % 5 = 4))""",
    "relations": "SELECT src, dst, count(*) AS weight, (src + dst) % 16 = 0 AS annotated FROM {details} GROUP BY src, dst",
    "edge_products": "SELECT d.src, d.dst, d.product, count(*) AS amount FROM {details} d JOIN {relations} r ON d.src = r.src AND d.dst = r.dst WHERE r.annotated GROUP BY d.src, d.dst, d.product",
    "products": "SELECT p_partkey AS product, p_name AS product_name, p_brand AS group_name, p_type AS family_name, p_partkey % 10 = 0 AS special FROM {part}",
    "capabilities": "SELECT DISTINCT l_suppkey AS firm_id, l_partkey AS product FROM {lineitem}",
    "sizes": "SELECT count(*) AS vectors FROM {embeddings}",
    # Read by the other engine only; here it is similarity.all_pairs().
    "alike": "SELECT a, b, score FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS score FROM {embeddings} x CROSS JOIN {embeddings} y) z WHERE score > 0.15",
    "degrees": """SELECT f.firm_id, f.nation_id, f.is_oem, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree,
            coalesce(i.w, 0) AS in_weight, coalesce(o.w, 0) AS out_weight FROM {firms} f
        LEFT JOIN (SELECT dst, count(*) AS n, sum(weight) AS w FROM {relations} GROUP BY dst) i ON f.firm_id = i.dst
        LEFT JOIN (SELECT src, count(*) AS n, sum(weight) AS w FROM {relations} GROUP BY src) o ON f.firm_id = o.src""",
    "neighbours": "SELECT src AS u, dst AS v FROM {relations} UNION SELECT dst, src FROM {relations}",
    "membership": "SELECT firm_id, nation_id AS community FROM {firms}",
    # Runs: a user's events in order are a run's weeks; earlier rows are the origins of later ones.
    "run_series": """SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS week, event_id, value FROM {events}""",
    "runs": """SELECT run_id, 1 + run_id % 5 AS num_seeds, run_id % 2 AS arm, run_id % 3 AS scenario, run_id % 10 AS sample_id, (run_id - run_id % 2) / 2 AS task_id, count(*) AS weeks
        FROM {run_series} GROUP BY run_id""",
    "capacity": "SELECT run_id, week, 1000.0 - sum(value) OVER (PARTITION BY run_id ORDER BY week) / 10.0 AS c, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY week) AS removed FROM {run_series}",
    "cascade": "SELECT s.run_id, s.week AS firm, s.week < r.num_seeds AS is_seed, s.week, 1 + s.event_id % 30 AS size, s.event_id FROM {run_series} s JOIN {runs} r ON s.run_id = r.run_id",
    # A run's removals laid on the network's firms: three events of four strike a supplier, the others a customer.
    "struck": f"""SELECT run_id, firm_id, max(CASE WHEN is_seed THEN 1 ELSE 0 END) AS seed FROM (SELECT c.run_id, c.is_seed, CASE WHEN c.event_id % 4 = 3 THEN {OEM} + c.event_id % k.n ELSE c.event_id % s.n END AS firm_id
        FROM {{cascade}} c CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) k CROSS JOIN (SELECT count(*) AS n FROM {{supplier}}) s) x GROUP BY run_id, firm_id""",
    "origins": """SELECT run_id, firm, 1 AS slot, CASE WHEN event_id % 11 = 0 THEN firm + 100000 ELSE (event_id * 13) % greatest(firm, 1) END AS origin FROM {cascade} WHERE NOT is_seed
        UNION ALL SELECT run_id, firm, 2, (event_id * 29) % greatest(firm, 1) FROM {cascade} WHERE NOT is_seed AND event_id % 11 <> 0 AND event_id % 3 <> 0""",
}
# The thin network above is for plans that walk paths, close triangles or pair firms; plans that filter, join and add up read
# the whole one: every line is a delivery to the order's customer and to the supplier of the next line.
THINNED = ("details", "relations", "edge_products", "degrees", "neighbours")
TABLES["all_details"] = f"""SELECT l_suppkey AS src, {OEM} + o_custkey AS dst, l_partkey AS product, l_returnflag AS model, year(l_shipdate) AS model_year FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
        UNION ALL SELECT a, b, product, model, model_year FROM (
            SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b,
                l_partkey AS product, l_returnflag AS model, year(l_shipdate) AS model_year FROM {{lineitem}}) x WHERE b IS NOT NULL AND a <> b"""


def whole(template: str) -> str:
    """The template over the whole network."""
    return re.sub(r"\{(" + "|".join(THINNED) + r")\}", r"{all_\1}", template)


TABLES |= {f"all_{name}": whole(TABLES[name]) for name in THINNED[1:]}


def _louvain_sql(turns: int, levels: int) -> str:
    """Louvain levels for the other engine: every turn of every level spelled out. Turns after the last move change nothing."""
    steps = [
        "e AS (SELECT src, dst FROM {relations} WHERE src <> dst UNION SELECT dst, src FROM {relations} WHERE src <> dst)",
        "lab AS (SELECT src AS s, src AS x FROM e UNION SELECT l.s, e.dst FROM lab l JOIN e ON l.x = e.src)",
        "comp AS MATERIALIZED (SELECT s, min(x) AS c FROM lab GROUP BY s)",
        "big AS MATERIALIZED (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)",
        "g0 AS MATERIALIZED (SELECT CAST(e.src AS BIGINT) AS s, CAST(e.dst AS BIGINT) AS d, 1 AS w FROM e JOIN comp ON e.src = comp.s JOIN big ON comp.c = big.c)",
        "m AS MATERIALIZED (SELECT sum(w) AS m2 FROM g0)",
        "of0 AS MATERIALIZED (SELECT DISTINCT s AS x, s AS c FROM g0)",
    ]
    for v in range(levels):
        steps.append(f"c{v}_0 AS MATERIALIZED (SELECT s AS x, sum(w) AS k, s AS c FROM g{v} GROUP BY s)")
        for t in range(turns):
            z = f"c{v}_{t}"
            steps.append(f"t{v}_{t} AS MATERIALIZED (SELECT c, sum(k) AS tot FROM {z} GROUP BY c)")
            steps.append(f"l{v}_{t} AS MATERIALIZED (SELECT x, c, sum(w) AS w FROM (SELECT g.s AS x, z.c, g.w FROM g{v} g JOIN {z} z ON g.d = z.x WHERE g.s <> g.d UNION ALL SELECT x, c, 0 FROM {z}) u GROUP BY x, c)")
            gain = "m.m2 * l.w - z.k * (t.tot - CASE WHEN l.c = z.c THEN z.k ELSE 0 END)"
            steps.append(f"b{v}_{t} AS MATERIALIZED (SELECT l.x, arg_min(l.c, (-({gain}), l.c <> z.c, l.c)) AS best FROM l{v}_{t} l JOIN {z} z ON l.x = z.x JOIN t{v}_{t} t ON l.c = t.c CROSS JOIN m GROUP BY l.x)")
            steps.append(f"c{v}_{t + 1} AS MATERIALIZED (SELECT z.x, z.k, CASE WHEN @u01(concat_ws('|', 'louvain', {v}, {t}, z.x)) < 0.5 THEN b.best ELSE z.c END AS c FROM {z} z JOIN b{v}_{t} b ON z.x = b.x)")
        steps.append(f"n{v} AS MATERIALIZED (SELECT x, min(x) OVER (PARTITION BY c) AS c FROM c{v}_{turns})")
        steps.append(f"of{v + 1} AS MATERIALIZED (SELECT o.x, n.c FROM of{v} o JOIN n{v} n ON o.c = n.x)")
        steps.append(f"g{v + 1} AS MATERIALIZED (SELECT a.c AS s, b.c AS d, sum(g.w) AS w FROM g{v} g JOIN n{v} a ON g.s = a.x JOIN n{v} b ON g.d = b.x GROUP BY a.c, b.c)")
    q = " UNION ALL ".join(f"SELECT {v} AS v, (SELECT m2 FROM m) * (SELECT coalesce(sum(w), 0) FROM g{v} WHERE s = d) - (SELECT sum(k * k) FROM (SELECT sum(w) AS k FROM g{v} GROUP BY s) y) AS q" for v in range(1, levels + 1))
    members = " UNION ALL ".join(f"SELECT {v} AS v, x, c FROM of{v}" for v in range(1, levels + 1))
    return f"WITH RECURSIVE {', '.join(steps)}, q AS ({q}), top AS (SELECT v FROM q ORDER BY q DESC, v LIMIT 1) SELECT x AS firm_id, c AS community FROM ({members}) a JOIN top ON a.v = top.v"


#: Louvain communities of the largest component; here they come from operators.communities, kept by operators.cache.
TABLES["communities"] = _louvain_sql(TURNS, LEVELS)

_SPARK = {"pct": "percentile({0}, {1})", "u01": "((cast(conv(substr(md5({0}), 1, 13), 16, 10) AS DOUBLE) + 0.5D) / 4503599627370496D)", "half": "bround({0}, {1})"}
_DUCK = {"pct": "quantile_cont({0}, {1})", "u01": "((('0x' || substr(md5({0}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)", "half": "round_even({0}, {1})"}


def _needs(template: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", template)))


def _macros(sql: str, dialect: dict[str, str]) -> str:
    """Numbers with a point become doubles; macros are replaced from the inside out."""
    sql = re.sub(r"(?<![\w.'\"])(\d+\.\d+)(?![\w.'\"])", r"\1e0", sql)
    while m := list(re.finditer(r"@(\w+)\(", sql)):
        at, args, depth, start = m[-1].end(), [], 0, m[-1].end()
        while depth >= 0:
            c = sql[at]
            depth += (c == "(") - (c == ")")
            if depth < 0 or (c == "," and not depth):
                args.append(sql[start:at].strip())
                start = at + 1
            at += 1
        sql = sql[: m[-1].start()] + dialect[m[-1][1]].format(*args) + sql[at:]
    return sql


def duck(template: str) -> str:
    """The template for the other engine, its tables as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES and name not in order:
            for x in _needs(TABLES[name]):
                visit(x)
            order.append(name)

    for x in _needs(template):
        visit(x)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    body = plain(template).strip()
    ctes = [f"{n} AS {'MATERIALIZED ' * (n == 'communities')}({plain(TABLES[n])})" for n in order]
    recursive = bool(re.match(r"WITH RECURSIVE\b", body))
    if m := re.match(r"WITH (?:RECURSIVE )?", body):
        body = body[m.end() :]
        head = ", ".join([*ctes, body])
        return _macros(f"WITH {'RECURSIVE ' if recursive else ''}{head}", _DUCK)
    return _macros((f"WITH {', '.join(ctes)} " if ctes else "") + body, _DUCK)


class Network:
    """The tables of one data directory as DataFrames, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name == "alike":
                self._made[name] = all_pairs(self["embeddings"], 0.15)
                return self._made[name]
            if name == "communities":
                files = [f"{self.sf_dir}/{x}.parquet" for x in ("orders", "lineitem")]
                found = lambda: louvain(largest_component(cut(self["relations"].select("src", "dst")))).withColumnRenamed("node", "firm_id")
                self._made[name] = cached(self.spark, "communities", files, {"turns": TURNS, "levels": LEVELS, "links": TABLES["details"]}, found)
                return self._made[name]
            self._made[name] = self.sql(TABLES[name]) if name in TABLES else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def sql(self, template: str, **made: DataFrame) -> DataFrame:
        """The template over the network's tables and those given by name."""
        return self.spark.sql(_macros(template, _SPARK), **{n: made[n] if n in made else self[n] for n in _needs(template)})
