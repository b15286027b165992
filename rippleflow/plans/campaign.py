"""Queries that sample scenarios and run cascades on them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bootstrap, powerlaw, statistics
from ..functions.random import u01
from ..operators import graph
from ..operators.iterate import cut
from ..operators.pools import united
from ..operators.similarity import all_pairs
from ..sources.adapter import Network, whole
from . import analytics, graphs, imputation, links, scenario, simulate, ticks

SEED = "340282366920938463463374607431768211455"  # seeds are wider than 64 bits, so they stay strings


def _tiers(n: Network) -> DataFrame:
    e = cut(n["relations"].select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    return cut(graph.tiers(e, n["firms"].select(F.col("firm_id").cast("long").alias("node"))).withColumnRenamed("node", "firm_id"))


def _pools(n: Network) -> DataFrame:
    return n["capabilities"].groupBy("product").agg(F.count("*").alias("pool"))


def edge_config(n: Network, relations: str = "all_relations", edge_products: str = "all_edge_products") -> DataFrame:
    """Products and amounts of the whole network's links, or of another one's."""
    return scenario.sample_edge_products(n[relations], n["capabilities"], n[edge_products], _pools(n), SEED, gamma=0.5)


def _degree_counts(n: Network) -> DataFrame:
    d = n["degrees"]
    all_ = d.select(F.lit("total").alias("series"), F.col("degree").alias("k")).union(d.select(F.lit("in"), "in_degree")).union(d.select(F.lit("out"), "out_degree"))
    return cut(powerlaw.histogram(all_, "series", "k"))


def power_laws(n: Network) -> DataFrame:
    """Tails of the total, in- and out-degrees."""
    f = powerlaw.fit_tails(_degree_counts(n))
    return f.select("series", "tail", "xmin", *[F.round(c, 6).alias(c) for c in ("alpha", "sigma", "ks")])


def power_law_rivals(n: Network) -> DataFrame:
    """The same tails against an exponential and a log-normal one."""
    counts = _degree_counts(n)
    r = powerlaw.rivals(counts, cut(powerlaw.fit_tails(counts)))
    return r.select("series", *[F.round(c, 6).alias(c) for c in r.columns[1:5]])


def bootstrap_means(n: Network) -> DataFrame:
    """Per arm, mean final size and its interval from 2,000 resamples."""
    return _intervals(n, "arm", "mean", 2000)


def bootstrap_medians(n: Network) -> DataFrame:
    """Per number of seeds, median final size and its interval from 1,000 resamples."""
    return _intervals(n, "num_seeds", "median", 1000)


def _intervals(n: Network, group: str, statistic: str, resamples: int) -> DataFrame:
    runs = cut(n["runs"].select(group, (F.col("weeks") - F.col("num_seeds")).cast("double").alias("y")))
    own = F.avg("y") if statistic == "mean" else F.expr("percentile(y, 0.5)")
    out = None
    for g in sorted(r[0] for r in runs.select(group).distinct().collect()):  # arms, or numbers of seeds: a handful
        mine = runs.where(F.col(group) == g)
        one = mine.agg(F.lit(g).alias(group), F.count("*").alias("runs"), F.round(own, 6).alias(statistic)).crossJoin(bootstrap.interval(mine, "y", resamples, statistic))  # rows of one
        out = one if out is None else out.union(one)
    return out.select(group, "runs", statistic, F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def budgets(n: Network) -> DataFrame:
    return scenario.budgets(n["relations"], _tiers(n), SEED)


def node_config(n: Network) -> DataFrame:
    out = scenario.node_scenario(n["degrees"], SEED, customerless=1)
    return out.select("firm_id", "size", F.round("k", 6).alias("k"), "cap")


def third_groups(n: Network) -> DataFrame:
    return scenario.thirds(n["degrees"].where("degree > 0"), SEED)


def _world(n: Network) -> simulate.World:
    vectors = cut(n["products"].crossJoin(F.broadcast(n["sizes"])).select("product", (F.col("product") % F.col("vectors")).alias("vector")).distinct())
    alike = n["alike"].where("score > 0.3").select(F.col("a").alias("product"), F.col("b").alias("alt"), "score")
    edges = cut(edge_config(n, "relations", "edge_products"))
    firms = node_config(n).join(_tiers(n).select("firm_id", F.col("tier").cast("long").alias("tier")), "firm_id", "left")
    return simulate.load_world(cut(firms), edges, cut(budgets(n)), cut(n["capabilities"]), cut(alike), vectors)


def configs(n: Network, rules: tuple[str, ...] = ("overlap", "specific", "hybrid"), runs: int = 4, until: int = 24) -> DataFrame:
    """The largest suppliers in turn as seeds, the same for every rule, so that arms pair by task."""
    seeds = n["degrees"].where("out_degree > 0").orderBy(F.desc("out_degree"), "firm_id").limit(2 * runs)
    numbered = seeds.select(F.col("firm_id").cast("long").alias("firm_id"), F.monotonically_increasing_id().alias("i"))
    sets = numbered.groupBy(F.pmod(F.xxhash64("firm_id"), F.lit(runs)).alias("task")).agg(F.sort_array(F.collect_list("firm_id")).alias("seeds"))
    arms = n.spark.createDataFrame(list(enumerate(rules)), "arm int, rule string")
    return cut(sets.crossJoin(F.broadcast(arms)).select((F.col("task") * 10 + F.col("arm")).cast("long").alias("run_id"), "seeds", "rule", F.lit(until).alias("until"), F.when(F.col("rule") == "overlap", 1).otherwise(3).alias("parallel"), F.lit(0.1).alias("margin")))


def series(n: Network) -> DataFrame:
    return simulate.with_differences(simulate.simulate(configs(n), _world(n)))


def struck_firms(n: Network) -> DataFrame:
    out = simulate.whole(simulate.simulate(configs(n), _world(n), "firms"))
    return out.select("run_id", "firm_id", "kind", "size", "tier", "k", "request_cap", "disruption_time", "removal_time", F.concat_ws(",", F.transform("origins", lambda x: x.cast("string"))).alias("origins"))


def consistency(n: Network) -> DataFrame:
    return simulate.whole(simulate.simulate(configs(n), _world(n))).agg(F.sum("violations").alias("violations"), F.count("*").alias("weeks"))


def link_model(n: Network) -> DataFrame:
    """Weighted logistic model of large links on their ends' degrees, by iterated least squares."""
    d = n["degrees"].select("firm_id", F.log1p("degree").alias("x"))
    of = lambda c, name: d.select(F.col("firm_id").alias(c), F.col("x").alias(name))
    rows = n["relations"].join(of("src", "x1"), "src").join(of("dst", "x2"), "dst").select("x1", "x2", (F.col("weight") > 1).cast("double").alias("k"), F.lit(1.0).alias("n"))
    w = statistics.logistic(cut(rows), ["x1", "x2"], "k", "n")
    return n.spark.createDataFrame([(name, round(v, 6)) for name, v in zip(["constant", "x1", "x2"], w, strict=True)], "term string, weight double")


def grouped_folds(n: Network) -> DataFrame:
    """Area under the curve of the link model on each of five folds of suppliers, fitted on the other four."""
    d = n["degrees"].select("firm_id", F.log1p("degree").alias("x"))
    of = lambda c, name: d.select(F.col("firm_id").alias(c), F.col("x").alias(name))
    fold = F.floor(u01([F.lit("fold"), F.col("src")]) * 5)
    rows = cut(n["relations"].join(of("src", "x1"), "src").join(of("dst", "x2"), "dst").select("x1", "x2", (F.col("weight") > 1).cast("double").alias("k"), F.lit(1.0).alias("n"), fold.alias("fold")))
    fits = statistics.logistic_fits(rows, ["x1", "x2"], "k", "n", "fold", [(["x1", "x2"], f) for f in range(5)])
    at = lambda i: F.element_at(F.array(*[F.lit(w[i]) for w in fits]), (F.col("fold") + 1).cast("int"))
    scored = rows.withColumn("score", at(0) + F.col("x1") * at(1) + F.col("x2") * at(2))
    return statistics.auc_by(scored, "score", "k", "n", ["fold"]).select(F.col("fold").cast("int").alias("fold"), F.round("auc", 6).alias("auc"))


def _holdout(n: Network) -> imputation.Holdout:
    size = n["sizes"].first()[0]
    classes = n["products"].select("product", F.pmod("product", F.lit(size)).alias("a"))
    like = cut(all_pairs(n["embeddings"], 0.3).select("a", "b"))
    return imputation.holdout(n["edge_products"], n["capabilities"], classes, like)


def imputation_holdout(n: Network) -> DataFrame:
    out = imputation.report(_holdout(n))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def gamma_by_folds(n: Network) -> DataFrame:
    return imputation.by_folds(_holdout(n)).select("fold", "gamma", F.round("ks", 6).alias("ks"), F.round("ks_uniform", 6).alias("ks_uniform"))


def _like_pools(n: Network) -> DataFrame:
    """product, pool: the firms that offer a product or one like it."""
    size = n["sizes"].first()[0]
    offers = cut(n["capabilities"].select("firm_id", F.pmod("product", F.lit(size)).alias("b")).distinct())
    like = cut(all_pairs(n["embeddings"], 0.3).select("a", "b"))
    like = like.union(offers.select(F.col("b").alias("a"), "b").distinct().join(like.select("a").distinct(), "a", "left_anti"))
    pool, _ = united(like, offers.select(F.coalesce("firm_id", F.lit(-(1 << 63)).cast("long")).alias("firm"), "b").where("b IS NOT NULL"))  # a row without firm counts as one
    return n["products"].select("product", F.pmod("product", F.lit(size)).alias("a")).join(pool, "a").select("product", "pool")


def exposed_links(n: Network) -> DataFrame:
    """Links with features, the runs n that exposed them and the k of these that passed the disruption on (query C40)."""
    edges = cut(n["relations"].select("src", "dst", "weight", "annotated"))
    found = links.link_features(edges, n["edge_products"], n["capabilities"], _like_pools(n))
    counts = n.sql(analytics.SQL["C40_exposure_counts"]).select("src", "dst", F.col("propagated").alias("k"), F.col("exposed").alias("n"))
    return cut(found.join(counts, ["src", "dst"]))


def link_models(n: Network) -> DataFrame:
    return links.link_models(exposed_links(n)).select("kind", "model", "term", F.round("value", 6).alias("value"))


def _newton_sql(steps: int = 14) -> str:
    """Weights a, b, c of the link model for every fold left out (-1: none), by Newton steps and Cramer's rule, as tables w<steps>(o, a, b, c)."""
    fold = "CAST(floor(@u01(concat_ws('|', 'fold', r.src)) * 5) AS INTEGER)"
    out = [
        f"x AS MATERIALIZED (SELECT r.src, r.dst, ln(1 + a.degree) AS x, ln(1 + b.degree) AS z, CASE WHEN r.weight > 1 THEN 1.0 ELSE 0.0 END AS k, {fold} AS f FROM {{relations}} r JOIN {{degrees}} a ON r.src = a.firm_id JOIN {{degrees}} b ON r.dst = b.firm_id)",
        "outs AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS o)",
        "w0 AS MATERIALIZED (SELECT o, 0.0 AS a, 0.0 AS b, 0.0 AS c FROM outs)",
    ]
    det = lambda a, b, c, d, e, f, g, h, i: f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
    m = ("h00", "h01", "h02", "h01", "h11", "h12", "h02", "h12", "h22")
    with_g = lambda j: det(*[f"g{n // 3}" if n % 3 == j else m[n] for n in range(9)])
    for t in range(steps):
        terms = [("h00", "1.0"), ("h01", "x"), ("h02", "z"), ("h11", "x * x"), ("h12", "x * z"), ("h22", "z * z")]
        sums = ", ".join([*(f"sum({v} * p * (1 - p)){' + 0.000000001' if n[1] == n[2] else ''} AS {n}" for n, v in terms), *(f"sum({v} * (k - p)) AS g{j}" for j, v in enumerate(("1.0", "x", "z")))])
        out.append(f"p{t} AS (SELECT w.o, x.x, x.z, x.k, 1 / (1 + exp(-(w.a + w.b * x.x + w.c * x.z))) AS p FROM x JOIN w{t} w ON x.f <> w.o), s{t} AS (SELECT o, {sums} FROM p{t} GROUP BY o)")
        out.append(f"w{t + 1} AS MATERIALIZED (SELECT w.o, w.a + {with_g(0)} / {det(*m)} AS a, w.b + {with_g(1)} / {det(*m)} AS b, w.c + {with_g(2)} / {det(*m)} AS c FROM w{t} w JOIN s{t} ON w.o = s{t}.o)")
    return ", ".join(out)


_LINK_MODEL = f"WITH {_newton_sql()}, w AS (SELECT * FROM w14 WHERE o = -1) SELECT 'constant' AS term, round(a, 6) AS weight FROM w UNION ALL SELECT 'x1', round(b, 6) FROM w UNION ALL SELECT 'x2', round(c, 6) FROM w"
_GROUPED_FOLDS = f"""WITH {_newton_sql()}, s AS (SELECT x.f, w.a + w.b * x.x + w.c * x.z AS s, sum(x.k) AS p, sum(1 - x.k) AS q FROM x JOIN w14 w ON x.f = w.o GROUP BY x.f, w.a + w.b * x.x + w.c * x.z),
    r AS (SELECT f, p, q, sum(q) OVER (PARTITION BY f ORDER BY s) - q AS below FROM s) SELECT f AS fold, round(sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0), 6) AS auc FROM r GROUP BY f"""


def _cdf(x: str) -> str:
    """random.normal_cdf for the other engine: its fit's coefficients, from the constant term up."""
    t, poly = f"(1 / (1 + 0.5 * (abs({x}) / sqrt(2.0))))", "0.0"
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * {t} + {c!r})"
    half = f"({t} * exp(-({x}) * ({x}) / 2.0 + {poly}) / 2.0)"
    return f"CASE WHEN {x} >= 0 THEN 1 - {half} ELSE {half} END"


def _edge_products_sql() -> str:
    """Edges' numbers of products, products and amounts by joins and windows, one row an option."""
    u = lambda what, *keys: f"@u01(concat_ws('|', '{SEED}', '{what}', {', '.join(keys)}))"
    return f"""WITH cnt AS (SELECT sum(amount) AS n FROM {{edge_products}} GROUP BY src, dst), st AS (SELECT count(*) AS n, coalesce(stddev_samp(n), 0) * power(count(*), -0.2) AS h, max(n) AS top FROM cnt),
        grid AS (SELECT m, st.n, h, (m + 0.5 - cnt.n) / h AS x FROM st CROSS JOIN (SELECT unnest(range(0, (SELECT CAST(ceil(top + 9 * h) AS BIGINT) + 1 FROM st))) AS m) q CROSS JOIN cnt),
        law AS MATERIALIZED (SELECT m, sum({_cdf("x")}) / max(n) AS g FROM grid GROUP BY m), ends AS (SELECT max(m) AS last FROM law),
        pool AS (SELECT product, count(*) AS pool FROM {{capabilities}} GROUP BY product), pf AS (SELECT firm_id, count(*) AS p FROM {{capabilities}} GROUP BY firm_id),
        w AS (SELECT r.src, r.dst, pf.p, a.g + {u("number", "r.src", "r.dst")} * (b.g - a.g) AS want FROM {{relations}} r JOIN pf ON r.src = pf.firm_id CROSS JOIN ends JOIN law a ON a.m = 0 JOIN law b ON b.m = least(pf.p, ends.last) WHERE NOT r.annotated),
        k AS (SELECT w.src, w.dst, least(w.p, 1 + count(l.m)) AS k FROM w LEFT JOIN law l ON l.m BETWEEN 1 AND w.p AND l.g < w.want GROUP BY w.src, w.dst, w.p),
        opt AS (SELECT k.src, k.dst, k.k, c.product, row_number() OVER (PARTITION BY k.src, k.dst ORDER BY -ln({u("product", "k.src", "k.dst", "c.product")}) / power(p.pool + 1.0, 0.5), c.product) AS r FROM k JOIN {{capabilities}} c ON k.src = c.firm_id JOIN pool p ON c.product = p.product),
        hp AS (SELECT product, coalesce(stddev_samp(amount), 0) * power(count(*), -0.2) AS h FROM {{edge_products}} GROUP BY product),
        part AS (SELECT product, v, h, a, sum(c * (1 - a)) OVER (PARTITION BY product ORDER BY v) AS up, sum(c * (1 - a)) OVER (PARTITION BY product) AS total FROM (SELECT e.product, e.v, e.c, hp.h, CASE WHEN hp.h > 0 THEN {_cdf("((0.5 - e.v) / nullif(hp.h, 0))")} ELSE 0.0 END AS a FROM (SELECT product, CAST(amount AS DOUBLE) AS v, count(*) AS c FROM {{edge_products}} GROUP BY product, amount) e JOIN hp ON e.product = hp.product) y),
        got AS (SELECT o.src, o.dst, o.product, t.v, t.h, t.a + {u("amount", "o.src", "o.dst", "o.product")} * (1 - t.a) AS q, row_number() OVER (PARTITION BY o.src, o.dst, o.product ORDER BY t.v) AS s FROM opt o LEFT JOIN part t ON o.product = t.product AND t.up >= {u("part", "o.src", "o.dst", "o.product")} * t.total WHERE o.r <= o.k)
        SELECT src, dst, product, CAST(amount AS BIGINT) AS amount FROM {{edge_products}} UNION ALL SELECT src, dst, product, CAST(CASE WHEN v IS NULL THEN 1 WHEN h > 0 THEN greatest(1, round_even(v + h * ({ticks.quantile("q")}), 0)) ELSE v END AS BIGINT) FROM got WHERE s = 1"""


def _zeta(s: str, a: str) -> str:
    """powerlaw.hurwitz for the other engine."""
    b = f"({a} + 10.0)"
    terms = " + ".join(f"power({a} + {k}.0, -({s}))" for k in range(10))
    return f"({terms} + power({b}, 1 - {s}) / ({s} - 1) + power({b}, -({s})) / 2 + {s} * power({b}, -{s} - 1) / 12 - {s} * ({s} + 1) * ({s} + 2) * power({b}, -{s} - 3) / 720 + {s} * ({s} + 1) * ({s} + 2) * ({s} + 3) * ({s} + 4) * power({b}, -{s} - 5) / 30240)"


def _power_law_sql() -> str:
    return f"""WITH x AS (SELECT 'total' AS series, degree AS k FROM {{degrees}} UNION ALL SELECT 'in', in_degree FROM {{degrees}} UNION ALL SELECT 'out', out_degree FROM {{degrees}}),
        h AS (SELECT series, k, count(*) AS c FROM x WHERE k > 0 GROUP BY series, k), top AS (SELECT series, max(k) AS k FROM h GROUP BY series),
        t AS (SELECT g.series, g.k AS xmin, x.k, x.c FROM h g JOIN top ON g.series = top.series AND g.k < top.k JOIN h x ON x.series = g.series AND x.k >= g.k),
        a AS (SELECT series, xmin, sum(c) AS n, 1 + sum(c) / sum(c * ln(k / (xmin - 0.5))) AS alpha FROM t GROUP BY series, xmin),
        f AS (SELECT t.series, t.xmin, a.alpha, a.n, {_zeta("a.alpha", "t.k")} AS z, {_zeta("a.alpha", "t.xmin")} AS z0, sum(t.c) OVER (PARTITION BY t.series, t.xmin ORDER BY t.k DESC) / (1.0 * a.n) AS share FROM t JOIN a ON t.series = a.series AND t.xmin = a.xmin),
        d AS (SELECT series, xmin, max(alpha) AS alpha, max(n) AS n, max(abs(share - z / z0)) AS ks FROM f GROUP BY series, xmin)
        SELECT series, CAST(n AS BIGINT) AS tail, xmin, round(alpha, 6) AS alpha, round((alpha - 1) / sqrt(n), 6) AS sigma, round(ks, 6) AS ks FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ks, xmin) AS r FROM d) y WHERE r = 1"""



QUERIES: dict[str, Callable[[Network], DataFrame]] = {
    "N7_bootstrap_means": bootstrap_means,
    "N7_bootstrap_medians": bootstrap_medians,
    "N19_power_law": power_laws,
    "N19_rival_tails": power_law_rivals,
    "C13_gamma_by_folds": gamma_by_folds,
    "C41_link_models": link_models,
    "Z21_edge_products": edge_config,
    "Z22_budgets": budgets,
    "Z23_node_scenario": node_config,
    "Z23_three_groups": third_groups,
    "Z20_run_series": series,
    "Z26_struck_firms": struck_firms,
    "Z27_consistency": consistency,
    "N9_link_model": link_model,
    "N12_grouped_folds": grouped_folds,
    "C12_imputation_holdout": imputation_holdout,
}
def _truncated(purpose: str, mu: float, sigma: float, low: float, high: float, key: str = "firm_id") -> str:
    """SQL of a truncated normal of the scenario's seed."""
    phi = lambda x: 0.5 * math.erfc(-(x - mu) / sigma / math.sqrt(2))
    u = f"({phi(low)!r} + @u01(concat_ws('|', '{SEED}', '{purpose}', {key})) * {phi(high) - phi(low)!r})"
    return f"least({high!r}, greatest({low!r}, {mu!r} + {sigma!r} * ({ticks.quantile(u)})))"


_STOCK = lambda side, key: f"CASE WHEN {side}_tier = -1 THEN 0.0 WHEN {side}_tier <= 1 THEN {_truncated(side, 12 / 7, 5 / 7, 0.0, 1e6, key)} ELSE {_truncated(side, 35 / 7, 5 / 7, 0.0, 1e6, key)} END"
_DRAWS = """cls AS (SELECT p.product, p.product % s.vectors AS a FROM {products} p CROSS JOIN {sizes} s), lk AS (SELECT a, b FROM {alike} WHERE score > 0.3),
        held AS (SELECT DISTINCT firm_id, product FROM {capabilities}), mem AS (SELECT DISTINCT l.a, h.firm_id FROM held h JOIN cls c ON h.product = c.product JOIN lk l ON l.b = c.a),
        obs AS (SELECT DISTINCT src, dst, product FROM {edge_products} WHERE src IN (SELECT firm_id FROM held)), k AS (SELECT src, dst, least(count(*), (SELECT count(*) FROM held h WHERE h.firm_id = src)) AS k FROM obs GROUP BY src, dst),
        ends AS (SELECT k.src, k.dst, c.a, (SELECT count(*) FROM mem m WHERE m.a = c.a AND m.firm_id NOT IN (k.src, k.dst)) AS pool FROM k CROSS JOIN (SELECT DISTINCT a FROM cls) c),
        seen AS (SELECT o.src, o.dst, o.product, e.a, e.pool FROM obs o JOIN cls c ON o.product = c.product JOIN ends e ON e.src = o.src AND e.dst = o.dst AND e.a = c.a),
        g AS (SELECT unnest([GAMMAS]) AS gamma), t AS (SELECT unnest(range(1, 21)) AS draw),
        opt AS (SELECT k.src, k.dst, k.k, h.product, e.a, e.pool, t.draw, -ln(@u01(concat_ws('|', 'holdout', k.src, k.dst, h.product, t.draw))) AS x
            FROM k JOIN held h ON k.src = h.firm_id JOIN cls c ON h.product = c.product JOIN ends e ON e.src = k.src AND e.dst = k.dst AND e.a = c.a CROSS JOIN t),
        drawn AS (SELECT gamma, draw, src, dst, product, a, pool FROM (SELECT *, row_number() OVER (PARTITION BY gamma, draw, src, dst ORDER BY x / power(pool + 1.0, gamma), product) AS place FROM opt CROSS JOIN g) z WHERE place <= k)""".replace("GAMMAS", ", ".join(f"CAST({x} AS DOUBLE)" for x in imputation.GAMMAS))
_HOLDOUT = f"""WITH {_DRAWS}, met AS (SELECT d.gamma, d.draw, o.src, o.dst, o.product, max(CASE WHEN d.product = o.product OR l.a IS NOT NULL THEN 1.0 ELSE 0.0 END) AS hit
            FROM drawn d JOIN seen o ON d.src = o.src AND d.dst = o.dst LEFT JOIN lk l ON l.a = o.a AND l.b = d.a GROUP BY d.gamma, d.draw, o.src, o.dst, o.product),
        rec AS (SELECT gamma, avg(hit) AS recall FROM met GROUP BY gamma),
        low AS (SELECT m.gamma, m.src, m.dst, @pct(m.m, 0.5) AS imp, max(r.m) AS re FROM (SELECT gamma, draw, src, dst, min(pool) AS m FROM drawn GROUP BY gamma, draw, src, dst) m JOIN (SELECT src, dst, min(pool) AS m FROM seen GROUP BY src, dst) r ON m.src = r.src AND m.dst = r.dst GROUP BY m.gamma, m.src, m.dst),
        rk AS (SELECT *, rank() OVER (PARTITION BY gamma ORDER BY imp) + (count(*) OVER (PARTITION BY gamma, imp) - 1) / 2.0 AS ri, rank() OVER (PARTITION BY gamma ORDER BY re) + (count(*) OVER (PARTITION BY gamma, re) - 1) / 2.0 AS rr FROM low),
        sc AS (SELECT gamma, @pct(imp, 0.5) AS m, avg(CASE WHEN imp <= 10 THEN 1.0 ELSE 0.0 END) AS s10, avg(CASE WHEN imp = 0 THEN 1.0 ELSE 0.0 END) AS s0, covar_pop(ri, rr) / nullif(stddev_pop(ri) * stddev_pop(rr), 0) AS rho FROM rk GROUP BY gamma),
        pl AS (SELECT gamma, count(*) AS n, @pct(pool, 0.5) AS m, avg(CASE WHEN pool <= 10 THEN 1.0 ELSE 0.0 END) AS s10, avg(CASE WHEN pool = 0 THEN 1.0 ELSE 0.0 END) AS s0 FROM drawn GROUP BY gamma),
        vals AS (SELECT gamma, pool FROM drawn UNION SELECT g.gamma, s.pool FROM seen s CROSS JOIN g),
        ks AS (SELECT a.gamma, max(abs((SELECT count(*) FROM drawn d WHERE d.gamma = a.gamma AND d.pool <= a.pool) / (1.0 * (SELECT count(*) FROM drawn d WHERE d.gamma = a.gamma)) - (SELECT count(*) FROM seen s WHERE s.pool <= a.pool) / (1.0 * (SELECT count(*) FROM seen)))) AS ks FROM vals a GROUP BY a.gamma)
        SELECT pl.gamma, pl.n AS drawn, round(pl.m, 6) AS median, round(pl.s10, 6) AS share_le10, round(pl.s0, 6) AS share_zero, round(rec.recall, 6) AS recall, round(sc.m, 6) AS scarcest_median, round(sc.s10, 6) AS scarcest_share_le10, round(sc.s0, 6) AS scarcest_share_zero, round(sc.rho, 6) AS spearman, round(ks.ks, 6) AS ks
        FROM pl JOIN rec ON pl.gamma = rec.gamma JOIN sc ON pl.gamma = sc.gamma JOIN ks ON pl.gamma = ks.gamma"""
ORACLES: dict[str, str] = {
    "N12_grouped_folds": _GROUPED_FOLDS,
    "N9_link_model": _LINK_MODEL,
    "Z21_edge_products": whole(_edge_products_sql()),
    "N19_power_law": _power_law_sql(),
    "Z22_budgets": f"WITH RECURSIVE {graphs._E}, sinks AS (SELECT x FROM nodes ANTI JOIN e ON x = src), up AS (SELECT x, 0 AS d FROM sinks UNION SELECT e.src, u.d + 1 FROM up u JOIN e ON u.x = e.dst WHERE u.d < 24), t AS (SELECT x, min(d) AS tier FROM up GROUP BY x) SELECT src, dst, CAST(floor({_STOCK('out', 'src')} + {_STOCK('in', 'dst')}) AS BIGINT) AS max_trials FROM (SELECT r.src, r.dst, a.tier AS out_tier, b.tier AS in_tier FROM (SELECT DISTINCT src, dst FROM {{relations}}) r LEFT JOIN t a ON r.src = a.x LEFT JOIN t b ON r.dst = b.x) z",
    "Z23_node_scenario": f"SELECT firm_id, CAST(greatest(degree, 1) AS BIGINT) AS size, round({_truncated('k', 1.5, 0.5, 1.0, 10000.0)}, 6) AS k, CASE WHEN out_degree = 0 THEN 1 ELSE CAST(@half(CAST(out_weight AS DOUBLE) * (1 - {_truncated('use', 0.75, 0.1, 0.0, 1.0)}), 0) AS BIGINT) END AS cap FROM {{degrees}}",
    "Z23_three_groups": f"SELECT firm_id, CAST(third AS BIGINT) AS third, CAST(@half(CASE third WHEN 1 THEN {_truncated('third', 2.0, 0.5, 0.0, 1e6)} WHEN 2 THEN {_truncated('third', 4.0, 1.0, 0.0, 1e6)} ELSE {_truncated('third', 6.0, 2.0, 0.0, 1e6)} END, 0) AS BIGINT) AS cap FROM (SELECT firm_id, ntile(3) OVER (ORDER BY degree, firm_id) AS third FROM {{degrees}} WHERE degree > 0) x",
    "C12_imputation_holdout": _HOLDOUT,
}
