"""Random numbers, statistics, similarity, scenarios, simulation, readers, streams."""

import json
import math
import os
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from rippleflow.functions import random as rnd
from rippleflow.functions import statistics
from rippleflow.operators import order, similarity
from rippleflow.plans import campaign, imputation, links, scenario, simulate
from rippleflow.sources import adapter, sinks, tables
from rippleflow.streaming import runs as stream


def test_uniform_numbers_are_even_and_independent_of_partitioning(spark):
    df = spark.range(4000).withColumn("u", rnd.u01([F.lit("x"), F.col("id")]))
    u = np.sort([r.u for r in df.collect()])
    assert 0 < u[0] and u[-1] < 1 and np.abs(u - (np.arange(4000) + 0.5) / 4000).max() < 0.03
    assert sorted(r.u for r in df.repartition(7).collect()) == u.tolist()


def test_normal_quantile_and_cdf_are_inverse(spark):
    ps = [1e-9, 0.001, 0.02, 0.1, 0.5, 0.77, 0.98, 0.9999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", rnd.normal_quantile(F.col("p")).alias("x")).withColumn("q", rnd.normal_cdf(F.col("x"))).collect()
    for r in rows:
        assert 0.5 * math.erfc(-r.x / math.sqrt(2)) == pytest.approx(r.p, rel=1e-7)
        assert r.q == pytest.approx(r.p, abs=2e-7)


def test_truncated_normal_has_its_bounds_and_mean(spark):
    df = spark.range(6000).select(rnd.truncated_normal(rnd.u01([F.lit("t"), F.col("id")]), 0.75, 0.1, 0.0, 0.8).alias("x"))
    x = np.array([r.x for r in df.collect()])
    rng = np.random.default_rng(1)
    want = rng.normal(0.75, 0.1, 200000)
    want = want[(want >= 0) & (want <= 0.8)]
    assert 0 <= x.min() and x.max() <= 0.8 and abs(x.mean() - want.mean()) < 0.004 and abs(x.std() - want.std()) < 0.004


def test_race_draws_by_weight(spark):
    df = spark.range(3000).withColumn("i", F.explode(F.array(*map(F.lit, range(3))))).withColumn("w", F.col("i") + 1.0)
    first = df.withColumn("t", rnd.race(rnd.u01([F.col("id"), F.col("i")]), F.col("w"))).groupBy("id").agg(F.min_by("i", "t").alias("i")).groupBy("i").count()
    share = {r.i: r["count"] / 3000 for r in first.collect()}
    assert all(abs(share[i] - (i + 1) / 6) < 0.04 for i in range(3))


def test_logistic_and_auc(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((x, y, float(rng.random() < 1 / (1 + math.exp(-(0.5 + 1.2 * x - 0.7 * y)))), 1.0))
    df = spark.createDataFrame(rows, "x double, y double, k double, n double")
    w = statistics.logistic(df, ["x", "y"], "k", "n")
    assert w == pytest.approx([0.5, 1.2, -0.7], abs=0.15)
    small = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 2.0, 2.0), (2.0, 0.0, 1.0), (0.5, 0.0, 1.0)], "s double, k double, n double")
    assert statistics.auc(small, "s", "k", "n") == pytest.approx((1 * (1 + 0.5) + 2 * (2 + 0.5)) / (3 * 3))


def test_correlation_p_value():
    assert statistics.correlation_p_value(0.5, 20) == pytest.approx(0.0248, abs=2e-4)
    assert statistics.correlation_p_value(0.0, 20) == pytest.approx(1.0)


def test_similarity_in_blocks_equals_one_product(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.a, r.b): r.score for r in similarity.all_pairs(df, 0.4, block=20).collect()}
    dot = np.round(v @ v.T, 6)
    assert got == {(i, j): dot[i, j] for i, j in zip(*np.nonzero(dot > 0.4))}


def test_best_match_in_blocks_equals_one_product(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(70, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(70, v[1].tolist())], "vec_id long, embedding array<double>")
    got = {r.a: (r.b, r.score) for r in similarity.best_match(df.where("vec_id < 40"), df.where("vec_id >= 30"), block=9).collect()}
    dot = np.round(v[:40] @ np.concatenate([v[30:], v[1:2]]).T, 6)
    assert got == {i: (30 + int(dot[i].argmax()), dot[i].max()) for i in range(40)}


def world(**change):
    w = simulate.World()
    w.size = {1: 1, 2: 2, 3: 1, 4: 1, 5: 1}
    w.k, w.cap = dict.fromkeys(w.size, 1.5), {1: 0, 2: 0, 3: 5, 4: 0, 5: 0}
    w.portfolio = {1: frozenset({7}), 3: frozenset({7}), 2: frozenset({8})}
    w.offers, w.alike = {7: [1, 3], 8: [2]}, {7: [(7, 1.0)], 8: [(8, 1.0)]}
    w.edges, w.trials = {(1, 2): {7: 2}, (2, 4): {8: 1}}, {(1, 2): 3, (2, 4): 1}
    for name, value in change.items():
        setattr(w, name, value)
    return w


@pytest.mark.parametrize("rule", ["overlap", "specific", "hybrid"])
def test_a_customer_finds_another_supplier(rule):
    run = simulate.Run(world(), 1, [1], rule).go(12)
    assert run.removed == {1: 1} and run.into[2] == {3} and not run.disrupted
    assert run.free[3] == (4 if rule == "overlap" else 3) and all(s[-1] == 0 for s in run.series)
    assert len(run.series) == 7


def test_without_capacity_the_cascade_goes_on():
    run = simulate.Run(world(cap=dict.fromkeys(range(1, 6), 0)), 1, [1], "specific", margin=0.0).go(40)
    assert run.removed[1] == 1 and run.origins[2][0] == 1
    assert set(run.removed) >= {1, 2} and run.removed[2] > 2
    rows = {(r[1], r[2]) for r in run.firms()}
    assert (1, "seed") in rows and (2, "removed") in rows


def test_first_answer_withdraws_the_request_from_others():
    w = world(portfolio={1: frozenset({7}), 3: frozenset({7}), 5: frozenset({7})}, offers={7: [1, 3, 5]}, cap={1: 0, 2: 0, 3: 5, 4: 0, 5: 5})
    run = simulate.Run(w, 3, [1], "specific").go(8)
    assert len(run.into[2]) == 1 and run.free[3] + run.free[5] == 8


def test_runs_don_t_depend_on_partitioning(spark):
    configs = spark.createDataFrame([(i, [1], "specific", 10, 3, 0.1) for i in range(6)], simulate.CONFIG)
    one, two = (sorted(map(tuple, simulate.simulate(c, world()).collect())) for c in (configs, configs.repartition(5)))
    assert one == two and len(one) == 6 * 6


def test_series_say_what_happened():
    run = simulate.Run(world(cap=dict.fromkeys(range(1, 6), 0)), 1, [1], "specific", margin=0.0).go(12)
    first, last = (dict(zip(simulate.METRICS, run.series[i][2:])) for i in (0, -1))
    assert len(simulate.METRICS) == 26
    # 1 -> 2 -> 4 with volumes 2 and 1; 3 and 5 have no links.
    assert (first["num_nodes"], first["num_edges"], first["num_isolates"], first["num_components"], first["edge_cap"], first["num_removed"]) == (5, 2, 2, 3, 3, 0)
    gone = run.removed
    assert last["num_removed"] == len(gone) and last["num_nodes"] == 5 - len(gone) and last["num_affected"] == len(gone & {1: 0, 2: 0}.keys())
    assert last["out_degree_removed"] == (1 in gone) + (2 in gone) and last["in_degree_removed"] == (2 in gone) + (4 in gone)
    assert last["w_degree_removed"] == last["w_in_degree_removed"] + last["w_out_degree_removed"] and last["w_out_degree_removed"] == 2 * (1 in gone) + (2 in gone)
    assert last["num_removed_edges"] == (1 in gone) + (2 in gone) and last["num_components"] == last["num_nodes"] - last["num_edges"]


def test_removal_by_a_truncated_normal():
    run = simulate.Run(world(), 1, [1], "specific", normal=(0.1, 0.2, 0.6))
    run.first_in[2], run.into[2] = 2, set()
    draws = []
    for t in range(400):
        run.tick = t
        draws.append(run.fall(2))
    p = 1.0  # all of the supply is lost
    law = NormalDist(p, 0.1)
    a, b = law.cdf(0.2), law.cdf(0.6)
    want = np.mean([law.inv_cdf(a + (i + 0.5) / 4000 * (b - a)) for i in range(4000)])
    assert 0.2 <= min(draws) and max(draws) <= 0.6 and abs(np.mean(draws) - want) < 0.01
    run.into[2] = {1}
    assert run.fall(2) == 0.0


def test_a_failed_run_leaves_its_error_and_records_read_back(spark, tmp_path):
    rows = [(1, [1], "specific", 10, 3, 0.1), (2, [1], "specific", None, 3, 0.1)]
    configs = spark.createDataFrame(rows, simulate.CONFIG)
    series, firms = (simulate.simulate(configs, world(), what) for what in ("series", "firms"))
    assert {r.run_id: r.n for r in series.where("error IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {2: 1}
    assert series.where("error IS NULL AND run_id = 1").count() == 6
    simulate.records(configs, series, firms).write.json(str(tmp_path / "runs"))
    back = {r.task_id: r for r in spark.read.schema(tables.RUNS).json(str(tmp_path / "runs")).collect()}
    assert back[2].error and back[2].num_removed is None and back[1].error is None
    assert back[1].num_removed[0] == 0 and back[1].num_removed[-1] == 1 and [x.id for x in back[1].seeds] == [1]
    week = simulate.with_differences(series.where("run_id = 1")).orderBy("week").collect()
    assert [r.diff_num_nodes for r in week][0] == 5 and sum(r.diff_num_nodes for r in week) == week[-1].num_nodes


def test_imputed_products_stay_in_the_portfolio(spark):
    relations = spark.createDataFrame([(1, 2, 3, False), (1, 3, 1, True), (4, 2, 1, False)], "src long, dst long, weight long, annotated boolean")
    capabilities = spark.createDataFrame([(1, p) for p in range(5)] + [(4, 9)], "firm_id long, product long")
    observed = spark.createDataFrame([(1, 3, 0, 2), (1, 3, 1, 4)], "src long, dst long, product long, amount long")
    pools = capabilities.groupBy("product").agg(F.count("*").alias("pool"))
    rows = scenario.sample_edge_products(relations, capabilities, observed, pools, "9" * 40, gamma=1.0).collect()
    assert {r.product for r in rows if r.src == 4} == {9} and all(r.amount >= 1 for r in rows)
    mine = [r.product for r in rows if (r.src, r.dst) == (1, 2)]
    assert 1 <= len(mine) == len(set(mine)) <= 5 and set(mine) <= set(range(5))


def test_macros_and_doubles():
    assert adapter.duck("SELECT @pct(x, 0.5) AS m, 1.5 * x FROM t") == "SELECT quantile_cont(x, 0.5e0) AS m, 1.5e0 * x FROM t"
    assert adapter._macros("@half(@pct(ln(a), 0.1), 0)", adapter._SPARK) == "bround(percentile(ln(a), 0.1e0), 0)"


def test_point_in_polygon_takes_the_first_shape(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    notch = [[2, 2], [6, 2], [6, 6], [4, 3], [2, 6], [2, 2]]
    feature = lambda name, kind, c: {"type": "Feature", "properties": {"nam": name}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "g.json").write_text(json.dumps({"features": [feature("a", "Polygon", [ring]), feature("b", "MultiPolygon", [[notch], [[[9, 9], [10, 9], [10, 10], [9, 9]]]])]}))
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 5.0, 3.0), (4, 4.0, 5.0), (5, 9.9, 9.5), (6, None, 1.0)], "id int, longitude double, latitude double")
    got = {r.id: r.name for r in tables.locate(points, tables.polygons(spark, str(tmp_path / "g.json"), "nam")).collect()}
    assert got == {1: "a", 2: "a", 3: "b", 4: None, 5: "b", 6: None}


def test_run_files_batch_and_stream_agree(spark, tmp_path):
    rows = [(i, 1 + i % 2, [1.0, 2.0 + i], "bad" if i == 5 else None) for i in range(8)]
    sinks.append_runs(spark.createDataFrame(rows, "task_id long, num_seeds int, num_removed array<double>, error string"), str(tmp_path))
    records = tables.run_records(spark, f"{tmp_path}/runs")
    assert records.count() == 7 and tables.run_weeks(records).count() == 14
    stream.to_memory(stream.cascade_sizes(spark, f"{tmp_path}/runs", 1), "sizes_test")
    got = {r.num_seeds: (r.runs, r.most) for r in spark.table("sizes_test").collect()}
    assert got == {1: (4, 7.0), 2: (3, 7.0)}
    assert spark.read.schema(tables.RUNS).json(f"{tmp_path}/errors").first().error == "bad"


def test_config_slice_and_tables(spark, tmp_path):
    configs = spark.range(10).withColumnRenamed("id", "task_id")
    assert tables.config_slice(configs, 3, 5).count() == 2 and tables.config_slice(configs, 3).count() == 7
    (tmp_path / "GeoNations.csv").write_text("nation_id,nation_name\n1,A\n2,\n")
    got = tables.csv_tables(spark, str(tmp_path), {"GeoNations": tables.SCHEMAS["GeoNations"]})
    assert [tuple(r) for r in got["GeoNations"].collect()] == [(1, "A"), (2, None)]


def test_gexf_is_well_formed(spark):
    import xml.etree.ElementTree as tree

    firms = spark.createDataFrame([(1, 3), (2, None)], "firm_id long, nation_id int")
    lines = sinks.gexf_lines(firms, spark.createDataFrame([(1, 2)], "src long, dst long")).orderBy("part", "id").collect()
    root = tree.fromstring("".join(r.line for r in lines))
    assert len(root.findall(".//{*}node")) == 2 and len(root.findall(".//{*}edge")) == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_runs_know_all_products(spark):
    n = adapter.Network(spark, "/root/testdata/sf0.01")
    w, size = campaign._world(n), n["sizes"].first()[0]
    can = [(r.firm_id, r.product) for r in n["capabilities"].collect()]
    assert max(p for _, p in can) > 400 and all(p in w.portfolio[f] and f in w.offers[p] for f, p in can)
    pairs = [(r.a, r.b, r.score) for r in n["alike"].where("score > 0.3").collect()]
    products = [r.product for r in n["products"].select("product").distinct().collect()]
    for product in (7, 777, max(products)):
        want = sorted((p, s) for a, b, s in pairs if a == product % size for p in products if p % size == b)
        assert want and simulate.alternatives(w, product) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_command_line_writes_records(spark, tmp_path):
    from rippleflow import run

    rows = [{"run_id": i, "seeds": [5 * (i + 1)], "rule": rule, "until": 8, "parallel": 2, "margin": 0.1} for i, rule in enumerate(("overlap", "specific", "hybrid"))]
    rows.append({"run_id": 9, "seeds": [5], "rule": "overlap", "until": None, "parallel": 2, "margin": 0.1})
    (tmp_path / "configs.json").write_text(json.dumps([*rows, {"run_id": 50, "seeds": [5], "rule": "overlap", "until": 8, "parallel": 1, "margin": 0.1}]))
    assert run.run(spark, "/root/testdata/sf0.001", str(tmp_path / "configs.json"), str(tmp_path / "out"), last=20) == 1
    back = {r.task_id: r for r in tables.run_records(spark, str(tmp_path / "out")).collect()}
    assert set(back) == {0, 1, 2, 9} and back[9].error and all(len(back[i].num_removed) == 5 for i in range(3))


def test_places_and_running_sums_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([1, 1, 1, 2, rng.randrange(1000)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    got = order.numbered(df, ["x", "id"], "i").collect()
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: r[1:]))}
    assert {r.id: r.i for r in got} == want
    assert sorted(r.i for r in order.numbered(df, ["x"], "i").collect()) == list(range(2000))
    sums = {r.id: r.s for r in order.before(df, ["x", "id"], F.col("x").cast("long"), "s", ("g",)).collect()}
    assert sums == {i: sum(x for h, x, j in rows if h == g and (x, j) < (y, i)) for g, y, i in rows}
    assert order.numbered(df.limit(0), ["x"], "i").count() == 0


def test_thirds_equal_ntile(spark):
    for n in (1, 2, 3, 7, 11):
        df = spark.createDataFrame([(i, i * 7 % 5) for i in range(n)], "firm_id int, degree int")
        want = {r.firm_id: r.t for r in df.selectExpr("firm_id", "ntile(3) OVER (ORDER BY degree, firm_id) AS t").collect()}
        assert {r.firm_id: r.third for r in scenario.thirds(df, "1").collect()} == want


def test_link_features_by_hand(spark):
    edges = spark.createDataFrame([(1, 9, 3, True), (2, 9, 1, False), (1, 8, 5, True), (3, 8, 1, False)], "src long, dst long, weight long, annotated boolean")
    sold = spark.createDataFrame([(1, 9, 10), (1, 9, 11), (1, 8, 11)], "src long, dst long, product long")
    can = spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "firm_id long, product long")
    pools = spark.createDataFrame([(10, 4), (11, 2)], "product long, pool long")
    got = {(r.src, r.dst): (r.log_pool, r.dependence, r.log_customer_degree) for r in links.link_features(edges, sold, can, pools).collect()}
    ln = math.log
    assert set(got) == {(1, 9), (2, 9), (1, 8)}  # firm 3 has neither products nor a pool
    assert got[1, 9] == pytest.approx((ln(2), 3 / 7, ln(2))) and got[2, 9] == pytest.approx(((ln(4) + ln(2)) / 2, 4 / 7, ln(2)))
    assert got[1, 8] == pytest.approx((ln(2), 5 / 9, ln(2)))


def test_link_models_find_what_passes_disruptions_on(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        pool, dependence, degree = rng.gauss(2, 1), rng.random(), rng.gauss(1, 0.5)
        p = 1 / (1 + math.exp(1 + 0.8 * (pool - 2) - 2 * dependence))
        rows.append((i % 300, i, pool, dependence, degree, sum(rng.random() < p for _ in range(10)), 10))
    df = spark.createDataFrame(rows, "src long, dst long, log_pool double, dependence double, log_customer_degree double, k int, n int")
    got = {(r.kind, r.model, r.term): r.value for r in links.link_models(df).collect()}
    assert got["coefficient", "full", "log_pool"] == pytest.approx(-0.8, abs=0.06)
    assert got["coefficient", "full", "dependence"] == pytest.approx(2 * 12**-0.5, abs=0.06)
    assert abs(got["coefficient", "full", "log_customer_degree"]) < 0.06
    assert got["auc_cv", "constant", ""] == 0.5 and abs(got["auc_cv", "topology", ""] - 0.5) < 0.03
    assert got["auc_cv", "full", ""] > got["auc_cv", "volume", ""] + 0.05 > 0.6
    low = sorted(rows, key=lambda r: r[2])
    assert got["rate", "", "log_pool 0"] == pytest.approx(sum(r[5] for r in low[:750]) / 7500, abs=2e-3)
    assert got["auc", "", "log_pool"] < 0.45
    assert links.link_models(df.limit(0)).count() == 0


def test_imputed_draws_equal_brute_force(spark):
    import hashlib

    rng = random.Random(8)
    portfolio = {f: rng.sample(range(12), rng.randint(1, 6)) for f in range(6)}
    observed = {(s, 50 + s % 2): rng.sample(range(14), rng.randint(1, 3)) for s in (0, 1, 2, 3, 99)}  # 99 has no portfolio, 12 and 13 are nobody's
    like = {(a, a) for a in range(4)} | {(0, 1), (1, 0)}
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    h = imputation.holdout(
        table([(s, d, p) for (s, d), ps in observed.items() for p in ps], "src long, dst long, product long"),
        table([(f, p) for f, ps in portfolio.items() for p in ps] * 2, "firm_id long, product long"),
        table([(p, p % 4) for p in range(14)], "product long, a long"), table(sorted(like), "a long, b long"), "t", (-1.0, 0.0, 2.0), 4,
    )
    firms = {a: {f for f, ps in portfolio.items() for p in ps if (a, p % 4) in like} for a in range(4)}
    pool = lambda p, s, d: len(firms[p % 4] - {s, d})
    u = lambda *key: (int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    want, hits = set(), {}
    for (s, d), ps in observed.items():
        if s not in portfolio:
            continue
        for g in (-1.0, 0.0, 2.0):
            for t in range(1, 5):
                first = sorted(portfolio[s], key=lambda p: -math.log(u("t", s, d, p, t)) / (pool(p, s, d) + 1) ** g)[: min(len(ps), len(portfolio[s]))]
                want |= {(g, t, s, d, p, pool(p, s, d)) for p in first}
                hits.setdefault(g, []).extend(any(p == q or (p % 4, q % 4) in like for q in first) for p in ps)
    assert {(r.gamma, r.draw, r.src, r.dst, r["product"], r.pool) for r in h.drawn.collect()} == want
    got = {r.gamma: r for r in imputation.report(h).collect()}
    real = [pool(p, s, d) for (s, d), ps in observed.items() if s in portfolio for p in ps]
    for g, r in got.items():
        mine = [x[5] for x in want if x[0] == g]
        assert r.drawn == len(mine) and r.recall == pytest.approx(sum(hits[g]) / len(hits[g])) and r.median == np.median(mine)
        assert r.ks == pytest.approx(max(abs(np.mean(np.array(mine) <= v) - np.mean(np.array(real) <= v)) for v in {*mine, *real}))
    assert {r.fold for r in imputation.by_folds(h).collect()} <= set(range(5))
