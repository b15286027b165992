"""Substitution pools, link features, capacity dynamics, experiment comparisons and statistics, as SQL plans."""

from __future__ import annotations

from ..sources.adapter import whole

# Similar products: vectors stand for products, p_partkey modulo their number.
_POOL = """offers AS (SELECT DISTINCT c.firm_id, c.product % s.vectors AS a FROM {capabilities} c CROSS JOIN {sizes} s),
        lost AS (SELECT DISTINCT e.product, e.product % s.vectors AS a FROM {edge_products} e CROSS JOIN {sizes} s),
        pool AS (SELECT DISTINCT l.product, o.firm_id FROM lost l JOIN {alike} p ON l.a = p.a AND p.score > 0.3 JOIN offers o ON p.b = o.a)"""
# Average ranks: running sums over distinct values, which are few, instead of a sort of all rows.
_RANKS = "WITH ri AS (SELECT v, sum(n) OVER (ORDER BY v) - (n - 1) / 2.0 AS r FROM (SELECT in_degree AS v, count(*) AS n FROM {degrees} WHERE degree > 0 GROUP BY in_degree) a), ro AS (SELECT v, sum(n) OVER (ORDER BY v) - (n - 1) / 2.0 AS r FROM (SELECT out_degree AS v, count(*) AS n FROM {degrees} WHERE degree > 0 GROUP BY out_degree) b)"
_COMPARE = "x AS (SELECT task_id, arm, scenario, num_seeds, sample_id, weeks - num_seeds AS cascade FROM {runs})"

SQL: dict[str, str] = {
    "C4_product_pools": f"WITH {_POOL} SELECT product, count(*) AS pool FROM pool GROUP BY product",
    "C5_edge_candidates": f"""WITH {_POOL} SELECT e.src, e.dst, e.product, count(p.firm_id) AS candidates FROM {{edge_products}} e
        LEFT JOIN pool p ON e.product = p.product AND p.firm_id <> e.src AND p.firm_id <> e.dst GROUP BY e.src, e.dst, e.product""",
    "C7_taxonomy": "SELECT round(avg(CASE WHEN x.group_name = y.group_name THEN 1.0 ELSE 0.0 END), 6) AS same_group, round(avg(CASE WHEN x.family_name <> y.family_name THEN 1.0 ELSE 0.0 END), 6) AS other_family, count(*) AS pairs FROM {alike} s CROSS JOIN {sizes} n JOIN {products} x ON x.product = s.a JOIN {products} y ON y.product = s.b WHERE s.a < s.b AND s.score > 0.3 AND NOT x.special AND NOT y.special",
    "C8_dual_sourcing": "SELECT 'strict' AS kind, count(*) AS pairs FROM (SELECT DISTINCT a.src, b.src AS other, a.product FROM {details} a JOIN {details} b ON a.dst = b.dst AND a.product = b.product AND a.model = b.model AND a.model_year = b.model_year AND a.src <> b.src) s UNION ALL SELECT 'loose', count(*) FROM (SELECT DISTINCT a.src, b.src AS other, a.product FROM {details} a JOIN {details} b ON a.dst = b.dst AND a.product = b.product AND a.src <> b.src) l",
    "C9_rule_recall": f"""WITH pairs AS (SELECT DISTINCT a.src AS u, b.src AS v, a.product % s.vectors AS x FROM {{details}} a JOIN {{details}} b ON a.dst = b.dst AND a.src <> b.src AND a.product = b.product CROSS JOIN {{sizes}} s),
        offers AS (SELECT DISTINCT c.firm_id, c.product % s.vectors AS a FROM {{capabilities}} c CROSS JOIN {{sizes}} s),
        hit AS (SELECT DISTINCT p.u, p.v, p.x FROM pairs p JOIN {{alike}} g ON p.x = g.a AND g.score > 0.3 JOIN offers o ON g.b = o.a AND o.firm_id = p.v)
        SELECT count(*) AS pairs, (SELECT count(*) FROM hit) AS recalled FROM pairs""",
    "C10_overlap_recall": "WITH pairs AS (SELECT DISTINCT a.src AS u, b.src AS v FROM {details} a JOIN {details} b ON a.dst = b.dst AND a.src <> b.src) SELECT count(*) AS pairs, (SELECT count(DISTINCT p.u * 100000000 + p.v) FROM pairs p JOIN {capabilities} x ON p.u = x.firm_id JOIN {capabilities} y ON p.v = y.firm_id AND x.product = y.product) AS recalled FROM pairs",
    "C11_edge_composition": "SELECT t.is_oem, count(*) AS edges, round(avg(CASE WHEN r.annotated THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(CASE WHEN r.annotated THEN r.weight END), 6) AS weight FROM {relations} r JOIN {firms} t ON r.dst = t.firm_id GROUP BY t.is_oem",
    "C14_vocabulary": "SELECT count(*) AS observed, CAST(sum(CASE WHEN c.product IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS known FROM (SELECT DISTINCT product FROM {edge_products}) e LEFT JOIN (SELECT DISTINCT product FROM {capabilities}) c ON e.product = c.product",
    "C15_cascade_size": f"WITH {_COMPARE} SELECT task_id, arm, cascade FROM x",
    "C16_arm_table": f"""WITH {_COMPARE} SELECT scenario, arm, round(avg(cascade), 6) AS mean, max(cascade) AS most, round(avg(CASE WHEN cascade > 65 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS runs FROM x GROUP BY scenario, arm""",
    "C17_sensitivity": f"WITH {_COMPARE} SELECT sample_id % 4 AS gamma, arm, round(avg(cascade), 6) AS mean, round(stddev_samp(cascade) / sqrt(count(*)), 6) AS se FROM x GROUP BY sample_id % 4, arm",
    "C18_robustness": f"""WITH {_COMPARE}, s AS (SELECT num_seeds, sample_id, avg(cascade) AS m, stddev_samp(cascade) / sqrt(count(*)) AS se FROM x GROUP BY num_seeds, sample_id),
        a AS (SELECT num_seeds, @pct(cascade, 0.5) AS med, avg(cascade) AS mean FROM x GROUP BY num_seeds)
        SELECT a.num_seeds, round(max(a.med), 6) AS median, round(max(a.mean), 6) AS mean, round(avg(s.se), 6) AS within_se, round(stddev_samp(s.m), 6) AS between_sd FROM a JOIN s ON a.num_seeds = s.num_seeds GROUP BY a.num_seeds""",
    "C19_horizon": "SELECT r.num_seeds, round(avg(z.disrupted), 6) AS mean, CAST(max(z.disrupted) AS BIGINT) AS most FROM (SELECT run_id, sum(CASE WHEN value BETWEEN 20 AND 50 THEN 1 ELSE 0 END) AS disrupted FROM {run_series} GROUP BY run_id) z JOIN {runs} r ON z.run_id = r.run_id GROUP BY r.num_seeds",
    "C20_capacity_windows": """WITH d AS (SELECT run_id, week, lag(c) OVER (PARTITION BY run_id ORDER BY week) - c AS lost, removed - lag(removed) OVER (PARTITION BY run_id ORDER BY week) AS gone FROM {capacity}),
        w AS (SELECT 2 AS a, 6 AS b UNION ALL SELECT 6, 10 UNION ALL SELECT 10, 16 UNION ALL SELECT 16, 25 UNION ALL SELECT 25, 53)
        SELECT r.num_seeds, w.a, round(sum(d.lost) / sum(d.gone), 6) AS lost_per_firm FROM d JOIN w ON d.week >= w.a AND d.week < w.b JOIN {runs} r ON d.run_id = r.run_id GROUP BY r.num_seeds, w.a HAVING sum(d.gone) > 0""",
    "C21_fastest_decline": """WITH d AS (SELECT run_id, week, c, lag(c) OVER (PARTITION BY run_id ORDER BY week) - c AS lost, first_value(c) OVER (PARTITION BY run_id ORDER BY week) AS x FROM {capacity}),
        k AS (SELECT run_id, week, c, x, row_number() OVER (PARTITION BY run_id ORDER BY lost DESC, week) AS k FROM d WHERE lost IS NOT NULL), e AS (SELECT run_id, min(c) AS y FROM {capacity} GROUP BY run_id)
        SELECT k.run_id, k.week, round(CASE WHEN k.x = e.y THEN 0 ELSE (k.x - k.c) / (k.x - e.y) END, 6) AS progress FROM k JOIN e ON k.run_id = e.run_id WHERE k.k = 1""",
    "C22_matched": f"WITH {_COMPARE} SELECT a.sample_id, round(avg(a.cascade - b.cascade), 6) AS diff, count(*) AS pairs FROM x a JOIN x b ON a.task_id = b.task_id AND a.arm = 0 AND b.arm = 1 GROUP BY a.sample_id",
    "C23_capacity_metrics": """WITH d AS (SELECT run_id, week, c, removed, lag(c) OVER (PARTITION BY run_id ORDER BY week) - c AS drop_, c - lag(c) OVER (PARTITION BY run_id ORDER BY week) AS rise FROM {capacity}),
        e AS (SELECT run_id, max(week) AS last, max(removed) AS total, min(c) AS low, max(c) AS high, max(drop_) AS most, CAST(sum(CASE WHEN rise > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rises FROM d GROUP BY run_id)
        SELECT d.run_id, max(e.rises) AS rises, round(max(e.most), 6) AS max_weekly, round(max(e.high - e.low), 6) AS loss, min(CASE WHEN d.drop_ = e.most THEN d.week END) AS t_fast,
            coalesce(min(CASE WHEN d.removed >= 0.9 * e.total THEN d.week END), 0) AS t90, coalesce(min(CASE WHEN e.high - d.c >= 0.5 * (e.high - e.low) THEN d.week END), 0) AS t50c, min(CASE WHEN d.c = e.low THEN d.week END) AS t_min
        FROM d JOIN e ON d.run_id = e.run_id GROUP BY d.run_id""",
    "C24_capacity_summary": """WITH e AS (SELECT c.run_id, max(r.scenario) AS scenario, max(c.c) - min(c.c) AS loss, max(c.removed) AS removed FROM {capacity} c JOIN {runs} r ON c.run_id = r.run_id GROUP BY c.run_id)
        SELECT scenario, 'loss' AS metric, round(@pct(loss, 0.5), 6) AS median, round(avg(loss), 6) AS mean, round(@pct(loss, 0.25), 6) AS q25, round(@pct(loss, 0.75), 6) AS q75 FROM e GROUP BY scenario
        UNION ALL SELECT scenario, 'removed', round(@pct(removed, 0.5), 6), round(avg(removed), 6), round(@pct(removed, 0.25), 6), round(@pct(removed, 0.75), 6) FROM e GROUP BY scenario""",
    "C25_mean_curves": "SELECT r.sample_id, c.week, round(avg(c.c), 6) AS mean, count(*) AS n FROM {capacity} c JOIN {runs} r ON c.run_id = r.run_id WHERE r.num_seeds = 1 + r.sample_id % 5 GROUP BY r.sample_id, c.week",
    "C30_equal_split": "SELECT c.firm, round(sum((r.weeks - r.num_seeds) / (1.0 * r.num_seeds)), 6) AS mass FROM {cascade} c JOIN {runs} r ON c.run_id = r.run_id WHERE c.is_seed GROUP BY c.firm",
    "C31_predictor_frame": "SELECT d.firm_id, d.out_degree, d.in_degree, coalesce(p.participation, 0) AS participation FROM {degrees} d LEFT JOIN (SELECT u, round(1 - sum(share * share), 9) AS participation FROM (SELECT n.u, c.community, count(*) / (1.0 * sum(count(*)) OVER (PARTITION BY n.u)) AS share FROM {neighbours} n JOIN {communities} c ON n.v = c.firm_id GROUP BY n.u, c.community) x GROUP BY u) p ON d.firm_id = p.u",
    "C32_nexus": "SELECT r.num_seeds, round(corr(z.s, r.weeks), 6) AS r_sum, round(corr(z.m, r.weeks), 6) AS r_mean FROM (SELECT run_id, sum(size) AS s, avg(size) AS m FROM {cascade} WHERE is_seed GROUP BY run_id) z JOIN {runs} r ON z.run_id = r.run_id GROUP BY r.num_seeds",
    "C33_multi_origin": """WITH o AS (SELECT o.run_id, o.firm, count(DISTINCT o.origin) AS n FROM {origins} o JOIN {cascade} c ON o.run_id = c.run_id AND o.origin = c.firm GROUP BY o.run_id, o.firm)
        SELECT round(avg(CASE WHEN coalesce(o.n, 0) >= 2 THEN 1.0 ELSE 0.0 END), 6) AS share, round(@pct(c.week, 0.5), 6) AS median, round(avg(c.week), 6) AS mean, round(@pct(c.week, 0.9), 6) AS p90 FROM {cascade} c LEFT JOIN o ON c.run_id = o.run_id AND c.firm = o.firm WHERE NOT c.is_seed""",
    "C34_any_origin": "SELECT round(avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS firms FROM (SELECT run_id, firm, count(DISTINCT origin) AS n FROM {origins} GROUP BY run_id, firm) x",
    "C35_example_runs": "SELECT run_id, weeks, num_seeds FROM (SELECT run_id, weeks, num_seeds, row_number() OVER (PARTITION BY num_seeds ORDER BY weeks DESC, run_id) AS k FROM {runs} WHERE weeks - num_seeds <= 80) x WHERE k = 1",
    "C36_community_share": "WITH n AS (SELECT c.run_id, m.community, count(*) AS n FROM {cascade} c JOIN {communities} m ON c.firm = m.firm_id WHERE NOT c.is_seed GROUP BY c.run_id, m.community) SELECT run_id, CAST(mapped AS BIGINT) AS mapped, community AS top_community, round(n / (1.0 * mapped), 6) AS share FROM (SELECT run_id, community, n, sum(n) OVER (PARTITION BY run_id) AS mapped, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, community) AS k FROM n) x WHERE k = 1",
    "C37_cascade_tree": """WITH ok AS (SELECT DISTINCT o.run_id, o.firm, o.origin, c.week FROM {origins} o JOIN {cascade} c ON o.run_id = c.run_id AND o.origin = c.firm),
        p AS (SELECT run_id, firm, origin, row_number() OVER (PARTITION BY run_id, firm ORDER BY week, origin) AS k, count(*) OVER (PARTITION BY run_id, firm) AS n FROM ok)
        SELECT c.run_id, c.firm, coalesce(p.origin, 0) AS parent, coalesce(p.n, 1) - 1 AS secondary FROM {cascade} c LEFT JOIN p ON c.run_id = p.run_id AND c.firm = p.firm AND p.k = 1 WHERE NOT c.is_seed""",
    "C38_region": """WITH m AS (SELECT c.run_id, c.firm, c.is_seed, c.week, f.nation_id, r.scenario FROM {cascade} c JOIN {firms} f ON c.firm = f.firm_id JOIN {runs} r ON c.run_id = r.run_id)
        SELECT scenario, count(DISTINCT CASE WHEN nation_id < 5 THEN firm END) AS inside, count(DISTINCT CASE WHEN nation_id >= 5 THEN firm END) AS outside, count(DISTINCT nation_id) AS nations, round(avg(CASE WHEN is_seed THEN 1.0 ELSE 0.0 END), 6) AS seed_share, round(avg(CASE WHEN is_seed THEN 0 ELSE week END), 6) AS mean_week FROM m GROUP BY scenario""",
    "C39_link_features": f"""WITH {_POOL}, size AS (SELECT product, count(*) AS n FROM pool GROUP BY product), inbound AS (SELECT dst, sum(weight) AS w FROM {{relations}} GROUP BY dst), few AS (SELECT e.src, e.dst, min(s.n) AS pool, sum(e.amount) AS amount FROM {{edge_products}} e JOIN size s ON e.product = s.product GROUP BY e.src, e.dst)
        SELECT f.src, f.dst, round(ln(f.pool), 6) AS log_pool, round(f.amount / (1.0 * i.w), 6) AS dependence, round(ln(d.degree), 6) AS log_degree FROM few f JOIN inbound i ON f.dst = i.dst JOIN {{degrees}} d ON f.dst = d.firm_id""",
    # A link is exposed in a run that removes its supplier and doesn't seed its customer, and passes on if the customer goes too.
    "C40_exposure_counts": "SELECT r.src, r.dst, count(*) AS exposed, count(d.firm_id) AS propagated FROM {relations} r JOIN {struck} s ON r.src = s.firm_id LEFT JOIN {struck} d ON d.run_id = s.run_id AND d.firm_id = r.dst WHERE coalesce(d.seed, 0) = 0 GROUP BY r.src, r.dst",
    "C43_criticality": f"{_RANKS} SELECT round(corr(d.out_degree, d.in_degree), 6) AS pearson, round(corr(ln(1 + d.out_degree), ln(1 + d.in_degree)), 6) AS log_pearson, round(corr(y.r, x.r), 6) AS spearman FROM {{degrees}} d JOIN ri x ON d.in_degree = x.v JOIN ro y ON d.out_degree = y.v WHERE d.degree > 0",
    # Statistics.
    "N1_pearson": "SELECT round(corr(in_degree, out_degree), 9) AS r, count(*) AS n FROM {degrees} WHERE degree > 0",
    "N2_correlation_matrix": "SELECT 'in_out' AS pair, round(corr(in_degree, out_degree), 6) AS r FROM {degrees} UNION ALL SELECT 'in_weight', round(corr(in_degree, in_weight), 6) FROM {degrees} UNION ALL SELECT 'out_weight', round(corr(out_degree, out_weight), 6) FROM {degrees}",
    "N3_spearman": f"{_RANKS} SELECT round(corr(x.r, y.r), 9) AS rho FROM {{degrees}} d JOIN ri x ON d.in_degree = x.v JOIN ro y ON d.out_degree = y.v WHERE d.degree > 0",
    "N4_log_pearson": "SELECT round(corr(ln(1 + value), ln(1 + week)), 9) AS r FROM {run_series}",
    "N5_partial_correlation": "SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 9) AS r FROM (SELECT corr(in_degree, out_degree) AS xy, corr(in_degree, degree * degree) AS xz, corr(out_degree, degree * degree) AS yz FROM {degrees} WHERE degree > 0) c",
    "N7_bootstrap": """WITH x AS (SELECT row_number() OVER (ORDER BY run_id) - 1 AS i, weeks - num_seeds AS y, count(*) OVER () AS n FROM {runs}), b AS (SELECT DISTINCT week AS b FROM {run_series}),
        d AS (SELECT b.b, CAST(floor(@u01(concat_ws('|', 'boot', CAST(b.b AS VARCHAR(20)), CAST(x.i AS VARCHAR(20)))) * x.n) AS BIGINT) AS j FROM b CROSS JOIN x),
        m AS (SELECT d.b, avg(x.y) AS m FROM d JOIN x ON d.j = x.i GROUP BY d.b) SELECT round(@pct(m, 0.025), 6) AS low, round(@pct(m, 0.975), 6) AS high FROM m""",
    "N8_paired_difference": "SELECT round(avg(a.weeks - b.weeks), 6) AS diff, round(avg(a.weeks) / avg(b.weeks), 6) AS ratio, round(stddev_samp(a.weeks - b.weeks) / sqrt(count(*)), 6) AS se FROM {runs} a JOIN {runs} b ON a.task_id = b.task_id AND a.arm = 0 AND b.arm = 1",
    "N10_standardise": "SELECT d.firm_id, round((d.in_degree - t.m) / t.s, 6) AS z FROM {degrees} d CROSS JOIN (SELECT avg(in_degree) AS m, stddev_pop(in_degree) AS s FROM {degrees} WHERE degree > 0) t WHERE d.degree > 0",
    "N11_weighted_auc": """WITH x AS (SELECT out_degree AS score, CASE WHEN in_degree > 1 THEN 1 ELSE 0 END AS y, degree AS w FROM {degrees} WHERE degree > 0), g AS (SELECT score, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS n FROM x GROUP BY score)
        SELECT round(sum(p * (below + n / 2.0)) / (max(tp) * max(tn)), 9) AS auc FROM (SELECT p, n, sum(n) OVER (ORDER BY score) - n AS below, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM g) z""",
    "N17_seed_sample": "SELECT nation_id, firm_id FROM (SELECT nation_id, firm_id, row_number() OVER (PARTITION BY nation_id ORDER BY @u01(concat_ws('|', 'seed', CAST(firm_id AS VARCHAR(20)))), firm_id) AS k, count(*) OVER (PARTITION BY nation_id) AS n FROM {degrees} WHERE out_degree > 0) x WHERE k <= floor(0.3 * n)",
    "N15_discrete_uniform": "SELECT firm_id, CAST(floor(@half(ln(degree), 0) / 2.0 + @u01(concat_ws('|', 'cap', CAST(firm_id AS VARCHAR(20)))) * 3) AS BIGINT) AS cap FROM {degrees} WHERE degree > 0",
    "N20_fit_slope": "WITH x AS (SELECT degree AS k FROM {degrees} WHERE degree >= 2), a AS (SELECT 1 + count(*) / sum(ln(k / 1.5)) AS alpha, count(*) AS n FROM x) SELECT DISTINCT x.k, round(power(x.k / 2.0, 1 - a.alpha) * a.n / t.n, 9) AS fit FROM x CROSS JOIN a CROSS JOIN (SELECT count(*) AS n FROM {degrees} WHERE degree > 0) t",
    "C49_config_grid": "SELECT s.scenario * 1000 + b.num_seeds * 100 + c.sample_id AS task_id, s.scenario, b.num_seeds, c.sample_id, CASE s.scenario WHEN 0 THEN 'random' WHEN 1 THEN 'degree' ELSE 'single' END AS strategy, concat_ws('-', CAST(s.scenario AS VARCHAR(9)), CAST(c.sample_id AS VARCHAR(9))) AS seed FROM (SELECT DISTINCT scenario FROM {runs}) s CROSS JOIN (SELECT DISTINCT num_seeds FROM {runs}) b CROSS JOIN (SELECT DISTINCT sample_id FROM {runs}) c",
    "C50_config_revision": "SELECT r.run_id, r.scenario, 1 AS no_customer_capacity, g.gamma FROM {runs} r CROSS JOIN (SELECT 0 AS gamma UNION ALL SELECT 1 UNION ALL SELECT 2) g WHERE r.scenario IN (0, 2)",
    "S6_config_slice": "SELECT run_id, scenario, num_seeds FROM {runs} WHERE run_id >= 20 AND run_id < 60",
    "S2_column_pruning": "SELECT l_suppkey, l_partkey FROM {lineitem} WHERE l_quantity >= 49",
    "K4_node_edge_sheets": "SELECT 'node' AS sheet, firm_id AS a, CAST(nation_id AS BIGINT) AS b FROM {firms} UNION ALL SELECT 'edge', src, dst FROM {relations}",
}
#: Plans over the whole network, as in relational.py.
WHOLE = """
    C8_dual_sourcing C11_edge_composition C14_vocabulary C43_criticality N1_pearson N2_correlation_matrix N3_spearman N5_partial_correlation
    N10_standardise N17_seed_sample N15_discrete_uniform N20_fit_slope K4_node_edge_sheets
""".split()
SQL |= {name: whole(SQL[name]) for name in WHOLE}
