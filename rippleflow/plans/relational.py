"""Filters, joins, aggregates, windows, ranks and set operations on the supply network, as declarative SQL.

Every entry is one plan; Catalyst prunes columns, pushes filters to the scans and picks the joins by size.
"""

from __future__ import annotations

from ..sources.adapter import whole

SQL: dict[str, str] = {
    # Projections and filters.
    "F1_select_rename": "SELECT firm_id AS id, nation_id AS country FROM {firms}",
    "F2_comparison": "SELECT firm_id, degree FROM {degrees} WHERE degree > 0 AND is_oem",
    "F3_nulls": "SELECT d.firm_id, r.weight IS NULL AS absent FROM {degrees} d LEFT JOIN {relations} r ON d.firm_id = r.src AND r.weight > 1 WHERE r.dst IS NULL",
    "F4_not_in_list": "SELECT f.firm_id FROM {firms} f LEFT ANTI JOIN (SELECT src AS firm_id FROM {relations} UNION ALL SELECT dst FROM {relations}) x ON f.firm_id = x.firm_id",
    "F5_derived_columns": "SELECT firm_id, in_degree + out_degree AS total, (in_degree + out_degree + degree) / 3.0 AS mean3 FROM {degrees}",
    "F6_fill_null": "SELECT f.firm_id, coalesce(n.products, 0) AS products FROM {firms} f LEFT JOIN (SELECT firm_id, count(*) AS products FROM {capabilities} GROUP BY firm_id) n ON f.firm_id = n.firm_id",
    "F7_complete_cases": "SELECT f.firm_id, f.capital, r.weight FROM {firms} f LEFT JOIN {relations} r ON f.firm_id = r.src WHERE f.capital IS NOT NULL AND r.weight IS NOT NULL",
    "F8_case_buckets": "SELECT CASE WHEN is_seed THEN 'seed' WHEN week <= 5 THEN '1' WHEN week <= 10 THEN '2' ELSE '3+' END AS bucket, count(*) AS n FROM {cascade} GROUP BY 1",
    "F9_seed_eligible": "SELECT firm_id FROM {degrees} WHERE out_degree > 0 AND degree > 0",
    "F10_percentile_threshold": "SELECT d.firm_id, d.degree FROM {degrees} d CROSS JOIN (SELECT @pct(degree, 0.9) AS p FROM {degrees} WHERE degree > 0) t WHERE d.degree > t.p",
    "F11_degree_one": "SELECT firm_id FROM {degrees} WHERE degree = 1",
    "F12_prune_empty_portfolio": """WITH gone AS (SELECT d.firm_id FROM {degrees} d LEFT ANTI JOIN (SELECT a.firm_id FROM {capabilities} a JOIN {firms} f ON a.firm_id = f.firm_id AND f.capital >= 0) c ON d.firm_id = c.firm_id WHERE d.out_degree > 0)
        SELECT r.src, r.dst, r.weight FROM {relations} r LEFT ANTI JOIN gone g ON r.src = g.firm_id LEFT ANTI JOIN gone h ON r.dst = h.firm_id""",
    "F13_prune_isolates": """WITH gone AS (SELECT d.firm_id FROM {degrees} d JOIN {firms} f ON d.firm_id = f.firm_id AND f.capital < 0 WHERE d.out_degree > 0),
        left_edges AS (SELECT r.src, r.dst FROM {relations} r LEFT ANTI JOIN gone g ON r.src = g.firm_id LEFT ANTI JOIN gone h ON r.dst = h.firm_id),
        touched AS (SELECT src AS firm_id FROM left_edges UNION SELECT dst FROM left_edges)
        SELECT f.firm_id FROM {firms} f LEFT ANTI JOIN gone g ON f.firm_id = g.firm_id WHERE f.firm_id IN (SELECT firm_id FROM touched) OR f.firm_id IN (SELECT firm_id FROM {capabilities})""",
    "F14_config_filter": "SELECT run_id, scenario, num_seeds FROM {runs} WHERE scenario IN (0, 2) OR (num_seeds = 5 AND sample_id = 0)",
    "F16_name_chain": "SELECT n_nationkey AS nation_id, regexp_replace(trim(replace(replace(replace(n_name || ' CO., LTD.', ' CO.', ''), ' LTD.', ''), 'UNITED', 'U')), ',+$', '') AS label FROM {nation}",
    # Joins.
    "J1_left_dimension": "SELECT c.firm_id, c.product, p.group_name FROM {capabilities} c LEFT JOIN {products} p ON c.product = p.product AND NOT p.special",
    "J2_inner_details": "SELECT r.src, r.dst, d.product, d.model, d.model_year FROM {relations} r JOIN {details} d ON r.src = d.src AND r.dst = d.dst WHERE r.annotated",
    "J3_firm_nation": "SELECT f.firm_id, n.nation_name, n.region_id FROM {firms} f LEFT JOIN {nations} n ON f.nation_id = n.nation_id AND n.region_id <> 4",
    # Firms in debt report no standard products, as in the loaded network.
    "J4_special_only": "SELECT DISTINCT c.firm_id FROM {capabilities} c JOIN {products} p ON c.product = p.product AND p.special LEFT ANTI JOIN (SELECT x.firm_id FROM {capabilities} x JOIN {products} y ON x.product = y.product JOIN {firms} f ON x.firm_id = f.firm_id WHERE NOT y.special AND f.capital >= 0) o ON c.firm_id = o.firm_id",
    "J5_collision_suffix": """SELECT a.firm_id, coalesce(a.n, 0) AS products, coalesce(b.n, 0) AS products_special FROM (SELECT firm_id, count(*) AS n FROM {capabilities} GROUP BY firm_id) a
        LEFT JOIN (SELECT c.firm_id, count(*) AS n FROM {capabilities} c JOIN {products} p ON c.product = p.product WHERE p.special GROUP BY c.firm_id) b ON a.firm_id = b.firm_id""",
    "J6_attributes_on_edges": "SELECT r.src, r.dst, s.degree AS src_degree, t.degree AS dst_degree FROM {relations} r JOIN {degrees} s ON r.src = s.firm_id JOIN {degrees} t ON r.dst = t.firm_id",
    "J7_semi_join": "SELECT f.firm_id FROM {firms} f LEFT SEMI JOIN {relations} r ON f.firm_id = r.src",
    "J12_paired_tasks": "SELECT a.task_id, a.weeks AS weeks_a, b.weeks AS weeks_b, a.weeks - b.weeks AS diff FROM {runs} a JOIN {runs} b ON a.task_id = b.task_id AND a.arm = 0 AND b.arm = 1",
    "J13_supplier_pairs": "SELECT DISTINCT a.src AS u, b.src AS v FROM {details} a JOIN {details} b ON a.dst = b.dst AND a.product = b.product AND a.src <> b.src",
    "J14_edge_communities": "SELECT r.src, r.dst, a.community AS src_community, b.community AS dst_community FROM {relations} r JOIN {communities} a ON r.src = a.firm_id JOIN {communities} b ON r.dst = b.firm_id",
    "J15_exposed_links": """WITH seeds AS (SELECT DISTINCT run_id % 50 AS run_set, firm_id FROM {struck} WHERE seed = 1), weights AS (SELECT run_set, count(*) AS n FROM (SELECT DISTINCT run_id, run_id % 50 AS run_set FROM {struck}) z GROUP BY run_set)
        SELECT r.src, r.dst, CAST(sum(w.n) AS BIGINT) AS exposures FROM seeds s JOIN weights w ON s.run_set = w.run_set JOIN {relations} r ON s.firm_id = r.src LEFT ANTI JOIN seeds t ON s.run_set = t.run_set AND r.dst = t.firm_id GROUP BY r.src, r.dst""",
    "J16_grid": "SELECT a.scenario, b.num_seeds, c.sample_id FROM (SELECT DISTINCT scenario FROM {runs}) a CROSS JOIN (SELECT DISTINCT num_seeds FROM {runs}) b CROSS JOIN (SELECT DISTINCT sample_id FROM {runs}) c",
    # Aggregates.
    "A1_group_members": "SELECT c.firm_id, count(DISTINCT p.group_name) AS groups, count(DISTINCT p.family_name) AS families, min(p.group_name) AS first_group FROM {capabilities} c JOIN {products} p ON c.product = p.product GROUP BY c.firm_id",
    "A2_edge_products": "SELECT src, dst, product, count(*) AS amount, count(DISTINCT model) AS models FROM {details} GROUP BY src, dst, product",
    "A3_count_non_null": "SELECT d.firm_id, count(r.dst) AS links, count(*) AS all_rows FROM {degrees} d LEFT JOIN {relations} r ON d.firm_id = r.src GROUP BY d.firm_id",
    "A4_product_counts": "SELECT product, count(*) AS edges, count(DISTINCT amount) = 1 AS degenerate, min(amount) AS low, max(amount) AS high FROM {edge_products} GROUP BY product",
    "A5_distinct_counts": "SELECT count(DISTINCT src) AS suppliers, count(DISTINCT dst) AS customers, count(DISTINCT product) AS products FROM {details}",
    "A6_distinct_first": "SELECT src, dst, product FROM (SELECT src, dst, product, row_number() OVER (PARTITION BY src ORDER BY dst, product, model, model_year) AS k FROM {details}) x WHERE k = 1",
    "A7_means_by_nation": "SELECT nation_id, round(avg(degree), 6) AS degree, round(avg(in_weight), 6) AS in_weight, count(*) AS firms FROM {degrees} GROUP BY nation_id",
    "A8_weighted_degree": "SELECT d.firm_id, n.nation_name, d.in_degree, d.out_degree, CAST(d.in_weight + d.out_weight AS BIGINT) AS strength FROM {degrees} d LEFT JOIN {nations} n ON d.nation_id = n.nation_id WHERE d.degree > 0",
    "A9_describe": "SELECT min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(@pct(value, 0.25), 6) AS q25, round(@pct(value, 0.5), 6) AS q50, round(@pct(value, 0.75), 6) AS q75, round(@pct(value, 0.9), 6) AS p90, round(@pct(value, 0.95), 6) AS p95 FROM {run_series}",
    "A10_standard_error": "SELECT run_id, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(*)), 6) AS se FROM {run_series} GROUP BY run_id HAVING count(*) > 1",
    "A11_share": "SELECT arm, round(avg(CASE WHEN weeks > 66 THEN 1.0 ELSE 0.0 END), 6) AS share FROM {runs} GROUP BY arm",
    "A12_most_common": "SELECT nation_id, count(*) AS n FROM {firms} GROUP BY nation_id ORDER BY n DESC, nation_id LIMIT 5",
    "A13_arg_max": "SELECT run_id, week, value FROM (SELECT run_id, week, value, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, week) AS k FROM {run_series}) x WHERE k = 1",
    "A14_ratio_of_sums": "SELECT r.scenario, round(sum(s.value) / sum(r.weeks), 6) AS ratio FROM {run_series} s JOIN {runs} r ON s.run_id = r.run_id GROUP BY r.scenario",
    "A15_frequency_by_scenario": """SELECT c.size, round(sum(CASE WHEN r.scenario = 0 THEN 1.0 ELSE 0.0 END) / max(t.n0), 6) AS p0, round(sum(CASE WHEN r.scenario = 1 THEN 1.0 ELSE 0.0 END) / max(t.n1), 6) AS p1
        FROM {cascade} c JOIN {runs} r ON c.run_id = r.run_id CROSS JOIN (SELECT sum(CASE WHEN scenario = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN scenario = 1 THEN 1 ELSE 0 END) AS n1 FROM {runs}) t GROUP BY c.size""",
    "A16_sum_by_key": "SELECT dst, CAST(sum(weight) AS BIGINT) AS weight FROM {relations} GROUP BY dst",
    "A17_mean_curve": "SELECT r.scenario, s.week, count(*) AS n, round(avg(s.value), 6) AS mean, round(avg(s.value) - 1.96 * stddev_pop(s.value) / sqrt(count(*)), 6) AS low, round(avg(s.value) + 1.96 * stddev_pop(s.value) / sqrt(count(*)), 6) AS high FROM {run_series} s JOIN {runs} r ON s.run_id = r.run_id GROUP BY r.scenario, s.week",
    "A18_modularity": """WITH e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM {relations}), m AS (SELECT count(*) AS m FROM e),
        inside AS (SELECT a.community, count(*) AS l FROM e JOIN {membership} a ON e.u = a.firm_id JOIN {membership} b ON e.v = b.firm_id AND a.community = b.community GROUP BY a.community),
        deg AS (SELECT community, count(*) AS d FROM (SELECT u AS x FROM e UNION ALL SELECT v FROM e) k JOIN {membership} c ON k.x = c.firm_id GROUP BY community)
        SELECT round(sum(coalesce(i.l, 0) / (1.0 * m.m) - (d.d / (2.0 * m.m)) * (d.d / (2.0 * m.m))), 9) AS q FROM deg d LEFT JOIN inside i ON d.community = i.community CROSS JOIN m""",
    "A19_degree_correlation": "SELECT round(corr(s.out_degree, t.out_degree), 6) AS out_out, round(corr(s.out_degree, t.in_degree), 6) AS out_in, round(corr(s.in_degree, t.out_degree), 6) AS in_out, round(corr(s.in_degree, t.in_degree), 6) AS in_in FROM {relations} r JOIN {degrees} s ON r.src = s.firm_id JOIN {degrees} t ON r.dst = t.firm_id",
    # Windows.
    "W1_ccdf": "SELECT degree, CAST(sum(n) OVER (ORDER BY degree DESC) AS BIGINT) AS at_least, round(sum(n) OVER (ORDER BY degree DESC) / (1.0 * sum(n) OVER ()), 9) AS ccdf FROM (SELECT degree, count(*) AS n FROM {degrees} WHERE degree > 0 GROUP BY degree) x",
    "W2_ecdf": "SELECT degree, round(sum(n) OVER (ORDER BY degree) / (1.0 * sum(n) OVER ()), 9) AS ecdf FROM (SELECT degree, count(*) AS n FROM {degrees} WHERE degree > 0 GROUP BY degree) x",
    "W3_diff_prepend": "SELECT run_id, week, round(c - coalesce(lag(c) OVER (PARTITION BY run_id ORDER BY week), 0), 6) AS d FROM {capacity}",
    "W4_diff": "SELECT run_id, week, round(c - lag(c) OVER (PARTITION BY run_id ORDER BY week), 6) AS d FROM {capacity}",
    "W5_first_index": "SELECT run_id, coalesce(min(CASE WHEN removed >= 3 THEN week END), 0) AS t FROM {capacity} GROUP BY run_id",
    "W6_arg_min_first": "SELECT run_id, week AS t_min FROM (SELECT run_id, week, row_number() OVER (PARTITION BY run_id ORDER BY c, week) AS k FROM {capacity}) x WHERE k = 1",
    "W7_window_sums": "SELECT s.run_id, w.a, round(sum(s.value), 4) AS total FROM {run_series} s JOIN (SELECT 2 AS a, 6 AS b UNION ALL SELECT 6, 10 UNION ALL SELECT 10, 16 UNION ALL SELECT 16, 25 UNION ALL SELECT 25, 53) w ON s.week >= w.a AND s.week < w.b GROUP BY s.run_id, w.a",
    "W8_progress": "SELECT run_id, week, round(CASE WHEN x = y THEN 0 ELSE least(greatest((x - c) / (x - y), 0), 1) END, 6) AS progress FROM (SELECT run_id, week, c, first_value(c) OVER (PARTITION BY run_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x, last_value(c) OVER (PARTITION BY run_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y FROM {capacity}) z",
    "W9_average_ranks": "SELECT d.firm_id, g.r FROM {degrees} d JOIN (SELECT degree, sum(n) OVER (ORDER BY degree) - (n - 1) / 2.0 AS r FROM (SELECT degree, count(*) AS n FROM {degrees} WHERE degree > 0 GROUP BY degree) x) g ON d.degree = g.degree",
    "W10_quartile_bins": "SELECT bin, count(*) AS n FROM (SELECT CASE WHEN value >= q3 THEN 3 WHEN value >= q2 THEN 2 WHEN value >= q1 THEN 1 ELSE 0 END AS bin FROM {run_series} CROSS JOIN (SELECT @pct(value, 0.25) AS q1, @pct(value, 0.5) AS q2, @pct(value, 0.75) AS q3 FROM {run_series}) t) x GROUP BY bin",
    # Ranks.
    "T1_sort": "SELECT firm_id, degree FROM {degrees} ORDER BY degree DESC, firm_id LIMIT 100",
    "T3_global_arg_max": "SELECT run_id, weeks, num_seeds FROM {runs} ORDER BY weeks DESC, num_seeds DESC, run_id LIMIT 1",
    "T5_top_overlap": "SELECT count(*) / 50.0 AS overlap FROM (SELECT firm_id FROM {degrees} ORDER BY in_degree DESC, firm_id LIMIT 50) a JOIN (SELECT firm_id FROM {degrees} ORDER BY in_weight DESC, firm_id LIMIT 50) b ON a.firm_id = b.firm_id",
    # Set operations and reshaping.
    "U1_union_distinct": "SELECT src AS firm_id FROM {relations} UNION SELECT dst FROM {relations}",
    "U2_intersection": "SELECT task_id FROM {runs} WHERE arm = 0 INTERSECT SELECT task_id FROM {runs} WHERE arm = 1",
    "U3_difference": "SELECT dst AS firm_id FROM {relations} EXCEPT SELECT src FROM {relations}",
    "U4_portfolio_union": "SELECT firm_id, count(*) AS products FROM (SELECT firm_id, product FROM {capabilities} UNION SELECT src, product FROM {edge_products}) x GROUP BY firm_id",
    "M1_unpivot": "SELECT firm_id, metric, CASE metric WHEN 'in' THEN in_degree WHEN 'out' THEN out_degree ELSE degree END AS value FROM {degrees} CROSS JOIN (SELECT 'in' AS metric UNION ALL SELECT 'out' UNION ALL SELECT 'all') m WHERE degree > 0",
    # Graph tables that need no iteration.
    "G1_digraph": "SELECT src, dst, product AS last_product FROM (SELECT src, dst, product, row_number() OVER (PARTITION BY src, dst ORDER BY model_year DESC, product DESC, model DESC) AS k FROM {details}) x WHERE k = 1",
    "G2_undirected": "SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM {relations} WHERE src <> dst",
    "G3_isolates": "SELECT count(*) AS isolates FROM {degrees} WHERE degree = 0",
    "G18_local_clustering": """WITH n AS (SELECT u, v FROM {neighbours} WHERE u <> v), d AS (SELECT u, count(*) AS k FROM n GROUP BY u),
        t AS (SELECT a.u, count(*) AS pairs FROM n a JOIN n b ON a.u = b.u AND a.v < b.v JOIN n c ON a.v = c.u AND b.v = c.v GROUP BY a.u)
        SELECT d.u AS firm_id, round(CASE WHEN d.k < 2 THEN 0 ELSE 2.0 * coalesce(t.pairs, 0) / (d.k * (d.k - 1)) END, 9) AS c FROM d LEFT JOIN t ON d.u = t.u""",
    "G18_transitivity": """WITH n AS (SELECT u, v FROM {neighbours} WHERE u <> v), w AS (SELECT sum(k * (k - 1) / 2.0) AS wedges FROM (SELECT u, count(*) AS k FROM n GROUP BY u) d),
        t AS (SELECT count(*) AS closed FROM n a JOIN n b ON a.u = b.u AND a.v < b.v JOIN n c ON a.v = c.u AND b.v = c.v) SELECT round(t.closed / w.wedges, 9) AS transitivity FROM t CROSS JOIN w""",
    "G19_triangles": """WITH e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM {relations} WHERE src <> dst),
        t AS (SELECT a.u AS x, a.v AS y, b.v AS z FROM e a JOIN e b ON a.v = b.u JOIN e c ON a.u = c.u AND b.v = c.v)
        SELECT firm_id, count(*) AS triangles FROM (SELECT x AS firm_id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) k GROUP BY firm_id ORDER BY triangles DESC, firm_id LIMIT 20""",
    "G17_directed_clustering": """WITH a AS (SELECT src AS i, dst AS j FROM {relations} WHERE src <> dst), s AS (SELECT i, j, count(*) AS w FROM (SELECT i, j FROM a UNION ALL SELECT j, i FROM a) z GROUP BY i, j),
        cube AS (SELECT x.i, sum(x.w * y.w * z.w) AS t FROM s x JOIN s y ON x.j = y.i JOIN s z ON y.j = z.i AND z.j = x.i GROUP BY x.i),
        d AS (SELECT i, sum(w) AS tot, sum(CASE WHEN w = 2 THEN 1 ELSE 0 END) AS mutual FROM s GROUP BY i)
        SELECT d.i AS firm_id, round(CASE WHEN coalesce(c.t, 0) = 0 THEN 0 ELSE (c.t / 2.0) / (d.tot * (d.tot - 1) - 2 * d.mutual) END, 9) AS c FROM d LEFT JOIN cube c ON d.i = c.i""",
    "G23_tier_modularity": """WITH e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM {relations}), p AS (SELECT firm_id, CASE WHEN is_oem THEN 0 ELSE 1 + firm_id % 5 END AS c FROM {firms}), m AS (SELECT count(*) AS m FROM e),
        i AS (SELECT a.c, count(*) AS l FROM e JOIN p a ON e.u = a.firm_id JOIN p b ON e.v = b.firm_id AND a.c = b.c GROUP BY a.c), d AS (SELECT c, count(*) AS d FROM (SELECT u AS x FROM e UNION ALL SELECT v FROM e) k JOIN p ON k.x = p.firm_id GROUP BY c)
        SELECT round(sum(coalesce(i.l, 0) / (1.0 * m.m) - (d.d / (2.0 * m.m)) * (d.d / (2.0 * m.m))), 9) AS q FROM d LEFT JOIN i ON d.c = i.c CROSS JOIN m""",
    "G24_participation": """SELECT u AS firm_id, round(1 - sum(share * share), 9) AS participation FROM (SELECT n.u, c.community, count(*) / (1.0 * sum(count(*)) OVER (PARTITION BY n.u)) AS share FROM {neighbours} n JOIN {communities} c ON n.v = c.firm_id GROUP BY n.u, c.community) x GROUP BY u""",
    "G22_quality": """WITH e AS (SELECT DISTINCT least(r.src, r.dst) AS u, greatest(r.src, r.dst) AS v FROM {relations} r JOIN {communities} c ON r.src = c.firm_id), m AS (SELECT count(*) AS m FROM e),
        i AS (SELECT a.community, count(*) AS l FROM e JOIN {communities} a ON e.u = a.firm_id JOIN {communities} b ON e.v = b.firm_id AND a.community = b.community GROUP BY a.community),
        d AS (SELECT c.community, count(*) AS d FROM (SELECT u AS x FROM e UNION ALL SELECT v FROM e) k JOIN {communities} c ON k.x = c.firm_id GROUP BY c.community)
        SELECT count(*) AS communities, round(sum(coalesce(i.l, 0) / (1.0 * m.m) - (d.d / (2.0 * m.m)) * (d.d / (2.0 * m.m))), 9) AS q FROM d LEFT JOIN i ON d.community = i.community CROSS JOIN m""",
    # The five largest communities, links among them, and the partner with which each shares most.
    "G25_community_edges": """WITH z AS (SELECT community, count(*) AS n FROM {communities} GROUP BY community), top AS (SELECT community FROM z ORDER BY n DESC, community LIMIT 5), m AS (SELECT c.firm_id, c.community FROM {communities} c JOIN top ON c.community = top.community),
        e AS (SELECT a.community AS x, b.community AS y FROM {relations} r JOIN m a ON r.src = a.firm_id JOIN m b ON r.dst = b.firm_id),
        p AS (SELECT least(x, y) AS x, greatest(x, y) AS y, count(*) AS n FROM e GROUP BY least(x, y), greatest(x, y)), o AS (SELECT x, y, n FROM p WHERE x <> y UNION ALL SELECT y, x, n FROM p WHERE x <> y)
        SELECT x AS community, inside, CAST(outside AS BIGINT) AS outside, round(outside / (1.0 * (inside + outside)), 9) AS outside_share, y AS partner, n FROM (SELECT o.x, o.y, o.n, coalesce(i.n, 0) AS inside, sum(o.n) OVER (PARTITION BY o.x) AS outside, row_number() OVER (PARTITION BY o.x ORDER BY o.n DESC, o.y) AS k FROM o LEFT JOIN p i ON i.x = o.x AND i.y = o.x) w WHERE k = 1""",
    "G28_group_sizes": "SELECT n AS size, count(*) AS groups FROM (SELECT nation_id, is_oem, count(*) AS n FROM {firms} GROUP BY nation_id, is_oem) x GROUP BY n",
    "G29_delivered_products": "SELECT src AS firm_id, count(DISTINCT product) AS products FROM {edge_products} GROUP BY src",
    "G30_partners": "SELECT u AS firm_id, count(*) AS partners FROM {neighbours} GROUP BY u",
    # Inventories.
    "C45_inventory": """SELECT (SELECT count(*) FROM {firms}) AS firms, (SELECT count(*) FROM {firms} WHERE is_oem) AS oems, (SELECT count(DISTINCT firm_id) FROM {capabilities}) AS with_products,
        (SELECT count(*) FROM {degrees} WHERE degree = 0) AS isolates, (SELECT count(*) FROM {relations}) AS edges, (SELECT count(*) FROM {relations} WHERE annotated) AS annotated""",
    "C46_products_per_firm": "SELECT products, CAST(sum(n) OVER (ORDER BY products DESC) AS BIGINT) AS at_least FROM (SELECT products, count(*) AS n FROM (SELECT firm_id, count(*) AS products FROM {capabilities} GROUP BY firm_id) a GROUP BY products) b",
    "C47_product_correlations": "SELECT round(corr(p.n, d.degree), 6) AS r_degree, round(corr(p.n, d.out_degree), 6) AS r_out FROM (SELECT firm_id, count(*) AS n FROM {capabilities} GROUP BY firm_id) p JOIN {degrees} d ON p.firm_id = d.firm_id",
}
#: Plans over the whole network; the others walk, close triangles or pair firms and read the thin one.
WHOLE = """
    F2_comparison F3_nulls F5_derived_columns F7_complete_cases F9_seed_eligible F10_percentile_threshold
    F12_prune_empty_portfolio F13_prune_isolates J2_inner_details J6_attributes_on_edges J7_semi_join J13_supplier_pairs A2_edge_products
    A3_count_non_null A4_product_counts A5_distinct_counts A6_distinct_first A7_means_by_nation A8_weighted_degree A16_sum_by_key A18_modularity
    W1_ccdf W2_ecdf W9_average_ranks T1_sort T5_top_overlap U1_union_distinct U3_difference U4_portfolio_union M1_unpivot
    G1_digraph G2_undirected G23_tier_modularity G29_delivered_products G30_partners C45_inventory C47_product_correlations
""".split()
SQL |= {name: whole(SQL[name]) for name in WHOLE}
