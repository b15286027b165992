"""Queries over the supply graph, and recursive SQL for the other engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import u01
from ..operators import graph, null_models, paths, similarity
from ..operators.iterate import cut
from ..sources.adapter import Network, whole

#: Rounds that the other engine's SQL spells out; it takes the first that moved less than TOLERANCE a node.
UNROLLED, TOLERANCE = 60, 1e-6


def _edges(n: Network, of: str = "relations") -> DataFrame:
    """Edges of the thin network, or of another one, computed once."""
    return cut(n[of].select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))


def _firms(n: Network) -> DataFrame:
    return n["firms"].select(F.col("firm_id").cast("long").alias("node"))


def _linked(n: Network) -> DataFrame:
    return graph.nodes_of(graph.plain(_edges(n)))


def weak(n: Network) -> DataFrame:
    return graph.weak_components(_edges(n)).withColumnRenamed("node", "firm_id")


def strong(n: Network) -> DataFrame:
    return graph.strong_components(_edges(n)).withColumnRenamed("node", "firm_id")


def tier(n: Network) -> DataFrame:
    return graph.tiers(_edges(n), _firms(n)).select(F.col("node").alias("firm_id"), F.col("tier").cast("long").alias("tier"))


def median_tier(n: Network) -> DataFrame:
    return graph.median_tiers(_edges(n), _firms(n)).select(F.col("node").alias("firm_id"), F.col("tier").cast("long").alias("tier"))


def descendants(n: Network) -> DataFrame:
    back = _edges(n).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.distance_counts(back).groupBy(F.col("node").alias("firm_id")).agg(F.sum("n").alias("descendants"))


def bow(n: Network) -> DataFrame:
    return graph.bow_tie(_edges(n)).withColumnRenamed("node", "firm_id")


def _lengths(counts: DataFrame) -> DataFrame:
    """Pairs, mean, median and deviation of lengths d that occur n times."""
    of = counts.groupBy("d").agg(F.sum("n").alias("n"))
    pairs, s, s2 = F.sum("n"), F.sum(F.col("d") * F.col("n")), F.sum(F.col("d") * F.col("d") * F.col("n"))
    mean = s / pairs
    return of.agg(F.coalesce(pairs, F.lit(0).cast("long")).alias("pairs"), F.round(mean, 6).alias("mean"), F.expr("percentile(d, 0.5, n)").alias("median"), F.round(F.sqrt(F.greatest(s2 / pairs - mean * mean, F.lit(0.0))), 6).alias("sd"))


def path_lengths(n: Network) -> DataFrame:
    """Lengths of paths of the whole network."""
    return _lengths(graph.distance_counts(_edges(n, "all_relations")))


def sampled_lengths(n: Network) -> DataFrame:
    """Lengths of paths of the whole network's undirected largest component, from all of its nodes."""
    return _lengths(graph.distance_counts(graph.undirected(graph.largest_component(_edges(n, "all_relations")))))


def reach_sketch(n: Network) -> DataFrame:
    """Estimated number of firms downstream, and mean distance to them."""
    r = paths.reach_sketches(_edges(n))
    return r.select(F.col("node").alias("firm_id"), "reached", F.when(F.col("reached") > 0, F.col("total") / F.col("reached")).alias("mean_distance"))


def close_sketch(n: Network) -> DataFrame:
    return paths.closeness_sketch(_edges(n), _linked(n)).withColumnRenamed("node", "firm_id")


def diameter(n: Network) -> DataFrame:
    d = paths.diameter(graph.largest_component(_edges(n)))
    return n.spark.createDataFrame([(d,)], "diameter long")


def rank(n: Network) -> DataFrame:
    return graph.pagerank(_edges(n), _linked(n), tolerance=TOLERANCE).select(F.col("node").alias("firm_id"), F.round("rank", 9).alias("rank"))


def eigen(n: Network) -> DataFrame:
    return graph.eigenvector(_edges(n), _linked(n), tolerance=TOLERANCE).select(F.col("node").alias("firm_id"), F.round("score", 9).alias("score"))


def close(n: Network) -> DataFrame:
    return graph.closeness(_edges(n), _linked(n)).select(F.col("node").alias("firm_id"), F.round("closeness", 9).alias("closeness"))


def between(n: Network) -> DataFrame:
    return paths.betweenness(_edges(n), _linked(n)).select(F.col("node").alias("firm_id"), F.round("betweenness", 9).alias("betweenness"))


def edge_between(n: Network) -> DataFrame:
    e = _edges(n, "all_relations")
    return paths.edge_betweenness(e, graph.nodes_of(graph.plain(e))).select("src", "dst", F.round("betweenness", 9).alias("betweenness"))


def cores(n: Network) -> DataFrame:
    return graph.core_numbers(_edges(n, "all_relations")).select(F.col("node").alias("firm_id"), F.col("core").cast("long").alias("core"))


def cyclicity(n: Network) -> DataFrame:
    found = graph.strong_components(_edges(n)).groupBy("component").agg(F.count("*").alias("n"))
    return found.agg(F.count("*").alias("components"), F.sum("n").alias("nodes"), F.max("n").alias("largest"))


def null_model(n: Network) -> DataFrame:
    copies = null_models.directed_copies(_edges(n), u01, 3)
    return copies.groupBy(F.col("copy").alias("copy")).agg(F.count("*").alias("edges"))


def chance(n: Network) -> DataFrame:
    """Clustering of the largest component against 50 directed and 30 undirected null graphs."""
    c = null_models.clustering_against_chance(graph.largest_component(_edges(n, "all_relations")), u01)
    return c.select("measure", *[F.round(x, 6).alias(x) for x in ("observed", "null_mean", "null_sd", "ratio", "z")], "copies")


def small_world(n: Network) -> DataFrame:
    """L from 1,000 sampled sources, ln N / ln k, their ratio, and sigma = (C / C_null) / ratio by either clustering."""
    inside = cut(graph.largest_component(_edges(n)))
    e = cut(graph.undirected(inside))
    size = e.agg(F.count("*").alias("m"), F.countDistinct("src").alias("n"))
    length = graph.distance_counts(e, graph.sampled_nodes(e, u01, 1000)).agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("l"))
    of = lambda m: F.max(F.when(F.col("measure") == m, F.col("ratio"))).alias(m)
    c = null_models.clustering_against_chance(inside, u01).agg(of("directed"), of("undirected"))
    random = F.log(F.col("n")) / F.log(F.col("m") / F.col("n"))
    one = size.crossJoin(length).crossJoin(c).withColumn("l_random", random).withColumn("ratio", F.col("l") / F.col("l_random"))  # rows of one
    return one.select(*[F.round(x, 6).alias(x) for x in ("l", "l_random", "ratio")], F.round(F.col("directed") / F.col("ratio"), 6).alias("sigma_directed"), F.round(F.col("undirected") / F.col("ratio"), 6).alias("sigma_undirected"))


def louvain(n: Network) -> DataFrame:
    """Louvain communities of the largest component, of the level with the greatest modularity."""
    return n["communities"].select("firm_id", "community")


def depth(n: Network) -> DataFrame:
    """Propagation depth: 0 for seeds, 1 + the least depth of an origin that was removed too, 1 without any."""
    firms = cut(n["cascade"].select("run_id", "firm", "is_seed"))
    valid = cut(n["origins"].select("run_id", "firm", "origin").distinct().join(firms.select("run_id", F.col("firm").alias("origin")), ["run_id", "origin"], "left_semi"))
    orphan = firms.where("not is_seed").join(valid, ["run_id", "firm"], "left_anti")
    orphan = cut(orphan.select("run_id", "firm"))
    last = cut(firms.where("is_seed").select("run_id", "firm"))
    seen, frames, k = last, [last.withColumn("depth", F.lit(0))], 0
    while k == 0 or not last.isEmpty():
        k += 1
        down = valid.join(last.select("run_id", F.col("firm").alias("origin")), ["run_id", "origin"]).select("run_id", "firm")
        down = down.union(orphan) if k == 1 else down
        last = cut(down.distinct().join(seen, ["run_id", "firm"], "left_anti"))
        seen = cut(seen.union(last))
        frames.append(last.withColumn("depth", F.lit(k)))
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.select("run_id", "firm", F.col("depth").cast("long").alias("depth"))


def depth_stats(n: Network) -> DataFrame:
    of = depth(n).groupBy("run_id").agg(F.max("depth").alias("d")).join(n["runs"].select("run_id", "num_seeds"), "run_id")
    return of.groupBy("num_seeds").agg(F.round(F.avg("d"), 6).alias("mean"), F.max("d").alias("most"), F.round(F.avg((F.col("d") >= 2).cast("double")), 6).alias("share_2"))


def depth_sizes(n: Network) -> DataFrame:
    of = depth(n).join(n["cascade"].select("run_id", "firm", "size"), ["run_id", "firm"])
    bucket = F.when(F.col("depth") == 0, "seed").when(F.col("depth") == 1, "1").when(F.col("depth") == 2, "2").otherwise("3+")
    return of.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("size"), 6).alias("mean"), F.round(F.avg((F.col("size") >= 17).cast("double")), 6).alias("large"))


def attribution(n: Network) -> DataFrame:
    """Mass of each removal, pushed to its valid origins in equal shares (repeated entries count) until seeds hold all."""
    firms = cut(n["cascade"].select("run_id", "firm", "is_seed"))
    valid = n["origins"].select("run_id", "firm", "origin").join(firms.select("run_id", F.col("firm").alias("origin")), ["run_id", "origin"], "left_semi")
    share = valid.groupBy("run_id", "firm").agg(F.count("*").alias("k"))
    pushed = cut(valid.join(share, ["run_id", "firm"]).select("run_id", "firm", "origin", (1.0 / F.col("k")).alias("p")))
    seeds = cut(firms.where("is_seed").select("run_id", "firm"))
    count = seeds.groupBy("run_id").agg(F.count("*").alias("s"))
    movable = pushed.select("run_id", "firm").distinct()
    mass, held = firms.where("not is_seed").select("run_id", "firm", F.lit(1.0).alias("mass")), []
    while True:
        stuck = mass.join(movable, ["run_id", "firm"], "left_anti").groupBy("run_id").agg(F.sum("mass").alias("m"))
        held.append(stuck.join(count, "run_id").join(seeds, "run_id").select("run_id", "firm", (F.col("m") / F.col("s")).alias("mass")))
        moved = cut(mass.join(pushed, ["run_id", "firm"]).groupBy("run_id", F.col("origin").alias("firm")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass")))
        if moved.isEmpty():
            break
        held.append(moved.join(seeds, ["run_id", "firm"], "left_semi"))
        mass = moved.join(seeds, ["run_id", "firm"], "left_anti")
    out = held[0]
    for f in held[1:]:
        out = out.unionByName(f)
    return out.groupBy("run_id", "firm").agg(F.round(F.sum("mass"), 6).alias("mass"))


def _probabilities(n: Network) -> DataFrame:
    """src, dst, p: a link's share of its customer's inbound volume, halved."""
    total = n["relations"].groupBy("dst").agg(F.sum("weight").alias("w"))
    return cut(n["relations"].join(total, "dst").select("src", "dst", (F.col("weight") / F.col("w") / 2).alias("p")))


def exposure(n: Network, rounds: int = 3) -> DataFrame:
    """R <- P (1 + R), rounds times, from 0."""
    p, r = _probabilities(n), None
    for _ in range(rounds):
        one = p.withColumn("r", F.lit(0.0)) if r is None else p.join(r.withColumnRenamed("src", "dst"), "dst", "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
        r = cut(one.groupBy("src").agg(F.sum(F.col("p") * (1 + F.col("r"))).alias("r")))
    return r.select(F.col("src").alias("firm_id"), F.round("r", 9).alias("exposure"))


def reach(n: Network, rounds: int = 3) -> DataFrame:
    """q <- 1 - (1 - pi) x product of (1 - q p) over suppliers, from run records: pi is a firm's share of runs that seed it.

    removed: the share of the other runs in which the firm is removed, which q is to foretell.
    """
    p, runs = _probabilities(n), cut(n["struck"])
    total = runs.select("run_id").distinct().count()
    seen = runs.groupBy(F.col("firm_id").alias("node")).agg(F.sum("seed").alias("seeds"), F.count("*").alias("struck"))
    seeds, struck = F.coalesce("seeds", F.lit(0)), F.coalesce("struck", F.lit(0))
    firms = cut(graph.nodes_of(p).join(seen, "node", "left").select("node", (seeds / total).alias("pi"), F.when(seeds < total, (struck - seeds) / (total - seeds)).alias("removed")))
    q = firms.select("node", F.col("pi").alias("q"))
    for _ in range(rounds):
        log = p.join(q, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.log1p(-F.col("q") * F.col("p"))).alias("l"))
        q = cut(firms.join(log, F.col("node") == F.col("dst"), "left").select("node", (1 - (1 - F.col("pi")) * F.exp(F.coalesce("l", F.lit(0.0)))).alias("q"), "removed"))
    return q.select(F.col("node").alias("firm_id"), F.round("q", 9).alias("reach"), F.round("removed", 9).alias("removed"))


def sigma(n: Network) -> DataFrame:
    return similarity.all_pairs(n["embeddings"], 0.3)


def tau_sweep(n: Network) -> DataFrame:
    return similarity.pair_counts(n["embeddings"], [0.2, 0.25, 0.3, 0.35, 0.4]).withColumnRenamed("floor", "tau")


def top_edge_product(n: Network) -> DataFrame:
    """Vectors with even ids stand for products on edges, the others for the vocabulary."""
    v = n["embeddings"]
    return similarity.best_match(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"))


QUERIES: dict[str, Callable[[Network], DataFrame]] = {
    "G4_weak_components": weak,
    "G5_strong_components": strong,
    "G6_tiers": tier,
    "G7_median_tiers": median_tier,
    "G8_descendants": descendants,
    "G9_bow_tie": bow,
    "G10_path_lengths": path_lengths,
    "G8_reach_sketch": reach_sketch,
    "G10_sampled_lengths": sampled_lengths,
    "G14_closeness_sketch": close_sketch,
    "G11_diameter": diameter,
    "G12_pagerank": rank,
    "G13_eigenvector": eigen,
    "G14_closeness": close,
    "G15_betweenness": between,
    "G16_edge_betweenness": edge_between,
    "G20_configuration_model": null_model,
    "G20_clustering_null": chance,
    "G21_small_world": small_world,
    "G22_communities": louvain,
    "G26_core_numbers": cores,
    "G27_cyclicity": cyclicity,
    "C26_depth": depth,
    "C27_depth_stats": depth_stats,
    "C28_depth_sizes": depth_sizes,
    "C29_attribution": attribution,
    "C42_exposure": exposure,
    "C44_reach": reach,
    "J8_similarity_join": sigma,
    "C1_substitution_map": sigma,
    "C3_threshold_sweep": tau_sweep,
    "T4_top_in_class": top_edge_product,
    "C2_top_edge_product": top_edge_product,
}

# Recursive SQL: paths are bounded by DEEP steps, more than any here has.
DEEP = 24
_E = "e AS (SELECT DISTINCT src, dst FROM {relations} WHERE src <> dst), nodes AS (SELECT src AS x FROM e UNION SELECT dst FROM e)"
_WALK = "walk AS (SELECT src AS s, dst AS x, 1 AS d FROM e UNION SELECT w.s, e.dst, w.d + 1 FROM walk w JOIN e ON w.x = e.src WHERE w.d < %d)" % DEEP
_DIST = "dist AS (SELECT s, x, min(d) AS d FROM walk WHERE s <> x GROUP BY s, x)"
_BOTH = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), lab AS (SELECT src AS s, src AS x FROM b UNION SELECT l.s, b.dst FROM lab l JOIN b ON l.x = b.src), comp AS (SELECT s, min(x) AS c FROM lab GROUP BY s)"
_MUTUAL = "scc AS (SELECT n.x AS s, greatest(n.x, coalesce(max(a.x), n.x)) AS c FROM nodes n LEFT JOIN (SELECT a.s, a.x FROM dist a JOIN dist b ON a.s = b.x AND a.x = b.s) a ON n.x = a.s GROUP BY n.x)"
_SIMILAR = "all_pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS score FROM {embeddings} x CROSS JOIN {embeddings} y)"
_DEPTH = """valid AS (SELECT DISTINCT o.run_id, o.firm, o.origin FROM {origins} o JOIN {cascade} c ON o.run_id = c.run_id AND o.origin = c.firm),
        deep AS (SELECT c.run_id, c.firm, CASE WHEN c.is_seed THEN 0 ELSE 1 END AS d FROM {cascade} c LEFT JOIN (SELECT DISTINCT run_id, firm FROM valid) v ON c.run_id = v.run_id AND c.firm = v.firm WHERE c.is_seed OR v.firm IS NULL
            UNION SELECT v.run_id, v.firm, p.d + 1 FROM deep p JOIN valid v ON p.run_id = v.run_id AND p.firm = v.origin),
        depths AS (SELECT run_id, firm, CAST(min(d) AS BIGINT) AS depth FROM deep GROUP BY run_id, firm)"""
_P = "p AS (SELECT r.src, r.dst, r.weight / (1.0 * t.w) / 2.0 AS p FROM {relations} r JOIN (SELECT dst, sum(weight) AS w FROM {relations} GROUP BY dst) t ON r.dst = t.dst)"


def _pagerank_sql() -> str:
    steps = ["k AS (SELECT src, count(*) AS k FROM e GROUP BY src)", "n AS (SELECT count(*) AS n FROM nodes)", "r0 AS (SELECT x, 1.0 / n.n AS r FROM nodes CROSS JOIN n)"]
    for i in range(UNROLLED):
        steps.append(f"d{i} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS d FROM r{i} LEFT JOIN k ON x = src WHERE src IS NULL)")
        steps.append(f"f{i} AS MATERIALIZED (SELECT e.dst, sum(r.r / k.k) AS f FROM e JOIN r{i} r ON e.src = r.x JOIN k ON e.src = k.src GROUP BY e.dst)")
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT x.x, (1 - 0.85) / n.n + 0.85 * (coalesce(f.f, 0) + d.d / n.n) AS r FROM r{i} x CROSS JOIN n CROSS JOIN d{i} d LEFT JOIN f{i} f ON x.x = f.dst)")
    return f"WITH {_E}, {', '.join(steps)}, {_settled()} SELECT x AS firm_id, round(r, 9) AS rank FROM settled"


def _settled() -> str:
    """The first round that moved less than the tolerance."""
    moved = " UNION ALL ".join(f"SELECT {i + 1} AS i, (SELECT sum(abs(a.r - b.r)) FROM r{i} a JOIN r{i + 1} b ON a.x = b.x) AS m" for i in range(UNROLLED))
    rounds = " UNION ALL ".join(f"SELECT {i + 1} AS i, x, r FROM r{i + 1}" for i in range(UNROLLED))
    return f"moved AS MATERIALIZED ({moved}), stop AS (SELECT min(i) AS i FROM moved WHERE m < {TOLERANCE!r} * (SELECT count(*) FROM nodes)), settled AS (SELECT z.x, z.r FROM ({rounds}) z JOIN stop ON z.i = stop.i)"


def _eigen_sql() -> str:
    steps = ["r0 AS (SELECT x, 1.0 / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for i in range(UNROLLED):
        steps.append(f"f{i} AS MATERIALIZED (SELECT x.x, x.r + coalesce(f.f, 0) AS r FROM r{i} x LEFT JOIN (SELECT e.dst, sum(y.r) AS f FROM e JOIN r{i} y ON e.src = y.x GROUP BY e.dst) f ON x.x = f.dst)")
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT x, r / (SELECT sqrt(sum(r * r)) FROM f{i}) AS r FROM f{i})")
    return f"WITH {_E}, {', '.join(steps)}, {_settled()} SELECT x AS firm_id, round(r, 9) AS score FROM settled"


def _exposure_sql() -> str:
    steps = ["r0 AS (SELECT src AS x, 0.0 AS r FROM p)"]
    for i in range(3):
        steps.append(f"r{i + 1} AS (SELECT p.src AS x, sum(p.p * (1 + coalesce(r.r, 0))) AS r FROM p LEFT JOIN (SELECT DISTINCT x, r FROM r{i}) r ON p.dst = r.x GROUP BY p.src)")
    return f"WITH {_P}, {', '.join(steps)} SELECT x AS firm_id, round(r, 9) AS exposure FROM r3"


def _reach_sql() -> str:
    steps = [
        "t AS (SELECT count(DISTINCT run_id) AS t FROM {struck})",
        "seen AS (SELECT firm_id, sum(seed) AS s, count(*) AS k FROM {struck} GROUP BY firm_id)",
        "n AS (SELECT z.x, coalesce(e.s, 0) / (1.0 * t.t) AS pi, CASE WHEN coalesce(e.s, 0) < t.t THEN (coalesce(e.k, 0) - coalesce(e.s, 0)) / (1.0 * (t.t - coalesce(e.s, 0))) END AS removed FROM (SELECT src AS x FROM p UNION SELECT dst FROM p) z CROSS JOIN t LEFT JOIN seen e ON z.x = e.firm_id)",
        "q0 AS (SELECT x, pi AS q FROM n)",
    ]
    for i in range(3):
        steps.append(f"q{i + 1} AS (SELECT n.x, 1 - (1 - n.pi) * exp(coalesce(l.l, 0)) AS q FROM n LEFT JOIN (SELECT p.dst, sum(ln(1 - q.q * p.p)) AS l FROM p JOIN q{i} q ON p.src = q.x GROUP BY p.dst) l ON n.x = l.dst)")
    return f"WITH {_P}, {', '.join(steps)} SELECT q3.x AS firm_id, round(q, 9) AS reach, round(n.removed, 9) AS removed FROM q3 JOIN n ON q3.x = n.x"


_PATHS = "paths AS (SELECT src AS s, dst AS x, [src, dst] AS path, 1 AS d FROM e UNION ALL SELECT p.s, e.dst, list_append(p.path, e.dst), p.d + 1 FROM paths p JOIN e ON p.x = e.src JOIN dist ON dist.s = p.s AND dist.x = e.dst AND dist.d = p.d + 1), count_of AS (SELECT s, x, count(*) AS n FROM paths GROUP BY s, x)"
_UNDIRECTED = "e AS (SELECT src, dst FROM {relations} WHERE src <> dst UNION SELECT dst, src FROM {relations} WHERE src <> dst), nodes AS (SELECT DISTINCT src AS x FROM e)"
#: Clustering of the largest component and of its null graphs (copy -1: the component itself), by rank joins and all wedges.
_CHANCE = """a AS (SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM {relations} WHERE src <> dst), b0 AS (SELECT src, dst FROM a UNION SELECT dst, src FROM a),
    lab AS (SELECT src AS s, src AS x FROM b0 UNION SELECT l.s, b0.dst FROM lab l JOIN b0 ON l.x = b0.src), comp AS MATERIALIZED (SELECT s, min(x) AS c FROM lab GROUP BY s), big AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1),
    nodes AS MATERIALIZED (SELECT comp.s AS x FROM comp JOIN big ON comp.c = big.c), e AS MATERIALIZED (SELECT a.src, a.dst FROM a JOIN nodes ON a.src = nodes.x), b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    tails AS (SELECT src, row_number() OVER (ORDER BY src, dst) AS k FROM e), cs AS (SELECT unnest(range(50)) AS copy),
    heads AS (SELECT copy, dst, row_number() OVER (PARTITION BY copy ORDER BY @u01(concat_ws('|', 'stub', copy, src, dst)), src, dst) AS k FROM e CROSS JOIN cs),
    ends AS (SELECT copy, src, row_number() OVER (PARTITION BY copy ORDER BY @u01(concat_ws('|', 'end', copy, src, dst)), src, dst) - 1 AS k FROM b CROSS JOIN cs WHERE copy < 30),
    dg AS (SELECT -1 AS copy, src, dst FROM e UNION ALL SELECT DISTINCT h.copy, t.src, h.dst FROM heads h JOIN tails t ON h.k = t.k WHERE t.src <> h.dst),
    ug AS (SELECT -1 AS copy, src, dst FROM b WHERE src < dst UNION ALL SELECT DISTINCT copy, u, v FROM (SELECT copy, k // 2 AS p, min(src) AS u, max(src) AS v FROM ends GROUP BY copy, k // 2) y WHERE u <> v),
    ds AS MATERIALIZED (SELECT copy, i, j, count(*) AS w FROM (SELECT copy, src AS i, dst AS j FROM dg UNION ALL SELECT copy, dst, src FROM dg) y GROUP BY copy, i, j),
    us AS MATERIALIZED (SELECT copy, src AS i, dst AS j FROM ug UNION ALL SELECT copy, dst, src FROM ug),
    dt AS (SELECT x.copy, x.i, sum(x.w * y.w * z.w) AS t FROM ds x JOIN ds y ON x.copy = y.copy AND x.j = y.i JOIN ds z ON y.copy = z.copy AND y.j = z.i AND z.j = x.i GROUP BY x.copy, x.i),
    dd AS (SELECT copy, i, sum(w) AS tot, sum(CASE WHEN w = 2 THEN 1 ELSE 0 END) AS mutual FROM ds GROUP BY copy, i),
    ut AS (SELECT x.copy, x.i, count(*) AS t FROM us x JOIN us y ON x.copy = y.copy AND x.j = y.i JOIN us z ON y.copy = z.copy AND y.j = z.i AND z.j = x.i GROUP BY x.copy, x.i), ud AS (SELECT copy, i, count(*) AS k FROM us GROUP BY copy, i),
    cl AS (SELECT 'directed' AS measure, d.copy, sum(CASE WHEN t.t > 0 THEN (t.t / 2.0) / (d.tot * (d.tot - 1) - 2 * d.mutual) ELSE 0.0 END) / (SELECT count(*) FROM nodes) AS x FROM dd d LEFT JOIN dt t ON d.copy = t.copy AND d.i = t.i GROUP BY d.copy
        UNION ALL SELECT 'undirected', d.copy, sum(CASE WHEN t.t > 0 THEN t.t / (1.0 * d.k * (d.k - 1)) ELSE 0.0 END) / (SELECT count(*) FROM nodes) FROM ud d LEFT JOIN ut t ON d.copy = t.copy AND d.i = t.i GROUP BY d.copy
        UNION ALL SELECT 'transitivity', d.copy, coalesce(sum(t.t), 0) / (1.0 * sum(d.k * (d.k - 1))) FROM ud d LEFT JOIN ut t ON d.copy = t.copy AND d.i = t.i GROUP BY d.copy),
    law AS (SELECT measure, avg(x) AS null_mean, stddev_pop(x) AS null_sd, count(*) AS copies FROM cl WHERE copy >= 0 GROUP BY measure),
    chance AS MATERIALIZED (SELECT l.measure, c.x AS observed, l.null_mean, l.null_sd, c.x / l.null_mean AS ratio, (c.x - l.null_mean) / l.null_sd AS z, l.copies FROM law l JOIN cl c ON l.measure = c.measure AND c.copy = -1)"""


def _core_sql(rounds: int = 40) -> str:
    """h-index rounds, more than any here takes."""
    steps = ["v0 AS MATERIALIZED (SELECT src AS x, count(*) AS v FROM e GROUP BY src)"]
    for i in range(rounds):
        steps.append(f"s{i} AS (SELECT e.src AS x, list_sort(list(v.v), 'DESC') AS l FROM e JOIN v{i} v ON e.dst = v.x GROUP BY e.src), v{i + 1} AS MATERIALIZED (SELECT x, len(list_filter(range(1, len(l) + 1), lambda k: l[k] >= k)) AS v FROM s{i})")
    return f"WITH {_UNDIRECTED}, {', '.join(steps)} SELECT x AS firm_id, CAST(v AS BIGINT) AS core FROM v{rounds}"


def _lengths_sql() -> str:
    """Distances from all nodes of the undirected largest component, level by level."""
    steps = ["k0 AS MATERIALIZED (SELECT s, s AS x, 0 AS d FROM comp JOIN big ON comp.c = big.c)"]
    for i in range(DEEP):
        steps.append(f"k{i + 1} AS MATERIALIZED (SELECT s, x, min(d) AS d FROM (SELECT s, x, d FROM k{i} UNION ALL SELECT k.s, e.dst, {i + 1} FROM k{i} k JOIN e ON k.x = e.src WHERE k.d = {i}) u GROUP BY s, x)")
    lab = "lab AS (SELECT src AS s, src AS x FROM e UNION SELECT l.s, e.dst FROM lab l JOIN e ON l.x = e.src), comp AS MATERIALIZED (SELECT s, min(x) AS c FROM lab GROUP BY s), big AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)"
    return f"WITH RECURSIVE {_UNDIRECTED}, {lab}, {', '.join(steps)} SELECT count(*) AS pairs, round(avg(d), 6) AS mean, quantile_cont(d, 0.5) AS median, round(stddev_pop(d), 6) AS sd FROM k{DEEP} WHERE d > 0"


ORACLES: dict[str, str] = {
    "G26_core_numbers": whole(_core_sql()),
    "G10_sampled_lengths": whole(_lengths_sql()),
    "G11_diameter": f"WITH RECURSIVE {_UNDIRECTED}, {_WALK}, {_DIST}, lab AS (SELECT s, least(min(x), s) AS c FROM dist GROUP BY s), big AS (SELECT c FROM lab GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT CAST(max(d.d) AS BIGINT) AS diameter FROM dist d JOIN lab l ON d.s = l.s JOIN big ON l.c = big.c",
    "G15_betweenness": f"WITH RECURSIVE {_E}, {_WALK}, {_DIST}, {_PATHS}, mid AS (SELECT p.path[i] AS v, 1.0 / c.n AS share FROM (SELECT s, x, path, unnest(range(2, len(path))) AS i FROM paths) p JOIN count_of c ON p.s = c.s AND p.x = c.x), t AS (SELECT v, sum(share) AS t FROM mid GROUP BY v), z AS (SELECT count(*) AS n FROM nodes) SELECT n.x AS firm_id, round(coalesce(t.t, 0) / ((z.n - 1.0) * (z.n - 2.0)), 9) AS betweenness FROM nodes n CROSS JOIN z LEFT JOIN t ON n.x = t.v",
    "G16_edge_betweenness": whole(f"WITH RECURSIVE {_E}, {_WALK}, {_DIST}, {_PATHS}, step AS (SELECT p.path[i] AS a, p.path[i + 1] AS b, 1.0 / c.n AS share FROM (SELECT s, x, path, unnest(range(1, len(path))) AS i FROM paths) p JOIN count_of c ON p.s = c.s AND p.x = c.x), t AS (SELECT a, b, sum(share) AS t FROM step GROUP BY a, b), z AS (SELECT count(*) AS n FROM nodes) SELECT e.src, e.dst, round(coalesce(t.t, 0) / (z.n * (z.n - 1.0)), 9) AS betweenness FROM e CROSS JOIN z LEFT JOIN t ON e.src = t.a AND e.dst = t.b"),
    "G20_clustering_null": whole(f"WITH RECURSIVE {_CHANCE} SELECT measure, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(ratio, 6) AS ratio, round(z, 6) AS z, copies FROM chance"),
    "G21_small_world": f"""WITH RECURSIVE {_CHANCE}, picked AS (SELECT x FROM nodes ORDER BY @u01(concat_ws('|', 'source', x)), x LIMIT 1000),
        walk AS (SELECT b.src AS s, b.dst AS x, 1 AS d FROM b JOIN picked p ON b.src = p.x UNION SELECT w.s, b.dst, w.d + 1 FROM walk w JOIN b ON w.x = b.src WHERE w.d < {DEEP}),
        dist AS (SELECT s, x, min(d) AS d FROM walk WHERE s <> x GROUP BY s, x), z AS (SELECT (SELECT count(*) FROM b) AS m, (SELECT count(*) FROM nodes) AS n, (SELECT avg(d) FROM dist) AS l),
        q AS (SELECT l, ln(n) / ln(m / (1.0 * n)) AS r FROM z)
        SELECT round(l, 6) AS l, round(r, 6) AS l_random, round(l / r, 6) AS ratio, round((SELECT ratio FROM chance WHERE measure = 'directed') / (l / r), 6) AS sigma_directed, round((SELECT ratio FROM chance WHERE measure = 'undirected') / (l / r), 6) AS sigma_undirected FROM q""",
    "G4_weak_components": f"WITH RECURSIVE {_E}, {_BOTH} SELECT s AS firm_id, c AS component FROM comp",
    "G5_strong_components": f"WITH RECURSIVE {_E}, {_WALK}, {_DIST}, {_MUTUAL} SELECT s AS firm_id, c AS component FROM scc",
    "G6_tiers": f"""WITH RECURSIVE {_E}, {_WALK}, {_DIST}, sinks AS (SELECT x FROM nodes ANTI JOIN e ON x = src)
        SELECT f.firm_id, CAST(CASE WHEN n.x IS NULL THEN -1 WHEN s.x IS NOT NULL THEN 0 ELSE t.d END AS BIGINT) AS tier FROM {{firms}} f LEFT JOIN nodes n ON f.firm_id = n.x LEFT JOIN sinks s ON f.firm_id = s.x
        LEFT JOIN (SELECT d.s, min(d.d) AS d FROM dist d JOIN sinks k ON d.x = k.x GROUP BY d.s) t ON f.firm_id = t.s""",
    "G7_median_tiers": f"""WITH RECURSIVE {_E}, {_WALK}, {_DIST}, sinks AS (SELECT x FROM nodes ANTI JOIN e ON x = src)
        SELECT f.firm_id, CAST(CASE WHEN n.x IS NULL THEN -1 WHEN s.x IS NOT NULL THEN 0 ELSE t.d END AS BIGINT) AS tier FROM {{firms}} f LEFT JOIN nodes n ON f.firm_id = n.x LEFT JOIN sinks s ON f.firm_id = s.x
        LEFT JOIN (SELECT d.s, floor(quantile_cont(d.d, 0.5)) AS d FROM dist d JOIN sinks k ON d.x = k.x GROUP BY d.s) t ON f.firm_id = t.s""",
    "G8_descendants": f"WITH RECURSIVE {_E}, {_WALK}, {_DIST} SELECT s AS firm_id, count(*) AS descendants FROM dist GROUP BY s",
    "G9_bow_tie": f"""WITH RECURSIVE {_E}, {_WALK}, {_DIST}, {_MUTUAL}, big AS (SELECT c FROM scc GROUP BY c ORDER BY count(*) DESC, c LIMIT 1), core AS (SELECT s AS x FROM scc SEMI JOIN big USING (c)),
        o AS (SELECT DISTINCT d.x FROM dist d JOIN core c ON d.s = c.x ANTI JOIN core k ON d.x = k.x), i AS (SELECT DISTINCT d.s AS x FROM dist d JOIN core c ON d.x = c.x ANTI JOIN core k ON d.s = k.x),
        fi AS (SELECT DISTINCT d.x FROM dist d JOIN i ON d.s = i.x), fo AS (SELECT DISTINCT d.s AS x FROM dist d JOIN o ON d.x = o.x)
        SELECT n.x AS firm_id, CASE WHEN n.x IN (SELECT x FROM core) THEN 'LSCC' WHEN n.x IN (SELECT x FROM i) THEN 'IN' WHEN n.x IN (SELECT x FROM o) THEN 'OUT' WHEN n.x IN (SELECT x FROM fi) AND n.x IN (SELECT x FROM fo) THEN 'TUBES'
            WHEN n.x IN (SELECT x FROM fi) THEN 'TENDRILS_IN' WHEN n.x IN (SELECT x FROM fo) THEN 'TENDRILS_OUT' ELSE 'DISCONNECTED' END AS part FROM nodes n""",
    "G10_path_lengths": whole(f"WITH RECURSIVE {_E}, {_WALK}, {_DIST} SELECT count(*) AS pairs, round(avg(d), 6) AS mean, quantile_cont(d, 0.5) AS median, round(stddev_pop(d), 6) AS sd FROM dist"),
    "G12_pagerank": _pagerank_sql(),
    "G13_eigenvector": _eigen_sql(),
    "G14_closeness": f"WITH RECURSIVE {_E}, {_WALK}, {_DIST}, t AS (SELECT x, count(*) AS r, sum(d) AS s FROM dist GROUP BY x) SELECT n.x AS firm_id, round(coalesce((t.r / (1.0 * t.s)) * (t.r / ((SELECT count(*) FROM nodes) - 1.0)), 0), 9) AS closeness FROM nodes n LEFT JOIN t ON n.x = t.x",
    "G20_configuration_model": """WITH e AS (SELECT DISTINCT src, dst FROM {relations} WHERE src <> dst), c AS (SELECT 0 AS copy UNION ALL SELECT 1 UNION ALL SELECT 2),
        t AS (SELECT copy, src, row_number() OVER (PARTITION BY copy ORDER BY src, dst) AS k FROM e CROSS JOIN c),
        h AS (SELECT copy, dst, row_number() OVER (PARTITION BY copy ORDER BY @u01(concat_ws('|', 'stub', copy, src, dst)), src, dst) AS k FROM e CROSS JOIN c)
        SELECT CAST(copy AS BIGINT) AS copy, count(*) AS edges FROM (SELECT DISTINCT t.copy, t.src, h.dst FROM t JOIN h ON t.copy = h.copy AND t.k = h.k WHERE t.src <> h.dst) x GROUP BY copy""",
    "G22_communities": "SELECT firm_id, community FROM {communities}",
    "G27_cyclicity": f"WITH RECURSIVE {_E}, {_WALK}, {_DIST}, {_MUTUAL}, z AS (SELECT c, count(*) AS n FROM scc GROUP BY c) SELECT count(*) AS components, CAST(sum(n) AS BIGINT) AS nodes, max(n) AS largest FROM z",
    "C26_depth": f"WITH RECURSIVE {_DEPTH} SELECT run_id, firm, depth FROM depths",
    "C27_depth_stats": f"WITH RECURSIVE {_DEPTH}, m AS (SELECT run_id, max(depth) AS d FROM depths GROUP BY run_id) SELECT r.num_seeds, round(avg(m.d), 6) AS mean, max(m.d) AS most, round(avg(CASE WHEN m.d >= 2 THEN 1.0 ELSE 0.0 END), 6) AS share_2 FROM m JOIN {{runs}} r ON m.run_id = r.run_id GROUP BY r.num_seeds",
    "C28_depth_sizes": f"WITH RECURSIVE {_DEPTH} SELECT CASE WHEN d.depth = 0 THEN 'seed' WHEN d.depth = 1 THEN '1' WHEN d.depth = 2 THEN '2' ELSE '3+' END AS bucket, count(*) AS n, round(avg(c.size), 6) AS mean, round(avg(CASE WHEN c.size >= 17 THEN 1.0 ELSE 0.0 END), 6) AS large FROM depths d JOIN {{cascade}} c ON d.run_id = c.run_id AND d.firm = c.firm GROUP BY 1",
    "C29_attribution": """WITH RECURSIVE valid AS (SELECT o.run_id, o.firm, o.origin, 1.0 / count(*) OVER (PARTITION BY o.run_id, o.firm) AS p FROM {origins} o JOIN {cascade} c ON o.run_id = c.run_id AND o.origin = c.firm),
        seeds AS (SELECT run_id, firm, count(*) OVER (PARTITION BY run_id) AS s FROM {cascade} WHERE is_seed), stuck AS (SELECT c.run_id, c.firm FROM {cascade} c ANTI JOIN valid v ON c.run_id = v.run_id AND c.firm = v.firm WHERE NOT c.is_seed),
        flow AS (SELECT run_id, firm, 1.0 AS m FROM {cascade} WHERE NOT is_seed UNION ALL SELECT f.run_id, v.origin, f.m * v.p FROM flow f JOIN valid v ON f.run_id = v.run_id AND f.firm = v.firm),
        held AS (SELECT f.run_id, f.firm, f.m FROM flow f JOIN seeds s ON f.run_id = s.run_id AND f.firm = s.firm UNION ALL SELECT s.run_id, s.firm, f.m / s.s FROM flow f JOIN stuck k ON f.run_id = k.run_id AND f.firm = k.firm JOIN seeds s ON f.run_id = s.run_id)
        SELECT run_id, firm, round(sum(m), 6) AS mass FROM held GROUP BY run_id, firm""",
    "C42_exposure": _exposure_sql(),
    "C44_reach": _reach_sql(),
    "J8_similarity_join": f"WITH {_SIMILAR} SELECT a, b, score FROM all_pairs WHERE score > 0.3",
    "C1_substitution_map": f"WITH {_SIMILAR} SELECT a, b, score FROM all_pairs WHERE score > 0.3",
    "C3_threshold_sweep": f"WITH {_SIMILAR} SELECT t.tau, count(*) AS pairs FROM all_pairs JOIN (SELECT 0.2 AS tau UNION ALL SELECT 0.25 UNION ALL SELECT 0.3 UNION ALL SELECT 0.35 UNION ALL SELECT 0.4) t ON score > t.tau GROUP BY t.tau",
    "T4_top_in_class": f"WITH {_SIMILAR} SELECT a, b, score FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM all_pairs WHERE a % 2 = 0 AND b % 2 = 1) x WHERE k = 1",
    "C2_top_edge_product": f"WITH {_SIMILAR} SELECT a, b, score FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM all_pairs WHERE a % 2 = 0 AND b % 2 = 1) x WHERE k = 1",
}
