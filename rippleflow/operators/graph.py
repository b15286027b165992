"""Graph operators on edge tables (src, dst): joins and aggregates, iterated where needed.

State frames are keyed by node or by (source, node), so every step is a shuffle on keys; nothing is gathered on the
driver but counts and sums. Frontiers shrink the join to new rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut, until_stable
from .searches import in_tasks


def plain(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    e = plain(edges)
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _fingerprint(df: DataFrame, *cols: str):
    return df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node): labels spread to neighbours, then jump to their label's label."""
    both = cut(undirected(edges))

    def step(state: DataFrame) -> DataFrame:
        near = both.join(state, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("component").alias("m"))
        new = state.join(near, F.col("node") == F.col("dst"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        new = cut(new)
        up = new.select(F.col("node").alias("n"), F.col("component").alias("c"))
        return new.join(up, F.col("component") == F.col("n")).select("node", F.col("c").alias("component"))

    return until_stable(nodes_of(both).select("node", F.col("node").alias("component")), step, lambda s: _fingerprint(s, "node", "component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """src, dst: the edges inside the weak component of most nodes (of equals, that of the least node)."""
    labels = cut(weak_components(edges))
    largest = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    core = cut(labels.join(largest, "component", "left_semi").select("node"))
    return plain(edges).join(core, F.col("src") == F.col("node"), "left_semi")


def distances(edges: DataFrame, sources: DataFrame | None = None, limit: int = 10**6) -> DataFrame:
    """source, node, d > 0: shortest path lengths from sources (a column node; all nodes if None)."""
    e = cut(edges.select("src", "dst"))
    start = nodes_of(e) if sources is None else sources.select("node")
    frontier = cut(start.join(e, F.col("node") == F.col("src")).select(F.col("node").alias("source"), F.col("dst").alias("node"), F.lit(1).alias("d")).where("source <> node").distinct())
    seen = frontier
    for d in range(2, limit + 1):
        if frontier.isEmpty():
            break
        ahead = frontier.join(e, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).where("source <> node").distinct()
        frontier = cut(ahead.join(seen, ["source", "node"], "left_anti").withColumn("d", F.lit(d)))
        seen = cut(seen.union(frontier)) if d % 4 == 0 else seen.union(frontier)
    return seen


def distance_counts(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, d > 0, n: from how many sources (a column node; all nodes if None) a node's shortest path has length d.

    What distances() gives, counted by node. Sources are searched in tasks that hold their components' links (`searches`), by
    bits: no row stands for a source and node, and nothing but links and counts is written.
    """
    e = cut(plain(edges))
    start = e.select(F.col("src").alias("node")).distinct()
    if sources is not None:
        start = start.join(sources.select("node").distinct(), "node", "left_semi")
    return in_tasks(e, cut(weak_components(e)), start, True)


def sampled_nodes(edges: DataFrame, uniform, k: int) -> DataFrame:
    """node: k nodes drawn evenly without replacement (all, if there are no more)."""
    return nodes_of(edges).orderBy(uniform([F.lit("source"), F.col("node")]), "node").limit(k)


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node: start's nodes and all that a path leads to."""
    e = cut(edges.select("src", "dst"))
    seen = frontier = cut(start.select("node").distinct())
    while not frontier.isEmpty():
        ahead = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(seen, "node", "left_anti"))
        seen = cut(seen.union(frontier))
    return seen


def tiers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, tier: least distance to a node without customers; -1 for isolates, null where no such node is reached."""
    e = plain(edges)
    linked = nodes_of(e)
    level = cut(linked.join(e, F.col("node") == F.col("src"), "left_anti").withColumn("tier", F.lit(0)))
    seen, k = level, 0
    while not level.isEmpty():
        k += 1
        up = level.join(e, F.col("node") == F.col("dst")).select(F.col("src").alias("node")).distinct()
        level = cut(up.join(seen, "node", "left_anti").withColumn("tier", F.lit(k)))
        seen = cut(seen.union(level))
    flagged = nodes.select("node").join(seen, "node", "left").join(linked.withColumn("linked", F.lit(True)), "node", "left")
    return flagged.select("node", F.when(F.col("linked").isNull(), -1).otherwise(F.col("tier")).alias("tier"))


def median_tiers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, tier: whole part of the median distance to the nodes without customers that it reaches, 0 for those."""
    e = plain(edges)
    sinks = nodes_of(e).join(e, F.col("node") == F.col("src"), "left_anti")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = distance_counts(back, sinks).union(sinks.select("node", F.lit(0), F.lit(1).cast("long")))
    level = found.groupBy("node").agg(F.floor(F.expr("percentile(d, 0.5, n)")).cast("int").alias("t"))
    linked = nodes_of(e).withColumn("linked", F.lit(True))
    return nodes.select("node").join(level, "node", "left").join(linked, "node", "left").select("node", F.when(F.col("linked").isNull(), -1).otherwise(F.col("t")).alias("tier"))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its greatest node): trim, colour forward, collect backward, repeat on what is left."""
    live, done = cut(plain(edges)), None
    rest = cut(nodes_of(edges))
    while True:
        while True:  # nodes without a way in or out are components of their own
            core = live.select(F.col("src").alias("node")).distinct().join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            single = rest.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))
            single = cut(single)
            if single.isEmpty():
                break
            done = single if done is None else cut(done.union(single))
            rest = cut(rest.join(single, "node", "left_anti"))
            live = cut(live.join(rest, F.col("src") == F.col("node"), "left_semi").join(rest, F.col("dst") == F.col("node"), "left_semi"))
        if rest.isEmpty():
            return done if done is not None else rest.select("node", F.col("node").alias("component"))

        def forward(state: DataFrame, live=live) -> DataFrame:
            best = live.join(state, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("m"))
            return state.join(best, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", F.coalesce("m", "colour")).alias("colour"))

        colour = until_stable(rest.select("node", F.col("node").alias("colour")), forward, lambda s: _fingerprint(s, "node", "colour"))
        c = lambda x: colour.select(F.col("node").alias(x), F.col("colour").alias(f"c{x}"))
        same = cut(live.join(c("src"), "src").join(c("dst"), "dst").where("csrc = cdst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = reachable(same, colour.where("node = colour"))
        found = cut(found.join(colour, "node").select("node", F.col("colour").alias("component")))
        done = found if done is None else cut(done.union(found))
        rest = cut(rest.join(found, "node", "left_anti"))
        live = cut(live.join(rest, F.col("src") == F.col("node"), "left_semi").join(rest, F.col("dst") == F.col("node"), "left_semi"))


def bow_tie(edges: DataFrame) -> DataFrame:
    """node, part: LSCC, IN, OUT, TUBES, TENDRILS_IN, TENDRILS_OUT or DISCONNECTED, in this precedence."""
    e = cut(plain(edges))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    scc = cut(strong_components(e))
    size = scc.groupBy("component").agg(F.count("*").alias("n"))
    largest = size.orderBy(F.desc("n"), "component").limit(1)
    core = cut(scc.join(largest, "component", "left_semi").select("node"))
    down, up = reachable(e, core), reachable(back, core)
    out, into = cut(down.join(core, "node", "left_anti")), cut(up.join(core, "node", "left_anti"))
    from_in, to_out = reachable(e, into), reachable(back, out)
    flag = lambda df, name: df.select("node", F.lit(True).alias(name))
    all_ = nodes_of(e)
    for df, name in ((core, "c"), (into, "i"), (out, "o"), (from_in, "fi"), (to_out, "to")):
        all_ = all_.join(flag(df, name), "node", "left")
    part = F.when(F.col("c"), "LSCC").when(F.col("i"), "IN").when(F.col("o"), "OUT").when(F.col("fi") & F.col("to"), "TUBES").when(F.col("fi"), "TENDRILS_IN").when(F.col("to"), "TENDRILS_OUT").otherwise("DISCONNECTED")
    return all_.select("node", part.alias("part"))


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, rank: dangling mass spread evenly; stops when the total change is below tolerance x nodes."""
    e, all_ = cut(plain(edges)), cut(nodes.select("node"))
    n = all_.count()
    degree = e.groupBy("src").agg(F.count("*").alias("k"))
    out = cut(e.join(degree, "src"))
    sinks = cut(all_.join(degree, F.col("node") == F.col("src"), "left_anti"))
    rank = cut(all_.withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(rounds):
        loose = rank.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = out.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("k")).alias("f"))
        new = cut(rank.join(flow, F.col("node") == F.col("dst"), "left").select("node", ((1 - damping) / n + damping * (F.coalesce("f", F.lit(0.0)) + loose / n)).alias("rank"), F.col("rank").alias("old")))
        moved = new.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0))).first()[0]
        rank = new.select("node", "rank")
        if moved < tolerance * n:
            break
    return rank


def eigenvector(edges: DataFrame, nodes: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, score: power iteration on in-edges plus the identity, of unit length."""
    e, all_ = cut(plain(edges)), nodes.select("node")
    n = max(all_.count(), 1)
    x = cut(all_.withColumn("score", F.lit(1.0 / n)))
    for _ in range(rounds):
        flow = e.join(x, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum("score").alias("f"))
        raw = cut(x.join(flow, F.col("node") == F.col("dst"), "left").select("node", (F.col("score") + F.coalesce("f", F.lit(0.0))).alias("raw"), "score"))
        norm = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw")))).first()[0] or 1.0
        moved = raw.agg(F.sum(F.abs(F.col("raw") / norm - F.col("score")))).first()[0] or 0.0
        x = raw.select("node", (F.col("raw") / norm).alias("score"))
        if moved < tolerance * n:
            break
    return x


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, closeness: from the lengths of paths that lead to it, scaled by the share of nodes that have one."""
    n = nodes.count()
    found = distance_counts(edges).groupBy("node").agg(F.sum("n").alias("r"), F.sum(F.col("d") * F.col("n")).alias("s"))
    value = F.when(F.col("s") > 0, (F.col("r") / F.col("s")) * (F.col("r") / (n - 1))).otherwise(0.0)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def _path_counts(e: DataFrame, sources: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """Breadth-first layers (source, node, d, paths) of all sources."""
    start = nodes_of(e) if sources is None else sources
    layers = [cut(start.select(F.col("node").alias("source"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths")))]
    seen = layers[0].select("source", "node")
    while True:
        ahead = layers[-1].join(e, F.col("node") == F.col("src")).groupBy("source", "dst").agg(F.sum("paths").alias("paths"))
        new = cut(ahead.withColumnRenamed("dst", "node").join(seen, ["source", "node"], "left_anti").select("source", "node", F.lit(len(layers)).alias("d"), "paths"))
        if new.isEmpty():
            return seen, layers
        layers.append(new)
        seen = cut(seen.union(new.select("source", "node")))


def _dependencies(edges: DataFrame, sources: DataFrame | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per layer (source, node, delta), and per layer the shares of its edges (source, src, dst, share)."""
    e = cut(plain(edges))
    _, layers = _path_counts(e, sources)
    below = layers[-1].select("source", "node", "paths", F.lit(0.0).alias("delta"))
    deltas, shares = [below.select("source", "node", "delta")], []
    for layer in reversed(layers[:-1]):
        w = below.select("source", F.col("node").alias("dst"), F.col("paths").alias("pw"), "delta")
        v = layer.select("source", F.col("node").alias("src"), F.col("paths").alias("pv"))
        share = cut(v.join(e, "src").join(w, ["source", "dst"]).select("source", "src", "dst", (F.col("pv") / F.col("pw") * (1 + F.col("delta"))).alias("share")))
        shares.append(share)
        total = share.groupBy("source", F.col("src").alias("node")).agg(F.sum("share").alias("t"))
        below = cut(layer.join(total, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("t", F.lit(0.0)).alias("delta")))
        deltas.append(below.select("source", "node", "delta"))
    return deltas, shares


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def betweenness(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, betweenness: shares of shortest paths through it, over (n - 1)(n - 2); of a sample of sources if given."""
    n = nodes.count()
    deltas, _ = _dependencies(edges, sources)
    total = _union(deltas).where("source <> node").groupBy("node").agg(F.sum("delta").alias("t"))
    return nodes.select("node").join(total, "node", "left").select("node", (F.coalesce("t", F.lit(0.0)) / max(1, (n - 1) * (n - 2))).alias("betweenness"))


def edge_betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, betweenness over n (n - 1)."""
    n = nodes.count()
    _, shares = _dependencies(edges, None)
    total = _union(shares).groupBy("src", "dst").agg(F.sum("share").alias("t"))
    return plain(edges).join(total, ["src", "dst"], "left").select("src", "dst", (F.coalesce("t", F.lit(0.0)) / max(1, n * (n - 1))).alias("betweenness"))


def core_numbers(edges: DataFrame, limit: int = 10**6) -> DataFrame:
    """node, core: every node takes the h-index of its partners' values, from degrees down, until none changes.

    h is the greatest v with v partners of v or more; partners' values above a node's own count as its own, so a hub's
    partners are counted by value before they meet. Components that are trees have 1 and are set aside first, so a long
    chain costs no rounds; a path that hangs on a denser part still takes about a round a node.
    """
    both = cut(undirected(edges))
    degree = cut(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("v")))
    part = cut(weak_components(both).join(degree, "node"))
    size = part.groupBy("component").agg(F.count("*").alias("n"), F.sum("v").alias("ends"))
    trees = size.where("ends = 2 * (n - 1)").select("component")
    easy = cut(part.join(trees, "component", "left_semi").select("node", F.lit(1).cast("long").alias("core")))
    state = cut(part.join(trees, "component", "left_anti").select("node", "v"))
    links = cut(both.join(state.select(F.col("node").alias("src")), "src", "left_semi"))
    for _ in range(limit):
        seen = links.join(state.select(F.col("node").alias("dst"), F.col("v").alias("theirs")), "dst").join(state.select(F.col("node").alias("src"), "v"), "src")
        counts = seen.groupBy(F.col("src").alias("node"), F.least("theirs", "v").alias("x")).agg(F.count("*").alias("c"))
        above = F.sum("c").over(Window.partitionBy("node").orderBy(F.desc("x")))
        h = counts.withColumn("above", above).groupBy("node").agg(F.max(F.least("x", "above")).alias("h"))
        state = cut(state.join(h, "node").select("node", F.col("h").alias("v"), (F.col("h") < F.col("v")).alias("fell")))
        if state.where("fell").isEmpty():
            break
        state = state.select("node", "v")
    return easy.union(state.select("node", F.col("v").alias("core")))


def communities(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """node, community: greedy modularity moves, even and odd hashes in turn, then labels as their least member.

    A node joins the neighbouring community of the largest gain if that beats staying; half of the nodes move at
    a time, so that neighbours don't swap for ever. Deterministic, of local-moving (first-level) quality.
    """
    e = cut(undirected(edges))
    degree = cut(e.groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("k")))
    m2 = float(e.count() or 1)
    state = cut(degree.select("node", "k", F.col("node").alias("c")))
    for turn in range(rounds):
        total = state.groupBy("c").agg(F.sum("k").alias("tot"))
        links = e.join(state.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.count("*").alias("w"))
        here = state.select("node", F.col("k").alias("kn"), F.col("c").alias("own"))
        gain = here.join(links.union(here.select("node", F.col("own").alias("c"), F.lit(0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w")), "node").join(total, "c")
        value = F.col("w") - F.col("kn") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("kn")).otherwise(0.0)) / m2
        best = gain.groupBy("node").agg(F.max(F.struct(value.alias("g"), (F.col("c") == F.col("own")).alias("stay"), (-F.col("c")).alias("n"), F.col("c").alias("to"))).alias("b"))
        free = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        state = cut(state.join(best, "node").select("node", "k", F.when(free, F.col("b.to")).otherwise(F.col("c")).alias("c")))
    low = state.groupBy("c").agg(F.min("node").alias("community"))
    return state.join(low, "c").select("node", "community")


def modularity(edges: DataFrame, membership: DataFrame) -> float:
    """Of membership (node, community) on the undirected graph."""
    e = cut(undirected(edges))
    m2 = e.count() or 1
    c = lambda x: membership.select(F.col("node").alias(x), F.col("community").alias(f"c_{x}"))
    inside = e.join(c("src"), "src").join(c("dst"), "dst").where("c_src = c_dst").count()
    squares = e.join(c("src"), "src").groupBy("c_src").agg(F.count("*").alias("k")).agg(F.sum((F.col("k") / m2) ** 2)).first()[0]
    return inside / m2 - (squares or 0.0)
