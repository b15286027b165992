"""Network scenarios: product imputation, budgets, capacities, as Column expressions over counter-based numbers.

Every draw depends on the scenario's seed and the row's keys only, so scenarios are reproducible for any
partitioning and all scenarios of a batch are one plan, keyed by seed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import normal_cdf, normal_quantile, race, truncated_normal, u01
from ..operators.iterate import cut
from ..operators.order import numbered


@dataclass(frozen=True)
class Utilisation:
    """Capacity by utilisation: outbound volume x (1 - u)."""

    mu: float = 0.75
    sigma: float = 0.1


def _draw(seed: Column, purpose: str, *keys: Column) -> Column:
    return u01([seed, F.lit(purpose), *keys])


def kde_resample(values: DataFrame, targets: DataFrame, value: str, keys: list[str], seed: Column, purpose: str) -> DataFrame:
    """targets with x: a value of the sample drawn evenly, plus a normal step of Scott's bandwidth."""
    stats = values.agg(F.count("*").alias("n"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    ranked = numbered(values.select(F.col(value).alias("v")), ["v"], "i")
    at = F.floor(_draw(seed, purpose, *map(F.col, keys)) * F.col("n"))
    step = normal_quantile(_draw(seed, purpose + "-step", *map(F.col, keys)))
    drawn = targets.crossJoin(F.broadcast(stats)).withColumn("i", at).join(ranked, "i", "left")  # stats is one row
    return drawn.withColumn("x", F.coalesce("v", F.lit(0.0)) + step * F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))).drop("v", "i", "n", "sd")


def count_law(values: DataFrame, value: str) -> DataFrame:
    """law: one row, the cumulated law of a rounded kernel density at 0, 1, 2, ... (share below m + 1/2), and most, its last m.

    The density is the values' (whole numbers) mixture of normals of Scott's bandwidth. It is a sum over distinct values, up
    to where nothing is left above, nine bandwidths over the greatest value.
    """
    counts = values.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    stats = values.agg(F.count("*").alias("n"), (F.coalesce(F.stddev_samp(value), F.lit(0.0)) * F.pow(F.count("*"), F.lit(-0.2))).alias("h"), F.max(value).cast("double").alias("top"))  # one row
    grid = counts.crossJoin(F.broadcast(stats)).withColumn("m", F.explode(F.sequence(F.lit(0), F.ceil(F.col("top") + 9 * F.col("h")).cast("int"))))
    step = F.col("m") + 0.5 - F.col("v")
    part = F.when(F.col("h") > 0, normal_cdf(step / F.col("h"))).otherwise((step >= 0).cast("double"))
    shares = grid.groupBy("m").agg((F.sum(F.col("c") * part) / F.max("n")).alias("g"))
    return shares.agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "g"))), lambda x: x["g"]).alias("law"))


def draw_within(law: Column, u: Column, most: Column) -> Column:
    """A whole number from 1 to most by the law, given that it lies there: the inverse of the law between its bounds.

    That is what drawing anew until the number fits would give, in one step. Where the law has nothing within the bounds,
    the number is the bound that is nearer to the law; without a law (no counts) it is 1.
    """
    top = F.least(most.cast("int"), F.size(law) - 1)
    low, high = law[0], F.element_at(law, top + 1)
    below = F.size(F.filter(F.slice(law, 2, F.greatest(top, F.lit(0))), lambda g: g < low + u * (high - low)))
    return F.when(F.coalesce(F.size(law), F.lit(0)) < 1, F.lit(1)).when(high > low, F.least(below + 1, most)).when(low >= 1, F.lit(1)).otherwise(most).cast("long")


def amount_laws(edge_products: DataFrame) -> DataFrame:
    """product, parts: its amounts v with bandwidth h, and shares cumulated with a, each normal's part below 1/2."""
    stats = edge_products.groupBy("product").agg((F.coalesce(F.stddev_samp("amount"), F.lit(0.0)) * F.pow(F.count("*"), F.lit(-0.2))).alias("h"))
    each = edge_products.groupBy("product", F.col("amount").cast("double").alias("v")).agg(F.count("*").alias("c")).join(stats, "product")
    a = F.when(F.col("h") > 0, normal_cdf((0.5 - F.col("v")) / F.col("h"))).otherwise(F.lit(0.0))
    each = each.withColumn("a", a).withColumn("up", F.sum(F.col("c") * (1 - F.col("a"))).over(Window.partitionBy("product").orderBy("v")))
    return each.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("up", "v", "h", "a"))).alias("parts"))


def draw_amount(parts: Column, pick: Column, u: Column) -> Column:
    """A rounded draw from the kernel density, given that it is 1 or more: a component, then its normal above 1/2; 1 without parts."""
    want = pick * F.element_at(parts, -1)["up"]
    part = F.coalesce(F.filter(parts, lambda p: p["up"] >= want)[0], F.element_at(parts, -1))
    value = F.transform(F.array(part), lambda p: F.when(p["h"] > 0, p["v"] + p["h"] * normal_quantile(p["a"] + u * (1 - p["a"]))).otherwise(p["v"]))[0]
    return F.when(parts.isNull(), F.lit(1)).otherwise(F.greatest(F.bround(value), F.lit(1.0))).cast("long")


def sample_edge_products(relations: DataFrame, capabilities: DataFrame, edge_products: DataFrame, pools: DataFrame, seed: str, gamma: float = 0.0) -> DataFrame:
    """src, dst, product, amount of every edge: observed for annotated ones, imputed for the others.

    The number of products is a resampled detail count, given that it lies in [1, portfolio size]; products are a weighted
    sample of the supplier's portfolio, with weights (pool + 1)^gamma; amounts are resampled per product, given that they
    are 1 or more (1 for products that no annotated edge has).
    """
    s = F.lit(seed)
    offers = capabilities.withColumnRenamed("firm_id", "src").join(pools, "product", "left")
    portfolio = offers.groupBy("src").agg(F.collect_list(F.struct("product", F.pow(F.coalesce("pool", F.lit(0)) + 1.0, F.lit(gamma)).alias("weight"))).alias("offers"))
    counts = edge_products.groupBy("src", "dst").agg(F.sum("amount").alias("n")).select("n")
    # The number of partitions is given: links are small until their suppliers' portfolios are raced, so sizes say nothing of the work.
    wide = max(int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * relations.sparkSession.sparkContext.defaultParallelism)
    open_ = relations.where("not annotated").select("src", "dst").repartition(wide, "src").hint("merge").join(portfolio, "src").crossJoin(F.broadcast(cut(count_law(counts, "n"))))  # one row
    k = draw_within(F.col("law"), _draw(s, "number", F.col("src"), F.col("dst")), F.size("offers"))
    arrival = F.transform("offers", lambda x: F.struct(race(_draw(s, "product", F.col("src"), F.col("dst"), x["product"]), x["weight"]).alias("t"), x["product"].alias("product")))
    chosen = open_.select("src", "dst", F.explode(F.slice(F.array_sort(arrival), 1, k.cast("int"))).alias("x")).select("src", "dst", F.col("x.product").alias("product"))
    keys = [F.col("src"), F.col("dst"), F.col("product")]
    amount = draw_amount(F.col("parts"), _draw(s, "part", *keys), _draw(s, "amount", *keys))
    imputed = chosen.join(amount_laws(edge_products), "product", "left").select("src", "dst", "product", amount.alias("amount"))
    return edge_products.select("src", "dst", "product", F.col("amount").cast("long").alias("amount")).unionByName(imputed)


def budgets(edges: DataFrame, tier: DataFrame, seed: str) -> DataFrame:
    """src, dst, max_trials: whole weeks of stock, by the tiers of both ends (at most 1, or more; isolates none)."""
    s = F.lit(seed)

    def stock(side: str, node: str) -> Column:
        u = _draw(s, side, F.col(node))
        near, far = truncated_normal(u, 12 / 7, 5 / 7, 0.0, 1e6), truncated_normal(u, 35 / 7, 5 / 7, 0.0, 1e6)
        t = F.col(f"{side}_tier")
        return F.when(t == -1, F.lit(0.0)).when(t <= 1, near).otherwise(far)

    of = lambda side, node: tier.select(F.col("firm_id").alias(node), F.col("tier").alias(f"{side}_tier"))
    both = edges.select("src", "dst").distinct().join(of("out", "src"), "src", "left").join(of("in", "dst"), "dst", "left")
    return both.select("src", "dst", F.floor(stock("in", "dst") + stock("out", "src")).cast("long").alias("max_trials"))


def node_scenario(degrees: DataFrame, seed: str, k_sigma: float = 0.5, capacity: Utilisation = Utilisation(), customerless: int | None = None) -> DataFrame:
    """firm_id, size, k, cap: degree (1 for isolates), preference for partners, free capacity."""
    s = F.lit(seed)
    k = truncated_normal(_draw(s, "k", F.col("firm_id")), 1.5, k_sigma, 1.0, 10_000.0)
    u = truncated_normal(_draw(s, "use", F.col("firm_id")), capacity.mu, capacity.sigma, 0.0, 1.0)
    volume = F.when(F.col("degree") == 0, F.lit(1.0)).otherwise(F.col("out_weight").cast("double"))
    cap = F.bround(volume * (1 - u)).cast("long")
    if customerless is not None:
        cap = F.when(F.col("out_degree") == 0, F.lit(customerless)).otherwise(cap)
    return degrees.select("firm_id", F.greatest("degree", F.lit(1)).cast("long").alias("size"), k.alias("k"), cap.alias("cap"))


def thirds(degrees: DataFrame, seed: str, mu: tuple = (2.0, 4.0, 6.0), sigma: tuple = (0.5, 1.0, 2.0)) -> DataFrame:
    """firm_id, cap: firms by size in three equal groups, each with its own truncated normal."""
    s, size = F.lit(seed), degrees.agg(F.count("*").alias("n"))  # one row
    short, over = F.floor(F.col("n") / 3), F.pmod("n", F.lit(3))  # the first thirds have a firm more where three don't divide
    long = (short + 1) * over
    third = 1 + F.when(F.col("i") < long, F.floor(F.col("i") / (short + 1))).otherwise(over + F.floor((F.col("i") - long) / F.greatest(short, F.lit(1))))
    placed = numbered(degrees, ["degree", "firm_id"], "i").crossJoin(F.broadcast(size))
    u = _draw(s, "third", F.col("firm_id"))
    drawn = [truncated_normal(u, m, d, 0.0, 1e6) for m, d in zip(mu, sigma, strict=True)]
    cap = F.bround(F.when(F.col("third") == 1, drawn[0]).when(F.col("third") == 2, drawn[1]).otherwise(drawn[2])).cast("long")
    return placed.withColumn("third", third).select("firm_id", F.col("third").cast("long").alias("third"), cap.alias("cap"))
